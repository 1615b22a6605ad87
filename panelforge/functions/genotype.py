"""Column functions on genotype calls, call-file fields and strands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the call formats.
CALLS = ("0/0", "0/1", "1/1")
NO_CALL, NOT_ASSAYED = "./.", "."
ASSAY_ABBREVIATIONS = {
    "affy": "A",
    "illumina": "I",
    "affy1KG": "A1",
    "illumina1KG": "I1",
    "broad": "B",
    "metabo": "M",
    "exome": "E",
    "bigtest": "T",
    "biggertest": "G",
}


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# --- fields of a call file ---------------------------------------------------------------------------------------------


def format_index(fmt: Column, name: str) -> Column:
    """0-based place of ``name`` in a colon-separated FORMAT, -9 where it is absent."""
    at = F.array_position(F.split(fmt, ":"), name).cast("int")
    return F.when(at > 0, at - 1).otherwise(-9)


def has_format(fmt: Column, name: str) -> Column:
    return F.array_contains(F.split(fmt, ":"), name)


def geno_field(geno: Column, index: Column) -> Column:
    """Field ``index`` (0-based) of a genotype string; null where it has none."""
    return F.when(index >= 0, F.get(F.split(geno, ":"), index))


def probabilities(geno: Column, gp_index: Column) -> Column:
    """The probabilities of a genotype string; unreadable ones are 0, a string without the field has none."""
    return F.transform(F.split(geno_field(geno, gp_index), ","), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def info_map(info: Column) -> Column:
    """INFO as a map; flags and items with more than one ``=`` are left out, of a repeated key the last counts."""
    items = F.filter(F.split(info, ";"), lambda x: x.rlike("^[^=]+=[^=]*$"))
    pairs = F.transform(items, lambda x: F.struct(F.element_at(F.split(x, "="), 1).alias("k"), F.element_at(F.split(x, "="), 2).alias("v")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def info_number(info: Column, key: str, default: float) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(F.filter(F.split(info, ";"), lambda x: x.startswith(key + "=")), lambda x: F.substring_index(x, "=", -1).try_cast("double")), lambda v: v.isNotNull()), F.lit(0)), F.lit(default))


def info_score(info: Column) -> Column:
    return info_number(info, "INFO", 1.0)


def reference_panel_af(info: Column) -> Column:
    return info_number(info, "RefPanelAF", 0.0)


def padded_chromosome(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def bare_chromosome(c: Column) -> Column:
    return F.regexp_replace(c, "^0", "")


def first_id(c: Column) -> Column:
    """The first part of a comma-separated id."""
    return F.substring_index(c, ",", 1)


def shown_allele(c: Column, width: int = 10) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit(" ..."))).otherwise(c)


def assay_tag(c: Column) -> Column:
    """Abbreviation of a panel; null where there is none."""
    return lit_map(ASSAY_ABBREVIATIONS)[c]


def assay_of_tag(c: Column) -> Column:
    return lit_map({v: k for k, v in ASSAY_ABBREVIATIONS.items()})[c]


# --- calls -------------------------------------------------------------------------------------------------------------


def top_probability(probs: Column) -> Column:
    """The greatest probability, 0 where there is none."""
    return F.coalesce(F.array_max(probs), F.lit(0.0))


def top_index(probs: Column) -> Column:
    """0-based place of the first greatest probability, -9 where none is above 0."""
    return F.when(top_probability(probs) > 0, F.array_position(probs, F.array_max(probs)).cast("int") - 1).otherwise(-9)


def call(probs: Column, threshold: float = 0.9) -> Column:
    """The call of the greatest probability; no call below the threshold (0 disables it) or where all are 0."""
    p = top_probability(probs)
    return F.when((p < threshold) | (p <= 0), NO_CALL).otherwise(F.coalesce(F.get(F.array(*[F.lit(c) for c in CALLS]), top_index(probs)), F.lit(NO_CALL)))


def call_number(gt: Column) -> Column:
    """0, 1, 2, -9 for no call, null for not assayed."""
    return F.when(gt == NOT_ASSAYED, None).otherwise(F.coalesce(lit_map({c: i for i, c in enumerate(CALLS)})[gt], F.lit(-9)))


def dosage(gt: Column) -> Column:
    """Copies of the alternative allele: het 1, homozygous 2, anything else 0."""
    return F.when(gt == CALLS[1], 1).when(gt == CALLS[2], 2).otherwise(0)


def flipped(number: Column) -> Column:
    """0 and 2 exchanged, others as they are."""
    return F.when(number == 0, 2).when(number == 2, 0).otherwise(number)


def flipped_probabilities(probs: Column) -> Column:
    return F.reverse(probs)


def effect_dosage(gt: Column, alt: Column, effect: Column) -> Column:
    """Copies of the effect allele, which is the alternative or else the reference allele."""
    return F.when(alt == effect, dosage(gt)).otherwise(2 - dosage(gt))


# --- strands -----------------------------------------------------------------------------------------------------------


def complement(allele: Column) -> Column:
    return F.translate(allele, "ACGT", "TGCA")


def is_palindromic(ref: Column, alt: Column) -> Column:
    return alt == complement(ref)


def alleles_compatible(effect: Column, ref: Column, alt: Column) -> Column:
    """Whether the effect allele is one of the two alleles on either strand."""
    return effect.isin(ref, alt) | complement(effect).isin(ref, alt)


def should_flip(weight_allele: Column, weight_freq: Column, local_risk: Column, local_other: Column, local_freq: Column) -> Column:
    """Whether the weight is for the other allele than the local risk allele.

    Equal alleles: no.  Complementary alleles: no if the site is not palindromic, or if it is and both frequencies lie on
    one side of a half.  Otherwise yes.
    """
    same_side = ((weight_freq < 0.5) & (local_freq < 0.5)) | ((weight_freq > 0.5) & (local_freq > 0.5))
    other_strand = weight_allele == complement(local_risk)
    return F.when(weight_allele == local_risk, False).when(other_strand & ~is_palindromic(local_risk, local_other), False).when(other_strand & same_side, False).otherwise(True)


# --- statistics --------------------------------------------------------------------------------------------------------


def log_factorial(n: Column) -> Column:
    """ln n!, exact to about 1e-13 of its size: a table below 16, Stirling's series above."""
    x = n.cast("double")
    table = F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(16)])
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < 16, F.get(table, n.cast("int"))).otherwise(series)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hardy_weinberg(het: Column, hom_a: Column, hom_b: Column) -> Column:
    """P value of the exact test of Wigginton and others (2005); null where there is no genotype.

    The weights of all heterozygote counts with the parity of the rare allele are taken from log factorials, relative to
    the greatest; the p value is the share of those not above the observed one.
    """
    n, rare = het + hom_a + hom_b, 2 * F.least(hom_a, hom_b) + het

    def weight(h: Column) -> Column:
        r = ((rare - h) / 2).cast("long")
        return h * math.log(2.0) - log_factorial(h) - log_factorial(r) - log_factorial(n - h - r)

    add = lambda acc, x: acc + x

    def share(w: Column) -> Column:
        return let(F.array_max(w), lambda top: let(F.exp(weight(het) - top) * (1 + 1e-9), lambda seen: let(F.transform(w, lambda x: F.exp(x - top)), lambda rel: F.aggregate(F.filter(rel, lambda x: x <= seen), F.lit(0.0), add) / F.aggregate(rel, F.lit(0.0), add))))

    p = let(F.transform(F.sequence(F.pmod(rare, F.lit(2)), rare, F.lit(2)), weight), share)
    return F.when(n > 0, F.least(F.lit(1.0), p))


def chi_square_2df(x: Column) -> Column:
    """P value of a chi-square statistic with two degrees of freedom."""
    return F.exp(-x / 2)
