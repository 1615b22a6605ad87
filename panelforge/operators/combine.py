"""Combining the records of a variant on several panels into one record over the union of samples.

``merge.py`` combines whole records, one shuffle per variant; it is what the registered queries use.  ``cells`` does the same
in long form, for genotypes that come as rows and are few (one shuffle on variant and sample).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions import genotype as G
from panelforge.operators import merge
from panelforge.operators.metrics import chi_square_concordance, with_calls
from panelforge.session import broadcast_if_small, cut

#: Panels of one cohort; their names are held by the driver.
MAX_PANELS = 1_000
#: ``pairwise`` (a running best, replaced by a strictly greater probability) is another name of ``argmax``.
POLICIES = ("argmax", "fold", "callrate", "pairwise")


def assay_order(assays: list[str]) -> Column:
    """Place of a panel in ``assays``; others come after, by name."""
    return F.coalesce(G.lit_map({a: i for i, a in enumerate(assays)})[F.col("assaytype")], F.lit(len(assays)))


def requested(long: DataFrame, requests: DataFrame, key: str = "rsid") -> DataFrame:
    """The rows of the requested ids, with the ordinal of the request (a repeated request keeps its first)."""
    once = requests.groupBy(key).agg(F.min("req_ord").alias("req_ord"))
    return long.join(broadcast_if_small(once), key)


def not_found(requests: DataFrame, catalogue: DataFrame, key: str = "rsid") -> DataFrame:
    return requests.join(catalogue.select(key).distinct(), key, "left_anti")


def first_alleles(long: DataFrame, key: str = "rsid") -> DataFrame:
    """(key, _first): the alleles of the first panel (by ``assay_ord``) that has the variant; one row per variant."""
    return cut(long.select(key, "assay_ord", "ref", "alt").distinct().groupBy(key).agg(F.min_by(F.struct("ref", "alt"), F.struct("assay_ord", "ref", "alt")).alias("_first")))


def with_agreement(long: DataFrame, key: str = "rsid", first: DataFrame | None = None) -> DataFrame:
    """Adds ``accepted``: whether the record's alleles are those of the first panel that has the variant."""
    rows = long.join(broadcast_if_small(first if first is not None else first_alleles(long, key)), key)
    return rows.withColumn("accepted", (F.col("ref") == F.col("_first.ref")) & (F.col("alt") == F.col("_first.alt"))).drop("_first")


def rejected_records(long: DataFrame, key: str = "rsid") -> DataFrame:
    """(key, assaytype, ref, alt) of records whose alleles differ from those of the first panel."""
    return with_agreement(long, key).where(~F.col("accepted")).select(key, "assaytype", "ref", "alt").distinct()


def _fold(cell: Column) -> Column:
    """The winner of a cell's genotypes in panel order, kept in a running state: an equal call changes nothing; at equal
    probability the higher info score takes over; otherwise the higher probability does."""
    start = F.struct(F.lit("").alias("gt"), F.lit(0.0).alias("p"), F.lit(0.0).alias("info"), F.lit(-1).alias("at"), F.lit(0).alias("same"), F.lit(0).alias("diff"))

    def step(s: Column, e: Column) -> Column:
        other, equal = e["gt"] != s["gt"], e["p"] == s["p"]
        wins = other & ((equal & (e["info"] > s["info"])) | (~equal & (e["p"] > s["p"])))
        take = lambda f: F.when(wins, e[f]).otherwise(s[f]).alias(f)
        return F.struct(take("gt"), take("p"), take("info"), F.when(wins, e["at"]).otherwise(s["at"]).alias("at"), (s["same"] + F.when(other & equal, 1).otherwise(0)).alias("same"), (s["diff"] + F.when(other & ~equal & (s["p"] != 0.0), 1).otherwise(0)).alias("diff"))

    return F.aggregate(F.transform(cell, lambda e, i: F.struct(e["gt"].alias("gt"), e["p"].alias("p"), e["info"].alias("info"), i.alias("at"))), start, step)


def cells(called: DataFrame, policy: str = "argmax", key: tuple[str, ...] = ("rsid",)) -> DataFrame:
    """One row per (key, sample): the winning genotype by ``policy`` and what the cell held.

    ``argmax``: greatest probability, first panel of equals.  ``fold``: sequential rule in panel order.  ``callrate``: greatest
    probability, then the panel with the higher call rate (column ``record_cr``), then the first.  Repeated rows of a panel
    in a cell count once, so a cell never holds more than one genotype per panel.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    policy = "argmax" if policy == "pairwise" else policy
    by = [*key, "sample_id"]
    # one exchange serves both aggregations
    once = called.repartition(*by).groupBy(*by, "assay_ord").agg(F.max(F.struct("p", "gt", "info", "probs", "assaytype", *(["record_cr"] if policy == "callrate" else []))).alias("g"))
    cell = F.array_sort(F.collect_list(F.struct("assay_ord", "g")))
    rows = once.groupBy(*by).agg(cell.alias("_s")).withColumn("_c", F.transform("_s", lambda e: e["g"]))
    n = F.size("_c")
    if policy == "fold":
        rows = rows.withColumn("_f", _fold(F.col("_c")))
        at = F.when(n == 1, 0).otherwise(F.col("_f.at"))
        extra = {"same_prob": F.when(n > 1, F.col("_f.same")).otherwise(0), "diff_prob": F.when(n > 1, F.col("_f.diff")).otherwise(0)}
    else:
        rank = (lambda e, i: F.struct(e["p"], e["record_cr"], -i)) if policy == "callrate" else (lambda e, i: F.struct(e["p"], -i))
        ranks = F.transform("_c", rank)
        at, extra = F.array_position(ranks, F.array_max(ranks)).cast("int") - 1, {}
    rows = rows.withColumn("_w", F.get("_c", at))
    distinct = F.size(F.array_distinct(F.transform("_c", lambda e: e["gt"])))
    return rows.select(*by, *[F.col(f"_w.{c}").alias(c) for c in ("gt", "p", "probs", "assaytype", "info")], n.alias("n_panels"), distinct.alias("n_calls"), F.size(F.filter("_c", lambda e: e["gt"] == "./.")).alias("n_missing"), *[c.alias(k) for k, c in extra.items()])


def combined(long: DataFrame, policy: str = "argmax", threshold: float = 0.9, key: str = "rsid") -> DataFrame:
    """Calls, rejects records of other alleles, resolves every cell."""
    return cells(with_agreement(with_calls(long, threshold), key).where("accepted"), policy, (key,))


def cell_counters(resolved: DataFrame, key: str = "rsid") -> DataFrame:
    """Counters per variant over the cells of a fold."""
    over = F.col("n_panels") > 1
    return resolved.groupBy(key).agg(
        F.count_if(over).alias("overlap_test"), F.count_if(F.col("n_panels") == 2).alias("two_overlap"), F.count_if(F.col("n_panels") > 2).alias("gt_two_overlap"), F.sum(F.when(over, F.col("n_calls") - 1).otherwise(0)).alias("mismatch"),
        F.sum(F.when(over, F.col("n_missing")).otherwise(0)).alias("miss_test"), F.count_if(F.col("gt") == "./.").alias("missing"), F.sum("same_prob").alias("same_prob_diffs"), F.sum("diff_prob").alias("diff_prob_diffs"),
    ).withColumn("err_pct", F.coalesce(F.try_divide(100.0 * F.col("mismatch"), F.col("overlap_test")), F.lit(0.0)))


def combine_metrics(long: DataFrame, threshold: float = 0.9, key: str = "rsid") -> DataFrame:
    """Counters of a combination per variant, by the fold policy; ``unique_geno`` is the number of combined columns, that is
    of distinct samples."""
    called = with_agreement(with_calls(long, threshold), key)
    everything = called.groupBy(key).agg(F.count("*").alias("all_geno"))
    out = cell_counters(cells(called.where("accepted"), "fold", (key,)), key)
    width = long.select("sample_id").distinct().count()
    return everything.join(out, key, "left").withColumn("unique_geno", F.lit(width).cast("long"))


def no_assay_counts(long: DataFrame, samples: DataFrame, key: str = "rsid") -> DataFrame:
    """(key, no_assay): slots of the accepted records of a variant that hold no genotype, for samples that are on at least two of
    the panels with such records.  ``samples`` is the registry (assaytype, sample_id)."""
    agreed = cut(with_agreement(long, key).where("accepted").select(key, "assaytype", "sample_id").distinct())
    slots = agreed.select(key, "assaytype").distinct().join(broadcast_if_small(samples.select("assaytype", "sample_id").distinct()), "assaytype")
    held = agreed.groupBy(key, "sample_id").agg(F.count("*").alias("_held"))
    per = slots.groupBy(key, "sample_id").agg(F.count("*").alias("_slots")).where("_slots > 1").join(held, [key, "sample_id"], "left")
    counted = per.groupBy(key).agg(F.sum(F.col("_slots") - F.coalesce("_held", F.lit(0))).alias("no_assay"))
    return agreed.select(key).distinct().join(counted, key, "left").withColumn("no_assay", F.coalesce("no_assay", F.lit(0).cast("long")))


def merge_counters(counts: DataFrame, key: str = "rsid", order: str = "assaytype", limit: float = 1e-8) -> DataFrame:
    """(n_variants, n_overlap, n_allele_discord, n_chi_discord) of merging the records of all panels: variants on several
    panels, further records whose alleles are not those of the first panel, and further records whose genotype counts disagree
    with those of the first (chi-square)."""
    w = F.min_by(F.struct("ref", "alt"), order)
    per = counts.groupBy(key).agg(F.count("*").alias("_n"), w.alias("_f"))
    discord = counts.join(per, key).where((F.col("ref") != F.col("_f.ref")) | (F.col("alt") != F.col("_f.alt"))).agg(F.count("*").alias("n_allele_discord"))
    chi = chi_square_concordance(counts, key, order, limit).where(~F.col("concordant")).agg(F.count("*").alias("n_chi_discord"))
    whole = per.agg(F.count("*").alias("n_variants"), F.count_if(F.col("_n") > 1).alias("n_overlap"))
    return whole.join(discord).join(chi)  # one row each


def total_metrics(per_variant: DataFrame) -> DataFrame:
    """The counters summed over variants (each once)."""
    counters = ("all_geno", "unique_geno", "overlap_test", "two_overlap", "gt_two_overlap", "mismatch", "miss_test", "missing", "same_prob_diffs", "diff_prob_diffs")
    return per_variant.agg(F.count("*").alias("n_variants"), *[F.sum(c).alias(c) for c in counters])


def error_gate(metrics: DataFrame, err_pct: float = 10.0) -> DataFrame:
    """The variants whose mismatch percentage is below the limit."""
    return metrics.where(F.col("err_pct") < err_pct)


def with_occurrence(long: DataFrame) -> DataFrame:
    """Numbers the records of a panel at one position: the i-th there pairs with the i-th of another panel.  Records are told
    apart and ordered by ``file_ord`` where the rows have it, then by alleles and id.  Only places with several records of a
    panel are joined; a record is numbered once, whatever the number of its genotypes."""
    fields = [*(["file_ord"] if "file_ord" in long.columns else []), "ref", "alt", "rsid"]
    at = ["assaytype", "chromosome", "position"]
    w = Window.partitionBy(*at)
    records = long.select(*at, *fields).distinct().withColumn("occurrence", F.row_number().over(w.orderBy(*fields))).withColumn("_n", F.count("*").over(w))
    several = broadcast_if_small(records.where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in (*at, *fields)], "occurrence"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*at, *fields)))
    return long.join(several, same, "left").select(*long.columns, F.coalesce("occurrence", F.lit(1)).alias("occurrence"))


def chromosome_merge(long: DataFrame, threshold: float = 0.9, err_pct: float = 10.0) -> DataFrame:
    """Whole-file merge: the i-th records of all panels at a place, panels in descending name order, resolved by the fold policy;
    variants whose mismatch percentage reaches the limit are left out.  One row per (place, occurrence, sample)."""
    names = [r[0] for r in long.select("assaytype").distinct().limit(MAX_PANELS + 1).collect()]
    if len(names) > MAX_PANELS:
        raise ValueError(f"more than {MAX_PANELS} panels")
    names = sorted(names, reverse=True)
    place = F.concat_ws("#", F.concat_ws(":", "chromosome", "position"), "occurrence")
    ordered = with_calls(with_occurrence(long).withColumn("assay_ord", assay_order(names)).withColumn("_at", place), threshold)
    whole = merge.merged_records(merge.record_arrays(ordered, "_at"), "fold", "_at").where("assaytype = 'combined'")
    kept = whole.where(F.coalesce(F.try_divide(100.0 * F.col("mismatch"), F.col("overlap_test")), F.lit(0.0)) < err_pct)
    cells = merge.combined_cells(kept, dict(enumerate(names)), "_at")
    parts = F.split("_at", "#")
    return cells.select(parts[0].alias("place"), parts[1].cast("int").alias("occurrence"), *[c for c in cells.columns if c != "_at"])
