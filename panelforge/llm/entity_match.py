"""Matching variants and laboratory probes that share no identifier.

Method: MinHash blocking over overlapping place windows together with the letters of the change; pairwise similarity
features; a logistic classifier trained on weak labels; calibrated probabilities, which decide.

Weak labels come from what is known apart from the change: the frequency the laboratory reports, which is kept out of the
features, is near that of the variant or not, and a place too far away is another variant's.  Such labels are often wrong, in a
known way: two unrelated variants have near frequencies with a
probability that follows from the two distributions of frequencies, two descriptions of one variant fail to with a
probability that is estimated.  Classifier and calibration are fitted under this noise, so that the confidence is that of a
match and not that of a label.

Both tables are first reduced to distinct descriptions (chromosome, place, alleles), so that copies are compared once, and
the matched descriptions are expanded into rows at the end by equi-joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.text import chromosome, strip
from panelforge.session import cut

#: Different ways of writing move a place by at most so many bases.
REACH = 2
#: Width and step of the place windows and number of MinHash functions.  Places at most 2 apart share all 16 windows, or 15 of
#: 17 where a border lies between them (2 of 8 cases), so one of the 5 functions agrees with probability 1 - 2/8 (2/17)^5 =
#: 1 - 5.6e-6 at a distance of 2, 1 - 2.8e-6 at 1, and always for one place with itself.
WINDOW, STEP, HASHES = 128, 8, 5
#: Fixed values of the laboratories' notation.
NO_ALLELE = ("", ".", "0", "N", "?", "NA", "X")
FEATURES = ("near", "off", "same", "swapped", "other_strand", "one_allele", "unspelled", "fits")
#: Prior of the classifier (intercept first): what it falls back to where weak labels are few.
PRIOR = (-2.0, 1.0, -0.25, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
#: Frequencies closer than the first number speak for a match, those farther apart than the second against one.
CLOSE, FAR = 0.05, 0.12
#: The same change this many bases away is another variant, whatever its frequency.
ANOTHER = 5


def complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("/", F.least(a, b), F.greatest(a, b))


def _trimmed(df: DataFrame) -> DataFrame:
    """Adds the change without the letters both alleles begin or end with, and its place."""
    both = F.concat("a", F.lit("\n"), "b")
    rows = df.withColumn("_head", F.when(F.col("a") != F.col("b"), F.regexp_extract(both, r"^([^\n]*)[^\n]*\n\1", 1)).otherwise(""))
    n = F.length("_head")
    rows = rows.withColumn("_x", F.substring(F.col("a"), n + 1, F.length("a"))).withColumn("_y", F.substring(F.col("b"), n + 1, F.length("b")))
    rows = rows.withColumn("_tail", F.when(F.col("_x") != F.col("_y"), F.regexp_extract(F.concat("_x", F.lit("\n"), "_y"), r"^[^\n]*?([^\n]*)\n[^\n]*\1$", 1)).otherwise(""))
    t = F.length("_tail")
    rows = rows.withColumn("x", F.substring(F.col("_x"), F.lit(1), F.length("_x") - t)).withColumn("y", F.substring(F.col("_y"), F.lit(1), F.length("_y") - t))
    token = F.least(_pair(_letters(F.col("x")), _letters(F.col("y"))), _pair(_letters(complement(F.col("x"))), _letters(complement(F.col("y")))))
    return rows.withColumn("place", F.col("pos") + n).withColumn("token", token).drop("_head", "_x", "_y", "_tail")


def _places(df: DataFrame) -> DataFrame:
    return df.where(F.col("chrom").isNotNull() & (F.col("pos") > 0))


def describe_variants(variants: DataFrame) -> DataFrame:
    """(vid, chrom, pos, a, b, maf) of the rows whose chromosome, place and both alleles are filled."""
    allele = lambda c: F.upper(strip(F.col(c)))
    rows = variants.select("vid", chromosome(F.col("chromosome")).alias("chrom"), F.col("startposition").cast("long").alias("pos"), allele("allelea").alias("a"), allele("alleleb").alias("b"), F.when(F.col("maf").between(0, 1), F.col("maf")).alias("maf"))
    return _places(rows).where(~F.col("a").isin("", ".") & ~F.col("b").isin("", "."))


def describe_probes(probes: DataFrame) -> DataFrame:
    """(probe_id, chrom, pos, a, b, kind, freq); kind is ``full``, ``part`` (one allele named, in ``a``) or ``unspelled``
    (insertion against deletion without the letters).  Rows without place or allele take no part."""
    written = F.concat_ws("|", *[F.upper(strip(F.coalesce(F.col(c), F.lit("")))) for c in ("allelea", "alleleb")])
    rows = _places(probes.select("probe_id", chromosome(F.col("chromosome")).alias("chrom"), F.col("startposition").cast("long").alias("pos"), written.alias("_t"), F.when(F.col("freq_b").between(0, 1), F.col("freq_b")).alias("freq")))
    t, none = F.col("_t"), "(" + "|".join(re.escape(x) for x in NO_ALLELE) + ")"
    kind = F.when(t.rlike(r"^[ID]\|[ID]$"), "unspelled").when(t.rlike(r"^([ACGT]+\|([ACGT]+|-+)|-+\|[ACGT]+)$"), "full").when(t.rlike(rf"^([ACGT]+\|{none}|{none}\|[ACGT]+)$"), "part")
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    first, last = F.regexp_extract(t, "^([ACGT]*)", 1), F.regexp_extract(t, "([ACGT]*)$", 1)
    full = F.col("kind") == "full"
    return rows.select("probe_id", "chrom", "pos", "kind", F.when(full, first).when(F.col("kind") == "part", F.when(first != "", first).otherwise(last)).otherwise("").alias("a"), F.when(full, last).otherwise("").alias("b"), "freq")


def signature(chrom: Column, pos: Column) -> Column:
    """The MinHashes of the windows that cover a place.  Window s of a place is cell floor((pos + s) / WINDOW) of the grid
    shifted by s, so two places share a window where they lie in one cell of that grid."""
    shifts = F.array(*[F.lit(s) for s in range(0, WINDOW, STEP)])
    at = lambda k: F.array_min(F.transform(shifts, lambda s: F.xxhash64(chrom, s, F.floor((pos + s) / WINDOW), F.lit(k))))
    return F.array(*[at(k) for k in range(HASHES)])


def _blocked(df: DataFrame) -> DataFrame:
    """A row per MinHash with no more than identifies the description and is compared: these rows are what the blocking
    shuffles.  The function is part of the key."""
    rows = df.withColumn("_t", F.xxhash64("token")).drop("token", "x", "y", "place")
    return rows.select("*", F.posexplode(signature(F.col("chrom"), F.col("pos"))).alias("_k", "_h"))


def candidates(v: DataFrame, p: DataFrame) -> DataFrame:
    """Pairs of descriptions that agree in a MinHash of the place and, where the probe spells both alleles, in the letters
    of the change on either strand.  Every pair comes out once."""
    key = ["chrom", "pos", "a", "b"]
    named = lambda df, side: df.select(*[F.col(c).alias(c if c.startswith("_") else f"{side}_{c}") for c in df.columns])
    left, right = named(_blocked(v), "v"), named(_blocked(p), "p")
    spelled = left.join(right.where("p_kind = 'full'"), ["_k", "_h", "_t"])
    others = left.drop("_t").join(right.where("p_kind <> 'full'").drop("_t"), ["_k", "_h"])
    near = (F.col("v_chrom") == F.col("p_chrom")) & (F.abs(F.col("v_pos") - F.col("p_pos")) < WINDOW)
    pairs = spelled.drop("_t").unionByName(others).where(near).drop("_k", "_h").dropDuplicates([*[f"v_{c}" for c in key], *[f"p_{c}" for c in key], "p_kind"])
    # the few candidates are taken apart again
    for side in ("v", "p"):
        theirs = _trimmed(pairs.select(*[F.col(c) for c in pairs.columns], *[F.col(f"{side}_{c}").alias(c) for c in ("pos", "a", "b")]))
        pairs = theirs.select(*pairs.columns, *[F.col(c).alias(f"{side}_{c}") for c in ("x", "y", "place", "token")])
    return pairs


def compared(pairs: DataFrame) -> DataFrame:
    """Adds the similarity features of each pair, and ``fits``: the exact check that place and change agree."""
    c = F.col
    rows = pairs.withColumn("_shift", c("p_place") - c("v_place")).withColumn("_full", c("p_kind") == "full")
    # an insertion or deletion within a repeat may be written some bases on, with its letters turned
    turn = c("_shift").between(-REACH, REACH) & (F.least(F.length("v_x"), F.length("v_y")) == 0)
    by = lambda s: F.pmod(c("_shift"), F.greatest(F.length(s), F.lit(1))).cast("int")
    turned = lambda s: F.when(turn, F.concat(F.substring(s, by(s) + 1, F.length(s)), F.substring(s, F.lit(1), by(s)))).otherwise(s)
    rows = rows.withColumn("_tx", turned(c("v_x"))).withColumn("_ty", turned(c("v_y")))
    equal = lambda a, b: (c(a) == c("p_x")) & (c(b) == c("p_y"))
    rows = rows.withColumn("_same", c("_full") & (equal("v_x", "v_y") | equal("_tx", "_ty")))
    rows = rows.withColumn("_swapped", c("_full") & ~c("_same") & (equal("v_y", "v_x") | equal("_ty", "_tx")))
    for name, f in (("_c", complement), ("_r", lambda s: F.reverse(complement(s)))):
        rows = rows.withColumn(f"{name}x", f(c("v_x"))).withColumn(f"{name}y", f(c("v_y")))
    rows = rows.withColumn("_strand", c("_full") & ~c("_same") & ~c("_swapped") & (equal("_cx", "_cy") | equal("_cy", "_cx") | equal("_rx", "_ry") | equal("_ry", "_rx")))
    rows = rows.withColumn("_one", (c("p_kind") == "part") & c("p_a").isin(c("v_a"), c("v_b"), complement(c("v_a")), complement(c("v_b"))))
    rows = rows.withColumn("_unspelled", (c("p_kind") == "unspelled") & (F.length("v_a") != F.length("v_b")))
    raw = F.abs(c("p_pos") - c("v_pos"))
    rows = rows.withColumn("off_by", F.when(c("_full"), F.least(F.abs("_shift"), raw)).otherwise(raw))
    rows = rows.withColumn("change", c("_same") | c("_swapped") | c("_strand") | c("_one") | c("_unspelled"))
    rows = rows.withColumn("gap", F.least(F.abs(c("p_freq") - c("v_maf")), F.abs(1.0 - c("p_freq") - c("v_maf"))))
    rows = rows.withColumn("fits", c("change") & (c("off_by") <= REACH))
    flag = lambda x: x.cast("double")
    feats = [flag(c("off_by") <= REACH), flag(F.least(c("off_by"), F.lit(16))) / 4.0, *[flag(c(n)) for n in ("_same", "_swapped", "_strand", "_one", "_unspelled", "fits")]]
    return rows.select(*pairs.columns, "off_by", "gap", *[x.alias(f"f_{n}") for n, x in zip(FEATURES, feats)])


def weak_label() -> Column:
    """1 where the frequencies are close and the places not too far apart, 0 where either is not so, null where the
    frequencies are neither close nor far or unknown.  It knows nothing of the change."""
    c = F.col
    return F.when((c("off_by") >= ANOTHER) | (c("gap") > FAR), 0.0).when(c("gap") < CLOSE, 1.0)


def chance_of_closeness(v: DataFrame, p: DataFrame) -> float:
    """The probability that the weak label of two unrelated descriptions is 1, from the distributions of both frequencies in
    bins of 0.01."""
    def bins(df: DataFrame, col: str) -> np.ndarray:
        folded = F.least(F.col(col), 1.0 - F.col(col))
        out = np.zeros(51)
        for b, n in df.where(folded.isNotNull()).groupBy(F.floor(folded * 100).alias("b")).agg(F.count("*").alias("n")).collect():
            out[min(50, max(0, int(b)))] += n
        return out / max(1.0, out.sum())

    x, y = bins(v, "maf"), bins(p, "freq")
    apart = np.abs(np.subtract.outer(np.arange(51), np.arange(51))) / 100.0
    both = np.outer(x, y)
    close, far = both[apart < CLOSE].sum(), both[apart > FAR].sum()
    return float(min(0.95, max(0.01, close / (close + far)))) if close + far else 0.5


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Weights of the logistic model with a normal prior, by Newton's method."""
    w = prior.copy()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _under_noise(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float, chance: float, agree: float, fixed: bool = False) -> tuple[np.ndarray, float]:
    """(weights, share of label 1 among matches) of a logistic model of matches whose labels are noisy: 1 with probability
    ``agree`` for a match, ``chance`` otherwise; by expectation and maximisation."""
    w = prior.copy()
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        yes, no = np.where(y == 1, agree, 1 - agree) * p, np.where(y == 1, chance, 1 - chance) * (1 - p)
        q = yes / np.maximum(yes + no, 1e-300)
        new = _logistic(x, q, prior, strength)
        if not fixed:
            agree = float(np.clip((q * y).sum() + 9.0, 0, None) / (q.sum() + 10.0))  # ten pairs of prior belief in 0.9
            agree = max(agree, min(0.99, chance + 0.05))
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w, agree


@dataclass(frozen=True)
class Model:
    """What was learnt: weights of the features (intercept first), of the calibration, and the noise of the labels."""

    weights: tuple[float, ...]
    platt: tuple[float, float]
    chance: float
    agree: float


def _pair_hash() -> Column:
    return F.xxhash64("v_chrom", "v_pos", "v_a", "v_b", "p_pos", "p_a", "p_b", "p_kind")


def train(features: DataFrame, chance: float, max_labels: int = 20_000, strength: float = 1.0) -> Model:
    """The model fitted on at most ``max_labels`` weakly labelled pairs, the first in the order of a hash of their
    descriptions.  Odd ones train, even ones calibrate (Platt scaling)."""
    rows = features.withColumn("_y", weak_label()).where(F.col("_y").isNotNull()).select("_y", _pair_hash().alias("_hash"), *[f"f_{n}" for n in FEATURES]).orderBy("_hash").limit(max_labels).collect()
    prior, plain = np.array(PRIOR), np.array([0.0, 1.0])
    if not rows:
        return Model(PRIOR, (0.0, 1.0), chance, 0.9)
    data = np.array([[r[0], *r[2:]] for r in rows], dtype=float)
    odd = np.array([r[1] % 2 == 1 for r in rows])
    x, y = np.hstack([np.ones((len(data), 1)), data[:, 1:]]), data[:, 0]
    w, agree = _under_noise(x[odd], y[odd], prior, strength, chance, 0.9) if odd.any() else (prior, 0.9)
    held = ~odd
    margin = np.hstack([np.ones((held.sum(), 1)), (x[held] @ w)[:, None]])
    platt = _under_noise(margin, y[held], plain, strength, chance, agree, fixed=True)[0] if held.any() else plain
    return Model(tuple(float(v) for v in w), (float(platt[0]), float(platt[1])), chance, agree)


def confidence(model: Model) -> Column:
    margin = F.lit(model.weights[0])
    for n, w in zip(FEATURES, model.weights[1:]):
        margin = margin + F.lit(w) * F.col(f"f_{n}")
    z = F.lit(model.platt[0]) + F.lit(model.platt[1]) * margin
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def scored_pairs(variants: DataFrame, probes: DataFrame, max_labels: int = 20_000) -> tuple[DataFrame, Model]:
    """(candidate pairs of descriptions with features and ``confidence``, the model)."""
    key = ["chrom", "pos", "a", "b"]
    v = cut(_with_token(describe_variants(variants).groupBy(*key).agg(F.avg("maf").alias("maf"))))
    p = cut(_with_token(describe_probes(probes).groupBy(*key, "kind").agg(F.avg("freq").alias("freq"))))
    pairs = cut(compared(candidates(v, p)))
    model = train(pairs, chance_of_closeness(v, p), max_labels)
    return pairs.withColumn("confidence", confidence(model)), model


def _with_token(df: DataFrame) -> DataFrame:
    return _trimmed(df).drop("x", "y", "place")


def match_descriptions(variants: DataFrame, probes: DataFrame, max_labels: int = 20_000, min_confidence: float = 0.5) -> DataFrame:
    """The matching pairs of descriptions: those whose confidence reaches ``min_confidence``."""
    key = ["chrom", "pos", "a", "b"]
    pairs, _ = scored_pairs(variants, probes, max_labels)
    found = pairs.where(F.col("confidence") >= min_confidence)
    # where the probe does not spell the change, what lies nearest is meant, with every row of the same change
    probe = [f"p_{c}" for c in (*key, "kind")]
    found = found.withColumn("_near", F.min("off_by").over(Window.partitionBy(*probe, "v_token"))).withColumn("_best", F.min("off_by").over(Window.partitionBy(*probe)))
    return found.where((F.col("p_kind") == "full") | (F.col("_near") == F.col("_best"))).select(*[f"v_{c}" for c in key], *probe, "confidence")


def reliability(variants: DataFrame, probes: DataFrame, max_labels: int = 20_000) -> DataFrame:
    """(bin, n_pairs, mean_confidence, n_labelled, close_share, matched_share): held-out candidate pairs (even hashes, which no
    weight was fitted on) by tenths of confidence; ``close_share`` is that of label 1, ``matched_share`` what it says about
    matches when the noise of the labels is taken off."""
    pairs, model = scored_pairs(variants, probes, max_labels)
    held = pairs.where(_pair_hash() % 2 == 0).withColumn("_y", weak_label()).withColumn("bin", F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int"))
    per = held.groupBy("bin").agg(F.count("*").alias("n_pairs"), F.avg("confidence").alias("mean_confidence"), F.count("_y").alias("n_labelled"), F.avg("_y").alias("close_share"))
    clean = (F.col("close_share") - model.chance) / (model.agree - model.chance)
    return per.withColumn("matched_share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), clean)))


def match(variants: DataFrame, probes: DataFrame, max_labels: int = 20_000) -> DataFrame:
    """(vid, probe_id, confidence) of all rows that describe the same variant.

    Rows with a null or unusable chromosome, place or allele take no part, null ids included; every copy of a row gives its
    own pairs; empty tables give none.  Extra columns are ignored.
    """
    key = ["chrom", "pos", "a", "b"]
    found = match_descriptions(variants, probes, max_labels)
    v = describe_variants(variants).where("vid is not null").select("vid", *[F.col(c).alias(f"v_{c}") for c in key])
    p = describe_probes(probes).where("probe_id is not null").select("probe_id", *[F.col(c).alias(f"p_{c}") for c in (*key, "kind")])
    return found.join(v, [f"v_{c}" for c in key]).join(p, [f"p_{c}" for c in (*key, "kind")]).select("vid", "probe_id", "confidence")
