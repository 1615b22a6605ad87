"""Mixing the sources of a corpus to target shares of its size in tokens.

Method: entropy balancing.  A document with n tokens has the mass m = n + mean n of its source (its tokens and a fixed share
for being a document).  The rates r of the documents of a source are those closest to 1 in relative entropy over this mass
that give the source its tokens, sum(n r) = goal, with no rate above the cap on repeats:

    r_i = min(cap, exp(lambda * n_i / m_i))

so that rates differ within a source - where a source must shrink, short documents keep more of their rate, long ones are
thinned but never crowded out - and lambda solves the convex dual by Newton's method.  Each step is one aggregation over
all documents for all sources at once: gradient sum(n r) - goal, curvature sum(n f r) with f = n / m.

The rates are rounded into copies by diffusion of the error in tokens, long documents first, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.bpe import count_tokens
from panelforge.session import broadcast_if_small, cut

#: Documents of a source per rounding block, which is rounded within one task.
BLOCK_DOCS = 20_000


def source_sizes(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, written once."""
    return cut(count_tokens(documents, vocabulary_path, keep=["source"]))


def read_targets(targets: DataFrame, max_sources: int = 10_000) -> dict[str, tuple[float, float]]:
    """source -> (target share, cap); of repeated sources the greatest share and cap.  Null sources, shares or caps and
    shares or caps not above 0 ask for nothing.  More than ``max_sources`` raise an error, since each is a term of the
    dual that the driver solves."""
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0 and not isnan(target_share)").groupBy("source").agg(F.max("target_share").cast("double"), F.max("max_repeats").cast("double")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources with targets")
    return {r[0]: (r[1], r[2]) for r in rows}


def _by_source(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, float(v))])[F.col("source")]


def _feature(mean: dict[str, float]) -> Column:
    n = F.col("n_tokens").cast("double")
    return n / (n + _by_source(mean))


def balance(sizes: DataFrame, wanted: dict[str, tuple[float, float]], total_tokens: float | None = None, tolerance: float = 1e-9, max_steps: int = 60) -> tuple[dict[str, float], dict[str, float]]:
    """(source -> lambda, source -> mean tokens of its documents).  A source that must give all its caps allow has the
    lambda infinity.

    Shares are taken relative to the sources that have any tokens.  The total is the largest at which every share can be
    met within the caps, or ``total_tokens`` if that is smaller.
    """
    some = sizes.where(F.col("n_tokens") > 0)
    first = some.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.avg("n_tokens").alias("mean"))
    known = {r["source"]: (float(r["have"]), r["mean"]) for r in first.where(F.col("source").isin(*wanted)).collect()} if wanted else {}
    if not known:
        return {}, {}
    whole = sum(wanted[s][0] for s in known)
    share = {s: wanted[s][0] / whole for s in known}
    total = min(wanted[s][1] * known[s][0] / share[s] for s in known)
    total = min(total, total_tokens) if total_tokens else total
    goal = {s: share[s] * total for s in known}
    mean = {s: known[s][1] for s in known}
    # where the goal is all that the caps allow, or all there is, the answer needs no step
    lam = {s: math.inf if goal[s] >= wanted[s][1] * known[s][0] * (1 - 1e-12) else 0.0 for s in known}
    lo, hi = {s: -math.inf for s in known}, {s: math.inf for s in known}
    todo = {s for s in known if lam[s] == 0.0 and abs(goal[s] - known[s][0]) > tolerance * goal[s]}
    lam |= {s: math.log(goal[s] / known[s][0]) for s in todo}  # what a constant rate would need
    for _ in range(max_steps):
        if not todo:
            break
        rows = some.where(F.col("source").isin(*todo))
        f, n = _feature(mean), F.col("n_tokens")
        rate = F.exp(_by_source({s: lam[s] for s in todo}) * f)
        cap = _by_source({s: wanted[s][1] for s in todo})
        step = rows.groupBy("source").agg(F.sum(n * F.least(rate, cap)).alias("mass"), F.sum(F.when(rate < cap, n * f * rate).otherwise(0.0)).alias("bend"))
        for s, mass, bend in step.collect():
            gap = mass - goal[s]
            if abs(gap) <= tolerance * goal[s]:
                todo.discard(s)
                continue
            lo[s], hi[s] = (lam[s], hi[s]) if gap < 0 else (lo[s], lam[s])
            new = lam[s] - gap / bend if bend > 0 else math.nan
            if not (lo[s] < new < hi[s]):  # outside what is known to hold the answer: halve it, or go further out
                new = (lo[s] + hi[s]) / 2 if math.isfinite(lo[s]) and math.isfinite(hi[s]) else lam[s] + (1.0 if gap < 0 else -1.0) * max(1.0, abs(lam[s]))
            lam[s] = new
    return lam, mean


def _diffuse(rate: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whole copies of documents in descending size: each is rounded down or up so that the tokens given follow the tokens
    due; what is over is carried to the next, shorter one."""
    low = np.floor(rate + 1e-9)
    up = np.ceil(rate - 1e-9)
    out, due = low.copy(), 0.0
    for i in range(len(rate)):
        due += rate[i] * n[i]
        if up[i] > low[i] and due - low[i] * n[i] >= 0.5 * n[i]:
            out[i] = up[i]
        due -= out[i] * n[i]
    return out


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of every document of a source with a target.

    ``copies`` is 0 for documents that are left out and never above the cap; documents without tokens (null or empty
    texts) contribute nothing and get 0.  Sources without documents cannot reach their share.
    """
    wanted = read_targets(targets)
    mine = sizes.where(F.col("source").isin(*wanted)) if wanted else sizes.limit(0)
    lam, mean = balance(mine, wanted, total_tokens)
    none = F.lit(0.0)
    if lam:
        cap, ends = _by_source({s: wanted[s][1] for s in lam}), _by_source({s: min(v, 1e9) for s, v in lam.items()})
        tilted = F.when(ends >= 1e9, cap).otherwise(F.least(cap, F.exp(F.least(ends * _feature(mean), F.lit(50.0)))))
        rate = F.when(F.col("n_tokens") > 0, F.coalesce(tilted, none)).otherwise(none)
    else:
        rate = none
    rows = mine.select("doc_id", "source", "n_tokens", rate.alias("rate"))
    # blocks by the size of each source, so that a small source is rounded as one whatever the corpus
    blocks = broadcast_if_small(mine.groupBy("source").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("_blocks")))
    rows = rows.join(blocks, "source").withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks"))).drop("_blocks")
    ordered = rows.repartition("source", "_block").sortWithinPartitions("source", "_block", F.desc("n_tokens"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the block that is being read
        for pdf in batches:
            parts = [g for _, g in pdf.groupby(["source", "_block"], sort=False)]
            for g in parts:
                if held and (held[0]["source"].iloc[0], held[0]["_block"].iloc[0]) != (g["source"].iloc[0], g["_block"].iloc[0]):
                    yield rounded(held)
                    held = []
                held.append(g)
        if held:
            yield rounded(held)

    def rounded(held: list[pd.DataFrame]) -> pd.DataFrame:
        block = pd.concat(held) if len(held) > 1 else held[0].copy()
        copies = _diffuse(block["rate"].to_numpy(dtype=float), block["n_tokens"].fillna(0).to_numpy(dtype=float))
        return block.drop(columns="_block").assign(copies=copies.astype("int64"))

    return ordered.mapInPandas(run, f"source string, doc_id {sizes.schema['doc_id'].dataType.simpleString()}, n_tokens long, rate double, copies long").select("doc_id", "source", "n_tokens", "rate", "copies")


def shares(sizes: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source, with a target or without: documents and tokens it has, copies and tokens it contributes, the share
    reached beside the one asked for, and ``wanted_share``, the target relative to the sources that have any tokens."""
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    per = cut(mixed.groupBy("source").agg(F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.min("rate").alias("least_rate"), F.max("rate").alias("most_rate"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens")))
    whole = F.lit(per.agg(F.sum("mixed_tokens")).first()[0]).cast("long")
    asked = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    same = lambda a, b: a.join(b.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "full").withColumn("source", F.coalesce("source", "_s")).drop("_s")
    out = cut(same(same(asked, have), per))
    met = out.where("target_share > 0 and max_repeats > 0 and tokens > 0").agg(F.sum("target_share")).first()[0]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    wanted = F.when((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0), F.try_divide(F.col("target_share"), F.lit(met).cast("double"))).otherwise(0.0)
    return out.select("source", "target_share", "max_repeats", *[zero(c) for c in ("n_docs", "tokens", "copies", "most_copies", "mixed_tokens")], "least_rate", "most_rate", wanted.alias("wanted_share"), F.coalesce(F.try_divide(F.col("mixed_tokens"), whole), F.lit(0.0)).alias("share"))


def checked(sizes: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: documents it has, documents of the mixture, those used more often than ``max_repeats`` or without tokens."""
    asked = targets.where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    used = mixed.join(broadcast_if_small(asked), "source").groupBy("source").agg(F.count("*").alias("n_weighed"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_too_often"), F.count_if((F.col("copies") > 0) & ~F.coalesce(F.col("n_tokens") > 0, F.lit(False))).alias("n_empty_used"))
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"))
    rows = have.join(used.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return rows.select("source", "n_docs", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_weighed", "n_too_often", "n_empty_used")])
