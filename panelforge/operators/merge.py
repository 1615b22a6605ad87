"""Combining whole records: a panel's record of a variant is one row with its genotypes in arrays, a shuffle brings the few
records of a variant together, and numpy resolves all samples of the variant at once.

A variant has at most one record per panel and a record one genotype per sample, so what comes together in a task is bounded
by the cohort.  Genotypes are spread into rows only where rows are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import genotype as G
from panelforge.operators.metrics import minor_allele, record_metrics

#: Codes of the calls within arrays.
CODES = {"./.": -1, "0/0": 0, "0/1": 1, "1/1": 2}
NONE = -9
COUNTERS = ("all_geno", "overlap_test", "two_overlap", "gt_two_overlap", "mismatch", "miss_test", "missing", "same_prob_diffs", "diff_prob_diffs")
CELLS = {"sample": T.StringType(), "code": T.IntegerType(), "p": T.DoubleType(), "at": T.IntegerType(), "n_panels": T.IntegerType(), "n_calls": T.IntegerType(), "n_missing": T.IntegerType(), "same": T.IntegerType(), "diff": T.IntegerType()}
HEAD = ("chromosome", "position", "ref", "alt", "info")


def record_arrays(called: DataFrame, key: str = "rsid") -> DataFrame:
    """(key, assay_ord, assaytype, *HEAD, sample, p, code): called genotypes in long form as one row per record.  Rows
    without a sample id take no part."""
    # p and code are worked out once, below the exchange; a filter on the code would work it out again
    narrow = called.where(F.col("sample_id").isNotNull()).select(key, "assay_ord", "assaytype", *HEAD, "sample_id", "p", G.lit_map(CODES)[F.col("gt")].cast("byte").alias("c"))
    rows = narrow.repartition(key).groupBy(key, "assay_ord", "assaytype", *HEAD).agg(F.collect_list(F.struct("sample_id", "p", "c")).alias("_c"))
    rows = rows.withColumn("_c", F.filter("_c", lambda e: e["c"].isNotNull()))
    return rows.select(key, "assay_ord", "assaytype", *HEAD, F.col("_c.sample_id").alias("sample"), F.col("_c.p").alias("p"), F.col("_c.c").cast("array<int>").alias("code"))


def stored_arrays(records: DataFrame, samples: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The same from records as they are read from call files, without spreading their genotypes: the samples of each panel in
    the order of their slots (``samples``: assaytype, sample_id, list_posn) are put beside its records."""
    slots = samples.groupBy("assaytype").agg(F.array_sort(F.collect_list(F.struct("list_posn", "sample_id"))).alias("_s"))
    at = G.format_index(F.col("format"), "GP")
    rows = records.withColumn("_gp", at).join(slots, "assaytype").withColumn("_z", F.filter(F.arrays_zip("genos", "_s"), lambda z: z["genos"] != "."))
    probs = lambda z: F.coalesce(G.probabilities(z["genos"], F.col("_gp")), F.array().cast("array<double>"))
    return rows.select("rsid", "assay_ord", "assaytype", *HEAD, F.transform("_z", lambda z: z["_s"]["sample_id"]).alias("sample"), F.transform("_z", lambda z: G.top_probability(probs(z))).alias("p"), F.transform("_z", lambda z: G.lit_map(CODES)[G.call(probs(z), threshold)]).alias("code"))


def _resolve(policy: str, p: np.ndarray, k: np.ndarray, info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record that wins in each cell or -1, equal-probability and other differences of a fold) of records (rows) by cells."""
    there = k != NONE
    n = there.sum(axis=0)
    zero = np.zeros(p.shape[1], dtype=np.int64)
    if policy != "fold":
        top = np.where(there, p, -1.0)
        best = top == top.max(axis=0)
        if policy == "callrate":
            rate = np.round(((k >= 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)), 9)
            best_rate = np.where(best & there, rate[:, None], -1.0)
            best = best_rate == best_rate.max(axis=0)
        return np.argmax(best & there, axis=0), zero, zero
    gt, prob, score, at = np.full(p.shape[1], NONE), np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.full(p.shape[1], -1)
    same, diff = zero.copy(), zero.copy()
    for i in range(len(p)):
        other, equal = there[i] & (k[i] != gt), p[i] == prob
        wins = other & ((equal & (info[i] > score)) | (~equal & (p[i] > prob)))
        same += other & equal
        diff += other & ~equal & (prob != 0.0)
        gt, prob, score, at = np.where(wins, k[i], gt), np.where(wins, p[i], prob), np.where(wins, info[i], score), np.where(wins, i, at)
    alone = n == 1
    return np.where(alone, np.argmax(there, axis=0), at), np.where(alone, 0, same), np.where(alone, 0, diff)


def merged_records(arrays: DataFrame, policy: str = "argmax", key: str = "rsid") -> DataFrame:
    """One row per record and one (``assaytype`` "combined") per variant: ``accepted`` (the record has the alleles of the
    variant's first panel), genotypes by call, and for the combined rows the counters of the combination and the cells as
    arrays: winning call, probability and panel of each sample, sorted by sample.

    The fields of a combined row are those of the last accepted record.  ``policy`` is argmax (greatest probability, first
    panel of equals; also called pairwise), callrate (then the higher call rate) or fold (sequential rule in panel order).
    """
    if policy not in ("argmax", "pairwise", "callrate", "fold"):
        raise ValueError(policy)
    head = [key, "assay_ord", "assaytype", *HEAD]
    together = arrays.groupBy(key).agg(F.collect_list(F.struct("assay_ord", "assaytype", *HEAD, "sample", "p", "code")).alias("recs"))
    longs = ["homref", "het", "homalt", "miss", "alln", *COUNTERS]
    schema = T.StructType([*[arrays.schema[c] for c in head], T.StructField("accepted", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.ArrayType(t)) for c, t in CELLS.items()]])
    schema["assay_ord"].nullable = True

    def counts(codes: np.ndarray) -> list[int]:
        return [int((codes == c).sum()) for c in (0, 1, 2, -1)] + [int((codes != NONE).sum())]

    def variant(key_value, recs: pa.StructArray) -> Iterator[dict]:
        order = np.argsort(recs.field("assay_ord").to_numpy(), kind="stable")
        info = recs.field("info").to_numpy(zero_copy_only=False)
        fields = {c: recs.field(c).to_pylist() for c in ("assay_ord", "assaytype", *HEAD)}
        names = sorted(range(len(order)), key=lambda i: (fields["assay_ord"][i], fields["ref"][i] or "", fields["alt"][i] or ""))
        first = (fields["ref"][names[0]], fields["alt"][names[0]])
        ends = recs.field("sample").offsets.to_numpy()
        base = ends[0]
        coded = pc.dictionary_encode(recs.field("sample").flatten())
        sample, who = coded.indices.to_numpy(), coded.dictionary
        prob, code = (recs.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("p", "code"))
        blank = dict.fromkeys((*COUNTERS, *CELLS))
        for i in range(len(order)):
            part = slice(ends[i] - base, ends[i + 1] - base)
            own = (fields["ref"][i], fields["alt"][i]) == first
            yield {key: key_value, **{c: v[i] for c, v in fields.items()}, "accepted": own, **dict(zip(longs, counts(code[part]))), **blank}
        panels = sorted({fields["assay_ord"][i] for i in names if (fields["ref"][i], fields["alt"][i]) == first})
        p, k, score = np.full((len(panels), len(who)), -1.0), np.full((len(panels), len(who)), NONE), np.zeros((len(panels), len(who)))
        kept = [i for i in names if (fields["ref"][i], fields["alt"][i]) == first]
        for i in kept:  # a panel's repeated records count once per cell, the greatest of them
            row, part = panels.index(fields["assay_ord"][i]), slice(ends[i] - base, ends[i + 1] - base)
            s, new_p, new_k = sample[part], prob[part], code[part]
            better = (new_p > p[row, s]) | ((new_p == p[row, s]) & (new_k > k[row, s]))
            s, new_p, new_k = s[better], new_p[better], new_k[better]
            p[row, s], k[row, s], score[row, s] = new_p, new_k, info[i]
        seen = np.flatnonzero((k != NONE).any(axis=0))
        p, k, score = p[:, seen], k[:, seen], score[:, seen]
        at, same, diff = _resolve(policy, p, k, score)
        cell = np.arange(len(seen))
        won = np.where(at >= 0, k[at, cell], NONE)
        n = (k != NONE).sum(axis=0)
        n_calls = sum((k == c).any(axis=0).astype(np.int64) for c in CODES.values())
        n_missing = (k == -1).sum(axis=0)
        over = n > 1
        sums = (len(code), over.sum(), (n == 2).sum(), (n > 2).sum(), (n_calls - 1)[over].sum(), n_missing[over].sum(), (won == -1).sum(), same.sum(), diff.sum())
        last = kept[-1]
        by = np.argsort(np.array(who.take(pa.array(seen)).to_pylist(), dtype=object), kind="stable") if len(seen) else np.array([], dtype=int)
        ords = np.array(panels)
        cells = (who.take(pa.array(seen[by])), won[by], np.where(at >= 0, p[at, cell], 0.0)[by], np.where(at >= 0, ords[at], NONE)[by], n[by], n_calls[by], n_missing[by], same[by], diff[by])
        yield {key: key_value, "assay_ord": None, "assaytype": "combined", **{c: fields[c][last] for c in HEAD}, "accepted": True, **dict(zip(longs, [*counts(won), *map(int, sums)])), **dict(zip(CELLS, cells))}

    arrow = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column(key).to_pylist()):
                rows += variant(value, batch.column("recs")[i].values)
            if not rows:
                continue
            columns = []
            for f in schema:
                if f.name in CELLS:
                    kind = arrow[f.dataType.elementType]
                    columns.append(pa.array([None if r[f.name] is None else pa.array(r[f.name], type=kind) if not isinstance(r[f.name], pa.Array) else r[f.name].cast(kind) for r in rows], type=pa.list_(kind)))
                else:
                    columns.append(pa.array([r[f.name] for r in rows], type=_arrow_type(f.dataType)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return together.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    return {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}[t]


def combined_cells(merged: DataFrame, panels: dict[int, str], key: str = "rsid") -> DataFrame:
    """(key, sample_id, gt, p, assaytype, ref, alt, n_panels, n_calls, n_missing, same_prob, diff_prob): the cells of the
    combined rows, spread; ``panels`` names the panels by ``assay_ord``."""
    both = merged.where("assaytype = 'combined'").select(key, "ref", "alt", F.explode(F.arrays_zip(*CELLS)).alias("e"))
    e = lambda c: F.col(f"e.{c}")
    return both.select(key, e("sample").alias("sample_id"), G.lit_map({v: c for c, v in CODES.items()})[e("code")].alias("gt"), e("p").alias("p"), G.lit_map(panels)[e("at")].alias("assaytype"), "ref", "alt", e("n_panels").alias("n_panels"), e("n_calls").alias("n_calls"), e("n_missing").alias("n_missing"), e("same").alias("same_prob"), e("diff").alias("diff_prob"))


def combined_counters(merged: DataFrame, n_samples: int, key: str = "rsid") -> DataFrame:
    """Counters of a fold per variant; ``n_samples`` is the number of combined columns."""
    rows = merged.where("assaytype = 'combined'").select(key, *COUNTERS)
    return rows.withColumn("unique_geno", F.lit(n_samples).cast("long")).withColumn("err_pct", F.coalesce(F.try_divide(100.0 * F.col("mismatch"), F.col("overlap_test")), F.lit(0.0)))


def results(merged: DataFrame) -> DataFrame:
    """The result page: metrics of each variant on each panel and of the combined record, in one frame and without another
    shuffle."""
    rows = record_metrics(merged.drop(*CELLS).withColumn("dot", F.lit(0).cast("long")))
    rows = rows.withColumn("minor", minor_allele(F.col("ref"), F.col("alt")))
    err = F.when(F.col("assaytype") == "combined", F.coalesce(F.try_divide(100.0 * F.col("mismatch"), F.col("overlap_test")), F.lit(0.0)))
    return rows.select("rsid", "assaytype", "chromosome", "position", "ref", "raf", "alt", "aaf", "cr", "maf", "hwep", "miss", "n", "info", "minor", err.alias("errpct"))
