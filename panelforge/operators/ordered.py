"""Global ordered passes without a single-task window.

A window ``PARTITION BY entity ORDER BY x`` puts a whole entity into one task, which fails when one entity
holds a third of all rows.  The operators here range-partition and sort globally by (entity, x), so that a hot
entity spreads over many tasks, and carry the little state that crosses a partition border:

1. range-partition, sort within partitions, and write the result once (checkpoint);
2. one tiny summary per partition goes to the driver (as many rows as partitions, whatever the data);
3. the summaries are prefix-combined in partition order;
4. every partition is scanned again, starting from the state that the partitions before it leave behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import cut, shuffle_width

PID = "_pid"


def range_sorted(df: DataFrame, order: list[str], width: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, materialised, with its partition number in ``_pid``."""
    width = width or shuffle_width(df.sparkSession)
    return cut(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn(PID, F.spark_partition_id()))


def _entity_breaks(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before (the first row: True)."""
    breaks = np.zeros(len(pdf), dtype=bool)
    breaks[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        breaks[1:] |= v[1:] != v[:-1]
    return breaks


def _key_at(pdf: pd.DataFrame, keys: list[str], i: int) -> tuple:
    return tuple(x.item() if isinstance(x, np.generic) else x for x in (pdf[k].iloc[i] for k in keys))


class _Island:
    """State of a scan over intervals sorted by (keys, start): the current entity, the largest end so far and the
    start of the current stretch."""

    def __init__(self, keys: list[str], start: str, end: str, carry: tuple | None = None):
        self.keys, self.start, self.end = keys, start, end
        self.key, self.top, self.island = carry or (None, None, None)

    def feed(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first row of its entity, largest end before the row, start of the row's stretch)."""
        s, e = pdf[self.start].to_numpy(np.int64), pdf[self.end].to_numpy(np.int64)
        first = _entity_breaks(pdf, self.keys)
        goes_on = self.key is not None and _key_at(pdf, self.keys, 0) == self.key
        first[0] = not goes_on
        code = np.cumsum(first)
        low = np.iinfo(np.int64).min
        ends = e.copy()
        if goes_on:
            ends[0] = max(ends[0], self.top)
        running = pd.Series(ends).groupby(code).cummax().to_numpy()
        before = np.concatenate([[self.top if goes_on else low], running[:-1]])
        before[first] = low
        opens = first | (s > before)
        at = np.where(opens, np.arange(len(s)), -1)
        last_open = np.maximum.accumulate(at)
        island = np.where(last_open >= 0, s[np.maximum(last_open, 0)], self.island if goes_on else low)
        self.key, self.top, self.island = _key_at(pdf, self.keys, len(pdf) - 1), int(running[-1]), int(island[-1])
        return first, before, island


def _carries(summaries: list[tuple[int, tuple, tuple, bool, int, int]]) -> dict[int, tuple]:
    """Prefix-combine (pid, first key, last key, one entity only, largest end and start of the last stretch of the
    last entity) in partition order: the state in force where each partition begins."""
    out: dict[int, tuple] = {}
    state: tuple | None = None
    for pid, first, last, single, top, island in sorted(summaries):
        if state is not None:
            out[pid] = state
        if state is not None and single and first == state[0]:
            state = (last, max(top, state[1]), state[2] if island <= state[1] else island)
        else:
            state = (last, top, island)
    return out


def _key_fields(df: DataFrame, keys: list[str], prefix: str = "") -> list[T.StructField]:
    return [T.StructField(prefix + k, df.schema[k].dataType) for k in keys]


def interval_pieces(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Scan half-open intervals [start, end) per entity ``keys``; rows of kind ``part`` (a piece of the stretch that
    begins at ``lo`` and reaches ``hi``) and ``gap`` (uncovered from ``lo`` to ``hi`` within the entity).

    Touching intervals belong to one stretch.  Rows with a null key or bound, or with start not below end, are no
    intervals.  Copies of an interval are collapsed before the sort.
    """
    clean = (
        df.select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
        .where(F.col("_s") < F.col("_e"))
        .dropna()
        .groupBy(*keys, "_s")
        .agg(F.max("_e").alias("_e"))  # of intervals with one start only the longest matters
    )
    ordered = range_sorted(clean, [*keys, "_s"])

    sum_schema = T.StructType(
        [T.StructField(PID, T.IntegerType()), *_key_fields(df, keys, "first_"), *_key_fields(df, keys, "last_"), T.StructField("single", T.BooleanType()), T.StructField("top", T.LongType()), T.StructField("island", T.LongType())]
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, first, pid, single = _Island(keys, "_s", "_e"), None, None, True
        for pdf in batches:
            if not len(pdf):
                continue
            if first is None:
                first, pid = _key_at(pdf, keys, 0), int(pdf[PID].iloc[0])
            scan.feed(pdf)
            single = single and first == scan.key
        if first is not None:
            yield pd.DataFrame([[pid, *first, *scan.key, single, scan.top, scan.island]], columns=sum_schema.names)

    n = len(keys)
    carry = _carries([(r[0], tuple(r[1 : 1 + n]), tuple(r[1 + n : 1 + 2 * n]), r[1 + 2 * n], r[2 + 2 * n], r[3 + 2 * n]) for r in ordered.mapInPandas(summarise, sum_schema).collect()])
    out_schema = T.StructType([*_key_fields(df, keys), T.StructField("kind", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = None
        for pdf in batches:
            if not len(pdf):
                continue
            scan = scan or _Island(keys, "_s", "_e", carry.get(int(pdf[PID].iloc[0])))
            first, before, island = scan.feed(pdf)
            s, e = pdf["_s"].to_numpy(np.int64), pdf["_e"].to_numpy(np.int64)
            gap = ~first & (s > before)
            gaps = pdf.loc[gap, keys].assign(kind="gap", lo=before[gap], hi=s[gap])
            parts = pdf[keys].assign(lo=island, hi=e).groupby([*keys, "lo"], sort=False, as_index=False)["hi"].max().assign(kind="part")
            yield pd.concat([gaps, parts])[out_schema.names]

    return ordered.mapInPandas(rescan, out_schema)


def merge_intervals(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The continuous stretches (keys, lo, hi) of ``interval_pieces``."""
    return pieces.where("kind = 'part'").groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))


def interval_gaps(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps (keys, lo, hi) between the stretches of ``interval_pieces``."""
    return pieces.where("kind = 'gap'").select(*keys, "lo", "hi")


def asof_match(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, until: str, tie: str) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of equal ``keys`` whose ``since`` is the last not after ``at``:
    adds ``match_since`` and ``match_until`` (null where none precedes).

    Both sides are sorted together by (keys, position, ``tie``), so a key that holds a third of the rows is spread
    over partitions; the last row of ``right`` before a partition is carried into it.  ``at`` and ``tie`` must not be
    null in ``left``; keys must not be null.
    """
    extra = [c for c in left.columns if c not in keys]
    payload = {c: f"_p{i}" for i, c in enumerate(extra)}
    a = left.select(*keys, F.col(at).cast("long").alias("_x"), F.lit(1).alias("_side"), F.col(tie).cast("string").alias("_tie"), F.lit(0).cast("long").alias("_u"), *[F.col(c).alias(p) for c, p in payload.items()])
    b = right.select(*keys, F.col(since).cast("long").alias("_x"), F.lit(0).alias("_side"), F.lit("").alias("_tie"), F.col(until).cast("long").alias("_u"), *[F.lit(None).cast(left.schema[c].dataType).alias(p) for c, p in payload.items()])
    ordered = range_sorted(a.unionByName(b), [*keys, "_x", "_side", "_tie"])

    n = len(keys)
    last_schema = T.StructType([T.StructField(PID, T.IntegerType()), *_key_fields(left, keys), T.StructField("_x", T.LongType()), T.StructField("_u", T.LongType())])

    def last_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            if len(pdf):
                i = len(pdf) - 1
                last = [int(pdf[PID].iloc[i]), *_key_at(pdf, keys, i), int(pdf["_x"].iloc[i]), int(pdf["_u"].iloc[i])]
        if last:
            yield pd.DataFrame([last], columns=last_schema.names)

    lasts = {r[0]: tuple(r[1:]) for r in ordered.where("_side = 0").select(PID, *keys, "_x", "_u").mapInPandas(last_of, last_schema).collect()}
    carry, state = {}, None
    for pid in range(max(lasts, default=-1) + 1):
        carry[pid] = state
        state = lasts.get(pid, state)
    final = state

    fields = [*_key_fields(left, keys), *[T.StructField(p, left.schema[c].dataType) for c, p in payload.items()], T.StructField("match_since", T.LongType()), T.StructField("match_until", T.LongType())]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                pid = batch.column(PID)[0].as_py()
                state, begun = carry.get(pid, final), True
            pdf = pd.DataFrame({k: batch.column(k).to_pandas() for k in keys})
            x, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_u"))
            is_right = batch.column("_side").to_numpy(zero_copy_only=False) == 0
            at_row = np.maximum.accumulate(np.where(is_right, np.arange(len(x)), -1))
            src = np.maximum(at_row, 0)
            same = at_row >= 0
            for k in keys:
                v = pdf[k].to_numpy()
                same &= v[src] == v
            since_, until_ = x[src], u[src]
            if state is not None:
                lead = at_row < 0
                for i, k in enumerate(keys):
                    lead &= (pdf[k] == state[i]).to_numpy()
                since_, until_, same = np.where(lead, state[n], since_), np.where(lead, state[n + 1], until_), same | lead
            if is_right.any():
                i = int(at_row[-1])
                state = (*_key_at(pdf, keys, i), int(x[i]), int(u[i]))
            keep = ~is_right
            out = batch.select([*keys, *payload.values()]).filter(pa.array(keep))
            none = ~same[keep]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(since_[keep], mask=none), pa.array(until_[keep], mask=none)], names=[f.name for f in fields])

    matched = ordered.mapInArrow(fill, T.StructType(fields))
    return matched.select(*keys, *[F.col(p).alias(c) for c, p in payload.items()], "match_since", "match_until")


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row among those of equal ``keys`` (not null), by ``order`` (columns or sort
    expressions), however many rows a key has: the rows are sorted globally, and the count of the key that a partition ends
    with is carried into the next."""
    by = [*[F.col(k) for k in keys], *order]
    ordered = cut(df.repartitionByRange(shuffle_width(df.sparkSession), *by).sortWithinPartitions(*by).withColumn(PID, F.spark_partition_id()))
    end_schema = T.StructType([T.StructField(PID, T.IntegerType()), *_key_fields(df, keys), T.StructField("n", T.LongType()), T.StructField("single", T.BooleanType())])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, pid, single = None, 0, 0, True
        for pdf in batches:
            if len(pdf):
                starts = np.flatnonzero(_entity_breaks(pdf, keys))
                goes_on = key is not None and _key_at(pdf, keys, 0) == key
                single = single and len(starts) == 1 and (key is None or goes_on)
                pid, n = int(pdf[PID].iloc[0]), len(pdf) - int(starts[-1]) + (n if goes_on and len(starts) == 1 else 0)
                key = _key_at(pdf, keys, len(pdf) - 1)
        if key is not None:
            yield pd.DataFrame([[pid, *key, n, single]], columns=end_schema.names)

    carry, state = {}, None
    for r in sorted(ordered.select(PID, *keys).mapInPandas(ends, end_schema).collect()):
        pid, key, n, single = r[0], tuple(r[1 : 1 + len(keys)]), r[1 + len(keys)], r[2 + len(keys)]
        carry[pid] = state
        state = (key, n + (state[1] if single and state and state[0] == key else 0))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, begun = None, False
        for pdf in batches:
            if not len(pdf):
                continue
            if not begun:
                state, begun = carry.get(int(pdf[PID].iloc[0])), True
            breaks = _entity_breaks(pdf, keys)
            at = np.arange(len(pdf))
            rank = at - np.maximum.accumulate(np.where(breaks, at, 0))
            if state and state[0] == _key_at(pdf, keys, 0):
                first_run = np.cumsum(breaks) == 1
                rank = np.where(first_run, rank + state[1], rank)
            state = (_key_at(pdf, keys, len(pdf) - 1), int(rank[-1]) + 1)
            yield pdf.drop(columns=PID).assign(**{name: rank})

    return ordered.mapInPandas(number, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))
