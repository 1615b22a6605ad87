"""Differences between two copies of a table, field by field.

Method: both copies are range-partitioned by key with the same split points (they are partitioned together), sorted
within partitions, and a streaming merge walks both sides of a partition with two pointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import shuffle_width


def _differs(a: pa.Array, b: pa.Array, tolerance: float) -> np.ndarray:
    """Null equals only null, NaN only NaN; doubles within ``tolerance`` are equal."""
    na, nb = a.is_null().to_numpy(zero_copy_only=False), b.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_floating(a.type):
        x, y = a.fill_null(0.0).to_numpy(zero_copy_only=False), b.fill_null(0.0).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            unequal = ~((x == y) | (np.abs(x - y) <= tolerance) | (np.isnan(x) & np.isnan(y)))
    else:
        unequal = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    return (na != nb) | (~na & ~nb & unequal)


def _least_of_each(key: str, cols: list[str]):
    """Map-side combiner: of the rows of a key within an Arrow batch only the least is handed to the shuffle, so that a key
    delivered over and over does not fill one task.  A batch without repeats passes as it is."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key)
            seen = pc.value_counts(keys)
            often = seen.field("values").filter(pc.greater(seen.field("counts"), 1))
            if not len(often):
                yield batch
                continue
            repeated = pc.is_in(keys, value_set=often)
            yield batch.filter(pc.invert(repeated))
            t = pa.Table.from_batches([batch.filter(repeated)])
            order = [key]
            for c in cols:  # Spark's order: null, numbers, NaN
                if pa.types.is_floating(t.schema.field(c).type):
                    t = t.append_column(f"{c}_nan", pc.is_nan(t.column(c)))
                    order.append(f"{c}_nan")
                order.append(c)
            t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
            k = t.column(key).combine_chunks().to_numpy(zero_copy_only=False)
            yield from t.filter(pa.array(np.concatenate([[True], k[1:] != k[:-1]]))).select(batch.schema.names).to_batches()

    return combine


def table_diff(left: DataFrame, right: DataFrame, key: str, tolerance: float = 1e-6, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """(key, field) rows: ``missing_in_<left_name>``, ``missing_in_<right_name>``, or the name of a column of ``right``
    (other than the key) that differs.

    Compared are the columns of ``right``; ``left`` must have them (types are brought to those of ``left``), and its
    further columns are ignored.  A key delivered more than once counts once: its least row in the order of all compared
    columns stands for it.  Rows without a key take no part.  Texts and integers differ unless identical.
    """
    fields = [c for c in right.columns if c != key]
    types = {c: left.schema[c].dataType for c in (key, *fields)}

    cols = [f"_f{i}" for i in range(len(fields))]

    def side(df: DataFrame, n: int) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).select(F.col(key), *[F.col(c).cast(types[c]).alias(f"_f{i}") for i, c in enumerate(fields)])
        return rows.mapInArrow(_least_of_each(key, cols), rows.schema).withColumn("_side", F.lit(n))

    both = side(left, 0).unionByName(side(right, 1))
    ordered = both.repartitionByRange(shuffle_width(left.sparkSession), key).sortWithinPartitions(key, "_side", *cols)
    schema = T.StructType([T.StructField(key, types[key]), T.StructField("field", T.StringType())])
    names = (f"missing_in_{right_name}", f"missing_in_{left_name}")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        """``t`` holds whole keys, sorted by key and side."""
        k = t.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        s = t.column("_side").combine_chunks().to_numpy(zero_copy_only=False)
        head = np.ones(len(k), dtype=bool)
        head[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        rows = np.flatnonzero(head)
        ks, ss = k[rows], s[rows]
        paired = np.zeros(len(rows), dtype=bool)
        paired[:-1] = (ks[:-1] == ks[1:]) & (ss[:-1] != ss[1:])
        second = np.concatenate([[False], paired[:-1]])
        alone = ~paired & ~second
        keys_out, field_out = [ks[alone]], [np.array(names, dtype=object)[ss[alone]]]
        first_rows, second_rows = rows[paired], rows[second]
        for c, name in zip(cols, fields):
            col = t.column(c).combine_chunks()
            bad = _differs(col.take(pa.array(first_rows)), col.take(pa.array(second_rows)), tolerance)
            keys_out.append(ks[paired][bad])
            field_out.append(np.full(int(bad.sum()), name, dtype=object))
        out_k, out_f = np.concatenate(keys_out), np.concatenate(field_out)
        return pa.RecordBatch.from_arrays([pa.array(out_k, type=t.schema.field(key).type), pa.array(out_f, type=pa.string())], names=[key, "field"]) if len(out_k) else None

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            k = t.column(key)
            last = k[t.num_rows - 1]
            open_from = pc.index(pc.equal(k, last), True).as_py()
            tail = t.slice(open_from)
            # of the key still open only the first row of each side is kept, however often it was delivered
            s = tail.column("_side").combine_chunks().to_numpy(zero_copy_only=False)
            held = pa.concat_tables([tail.slice(int(np.argmax(s == v)), 1) for v in (0, 1) if (s == v).any()])
            if open_from and (out := compare(t.slice(0, open_from))):
                yield out
        if held is not None and (out := compare(held)):
            yield out

    return ordered.mapInArrow(merge, schema)
