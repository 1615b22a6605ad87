"""Equi-joins where a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import broadcast_if_small

SALT = "_salt"


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = 50_000) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``; a key with more than ``hot_rows`` rows on the left is split into parts of
    about that size by a hash of the left row, and the right rows of such keys are handed to every part.

    ``how`` is inner or left.  Keys that are not hot are joined as ever; the result is the same in any case.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    spread = [c for c in left.columns if c not in keys] or list(keys)
    counted = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    parts = broadcast_if_small(counted.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")))
    one = F.coalesce(F.col("_parts"), F.lit(1))
    a = left.join(parts, keys, "left").withColumn(SALT, F.pmod(F.xxhash64(*spread), one).cast("int")).drop("_parts")
    b = right.join(parts, keys, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return a.join(b, [*keys, SALT], how).drop(SALT)
