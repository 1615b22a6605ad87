"""References to records that do not exist, no longer exist or came later.

Method: the parents' keys are split into (space, integer); within a space the sorted integers are compressed into
contiguous runs, references are as-of matched to the preceding run start, and those beyond its end are orphans.  A key
inside a run is then as-of matched on time against the merged validity periods of that key: before the first period
the parent came later, beyond the end of the preceding period it was gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import id_tokens, key_number, key_space, panel
from panelforge.operators.ordered import asof_match, interval_pieces, merge_intervals

FOREVER = 2**62
SPACE = ["tab", "space"]
KEY = ["tab", "space", "num"]


def micros(c: str):
    """Timestamp (with or without zone) as microseconds."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def parent_keys(variants: DataFrame) -> DataFrame:
    """(tab, space, num, valid_from, valid_to) of every key ``variants`` answers to: each id of a comma-separated rsid
    for ``grsinput``, the panel for ``filepaths``.  A row without loaded_at, or retired before it was loaded, is never
    valid; valid_to is exclusive."""
    keys = F.array_union(
        F.transform(F.coalesce(id_tokens(F.col("rsid")), F.array().cast("array<string>")), lambda k: F.struct(F.lit("grsinput").alias("tab"), k.alias("key"))),
        F.when(panel(F.col("assaytype")).isNotNull(), F.array(F.struct(F.lit("filepaths").alias("tab"), panel(F.col("assaytype")).alias("key")))).otherwise(F.array().cast("array<struct<tab:string,key:string>>")),
    )
    rows = variants.select(F.explode(keys).alias("k"), micros("loaded_at").alias("valid_from"), F.coalesce(micros("retired_at") + 1, F.lit(FOREVER)).alias("valid_to"))
    return (
        rows.where("valid_from < valid_to")
        .groupBy(F.col("k.tab").alias("tab"), F.col("k.key").alias("key"), "valid_to")
        .agg(F.min("valid_from").alias("valid_from"))
        .select("tab", key_space(F.col("key")).alias("space"), key_number(F.col("key")).alias("num"), "valid_from", "valid_to")
    )


def references(grsinput: DataFrame, filepaths: DataFrame) -> DataFrame:
    """(tab, row_id, space, num, at, month) of every filled reference."""
    a = grsinput.select(F.lit("grsinput").alias("tab"), F.col("grs_id").alias("row_id"), panel(F.col("varid")).alias("key"), "loaded_at")
    b = filepaths.select(F.lit("filepaths").alias("tab"), F.col("path_id").alias("row_id"), panel(F.col("assaytype")).alias("key"), "loaded_at")
    return a.unionByName(b).where(F.col("key").isNotNull()).select("tab", "row_id", "key", key_space(F.col("key")).alias("space"), key_number(F.col("key")).alias("num"), micros("loaded_at").alias("at"), F.date_format("loaded_at", "yyyy-MM").alias("month"))


def orphans(variants: DataFrame, grsinput: DataFrame, filepaths: DataFrame) -> DataFrame:
    """(tab, row_id, key, month, reason) of every orphan; reason is ``unknown`` (no parent ever had the key), ``later``
    (the parent was loaded after the reference), ``retired`` or ``undated`` (the reference has no loaded_at, so nothing
    can be shown to have answered it).  Empty tables give no rows; extra columns are ignored."""
    parents = parent_keys(variants)
    refs = references(grsinput, filepaths)
    runs = merge_intervals(interval_pieces(parents.select(*KEY, (F.col("num") + 1).alias("next")), SPACE, "num", "next"), SPACE)
    placed = asof_match(refs, runs, SPACE, "num", "lo", "hi", "row_id")
    known = F.coalesce(F.col("num") < F.col("match_until"), F.lit(False))
    unknown = placed.where(~known).withColumn("reason", F.when(F.col("at").isNull(), "undated").otherwise("unknown"))
    inside = placed.where(known).drop("match_since", "match_until")

    periods = merge_intervals(interval_pieces(parents, KEY, "valid_from", "valid_to"), KEY)
    timed = asof_match(inside.where("at is not null"), periods, KEY, "at", "lo", "hi", "row_id")
    outside = timed.where(~F.coalesce(F.col("at") < F.col("match_until"), F.lit(False))).withColumn("reason", F.when(F.col("match_until").isNull(), "later").otherwise("retired"))
    undated = inside.where("at is null").withColumn("reason", F.lit("undated"))
    cols = ["tab", "row_id", "key", "month", "reason"]
    return unknown.select(*cols).unionByName(outside.select(*cols)).unionByName(undated.select(*cols))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month of loaded_at and reason."""
    return found.groupBy("tab", "month", "reason").agg(F.count("*").alias("n_orphans"), F.count_distinct("key").alias("n_keys"))
