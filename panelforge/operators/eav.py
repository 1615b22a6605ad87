"""Entity, attribute, value rows into one typed row per entity.

Method: the readable values of each cell (entity, attribute) are resolved, each entity's cells are gathered into a
key-value map, and the known keys are projected into typed columns; unreadable values are kept beside them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import strip
from panelforge.session import broadcast_if_small

#: Fixed values of the input format.
MISSING = ("", "na", "n/a", "null", "missing", ".", "-9")
TRUE_WORDS = ("1", "yes", "y", "true", "case")
FALSE_WORDS = ("0", "no", "n", "false", "control")

NUMBER = r"[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?"


def attribute_name(c: Column) -> Column:
    """Names match without regard to case, outer blanks and whether space, hyphen or underscore separates."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s_-]+", "_")


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(strip(value)).isin(*MISSING)


def readable_value(value: Column, phenoclass: Column, unit: Column) -> Column:
    """The value as double (Binary: 1 or 0); null for missing markers and for anything that is no value of the class.

    Continuous: a number with point or comma, sign, exponent, outer blanks or the attribute's own unit behind it.
    """
    t = F.lower(strip(value))
    number, rest = F.regexp_extract(t, f"^({NUMBER})", 1), F.regexp_replace(t, f"^{NUMBER}", "")
    d = F.when((number != "") & ((rest == "") | (strip(rest) == F.lower(strip(unit)))), F.replace(number, F.lit(","), F.lit("."))).try_cast("double")
    continuous = F.when(F.abs(d) < float("inf"), d + F.lit(0.0))
    binary = F.when(t.isin(*TRUE_WORDS), F.lit(1.0)).when(t.isin(*FALSE_WORDS), F.lit(0.0))
    return F.when(is_missing(value), F.lit(None).cast("double")).when(phenoclass == "Binary", binary).otherwise(continuous)


def _readings(pheno: DataFrame, meta: DataFrame) -> DataFrame:
    """(iid, name, _raw, _v, _m, _o, loaded_at): the rows of known attributes with what they read as."""
    known = meta.select(attribute_name(F.col("name")).alias("_n"), F.col("name"), F.col("phenoclass"), F.col("unit")).dropDuplicates(["_n"])
    rows = pheno.where(F.col("iid").isNotNull()).select("iid", attribute_name(F.col("name")).alias("_n"), F.col("value").alias("_raw"), "obs_at", "loaded_at")
    rows = rows.join(broadcast_if_small(known, 10_000), "_n")
    v = readable_value(F.col("_raw"), F.col("phenoclass"), F.col("unit"))
    return rows.select("iid", "name", "_raw", v.alias("_v"), is_missing(F.col("_raw")).alias("_m"), F.when(F.col("obs_at") <= F.coalesce("loaded_at", "obs_at"), F.col("obs_at")).alias("_o"), "loaded_at")


def cast_failures(pheno: DataFrame, meta: DataFrame) -> DataFrame:
    """(iid, name, raw, n_rows, first_loaded, last_loaded): every unreadable text of a cell, with how often and when it came.
    Copies are counted before the shuffle; texts are never gathered into one row."""
    rows = _readings(pheno, meta).where(F.col("_v").isNull() & ~F.col("_m"))
    return rows.groupBy("iid", "name", F.col("_raw").alias("raw")).agg(F.count("*").alias("n_rows"), F.min("loaded_at").alias("first_loaded"), F.max("loaded_at").alias("last_loaded"))


def cells(pheno: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per (iid, name) of a known attribute:

    ``value`` the resolved value: of the readable ones the latest observed, then the latest loaded, then the greatest (a
    missing obs_at, or one after loaded_at, counts as oldest); ``n_rows``, ``n_missing``, ``n_failed``; ``failed`` the least of
    the unreadable texts (``cast_failures`` has them all); ``lowest`` and ``highest`` readable value, so a cell is contradictory if they differ.
    Rows with a null iid or an unknown or null name are no cells.
    """
    rows = _readings(pheno, meta)
    failed = F.col("_v").isNull() & ~F.col("_m")
    # everything here combines before the shuffle, so an entity with a tenth of all rows sends one row per cell and task
    return rows.groupBy("iid", "name").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(F.col("_o").isNotNull(), "_o", "loaded_at", "_v"))).alias("value"),
        F.count("*").alias("n_rows"),
        F.count_if("_m").alias("n_missing"),
        F.count_if(failed).alias("n_failed"),
        F.min(F.when(failed, F.col("_raw"))).alias("failed"),
        F.min("_v").alias("lowest"),
        F.max("_v").alias("highest"),
    )


def _column_name(name: str, taken: set[str]) -> str:
    c = re.sub(r"\W", "_", name)
    while c in taken:
        c += "_"
    taken.add(c)
    return c


def wide(pheno: DataFrame, meta: DataFrame, max_attributes: int = 2_000) -> DataFrame:
    """One row per iid with at least one cell: a typed column per attribute of ``meta`` (double for Continuous, boolean
    for Binary), ``conflicts`` (names of cells with two or more different values) and ``cast_failures`` (name to the
    number of unreadable rows and the least of their texts; all of them are rows of ``cast_failures()``).  The attributes become columns of the plan, so more than ``max_attributes`` raise an error."""
    attributes = meta.select("name", "phenoclass").dropDuplicates(["name"]).orderBy("name").limit(max_attributes + 1).collect()
    if len(attributes) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes")
    per_entity = (
        cells(pheno, meta)
        .groupBy("iid")
        .agg(F.collect_list(F.struct("name", "value", "n_failed", "failed", (F.col("lowest") < F.col("highest")).alias("conflict"))).alias("_c"))
        .select(
            "iid",
            F.map_from_entries(F.transform(F.filter("_c", lambda c: c["value"].isNotNull()), lambda c: F.struct(c["name"], c["value"]))).alias("_kv"),
            F.array_sort(F.transform(F.filter("_c", lambda c: F.coalesce(c["conflict"], F.lit(False))), lambda c: c["name"])).alias("conflicts"),
            F.map_from_entries(F.transform(F.filter("_c", lambda c: c["failed"].isNotNull()), lambda c: F.struct(c["name"], F.struct(c["n_failed"].alias("n"), c["failed"].alias("least"))))).alias("cast_failures"),
        )
    )
    taken = {"iid", "conflicts", "cast_failures"}
    typed = [(F.col("_kv")[r["name"]] == 1.0 if r["phenoclass"] == "Binary" else F.col("_kv")[r["name"]]).alias(_column_name(r["name"], taken)) for r in attributes]
    return per_entity.select("iid", *typed, "conflicts", "cast_failures")


def contradictory_cells(wide_rows: DataFrame) -> DataFrame:
    """(iid, name) of the cells to which the rows give two or more different values."""
    return wide_rows.select("iid", F.explode("conflicts").alias("name"))


def failure_report(pheno: DataFrame, meta: DataFrame) -> DataFrame:
    """Per attribute: cells, rows, missing markers, unreadable values and contradictory cells."""
    counts = [F.sum(c).alias(c) for c in ("n_rows", "n_missing", "n_failed")]
    return cells(pheno, meta).groupBy("name").agg(F.count("*").alias("n_cells"), *counts, F.count_if(F.col("lowest") < F.col("highest")).alias("n_conflicts"))


