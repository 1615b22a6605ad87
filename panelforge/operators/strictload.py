"""Rows that fail to parse, apart from the rows that load.

Method: a strict load takes only conforming lines and keeps their offsets; an anti-join subtracts the loaded offsets from
the raw ones; only the remainder is diagnosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import NUMBER, decimal_number, strip
from panelforge.operators.eav import attribute_name, is_missing, readable_value
from panelforge.session import broadcast_if_small, cut

#: One comma-separated field: without any double quote, or wholly in double quotes (a quote inside is doubled).
FIELD = r'([^",]*|"(?:[^"]|"")*")'
BOUNDS = ("txstart", "txend", "cdsstart", "cdsend", "exoncount")


def _body(line: Column) -> Column:
    """The line without the carriage return at its end."""
    return F.regexp_replace(line, r"\r$", "")


def content_lines(raw: DataFrame) -> DataFrame:
    """The lines that are to be loaded: null and blank lines and those starting with ``#`` are skipped."""
    return raw.where(F.col("line").isNotNull() & (strip(F.col("line")) != "") & ~F.col("line").startswith("#")).select("line_id", "feed", "file_name", "line_no", _body(F.col("line")).alias("body"))


def _csv(lines: DataFrame, names: list[str]) -> DataFrame:
    """The lines that have exactly these fields, all well quoted, as (line_id, *names), unquoted."""
    pattern = "^" + ",".join([FIELD] * len(names)) + "$"
    raw = lines.where(F.col("body").rlike(pattern)).select("line_id", *[F.regexp_extract("body", pattern, i + 1).alias(c) for i, c in enumerate(names)])
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return raw.select("line_id", *[F.when(F.startswith(c, F.lit('"')), inner(F.col(c))).otherwise(F.col(c)).alias(c) for c in names])


def load_genemap(lines: DataFrame) -> DataFrame:
    f = F.split(strip(F.col("body")), r"[\s ]+")
    rows = lines.where("feed = 'genemap'").withColumn("_f", f).where(F.size("_f") == 11)
    number = lambda i: F.when(F.col("_f")[i].rlike("^[0-9]+$"), F.col("_f")[i]).try_cast("int")
    names = ("genename", "name", "chrom", "strand")
    rows = rows.select("line_id", *[F.col("_f")[i].alias(c) for i, c in enumerate(names)], *[number(i + 4).alias(c) for i, c in enumerate(BOUNDS)], F.col("_f")[9].alias("_es"), F.col("_f")[10].alias("_ee"))
    exons = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return rows.where(F.col("strand").isin("+", "-") & (F.col("txstart") <= F.col("txend"))).dropna(subset=list(BOUNDS)).select("line_id", *names, *BOUNDS, exons(F.col("_es")).alias("exonstarts"), exons(F.col("_ee")).alias("exonends"))


def load_pheno(lines: DataFrame, meta: DataFrame) -> DataFrame:
    known = meta.select(attribute_name(F.col("name")).alias("_n"), "phenoclass", "unit").dropDuplicates(["_n"])
    rows = _csv(lines.where("feed = 'pheno'"), ["iid", "name", "value"])
    rows = rows.withColumn("_n", attribute_name(F.col("name"))).join(broadcast_if_small(known, 10_000), "_n", "left")
    rows = rows.withColumn("number", F.when(F.col("phenoclass").isNotNull(), readable_value(F.col("value"), F.col("phenoclass"), F.col("unit"))))
    return rows.where(is_missing(F.col("value")) | F.col("number").isNotNull()).select("line_id", "iid", "name", "value", "number")


def load_grsinput(lines: DataFrame) -> DataFrame:
    rows = _csv(lines.where("feed = 'grsinput'"), ["varid", "ea", "eaf", "wgt"])
    rows = rows.select("line_id", "varid", "ea", strip(F.col("eaf")).alias("_eaf"), decimal_number(F.col("eaf")).alias("eaf"), decimal_number(F.col("wgt")).alias("wgt"))
    return rows.where(F.col("wgt").isNotNull() & ((F.col("_eaf") == "") | F.col("eaf").between(0.0, 1.0))).drop("_eaf")


def rejected(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """(line_id, feed, file_name, line_no, reason, line) of every line that cannot be loaded.

    ``feed`` other than the three known ones (or null) is rejected as ``unknown feed``; an empty table gives no rows.
    """
    lines = content_lines(raw)
    loaded = load_genemap(lines).select("line_id").unionByName(load_pheno(lines, meta).select("line_id")).unionByName(load_grsinput(lines).select("line_id"))
    # offsets are subtracted from offsets; only the text of what remains is looked at again
    rest = cut(lines.select("line_id").join(loaded, "line_id", "left_anti"))
    return diagnose(lines.join(broadcast_if_small(rest), "line_id", "left_semi")).select("line_id", "feed", "file_name", "line_no", "reason", F.col("body").alias("line"))


def diagnose(faulty: DataFrame) -> DataFrame:
    """``faulty`` lines with the first reason that holds for each."""
    body, feed, n = F.col("body"), F.col("feed"), F.size("_f")
    rows = faulty.withColumn("_f", F.split(strip(body), r"[\s\u00a0]+")).withColumn("_c", F.split(body, ","))
    strict = "^" + FIELD + "(," + FIELD + ")*$"
    rows = rows.withColumn("_well", body.rlike(strict)).withColumn("_wgt", strip(F.replace(F.element_at("_c", -1), F.lit('"'), F.lit("")))).withColumn("_eaf", strip(F.replace(F.get("_c", F.lit(2)), F.lit('"'), F.lit(""))))
    number = lambda i: F.get("_f", F.lit(i))
    genemap = F.when(n != 11, F.concat(F.lit("field count "), n)).when(~number(3).isin("+", "-"), "strand")
    for i, c in enumerate(BOUNDS):
        genemap = genemap.when(~number(i + 4).rlike("^[0-9]+$"), f"{c} not a number").when(number(i + 4).try_cast("int").isNull(), f"{c} out of range")
    genemap = genemap.otherwise("txstart above txend")
    three, four = ("^" + ",".join([FIELD] * k) + "$" for k in (3, 4))
    pheno = F.when(~F.col("_well"), "quoting").when(~body.rlike(three), "field count").otherwise("value not readable for its name")
    grs = (
        F.when(~F.col("_well"), "quoting")
        .when(~body.rlike(four), "field count")
        .when(F.col("_wgt") == "", "wgt missing")
        .when(~F.col("_wgt").rlike(f"^{NUMBER}$"), "wgt not a number")
        .when(F.col("_wgt").try_cast("double").isin(float("inf"), float("-inf")), "wgt not finite")
        .when(~F.col("_eaf").rlike(f"^{NUMBER}$"), "eaf not a number")
        .otherwise("eaf out of range")
    )
    return rows.withColumn("reason", F.when(feed == "genemap", genemap).when(feed == "pheno", pheno).when(feed == "grsinput", grs).otherwise("unknown feed"))


def load_summary(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """Lines per feed: content lines, rejected, loaded."""
    bad = rejected(raw, meta).groupBy("feed").agg(F.count("*").alias("n_rejected"))
    return content_lines(raw).groupBy("feed").agg(F.count("*").alias("n_lines")).join(bad, "feed", "left").select("feed", "n_lines", F.coalesce("n_rejected", F.lit(0).cast("long")).alias("n_rejected")).withColumn("n_loaded", F.col("n_lines") - F.col("n_rejected"))
