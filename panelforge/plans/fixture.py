"""Genotype data derived from the given order tables, once as a DataFrame and once as a DuckDB prefix.

Every line item becomes a genotype of a sample (its customer) for a variant (its part) on a panel (its supplier); one row
per (panel, variant, sample) is kept, the first in the order of its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.session import table

ASSAYS = ("affy", "broad", "exome", "illumina", "metabo")


def genotypes(s: SparkSession, d: str) -> DataFrame:
    """Long form: one row per (panel, variant, sample) with the three call probabilities."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    keyed = li.join(o, "l_orderkey").select(
        (F.col("l_suppkey") % 5).cast("int").alias("assay_no"),
        (F.col("l_partkey") % 60 + 60 * F.floor(F.col("l_partkey") / 2000)).cast("int").alias("variant_no"),
        (F.col("o_custkey") % 200).cast("int").alias("sample_no"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").alias("row"),
    )
    first = keyed.groupBy("assay_no", "variant_no", "sample_no").agg(F.min("row").alias("row"))
    v, a = F.col("variant_no"), F.col("assay_no")
    r = (F.col("row.l_orderkey") * 31 + F.col("row.l_linenumber") * 17 + F.col("row.l_partkey") * 7) % 100
    pm = 880 + 12 * F.round(F.col("row.l_discount") * 100).cast("int")
    rows = first.select("assay_no", "variant_no", "sample_no", r.alias("r"), (10 + (v * 13) % 40).alias("q"), pm.alias("pm"))
    q = F.col("q")
    k = F.when(F.col("r") * 100 < (100 - q) * (100 - q), 0).when(F.col("r") * 100 < (100 - q) * (100 - q) + 2 * q * (100 - q), 1).otherwise(2)
    rows = rows.withColumn("k", k).withColumn("hi", F.col("pm") / 1000.0).withColumn("lo", (1000 - F.col("pm")) / 2000.0)
    swapped = (a == 3) & (v % 17 == 5)
    ref = F.get(F.array(*map(F.lit, "ACAC")), v % 4)
    alt = F.get(F.array(*map(F.lit, "GTTG")), v % 4)
    return rows.select(
        "assay_no", F.get(F.array(*map(F.lit, ASSAYS)), a).alias("assaytype"), "variant_no", F.concat(F.lit("rs"), (1000 + v).cast("string")).alias("rsid"), F.lpad((1 + v % 22).cast("string"), 2, "0").alias("chromosome"), (1000000 + 1000 * v).cast("int").alias("position"),
        F.when(swapped, alt).otherwise(ref).alias("ref"), F.when(swapped, ref).otherwise(alt).alias("alt"), F.when(a.isin(2, 4), 1.0).otherwise(0.5 + ((v * 7 + a * 11) % 50) / 100.0).alias("info"),
        F.lpad(F.col("sample_no").cast("string"), 6, "0").alias("sample_id"), F.array(*[F.when(F.col("k") == i, F.col("hi")).otherwise(F.col("lo")) for i in range(3)]).alias("probs"),
    )


def catalogue(s: SparkSession, d: str) -> DataFrame:
    """One row per (panel, variant) of the derived genotypes."""
    return genotypes(s, d).groupBy("assay_no", "assaytype", "variant_no", "rsid", "chromosome", "position", "ref", "alt", "info").agg(F.count("*").alias("n_samples")).withColumn("ref_maf", (10 + (F.col("variant_no") * 13) % 40) / 100.0)


def sample_registry(s: SparkSession, d: str) -> DataFrame:
    """(assaytype, sample_id, list_posn): the 0-based column of each sample in its panel's call file.  Small: samples, not
    genotypes, are numbered within a panel."""
    w = Window.partitionBy("assaytype").orderBy("sample_id")
    return genotypes(s, d).select("assaytype", "sample_id").distinct().withColumn("list_posn", F.row_number().over(w) - 1)


def weights(s: SparkSession, d: str) -> DataFrame:
    """Risk-score weights: every third variant, effect allele the alternative one for even numbers."""
    v = F.col("variant_no")
    base = genotypes(s, d).select("variant_no", "rsid").distinct().where(v % 3 == 0)
    ref, alt = F.get(F.array(*map(F.lit, "ACAC")), v % 4), F.get(F.array(*map(F.lit, "GTTG")), v % 4)
    return base.select("rsid", F.when(v % 2 == 0, alt).otherwise(ref).alias("ea"), ((10 + (v * 13) % 40) / 100.0).alias("eaf"), (((v % 21) - 10) / 100.0).alias("wgt"))


def phenotypes(s: SparkSession, d: str) -> DataFrame:
    """Per sample: a continuous value (mean order price) and a binary one."""
    o = table(s, d, "orders").select((F.col("o_custkey") % 200).cast("int").alias("sample_no"), "o_totalprice")
    return o.groupBy("sample_no").agg(F.round(F.avg("o_totalprice"), 2).alias("continuous")).select(F.lpad(F.col("sample_no").cast("string"), 6, "0").alias("iid"), "continuous", F.when(F.col("sample_no") % 3 == 0, 1).otherwise(0).alias("binary"))


SQL = """
WITH first_ AS (
  SELECT l_suppkey % 5 AS assay_no, (l_partkey % 60) + 60 * (l_partkey // 2000) AS variant_no, o_custkey % 200 AS sample_no, l_orderkey, l_linenumber, l_partkey, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY l_suppkey % 5, (l_partkey % 60) + 60 * (l_partkey // 2000), o_custkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1),
made AS (SELECT *, (l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 100 AS r, 10 + (variant_no * 13) % 40 AS q, 880 + 12 * round(l_discount * 100)::INT AS pm FROM first_),
called AS (SELECT *, CASE WHEN r * 100 < (100 - q) * (100 - q) THEN 0 WHEN r * 100 < (100 - q) * (100 - q) + 2 * q * (100 - q) THEN 1 ELSE 2 END AS k, pm / 1000.0::DOUBLE AS hi, (1000 - pm) / 2000.0::DOUBLE AS lo,
  ['A', 'C', 'A', 'C'][variant_no % 4 + 1] AS ref0, ['G', 'T', 'T', 'G'][variant_no % 4 + 1] AS alt0, assay_no = 3 AND variant_no % 17 = 5 AS swapped FROM made),
g AS (SELECT assay_no, ['affy', 'broad', 'exome', 'illumina', 'metabo'][assay_no + 1] AS assaytype, variant_no, 'rs' || (1000 + variant_no) AS rsid, lpad((1 + variant_no % 22)::VARCHAR, 2, '0') AS chromosome,
  (1000000 + 1000 * variant_no)::INT AS position, CASE WHEN swapped THEN alt0 ELSE ref0 END AS ref, CASE WHEN swapped THEN ref0 ELSE alt0 END AS alt,
  CASE WHEN assay_no IN (2, 4) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE + ((variant_no * 7 + assay_no * 11) % 50) / 100.0::DOUBLE END AS info, lpad(sample_no::VARCHAR, 6, '0') AS sample_id,
  k, hi, lo, CASE WHEN k = 0 THEN hi ELSE lo END AS p0, CASE WHEN k = 1 THEN hi ELSE lo END AS p1, CASE WHEN k = 2 THEN hi ELSE lo END AS p2, CASE WHEN hi >= 0.9::DOUBLE THEN ['0/0', '0/1', '1/1'][k + 1] ELSE './.' END AS gt FROM called),
samples AS (SELECT assaytype, sample_id, row_number() OVER (PARTITION BY assaytype ORDER BY sample_id) - 1 AS list_posn FROM (SELECT DISTINCT assaytype, sample_id FROM g)),
weights AS (SELECT DISTINCT rsid, CASE WHEN variant_no % 2 = 0 THEN ['G', 'T', 'T', 'G'][variant_no % 4 + 1] ELSE ['A', 'C', 'A', 'C'][variant_no % 4 + 1] END AS ea,
  (10 + (variant_no * 13) % 40) / 100.0::DOUBLE AS eaf, ((variant_no % 21) - 10) / 100.0::DOUBLE AS wgt FROM g WHERE variant_no % 3 = 0),
phenotypes AS (SELECT lpad((o_custkey % 200)::VARCHAR, 6, '0') AS iid, round(avg(o_totalprice), 2) AS continuous, CASE WHEN o_custkey % 200 % 3 = 0 THEN 1 ELSE 0 END AS "binary" FROM orders GROUP BY o_custkey % 200)
"""
