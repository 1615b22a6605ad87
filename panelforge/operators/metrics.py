"""Quality metrics of genotype records, in long form (rows of called genotypes) and in array form (one row per record)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import genotype as G


def with_calls(long: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Adds ``p`` (greatest probability), ``gt`` (call), ``dosage``."""
    return long.withColumn("p", G.top_probability(F.col("probs"))).withColumn("gt", G.call(F.col("probs"), threshold)).withColumn("dosage", G.dosage(F.col("gt")))


def call_counts(called: DataFrame, *keys: str) -> DataFrame:
    """Genotypes by call for each record ``keys``; one combining aggregation."""
    gt = F.col("gt")
    return called.groupBy(*keys).agg(
        F.count_if(gt == "0/0").alias("homref"), F.count_if(gt.isin("0/1", "1/0")).alias("het"), F.count_if(gt == "1/1").alias("homalt"), F.count_if(gt == "./.").alias("miss"), F.count_if(gt != ".").alias("alln"), F.count_if(gt == ".").alias("dot")
    )


def array_counts(records: DataFrame, calls: str = "calls") -> DataFrame:
    """The same from an array of calls per record, without a shuffle."""
    n = lambda *v: F.size(F.filter(calls, lambda x: x.isin(*v))).cast("long")
    return records.withColumns({"homref": n("0/0"), "het": n("0/1", "1/0"), "homalt": n("1/1"), "miss": n("./."), "dot": n("."), "alln": F.size(F.filter(calls, lambda x: x != ".")).cast("long")})


def record_metrics(counts: DataFrame) -> DataFrame:
    """Adds call rate, allele frequencies, minor allele frequency, the exact Hardy-Weinberg p value and the homozygote counts
    by frequency.  A record without any called genotype has null metrics."""
    c = F.col
    called = c("homref") + c("het") + c("homalt")
    rows = counts.withColumn("n", c("alln") - c("miss")).withColumn("cr", F.try_divide(called, c("alln")))
    rows = rows.withColumn("raf", F.try_divide(2 * c("homref") + c("het"), 2 * c("n"))).withColumn("aaf", F.try_divide(2 * c("homalt") + c("het"), 2 * c("n")))
    return rows.withColumns({"maf": F.least("raf", "aaf"), "hwep": G.hardy_weinberg(c("het"), c("homref"), c("homalt")), "hom_common": F.greatest("homref", "homalt"), "hom_rare": F.least("homref", "homalt")})


def minor_allele(ref: Column, alt: Column) -> Column:
    """The rarer allele by homozygotes, the alternative one if equal."""
    return F.when(F.col("homref") < F.col("homalt"), ref).otherwise(alt)


def chi_square_concordance(counts: DataFrame, key: str, order: str, limit: float = 1e-8) -> DataFrame:
    """Genotype counts of each further record of ``key`` against those of its first (by ``order``), each plus one: the
    statistic, its p value (two degrees of freedom) and whether it is concordant."""
    first = counts.groupBy(key).agg(F.min_by(F.struct(order, "homref", "het", "homalt"), order).alias("_f"))
    rows = counts.join(first, key).where(F.col(order) > F.col(f"_f.{order}"))
    stat = sum((F.pow(F.col(f"_f.{c}") - F.col(c), F.lit(2)) / (F.col(c) + 1) for c in ("homref", "het", "homalt")), F.lit(0.0))
    rows = rows.withColumn("chi_square", stat).withColumn("p_value", G.chi_square_2df(stat))
    return rows.select(key, F.col(f"_f.{order}").alias("first_panel"), F.col(order).alias("panel"), "chi_square", "p_value", (F.col("p_value") >= limit).alias("concordant"))


def file_totals(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.count("*").alias("n_records"), *[F.sum(c).alias(c) for c in ("homref", "het", "homalt", "miss", "dot")])
