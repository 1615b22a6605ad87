"""Genetic risk scores with strand and effect-allele handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import genotype as G
from panelforge.functions.text import decimal_number, strip
from panelforge.session import broadcast_if_small


def weight_rows(grsinput: DataFrame) -> DataFrame:
    """(name, varid, ea, eaf, wgt) of stored text weights: effect allele in upper case, blank or unreadable numbers are 0."""
    zero = lambda c: F.coalesce(decimal_number(F.col(c)), F.lit(0.0))
    return grsinput.select("name", F.lower(strip(F.col("varid"))).alias("varid"), F.upper(strip(F.col("ea"))).alias("ea"), zero("eaf").alias("eaf"), zero("wgt").alias("wgt"))


def scores(called: DataFrame, weights: DataFrame) -> DataFrame:
    """Per sample: variants counted, the score with changed sign where the effect allele is the reference one, and the score
    over copies of the effect allele.  Variants whose effect allele is neither allele are left out; a sample seen with
    nothing but missing genotypes has 0."""
    rows = called.join(broadcast_if_small(weights.select("rsid", "ea", "wgt")), "rsid").where(F.col("ea").isin(F.col("ref"), F.col("alt")))
    seen = ~F.col("gt").startswith(".")
    sign = F.when(F.col("ea") == F.col("ref"), -1.0).otherwise(1.0)
    value = lambda x: F.sum(F.when(seen, x * F.col("wgt")).otherwise(0.0))
    return rows.groupBy("sample_id").agg(F.count_if(seen).alias("snp_count"), value(G.dosage(F.col("gt")) * sign).alias("score_sign"), value(G.effect_dosage(F.col("gt"), F.col("alt"), F.col("ea"))).alias("score_flip"))


def strand_decisions(weights: DataFrame, local: DataFrame) -> DataFrame:
    """Each weight beside the local statistics of its variant (rsid, ref, alt, minor, maf): NOTFOUND, REJECT (no allele fits
    on either strand), FLIP or KEEP."""
    risk_freq = F.when(F.col("minor") == F.col("ref"), 1 - F.col("maf")).otherwise(F.col("maf"))
    rows = weights.join(local.select("rsid", "ref", "alt", "minor", "maf"), "rsid", "left")
    flip = G.should_flip(F.col("ea"), F.col("eaf"), F.col("alt"), F.col("ref"), risk_freq)
    decision = F.when(F.col("ref").isNull(), "NOTFOUND").when(~G.alleles_compatible(F.col("ea"), F.col("ref"), F.col("alt")), "REJECT").when(flip, "FLIP").otherwise("KEEP")
    return rows.select("rsid", "ea", "eaf", "wgt", "ref", "alt", decision.alias("decision"), F.when(decision == "FLIP", -F.col("wgt")).otherwise(F.col("wgt")).alias("signed_wgt"))


def strand_scores(called: DataFrame, decisions: DataFrame, flip_genotypes: bool = False) -> DataFrame:
    """Per sample: the score by the strand decisions (rejected variants left out), and whether at least half of the
    variants were seen (OUTPUT, else LOWCOUNT)."""
    usable = decisions.where("decision <> 'REJECT'")
    number = G.call_number(F.col("gt"))
    value = F.when(F.col("decision") == "FLIP", G.flipped(number)).otherwise(number) * F.col("wgt") if flip_genotypes else number * F.col("signed_wgt")
    rows = called.join(broadcast_if_small(usable.select("rsid", "decision", "wgt", "signed_wgt")), "rsid").where(number >= 0)
    per = rows.groupBy("sample_id").agg(F.count("*").alias("snp_count"), F.sum(value).alias("score"))
    size = F.lit(usable.count()).cast("long")
    return per.withColumn("n_weights", size).withColumn("status", completeness(F.col("snp_count"), size))


def completeness(n: Column, of: Column) -> Column:
    return F.when(n >= F.floor(of / 2), "OUTPUT").otherwise("LOWCOUNT")


def rejected_weights(called: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights whose effect allele is neither allele of the variant."""
    alleles = called.select("rsid", "ref", "alt").distinct()
    return alleles.join(broadcast_if_small(weights), "rsid").where(~F.col("ea").isin(F.col("ref"), F.col("alt"))).select("rsid", "ref", "alt", "ea")
