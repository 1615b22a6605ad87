"""Quality-control filter of records with independently counted reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import broadcast_if_small

REASONS = ("posn", "maf", "hwe", "cr", "info", "maffactor", "dot", "nocall")


def qc_flags(metrics: DataFrame, excluded: DataFrame | None = None, maf: float = 0.05, hwe: float = 1e-6, cr: float = 0.9, info: float = 0.9, maffactor: float = 0.0) -> DataFrame:
    """Adds a column ``bad_<reason>`` for each reason to reject a record, and ``passes``.

    ``excluded`` holds positions to reject.  ``nocall`` marks records without any called genotype, whose metrics are null.
    """
    c = F.col
    if excluded is None:
        rows = metrics.withColumn("bad_posn", F.lit(False))
    else:
        listed = broadcast_if_small(excluded.select(c("position").alias("_x")).distinct())
        rows = metrics.join(listed, c("position") == c("_x"), "left").withColumn("bad_posn", c("_x").isNotNull()).drop("_x")
    far = (c("maf") < c("ref_maf") / maffactor) | (c("maf") > c("ref_maf") * maffactor) if maffactor else F.lit(False)
    tests = {"maf": c("maf") < maf, "hwe": c("hwep") < hwe, "cr": c("cr") < cr, "info": c("info") < info, "maffactor": far, "dot": c("rsid") == ".", "nocall": c("n") == 0}
    rows = rows.withColumns({f"bad_{k}": F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    return rows.withColumn("passes", ~F.greatest(*[c(f"bad_{k}") for k in REASONS]))


def qc_filter(flagged: DataFrame) -> DataFrame:
    return flagged.where("passes").drop("passes", *[f"bad_{k}" for k in REASONS])


def qc_report(flagged: DataFrame, *keys: str) -> DataFrame:
    """Records read, written and rejected by each reason."""
    return flagged.groupBy(*keys).agg(F.count("*").alias("n_read"), F.count_if("passes").alias("n_written"), *[F.count_if(f"bad_{k}").alias(f"n_{k}") for k in REASONS])
