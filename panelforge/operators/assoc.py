"""Single-variant association of combined genotypes with stored phenotypes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.functions import genotype as G
from panelforge.session import broadcast_if_small


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p value of Student's t."""
    if not df > 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1.0) / (a + b + 2.0) else 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def t_p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, df in batches:
        yield pd.Series(np.fromiter((t_two_sided(x, y) for x, y in zip(t, df)), dtype=float, count=len(t)))


@F.pandas_udf(DoubleType())
def chi_square_1df(x: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(math.sqrt(max(v, 0.0) / 2.0)) if v == v else math.nan for v in x])


def joined(cells: DataFrame, pheno: DataFrame, value: str) -> DataFrame:
    """Called genotypes beside the phenotype of their sample."""
    p = pheno.select(F.col("iid").alias("sample_id"), F.col(value).cast("double").alias("y")).where("y is not null")
    return cells.where(G.call_number(F.col("gt")) >= 0).withColumn("x", G.call_number(F.col("gt")).cast("double")).join(broadcast_if_small(p), "sample_id")


def linear(rows: DataFrame, key: str = "rsid") -> DataFrame:
    """Additive linear regression of y on the number of alternative alleles, per variant."""
    fit = rows.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    df = F.col("n") - 2
    t = F.when((df > 0) & (F.col("r2") < 1), F.signum("beta") * F.sqrt(F.col("r2") * df / (1 - F.col("r2"))))
    return fit.withColumn("t", t).withColumn("p_value", F.when(F.col("t").isNotNull(), t_p_value(F.coalesce("t", F.lit(float("nan"))), df.cast("double"))))


def allelic(rows: DataFrame, key: str = "rsid") -> DataFrame:
    """Allele counts in cases (y = 1) and controls (y = 0): odds ratio and chi-square of the two-by-two table."""
    case, x = F.col("y") == 1, F.col("x")
    counts: dict[str, Column] = {"case_alt": F.when(case, x), "case_ref": F.when(case, 2 - x), "control_alt": F.when(~case, x), "control_ref": F.when(~case, 2 - x)}
    t = rows.groupBy(key).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).cast("long").alias(k) for k, v in counts.items()])
    a, b, c, d = (F.col(k).cast("double") for k in counts)
    n, cross = a + b + c + d, a * d - b * c
    stat = F.try_divide(n * cross * cross, (a + b) * (c + d) * (a + c) * (b + d))
    t = t.withColumn("odds_ratio", F.try_divide(a * d, b * c)).withColumn("chi_square", stat)
    return t.withColumn("p_value", F.when(F.col("chi_square").isNotNull(), chi_square_1df(F.coalesce("chi_square", F.lit(float("nan"))))))


def associate(cells: DataFrame, pheno: DataFrame, value: str, phenoclass: str) -> DataFrame:
    """The test of the phenotype's class: Binary allelic, Continuous linear."""
    rows = joined(cells, pheno, value)
    return allelic(rows) if phenoclass == "Binary" else linear(rows)
