"""Overlapping, nested and gapped intervals per entity: the stretches they cover and the gaps between.

Method: global range sort by entity and start, maximum-end summaries per partition, prefix combination of the
summaries, and a second scan with carried state (``operators.ordered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import gene_chromosome, strip
from panelforge.operators.ordered import interval_gaps, interval_pieces, merge_intervals


def gene_intervals(genemap: DataFrame) -> DataFrame:
    """Transcript bounds by (genename, chrom) in one spelling.  A null or blank gene name or chromosome is no
    entity; rows with a null bound or txstart not below txend are no intervals (left to ``interval_pieces``)."""
    return genemap.select(
        F.nullif(F.upper(strip(F.col("genename"))), F.lit("")).alias("genename"),
        gene_chromosome(F.col("chrom")).alias("chrom"),
        F.col("txstart").cast("long").alias("txstart"),
        F.col("txend").cast("long").alias("txend"),
    )


def gene_coverage(genemap: DataFrame) -> DataFrame:
    """(genename, chrom, kind, lo, hi): pieces and gaps of every gene, for the two functions below."""
    return interval_pieces(gene_intervals(genemap), ["genename", "chrom"], "txstart", "txend")


def gene_stretches(genemap: DataFrame) -> DataFrame:
    return merge_intervals(gene_coverage(genemap), ["genename", "chrom"]).select("genename", "chrom", F.col("lo").alias("stretch_start"), F.col("hi").alias("stretch_end"))


def gene_gaps(genemap: DataFrame) -> DataFrame:
    return interval_gaps(gene_coverage(genemap), ["genename", "chrom"]).select("genename", "chrom", F.col("lo").alias("gap_start"), F.col("hi").alias("gap_end"))
