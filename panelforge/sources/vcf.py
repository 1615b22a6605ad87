"""Call files (VCF 4.2 text, plain or gzip) as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import genotype as G
from panelforge.session import broadcast_if_small

#: Fixed values of the format: the meta lines of a combined file.
META_LINES = (
    "##fileformat=VCFv4.2",
    '##INFO=<ID=AC,Number=A,Type=Integer,Description="Allele count in genotypes">',
    '##INFO=<ID=AN,Number=1,Type=Integer,Description="Total number of alleles in called genotypes">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##INFO=<ID=RefPanelAF,Number=A,Type=Float,Description="Allele frequency in imputation reference panel">',
    '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Genotype dosage">',
    '##FORMAT=<ID=GP,Number=G,Type=Float,Description="Genotype posterior probabilities">',
    '##FORMAT=<ID=AT,Number=1,Type=String,Description="Assay Type">',
    '##INFO=<ID=TYPED,Number=0,Type=Flag,Description="Typed in input data">',
)
FIXED = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def call_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_ord, value) of call files.  Gzip files are read whole, one task each, so convert them to Parquet once."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_ord"), "value")


def meta_lines(lines: DataFrame) -> DataFrame:
    """(path, line_ord, key, value) of the meta lines, ``##key=value``."""
    text = F.substring("value", 3, 1_000_000)
    return lines.where(F.col("value").startswith("##")).select("path", "line_ord", F.substring_index(text, "=", 1).alias("key"), F.expr("substring(value, 4 + length(substring_index(substring(value, 3), '=', 1)))").alias("value"))


def record_text(records: DataFrame) -> Column:
    """A record as a line again, from its fields as they are now."""
    fixed = [F.col(c).cast("string") for c in ("chromosome", "position", "rsid", "ref", "alt", "qual", "filter", "info_text", "format")]
    return F.concat_ws("\t", *fixed, F.array_join("genos", "\t"))


def raw_counts(records: DataFrame) -> DataFrame:
    """Adds the number of genotypes, of the file's own calls of each kind, and the call rate by them (anything but ``./.`` is a
    call), without any threshold and without a shuffle."""
    own = F.transform("genos", lambda g: F.substring_index(g, ":", 1))
    n = lambda v: F.size(F.filter("_own", lambda x: x == v)).cast("long")
    rows = records.withColumn("_own", own).withColumns({"raw_n": F.size("_own").cast("long"), "raw_homref": n("0/0"), "raw_het": n("0/1"), "raw_homalt": n("1/1"), "raw_miss": n("./."), "raw_dot": n(".")})
    return rows.withColumn("raw_cr", F.try_divide(F.col("raw_n") - F.col("raw_miss"), F.col("raw_n"))).drop("_own")


def samples_of(lines: DataFrame, assaytype: Column) -> DataFrame:
    """(assaytype, sample_id, list_posn): the 0-based slot of each sample, from the header lines."""
    head = lines.where(F.col("value").startswith("#CHROM")).select(assaytype.alias("assaytype"), F.split("value", "\t").alias("f"))
    return head.select("assaytype", F.posexplode(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0)))).alias("list_posn", "sample_id")).select("assaytype", "sample_id", "list_posn").distinct()


def records_of(lines: DataFrame, assaytype: Column) -> DataFrame:
    """One row per record with its nine fixed fields and the genotype strings as an array; ``line`` is the text itself."""
    f = F.col("f")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(assaytype.alias("assaytype"), "line_ord", F.col("value").alias("line"), F.split("value", "\t").alias("f"))
    g = lambda i: F.get(f, F.lit(i))
    return rows.select(
        "assaytype", F.col("line_ord").alias("file_ord"), G.padded_chromosome(g(0)).alias("chromosome"), g(1).try_cast("int").alias("position"), g(2).alias("rsid"), g(3).alias("ref"), g(4).alias("alt"), g(5).alias("qual"), g(6).alias("filter"), g(7).alias("info_text"), g(8).alias("format"),
        G.info_score(g(7)).alias("info"), G.reference_panel_af(g(7)).alias("ref_maf"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("genos"), "line",
    )


def genotypes_of(records: DataFrame, samples: DataFrame, dot_as_nocall: bool = False) -> DataFrame:
    """Long form: one row per (record, sample) that was assayed, with its probabilities; ``.`` is no row, or a no call with
    ``dot_as_nocall``.  The file's own GT is kept as ``file_gt``."""
    rows = records.withColumn("_gp", G.format_index(F.col("format"), "GP")).select("*", F.posexplode("genos").alias("list_posn", "geno")).drop("genos", "line")
    rows = rows.join(broadcast_if_small(samples), ["assaytype", "list_posn"])
    if not dot_as_nocall:
        rows = rows.where("geno <> '.'")
    probs = F.coalesce(G.probabilities(F.col("geno"), F.col("_gp")), F.array().cast("array<double>"))
    return rows.withColumn("file_gt", G.geno_field(F.col("geno"), F.lit(0))).withColumn("probs", probs).drop("_gp")


def read_calls(spark: SparkSession, path: str | list[str], assaytype: str) -> tuple[DataFrame, DataFrame]:
    """(records, samples) of the call files of one panel."""
    lines = call_lines(spark, path)
    return records_of(lines, F.lit(assaytype)), samples_of(lines, F.lit(assaytype))


def variants_of(records: DataFrame) -> DataFrame:
    """Catalogue rows of a panel's records."""
    return records.select("assaytype", "rsid", "chromosome", "position", F.col("ref").alias("alleleA"), F.col("alt").alias("alleleB"), "ref_maf", "info")


def width_report(records: DataFrame, samples: DataFrame) -> DataFrame:
    """Records whose number of genotypes is not that of the panel's samples."""
    n = broadcast_if_small(samples.groupBy("assaytype").agg(F.count("*").alias("n_samples")))
    return records.withColumn("n_genos", F.size("genos")).join(n, "assaytype").where("n_genos <> n_samples").select("assaytype", "rsid", "position", "n_genos", "n_samples")


def header_lines(spark: SparkSession, samples: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate([*META_LINES, "\t".join([*FIXED, *samples])])], "ord int, value string")
