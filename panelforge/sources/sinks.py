"""Writers: the store, call files, tables by panel, named objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.catalogue import new_names
from panelforge.sources.vcf import header_lines


def write_store(records: DataFrame, path: str, mode: str = "append", files: int | None = None) -> None:
    """Records partitioned by panel and chromosome and sorted by place within each file, so that a range reads few row
    groups.  ``files`` spreads a partition over that many files."""
    by = ["assaytype", "chromosome"]
    spread = [F.pmod(F.floor(F.col("position") / 1_000_000), F.lit(files))] if files else []
    records.repartition(*by, *spread).sortWithinPartitions(*by, "position").write.mode(mode).partitionBy(*by).parquet(path)


def write_call_file(lines: DataFrame, samples: list[str], path: str) -> None:
    """A combined call file as gzip text in order of place: meta lines, header, records (columns ``ord`` and ``line``)."""
    head = header_lines(lines.sparkSession, samples).select((F.col("ord") - 1_000).cast("long").alias("ord"), F.col("value"))
    body = lines.select(F.col("ord").cast("long").alias("ord"), F.col("line").alias("value"))
    head.unionByName(body).orderBy("ord").select("value").write.mode("errorifexists").option("compression", "gzip").text(path)


def write_lines(head: DataFrame, records: DataFrame, path: str) -> None:
    """A filtered call file: header lines (``line_ord``, ``value``) and the unchanged ``line`` of the records that are kept, in the
    order of the file, as gzip text."""
    body = records.select(F.col("file_ord").alias("line_ord"), F.col("line").alias("value"))
    head.select("line_ord", "value").unionByName(body).orderBy("line_ord").select("value").write.mode("errorifexists").option("compression", "gzip").text(path)


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(path)


def write_download(summary: DataFrame, samples: DataFrame, path: str) -> None:
    """What a request downloads: the summary of its variants, and beside it the genotypes of each panel."""
    summary.write.mode("errorifexists").option("header", True).csv(f"{path}/snp_summary")
    write_by_panel(samples, f"{path}/samples")


def write_by_panel(df: DataFrame, path: str) -> None:
    """One CSV folder per panel, the combined one among them."""
    df.write.mode("errorifexists").partitionBy("assaytype").option("header", True).csv(path)


def append_named(df: DataFrame, path: str) -> DataFrame:
    """Appends the rows whose name is not stored yet; returns the refused names."""
    try:
        store = df.sparkSession.read.parquet(path)
    except Exception as e:  # the first rows make the store
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        df.write.parquet(path)
        return df.select("name").limit(0)
    fresh, refused = new_names(store, df)
    names = refused.select("name").distinct()
    rows = names.collect()  # names of one upload
    fresh.write.mode("append").parquet(path)
    return df.sparkSession.createDataFrame([(r[0],) for r in rows], "name string")
