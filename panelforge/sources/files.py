"""Readers of the other input files: variant info, gene map, sequence, uploads, request lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import genotype as G
from panelforge.functions.text import decimal_number, strip
from panelforge.operators.ordered import range_sorted

INT_FIELDS = ("position",)
DOUBLE_FIELDS = ("all_maf", "info", "cohort_1_hwe")
CHUNK = 5_000


def read_info(spark: SparkSession, path: str, assaytype: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faulty lines) of a white-space separated info file whose header begins with ``alternate``.  Columns are named
    by the header; ``---`` marks an imputed variant; lines of another width are set apart."""
    lines = spark.read.text(path).select(F.split(strip(F.col("value")), r"\s+").alias("f"), "value")
    head = lines.where(F.get("f", F.lit(0)).startswith("alternate")).limit(1).collect()
    if not head:
        raise ValueError("no header line")
    names = head[0]["f"]
    body = lines.where(~F.get("f", F.lit(0)).startswith("alternate") & (F.col("value") != ""))
    fits = F.size("f") == len(names)
    typed = []
    for i, n in enumerate(names):
        c = F.get("f", F.lit(i))
        typed.append((c.try_cast("int") if n in INT_FIELDS else c.try_cast("double") if n in DOUBLE_FIELDS else c).alias(n))
    rows = body.where(fits).select(F.lit(assaytype).alias("assaytype"), *typed, F.when(F.array_contains("f", "---"), 1).alias("imputed"))
    return rows, body.where(~fits).select("value", F.size("f").alias("width"))


def read_genemap(spark: SparkSession, path: str) -> DataFrame:
    """Gene map of eleven white-space separated fields; exon lists keep whole numbers only."""
    f = lambda i: F.get("f", F.lit(i))
    ints = lambda i: F.filter(F.transform(F.split(f(i), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(strip(F.col("value")), r"\s+").alias("f")).where(F.size("f") == 11)
    numbers = [f(i + 4).try_cast("int").alias(n) for i, n in enumerate(("txstart", "txend", "cdsstart", "cdsend", "exoncount"))]
    return rows.select(f(0).alias("genename"), f(1).alias("name"), F.regexp_replace(f(2), "^chr", "").alias("chrom"), f(3).alias("strand"), *numbers, ints(9).alias("exonstarts"), ints(10).alias("exonends"))


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, start_posn, genome_string): FASTA contigs in chunks of 5000 bases with 1-based starts; X is 23, Y 24.

    Lines are numbered by file, block and place in the block, and sorted by that number; the contig and the bases before each
    partition are carried over its border, so that a contig is read by many tasks and the work grows with the text.
    """
    at = ["path", "block", "ord"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), strip(F.col("value")).alias("value")).where("value <> ''")
    ordered = range_sorted(lines, at)
    schema = "_pid int, path string, head string, bases long"

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, where, head, bases = None, None, None, 0
        for pdf in batches:
            for p, file, v in zip(pdf["_pid"], pdf["path"], pdf["value"]):
                if file != where or v.startswith(">"):
                    head, bases = (v if v.startswith(">") else None), 0 if v.startswith(">") else len(v)
                else:
                    bases += len(v)
                pid, where = p, file
        if pid is not None:
            yield pd.DataFrame([[pid, where, head, bases]], columns=["_pid", "path", "head", "bases"])

    carry, state = {}, (None, None, 0)
    for pid, file, head, bases in sorted(tuple(r) for r in ordered.select("_pid", "path", "value").mapInPandas(ends, schema).collect()):
        carry[pid] = state
        state = (file, head, bases) if head is not None or file != state[0] else (file, state[1], state[2] + bases)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, head, done, begun = None, None, 0, False
        for pdf in batches:
            out = []
            for p, file, v in zip(pdf["_pid"], pdf["path"], pdf["value"]):
                if not begun:
                    (where, head, done), begun = carry.get(p, (None, None, 0)), True
                if file != where:
                    where, head, done = file, None, 0
                if v.startswith(">"):
                    head, done = v, 0
                elif head is not None:
                    v = "".join(v.split())
                    for i in range(done // CHUNK, (done + len(v) - 1) // CHUNK + 1):
                        out.append((file, head, i, max(done, i * CHUNK), v[max(0, i * CHUNK - done) : (i + 1) * CHUNK - done]))
                    done += len(v)
            yield pd.DataFrame(out, columns=["path", "head", "i", "start", "s"])

    parts = ordered.mapInPandas(pieces, "path string, head string, i long, start long, s string")
    name = F.regexp_replace(F.split(F.substring("head", 2, 1_000), r"\s")[0], "^chr", "")
    number = F.when(name == "X", 23).when(name == "Y", 24).otherwise(name.try_cast("int"))
    # a chunk is at most CHUNK bases, whatever the lines
    whole = parts.groupBy("path", "head", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "s"))), lambda e: e["s"]), "").alias("genome_string"))
    return whole.select(number.alias("chromosome"), (F.col("i") * CHUNK + 1).cast("int").alias("start_posn"), "genome_string").where("chromosome is not null")


def missing_columns(found: list[str], required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in [x.strip().lower() for x in found]]


def read_upload(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV with a header that must contain the required columns, in any order; all values are text."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if lost := missing_columns(df.columns, required):
        raise ValueError(f"header lacks {', '.join(lost)}")
    names = {c.strip().lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{names[c]}`").alias(c) for c in required])


def read_phenotypes(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_upload(spark, path, ("iid", "value")).select(F.lit(name).alias("name"), "iid", "value")


def read_weights(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Risk-score weights: effect allele in upper case, blank or unreadable numbers are 0."""
    rows = read_upload(spark, path, ("varid", "ea", "eaf", "wgt"))
    number = lambda c: F.coalesce(decimal_number(F.col(c)), F.lit(0.0)).alias(c)
    return rows.select(F.lit(name).alias("name"), "varid", F.upper("ea").alias("ea"), number("eaf"), number("wgt"))


def read_variant_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_upload(spark, path, ("varid",)).select(F.lit(name).alias("name"), "varid")


def read_id_list(spark: SparkSession, path: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(requests, faulty lines): the first word of each line, in order, if it is an rs id.  More than ``limit`` lines are
    refused, as a request is made by hand."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("req_ord"), F.split(strip(F.col("value")), r"\s+")[0].alias("rsid")).where("rsid <> ''")
    if lines.limit(limit + 1).count() > limit:
        raise ValueError(f"the list has more than {limit} lines")
    return lines.where(F.col("rsid").startswith("rs")), lines.where(~F.col("rsid").startswith("rs"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).try_cast("int").alias("position")).where("position is not null")


def read_map(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(old, new) of a two-column map."""
    f = F.split(strip(F.col("value")), separator)
    return spark.read.text(path).where("value <> ''").select(F.get(f, F.lit(0)).alias("old"), F.get(f, F.lit(1)).alias("new"))


def read_snp_map(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, position) of a white-space separated map; the position is the fourth field."""
    f = F.split(strip(F.col("value")), r"\s+")
    return spark.read.text(path).where("value <> ''").select(G.padded_chromosome(F.get(f, F.lit(0))).alias("chromosome"), F.get(f, F.lit(3)).try_cast("int").alias("position"))


def list_files(spark: SparkSession, path: str, assaytype: str, suffix: str = ".vcf.gz", chromosome: str = r"(\d+)", recursive: bool = False) -> DataFrame:
    """The call files of a directory (and those below it) as a file catalogue row: names with the suffix in which the pattern
    ``chromosome`` finds something; its first group is the chromosome."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive).load(path)
    chrom = F.regexp_extract("filename", chromosome, 1)
    found = files.select(F.substring_index("path", "/", -1).alias("filename")).where(chrom != "")
    return found.groupBy().agg(F.array_sort(F.collect_list(F.struct(chrom.alias("chrom"), "filename"))).alias("files")).select(F.lit(assaytype).alias("assaytype"), F.lit(path).alias("filepath"), "files")


#: Run parameters and their types.
PARAMETERS = {"TESTNUM": int, "CALLRATE": float, "MAFDELTA": float, "INFOSCORE": float}


def read_parameters(text: str) -> dict[str, str | int | float]:
    """key=value lines; ``#`` begins a comment.  Known parameters are numbers, and an unreadable one raises an error."""
    found = dict(m.groups() for line in text.splitlines() if (m := re.match(r"\s*([^#=\s]+)\s*=\s*(.*?)\s*$", line)))
    return {k: PARAMETERS[k](v.partition("#")[0]) if k in PARAMETERS else v for k, v in found.items()}


def read_local_stats(spark: SparkSession, path: str) -> DataFrame:
    """(rsid, ref, alt, minor, maf) of a statistics file by position: fields 0, 4, 5, 6 and 7; its header line is skipped."""
    f = F.split(F.col("value"), ",")
    rows = spark.read.text(path).where("value <> ''").select(*[strip(F.get(f, F.lit(i))).alias(n) for i, n in ((0, "rsid"), (4, "ref"), (5, "alt"), (6, "minor"), (7, "maf"))])
    return rows.where(~F.lower("rsid").isin("snpid", "rsid", "")).withColumn("maf", F.col("maf").try_cast("double"))


def read_snp_summary(spark: SparkSession, path: str) -> DataFrame:
    """(rsid, assaytype, ref, alt, maf) of a downloaded summary; its columns may stand in any order."""
    rows = read_upload(spark, path, ("snpid", "assaytype", "ref", "alt", "maf"))
    return rows.select(F.col("snpid").alias("rsid"), "assaytype", "ref", "alt", F.col("maf").try_cast("double").alias("maf"))


def read_wide_calls(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, str, list[str]]:
    """(rows, name of the id column, ids) of a wide genotype table: the first column identifies the sample; all values are
    text."""
    df = spark.read.option("header", True).option("inferSchema", False).option("sep", separator).csv(path)
    return df, df.columns[0], df.columns[1:]


def read_gen_records(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, rsid, position, ref, alt, probs) of white-space separated probability records: five leading fields, then
    three probabilities per sample as one array in the order of the samples."""
    f = F.split(strip(F.col("value")), r"\s+")
    rows = spark.read.text(path).where("value <> ''").select(f.alias("f"))
    g = lambda i: F.get("f", F.lit(i))
    numbers = F.transform(F.slice("f", 6, F.greatest(F.size("f") - 5, F.lit(0))), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int") - 1), lambda i: F.slice("p", i * 3 + 1, F.lit(3)))
    out = rows.select(g(0).alias("chromosome"), g(1).alias("rsid"), g(2).try_cast("int").alias("position"), g(3).alias("ref"), g(4).alias("alt"), numbers.alias("p"))
    return out.select("chromosome", "rsid", "position", "ref", "alt", F.when(F.size("p") >= 3, triples).otherwise(F.array().cast("array<array<double>>")).alias("probs"))
