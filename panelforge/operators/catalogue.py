"""Lookups in the variant, sample, file, gene, phenotype and weight catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import genotype as G
from panelforge.functions.text import chromosome, id_tokens, panel, strip
from panelforge.operators.ordered import ranked
from panelforge.session import broadcast_if_small

MAX_EXTENT = 250_000


def tidy_chromosome(c: Column) -> Column:
    return G.padded_chromosome(chromosome(c))


def tidy(variants: DataFrame) -> DataFrame:
    """The stored catalogue with panel, chromosome (two digits) and ids in one spelling; one row per stored row and id."""
    ids = F.coalesce(F.filter(id_tokens(F.col("rsid")), lambda x: x != "."), F.array().cast("array<string>"))
    return variants.select("vid", panel(F.col("assaytype")).alias("assaytype"), F.explode_outer(ids).alias("rsid"), G.padded_chromosome(chromosome(F.col("chromosome"))).alias("chromosome"), F.col("startposition").alias("position"), "allelea", "alleleb", "ref_maf", "infoscore", "imputed")


def by_ids(catalogue: DataFrame, requests: DataFrame, assays: list[str] | None = None) -> DataFrame:
    """The rows of the requested ids, optionally on some panels only."""
    rows = catalogue if assays is None else catalogue.where(F.col("assaytype").isin(*assays))
    return rows.join(broadcast_if_small(requests.select("rsid").distinct()), "rsid", "left_semi")


def in_range(catalogue: DataFrame, chrom: str, start: int, end: int, assays: list[str] | None = None) -> DataFrame:
    """Rows from start to end, both included.  A range that is negative or wider than 250 kb is refused."""
    if start < 0:
        raise ValueError("start position is negative")
    if end < start:
        raise ValueError("start position is greater than end position")
    if end - start > MAX_EXTENT:
        raise ValueError(f"the range is wider than {MAX_EXTENT}")
    rows = catalogue.where((F.col("chromosome") == chrom) & F.col("position").between(start, end))
    return rows if assays is None else rows.where(F.col("assaytype").isin(*assays))


def with_imputed_flag(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("imputed", F.when(F.col("imputed").isNotNull() | (F.col("infoscore") != 1.0), 1).otherwise(0))


def marker_totals(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("chromosome", "assaytype").agg(F.count("*").alias("n_variants"))


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("assaytype").agg(F.count("*").alias("n_samples"))


def with_sample_counts(catalogue: DataFrame, samples: DataFrame) -> DataFrame:
    """Variants with the number of samples of their panel."""
    return catalogue.join(broadcast_if_small(sample_counts(samples)), "assaytype", "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("long")))


def combined_columns(samples: DataFrame, order: list[str]) -> DataFrame:
    """(sample_id, column): the 0-based column of each sample in a combined file: samples of the first panel in the order of
    their slots, then those the second adds, and so on.  Panels not in ``order`` come last, by name."""
    place = F.coalesce(G.lit_map({a: i for i, a in enumerate(order)})[F.col("assaytype")], F.lit(len(order)))
    first = samples.groupBy("sample_id").agg(F.min(F.struct(place.alias("p"), F.col("assaytype").alias("a"), F.col("list_posn").alias("l"))).alias("_f"))
    keyed = first.withColumn("_all", F.lit(0)).select("sample_id", "_all", F.col("_f.p").alias("p"), F.col("_f.a").alias("a"), F.col("_f.l").alias("l"))
    return ranked(keyed, ["_all"], [F.col("p"), F.col("a"), F.col("l"), F.col("sample_id")], "column").select("sample_id", "column")


def at_places(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored variants at the wanted places with the wanted alleles (chromosome, position, allelea, alleleb)."""
    return catalogue.join(broadcast_if_small(wanted.select("chromosome", "position", "allelea", "alleleb").distinct()), ["chromosome", "position", "allelea", "alleleb"], "left_semi")


def with_records(catalogue: DataFrame, records: DataFrame) -> DataFrame:
    """Catalogue rows beside the records of their panel at the same place with the same alleles."""
    r = records.select("assaytype", "chromosome", "position", F.col("ref").alias("allelea"), F.col("alt").alias("alleleb"), F.col("rsid").alias("record_rsid"), F.col("info").alias("record_info"))
    return catalogue.join(r, ["assaytype", "chromosome", "position", "allelea", "alleleb"])


def with_file(catalogue: DataFrame, paths: DataFrame) -> DataFrame:
    """Variants with the file of their panel and chromosome; of several deliveries the last (the greatest path_id)."""
    last = paths.groupBy("assaytype", F.col("chrom").alias("chromosome")).agg(F.max_by("path", "path_id").alias("path"))
    return catalogue.join(broadcast_if_small(last), ["assaytype", "chromosome"], "left")


def first_found(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in a stated order (nulls first), so that it is always the same."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def genes_by_name(genes: DataFrame, names: DataFrame) -> DataFrame:
    """The transcripts of the named genes (column ``genename``, in any case), by name, start and end."""
    asked = names.select(F.upper(strip(F.col("genename"))).alias("genename")).distinct()
    return genes.join(broadcast_if_small(asked), "genename", "left_semi").orderBy("genename", "txstart", "txend", "name", "chrom")


def ids_in_range(catalogue: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return in_range(catalogue, chrom, start, end).where("rsid is not null").select("rsid").distinct()


def check_request(chromosome: str | int | None = None, threshold: float | None = None) -> None:
    """A threshold lies from 0 to 1, a chromosome from 1 to 22."""
    if threshold is not None and not 0.0 <= threshold <= 1.0:
        raise ValueError(f"the threshold {threshold} is not from 0 to 1")
    if chromosome is not None and not (str(chromosome).isdigit() and 1 <= int(chromosome) <= 22):
        raise ValueError(f"no chromosome {chromosome}")


def sample_union(samples: DataFrame) -> DataFrame:
    """Distinct samples with the number of panels they are on and the first of them by name (``combined_columns`` orders them)."""
    return samples.groupBy("sample_id").agg(F.count_distinct("assaytype").alias("n_panels"), F.min("assaytype").alias("first_panel"))


def overlapping_samples(samples: DataFrame) -> DataFrame:
    return sample_union(samples).where("n_panels >= 2")


def file_paths(filepaths: DataFrame, prefix: str | None = None) -> DataFrame:
    """(path_id, assaytype, chrom, path): the file of each panel and chromosome, optionally under another prefix."""
    rows = filepaths.select("path_id", panel(F.col("assaytype")).alias("assaytype"), "fpath_prefix", "fpath_suffix", F.explode("files").alias("f"))
    root = F.lit(prefix) if prefix is not None else F.coalesce(F.col("fpath_prefix"), F.lit(""))
    joined = F.concat_ws("/", F.regexp_replace(root, "/+$", ""), F.regexp_replace(F.coalesce("fpath_suffix", F.lit("")), "^/+|/+$", ""), F.col("f.filename"))
    return rows.select("path_id", "assaytype", G.padded_chromosome(F.col("f.chrom")).alias("chrom"), F.regexp_replace(joined, "/{2,}", "/").alias("path"))


def genes(genemap: DataFrame) -> DataFrame:
    """Genes with the name in upper case (``genes_by_name`` orders them)."""
    return genemap.select(F.upper(strip(F.col("genename"))).alias("genename"), F.col("name"), G.padded_chromosome(chromosome(F.col("chrom"))).alias("chrom"), "strand", "txstart", "txend")


def named(store: DataFrame, name: str) -> DataFrame:
    """The rows stored under a name (phenotypes, weights, variant lists)."""
    return store.where(F.col("name") == name)


def new_names(store: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused because their name is already stored)."""
    have = store.select("name").distinct()
    return incoming.join(have, "name", "left_anti"), incoming.join(have, "name", "left_semi")
