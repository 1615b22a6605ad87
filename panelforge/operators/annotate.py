"""Annotation and conversion of records: ids, reference bases, genes nearby, id maps, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import genotype as G
from panelforge.session import broadcast_if_small

CHUNK = 5_000
GENE_BIN = 1_000_000


def annotate_ids(records: DataFrame, known: DataFrame) -> DataFrame:
    """Overwrites the id by that of the known variant at the place (the least if there are several); keeps unmatched rows."""
    one = known.groupBy("chromosome", "position").agg(F.min("rsid").alias("_id"))
    return records.join(one, ["chromosome", "position"], "left").withColumn("rsid", F.coalesce("_id", "rsid")).drop("_id")


def reference_bases(places: DataFrame, genome: DataFrame) -> DataFrame:
    """Adds ``base``, the reference base at each place, from chunks of 5000 bases keyed by (chromosome, 1-based start)."""
    start = (F.floor((F.col("position") - 1) / CHUNK) * CHUNK + 1).cast("int")
    rows = places.withColumn("start_posn", start).join(genome, ["chromosome", "start_posn"], "left")
    return rows.withColumn("base", F.upper(F.substring("genome_string", F.col("position") - F.col("start_posn") + 1, F.lit(1)))).drop("genome_string", "start_posn")


def reference_mismatches(records: DataFrame, genome: DataFrame) -> DataFrame:
    """Records whose first reference base is not that of the genome; places without sequence are not reported."""
    rows = reference_bases(records, genome)
    return rows.where((F.col("base") != "") & (F.col("base") != F.upper(F.substring("ref", 1, 1))))


def genes_near(places: DataFrame, genes: DataFrame, upstream: int = 0, downstream: int = 0) -> DataFrame:
    """Places with every gene that overlaps [position - downstream, position + upstream].

    Both sides are cut into bins of a megabase, so the interval condition becomes an equi-join with a residual test; a gene
    lies in as many bins as it spans, a place in one.
    """
    g = genes.where("txstart is not null and txend is not null and txstart <= txend").withColumn("_bin", F.explode(F.sequence(F.floor((F.col("txstart") - upstream) / GENE_BIN), F.floor((F.col("txend") + downstream) / GENE_BIN))))
    p = places.withColumn("_bin", F.floor(F.col("position") / GENE_BIN))
    near = (F.col("txstart") <= F.col("position") + upstream) & (F.col("txend") >= F.col("position") - downstream)
    return p.join(g, (p["chromosome"] == g["chrom"]) & (p["_bin"] == g["_bin"]) & near).drop("_bin")


def mapped(rows: DataFrame, column: str, mapping: DataFrame, check: bool = True) -> DataFrame:
    """``column`` renamed by a map (old, new); with ``check`` an id that is not in the map raises an error."""
    m = mapping.groupBy(F.col("old").alias(column)).agg(F.min("new").alias("_new"))
    if check and (lost := rows.select(column).distinct().join(m, column, "left_anti").limit(1).collect()):
        raise ValueError(f"{column} {lost[0][0]!r} is not in the map")
    return rows.join(broadcast_if_small(m), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def mapped_with_fallback(rows: DataFrame, column: str, *mappings: DataFrame) -> DataFrame:
    """``column`` by the first map that has it; otherwise as it is."""
    out = []
    for i, mapping in enumerate(mappings):
        m = mapping.groupBy(F.col("old").alias(column)).agg(F.min("new").alias(f"_m{i}"))
        rows = rows.join(broadcast_if_small(m), column, "left")
        out.append(f"_m{i}")
    return rows.withColumn("mapped", F.coalesce(*out, column)).drop(*out)


def compare_calls(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("rsid", "sample_id")) -> DataFrame:
    """Rows present in both whose calls differ."""
    x, y = a.select(*by, F.col("gt").alias("gt_a")), b.select(*by, F.col("gt").alias("gt_b"))
    return x.join(y, list(by)).where(~F.col("gt_a").eqNullSafe(F.col("gt_b")))


def compare_mapped(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """(rsid, sample_id, other_id, gt_a, gt_b): calls of ``a`` that differ from those of ``b``, whose samples are known by other
    ids: ``ids`` maps (old, new).  Samples without an entry in the map are not compared."""
    m = ids.groupBy(F.col("old").alias("sample_id")).agg(F.min("new").alias("other_id"))
    x = a.join(broadcast_if_small(m), "sample_id").select("rsid", "sample_id", "other_id", F.col("gt").alias("gt_a"))
    y = b.select("rsid", F.col("sample_id").alias("other_id"), F.col("gt").alias("gt_b"))
    return x.join(y, ["rsid", "other_id"]).where(~F.col("gt_a").eqNullSafe(F.col("gt_b"))).select("rsid", "sample_id", "other_id", "gt_a", "gt_b")


def every_nth_kept(samples: DataFrame, n: int, prefix: str = "2") -> DataFrame:
    """Every n-th sample of a panel (by column) keeps its id, the others get another first character: forces overlaps to be
    tested."""
    return samples.withColumn("new_id", F.when((F.col("list_posn") + 1) % n == 0, F.col("sample_id")).otherwise(F.concat(F.lit(prefix), F.substring("sample_id", 2, 1_000))))


def two_way_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two record sets on place: which side has it, and whether the alleles agree."""
    x = a.select("chromosome", "position", F.col("ref").alias("ref_a"), F.col("alt").alias("alt_a"))
    y = b.select("chromosome", "position", F.col("ref").alias("ref_b"), F.col("alt").alias("alt_b"))
    rows = x.join(y, ["chromosome", "position"], "full")
    side = F.when(F.col("ref_b").isNull(), "a").when(F.col("ref_a").isNull(), "b").otherwise("both")
    return rows.withColumn("side", side).withColumn("concordant", F.when(side == "both", (F.col("ref_a") == F.col("ref_b")) & (F.col("alt_a") == F.col("alt_b"))))


def flipped_calls(rows: DataFrame, flips: DataFrame, key: tuple[str, ...] = ("assaytype", "rsid")) -> DataFrame:
    """0 and 2 exchanged for the variants of a panel listed in ``flips``."""
    number = G.call_number(F.col("gt"))
    return _listed(rows, flips, key).withColumn("number", F.when(F.col("_flip"), G.flipped(number)).otherwise(number)).drop("_flip")


def flipped_records(rows: DataFrame, flips: DataFrame, key: tuple[str, ...] = ("assaytype", "rsid")) -> DataFrame:
    """``probs`` in reversed order for the variants of a panel listed in ``flips``."""
    return _listed(rows, flips, key).withColumn("probs", F.when(F.col("_flip"), G.flipped_probabilities(F.col("probs"))).otherwise(F.col("probs"))).drop("_flip")


def _listed(rows: DataFrame, flips: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Adds ``_flip``, true for the rows whose key is listed, otherwise null."""
    return rows.join(broadcast_if_small(flips.select(*key).distinct().withColumn("_flip", F.lit(True))), list(key), "left")


def corrected_headers(headers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, rsid, flip) of column names of a genotype table, ``rs1_A``, ``1:100_A`` or ``1:100:A``: the id they stand for, and
    whether the counted allele is the reference one, so that 0 and 2 change places.  Unknown names have a null id."""
    name = F.col("name")
    parts = F.split(name, "[_:]")
    by_id = name.startswith("rs")
    asked = headers.select("name", F.when(by_id, parts[0]).alias("_id"), F.when(~by_id, G.padded_chromosome(parts[0])).alias("_chrom"), F.when(~by_id, F.get(parts, F.lit(1)).try_cast("int")).alias("_pos"), F.element_at(parts, -1).alias("_allele"))
    known = catalogue.groupBy("rsid", "chromosome", "position").agg(F.min("ref").alias("ref"))
    a = asked.where("_id is not null").join(known, asked["_id"] == known["rsid"], "left")
    b = asked.where("_id is null").join(known, (asked["_chrom"] == known["chromosome"]) & (asked["_pos"] == known["position"]), "left")
    return a.unionByName(b).groupBy("name").agg(F.min_by(F.struct("rsid", (F.col("_allele") == F.col("ref")).alias("flip")), "rsid").alias("r")).select("name", "r.rsid", F.coalesce("r.flip", F.lit(False)).alias("flip"))


def normalised_calls(called: DataFrame, metrics: DataFrame, key: tuple[str, ...] = ("assaytype", "rsid")) -> DataFrame:
    """Calls as copies of the rarer allele: 0 and 2 change places where the reference allele is the rarer one."""
    rare = metrics.where(F.col("raf") < F.col("aaf")).select(*key).withColumn("normalised", F.lit(True))
    number = G.call_number(F.col("gt"))
    rows = called.join(broadcast_if_small(rare), list(key), "left").withColumn("normalised", F.coalesce("normalised", F.lit(False)))
    return rows.withColumn("number", F.when(F.col("normalised"), G.flipped(number)).otherwise(number))
