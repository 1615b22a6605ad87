"""Files read and written: round trips, headers, faulty lines, landing folder."""

from __future__ import annotations

import gzip
import time

import pytest
from pyspark.sql import functions as F

from panelforge import session
from panelforge.operators import catalogue, metrics, reshape
from panelforge.sources import files, sinks, vcf
from panelforge.streaming.landing import ingest_calls

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t001\t002\t003\n"
BODY = "1\t100\trs1\tA\tG\t.\t.\tINFO=0.7;TYPED\tGT:GP\t0/0:0.95,0.05,0\t.\t0/1:0,1,0\n2\t200\trs2\tC\tT\t.\t.\t.\tGT:DS:GP\t0/0:0:0.5,0.5,0\t1/1:2:0,0,1\t./.:0:0,0,0\n"


@pytest.fixture
def call_file(tmp_path):
    p = tmp_path / "affy_chr01.vcf.gz"
    with gzip.open(p, "wt") as f:
        f.write(HEAD + BODY)
    return str(p)


def test_read_calls(spark, call_file):
    records, samples = vcf.read_calls(spark, call_file, "affy")
    assert [tuple(r) for r in samples.orderBy("list_posn").collect()] == [("affy", "001", 0), ("affy", "002", 1), ("affy", "003", 2)]
    long = metrics.with_calls(vcf.genotypes_of(records, samples))
    got = {(r["rsid"], r["sample_id"]): (r["gt"], r["info"], r["chromosome"]) for r in long.collect()}
    assert got == {("rs1", "001"): ("0/0", 0.7, "01"), ("rs1", "003"): ("0/1", 0.7, "01"), ("rs2", "001"): ("./.", 1.0, "02"), ("rs2", "002"): ("1/1", 1.0, "02"), ("rs2", "003"): ("./.", 1.0, "02")}
    assert vcf.genotypes_of(records, samples, dot_as_nocall=True).count() == 6
    assert vcf.width_report(records, samples).count() == 0
    assert vcf.variants_of(records).count() == 2


def test_round_trip(spark, call_file, tmp_path):
    records, samples = vcf.read_calls(spark, call_file, "affy")
    long = metrics.with_calls(vcf.genotypes_of(records, samples))
    heads = records.select(F.regexp_replace("chromosome", "^0", "").alias("chromosome"), "position", "rsid", "ref", "alt", "qual", "filter", F.col("info_text").alias("info"), F.lit("GT:GP:AT").alias("format"))
    lines = reshape.record_lines(long, samples.select("sample_id", F.col("list_posn").alias("column")), heads)
    out = str(tmp_path / "out")
    sinks.write_call_file(lines.join(records.select("rsid", F.col("position").alias("ord")), "rsid"), ["001", "002", "003"], out)
    again, samples2 = vcf.read_calls(spark, out, "affy")
    got = metrics.with_calls(vcf.genotypes_of(again, samples2))
    key = ("rsid", "sample_id", "gt", "chromosome", "position")
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, long.select(*key).collect()))


def test_store_is_partitioned(spark, call_file, tmp_path):
    records, _ = vcf.read_calls(spark, call_file, "affy")
    sinks.write_store(records, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store")).where("assaytype = 'affy' and position between 150 and 250")
    assert [r["rsid"] for r in back.collect()] == ["rs2"]


def test_info_file(spark, tmp_path):
    p = tmp_path / "x.info"
    p.write_text("alternate_ids rsid position info\n--- rs1 5 0.9\nx rs2 y 0.8\nx rs3 6\n")
    rows, bad = files.read_info(spark, str(p), "affy")
    assert sorted((r["rsid"], r["position"], r["info"], r["imputed"]) for r in rows.collect()) == [("rs1", 5, 0.9, 1), ("rs2", None, 0.8, None)]
    assert [r["width"] for r in bad.collect()] == [3]


def test_gene_map_and_sequence(spark, tmp_path):
    (tmp_path / "g.txt").write_text("#h\nABC1\tN1\tchr1\t+\t1\t9\t2\t8\t2\t1,x,5,\t3,9,\n")
    g = files.read_genemap(spark, str(tmp_path / "g.txt")).first()
    assert (g["chrom"], g["exonstarts"], g["txend"]) == ("1", [1, 5], 9)
    (tmp_path / "s.fa").write_text(">chr1 x\n" + "ACGTA\n" * 1_100 + ">chrX\nGGG\n>other\nA\n")
    s = {(r["chromosome"], r["start_posn"]): r["genome_string"] for r in files.read_sequence(spark, str(tmp_path / "s.fa")).collect()}
    assert set(s) == {(1, 1), (1, 5_001), (23, 1)} and len(s[1, 1]) == 5_000 and s[1, 5_001] == "ACGTA" * 100 and s[23, 1] == "GGG"


def test_uploads(spark, tmp_path):
    (tmp_path / "w.csv").write_text("ea,varid,wgt,eaf\na,rs1,,0.5\n")
    assert tuple(files.read_weights(spark, str(tmp_path / "w.csv"), "n").first()) == ("n", "rs1", "A", 0.5, 0.0)
    (tmp_path / "p.csv").write_text("iid,v\n1,2\n")
    with pytest.raises(ValueError, match="value"):
        files.read_phenotypes(spark, str(tmp_path / "p.csv"), "n")
    (tmp_path / "l.txt").write_text("rs1 x\nbad\nrs2\n")
    good, bad = files.read_id_list(spark, str(tmp_path / "l.txt"))
    assert [r["rsid"] for r in good.orderBy("req_ord").collect()] == ["rs1", "rs2"] and bad.count() == 1
    with pytest.raises(ValueError, match="more than 2"):
        files.read_id_list(spark, str(tmp_path / "l.txt"), 2)
    assert files.read_parameters("# c\nTESTNUM=5\n MAFDELTA = 0.1 # x\n") == {"TESTNUM": 5, "MAFDELTA": 0.1}


def test_named_objects_are_stored_once(spark, tmp_path):
    p = str(tmp_path / "store")
    make = lambda *n: spark.createDataFrame([(x, "rs1") for x in n], "name string, varid string")
    assert sinks.append_named(make("a"), p).count() == 0
    assert [r[0] for r in sinks.append_named(make("a", "b"), p).collect()] == ["a"]
    assert sorted(r["name"] for r in spark.read.parquet(p).collect()) == ["a", "b"]


def test_file_listing(spark, call_file):
    row = files.list_files(spark, call_file.rsplit("/", 1)[0], "affy").first()
    assert [(f["chrom"], f["filename"]) for f in row["files"]] == [("01", "affy_chr01.vcf.gz")]


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "affy_chr01.vcf").write_text(HEAD + BODY)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"))
    ingest_calls(*args).awaitTermination(60)
    (tmp_path / "in" / "broad_chr01.vcf").write_text(HEAD + BODY.splitlines(keepends=True)[0])
    ingest_calls(*args).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "store" / "records"))
    assert sorted((r["assaytype"], r["rsid"]) for r in rows.collect()) == [("affy", "rs1"), ("affy", "rs2"), ("broad", "rs1")]
    assert spark.read.parquet(str(tmp_path / "store" / "samples")).count() == 6


def test_sequence_grows_with_the_text(spark, tmp_path):
    """Contigs over several blocks and files, lines of any width; a second line of four times the text takes no sixteen times."""
    import random

    rnd = random.Random(2)
    want = {}
    for f, contigs in enumerate((("1", 61_003), ("2", 5_000)), 1):
        name, n = contigs
        bases = "".join(rnd.choice("ACGT") for _ in range(n))
        width = 50 + f
        (tmp_path / f"s{f}.fa").write_text(f">chr{name} note\n" + "\n".join(bases[i : i + width] for i in range(0, n, width)) + "\n")
        want |= {(int(name), i + 1): bases[i : i + 5_000] for i in range(0, n, 5_000)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = {(r["chromosome"], r["start_posn"]): r["genome_string"] for r in files.read_sequence(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.fa").write_text("")
    assert files.read_sequence(spark, str(tmp_path / "none")).count() == 0


def test_lines_grow_with_the_samples(spark):
    def seconds(n):
        cells = spark.range(n).select(F.lit("rs1").alias("rsid"), F.format_string("s%07d", "id").alias("sample_id"), F.lit("0/1").alias("gt"), F.array(F.lit(0.1), F.lit(0.9), F.lit(0.0)).alias("probs"), F.lit("affy").alias("assaytype")).where("id % 3 > 0").cache()
        slots = spark.range(n).select(F.format_string("s%07d", "id").alias("sample_id"), F.col("id").cast("int").alias("column")).cache()
        heads = spark.createDataFrame([("01", 5, "rs1", "A", "G", ".", ".", "x", "GT")], "chromosome string, position int, rsid string, ref string, alt string, qual string, filter string, info string, format string")
        cells.count(), slots.count()
        began = time.perf_counter()
        line = reshape.record_lines(cells.drop("assaytype"), slots, heads, F.col("gt")).first()["line"]
        took = time.perf_counter() - began
        assert len(line.split("\t")) == 9 + n and line.split("\t")[9:13] == [".", "0/1", "0/1", "."]
        return took

    seconds(1_000)
    assert seconds(64_000) < 8 * seconds(16_000) + 1


def test_further_readers_and_writers(spark, tmp_path):
    (tmp_path / "st.csv").write_text("SNPId,AssayType,chr,pos,REF,ALT,Minor,MAF\nrs1,affy,1,5,A,G,G,0.2\nrs2,affy,1,6,C,T,C,x\n")
    assert sorted(map(tuple, files.read_local_stats(spark, str(tmp_path / "st.csv")).collect())) == [("rs1", "A", "G", "G", 0.2), ("rs2", "C", "T", "C", None)]
    assert files.read_snp_summary(spark, str(tmp_path / "st.csv")).first()["maf"] == 0.2
    (tmp_path / "w.csv").write_text("id,rs1,rs2\n01,0,NA\n02,-9,2\n")
    rows, key, ids = files.read_wide_calls(spark, str(tmp_path / "w.csv"))
    assert (key, ids) == ("id", ["rs1", "rs2"]) and sorted(map(tuple, reshape.unpivoted(rows, key, ids).collect())) == [("01", "rs1", 0), ("02", "rs2", 2)]
    (tmp_path / "g.gen").write_text("--- rs1 5 A G 0.1 0.9 0 1 0 0\n--- rs2 6 C T\n")
    assert [tuple(r) for r in files.read_gen_records(spark, str(tmp_path / "g.gen")).orderBy("rsid").select("rsid", "position", "probs").collect()] == [("rs1", 5, [[0.1, 0.9, 0.0], [1.0, 0.0, 0.0]]), ("rs2", 6, [])]
    (tmp_path / "m.csv").write_text("a,b\nc,d\n")
    assert sorted(map(tuple, files.read_map(spark, str(tmp_path / "m.csv")).collect())) == [("a", "b"), ("c", "d")]
    (tmp_path / "x.txt").write_text("12\nbad\n")
    assert [r[0] for r in files.read_positions(spark, str(tmp_path / "x.txt")).collect()] == [12]
    (tmp_path / "snp.map").write_text("1 rs1 0 77\n")
    assert tuple(files.read_snp_map(spark, str(tmp_path / "snp.map")).first()) == ("01", 77)
    df = spark.createDataFrame([("affy", "rs1", 1), ("combined", "rs1", 2)], "assaytype string, rsid string, n int")
    sinks.write_download(df, df, str(tmp_path / "down"))
    assert spark.read.option("header", True).csv(str(tmp_path / "down" / "samples")).where("assaytype = 'combined'").first()["n"] == "2"
    sinks.write_csv_gz(df, str(tmp_path / "gz"))
    assert spark.read.option("header", True).csv(str(tmp_path / "gz")).count() == 2 and list((tmp_path / "gz").glob("*.csv.gz"))


def test_filtered_call_file_keeps_its_lines(spark, tmp_path):
    (tmp_path / "affy_chr01.vcf").write_text(HEAD + BODY)
    lines = vcf.call_lines(spark, str(tmp_path / "affy_chr01.vcf"))
    records = vcf.records_of(lines, F.lit("affy"))
    sinks.write_lines(lines.where(F.col("value").startswith("#")), records.where("rsid = 'rs2'"), str(tmp_path / "out"))
    got = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got == [*HEAD.splitlines(), *[x for x in BODY.splitlines() if "\trs2\t" in x]]
    assert [r[0] for r in records.select(vcf.record_text(records.withColumn("x", F.lit(1)))).collect()] == [x if x[1] != "\t" else "0" + x for x in BODY.splitlines()]
    changed = records.withColumn("rsid", F.lit("new")).select(vcf.record_text(records).alias("t")).first()["t"]
    assert changed.split("\t")[2] == "new"
    assert vcf.meta_lines(lines).where("key = 'fileformat'").count() == sum(x.startswith("##fileformat") for x in HEAD.splitlines())


def test_requests_are_checked(spark):
    catalogue.check_request("22", 0.9)
    for bad in (("23", None), ("x", None), (None, 1.1), (None, -0.1)):
        with pytest.raises(ValueError):
            catalogue.check_request(*bad)
    with pytest.raises(ValueError):
        catalogue.in_range(spark.range(1), "01", -5, 10)


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)
