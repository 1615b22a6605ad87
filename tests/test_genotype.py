"""Call functions, resolution policies and statistics on hand-made rows."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions import genotype as G
from panelforge.operators import annotate, assoc, chunks, combine, grs, metrics, qc, reshape


@pytest.mark.parametrize(
    ("probs", "threshold", "want"),
    [([0.5, 0.5, 0.0], 0.4, "0/0"), ([0.5, 0.5, 0.0], 0.9, "./."), ([0.0, 0.0, 0.0], 0.0, "./."), ([0.0, 0.05, 0.95], 0.9, "1/1"), ([0.1, 0.9, 0.0], 0.9, "0/1"), ([], 0.0, "./.")],
)
def test_call(spark, probs, threshold, want):
    df = spark.createDataFrame([(probs,)], "p array<double>")
    assert df.select(G.call(F.col("p"), threshold)).first()[0] == want


def test_fields(spark):
    rows = [("GT:GP", "0/0:1,0,0", "INFO=0.8;TYPED;A=1=2;RefPanelAF=.1"), ("GT:DS:GP:AT", "0/1:1:0.1,x,0.2:A", "."), ("GT", "./.", "INFO=bad")]
    df = spark.createDataFrame(rows, "f string, g string, i string")
    i = G.format_index(F.col("f"), "GP")
    out = df.select(i.alias("i"), G.probabilities(F.col("g"), i).alias("p"), G.info_score(F.col("i")).alias("s"), G.reference_panel_af(F.col("i")).alias("a"), G.info_map(F.col("i")).alias("m")).collect()
    assert [r["i"] for r in out] == [1, 2, -9]
    assert [r["p"] for r in out] == [[1.0, 0.0, 0.0], [0.1, 0.0, 0.2], None]
    assert [(r["s"], r["a"]) for r in out] == [(0.8, 0.1), (1.0, 0.0), (1.0, 0.0)]
    assert out[0]["m"] == {"INFO": "0.8", "RefPanelAF": ".1"}


def exact_hwe(het, a, b):
    """All heterozygote counts by exact integers."""
    n, rare = het + a + b, 2 * min(a, b) + het
    w = {}
    for h in range(rare % 2, rare + 1, 2):
        r = (rare - h) // 2
        w[h] = 2**h * math.factorial(n) // 1 / (math.factorial(h) * math.factorial(r) * math.factorial(n - h - r))
    return sum(x for x in w.values() if x <= w[het] * (1 + 1e-9)) / sum(w.values())


def test_hardy_weinberg(spark):
    triples = [t for t in itertools.product(range(0, 40, 7), range(0, 40, 6), range(0, 40, 9)) if sum(t)]
    df = spark.createDataFrame([*triples, (0, 0, 0)], "h long, a long, b long").select("*", G.hardy_weinberg(F.col("h"), F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        if r["h"] + r["a"] + r["b"] == 0:
            assert r["p"] is None
        else:
            assert abs(r["p"] - exact_hwe(r["h"], r["a"], r["b"])) < 1e-10 and 0 < r["p"] <= 1


def genos(spark, rows):
    return spark.createDataFrame([("v", "s", i, f"a{i}", "A", "G", float(info), [float(x) for x in p]) for i, (info, p) in enumerate(rows)], "rsid string, sample_id string, assay_ord int, assaytype string, ref string, alt string, info double, probs array<double>")


def test_fold_is_not_argmax(spark):
    rows = genos(spark, [(1, (0.91, 0.09, 0)), (1, (0.99, 0.01, 0)), (1, (0.05, 0.95, 0))])
    assert combine.combined(rows, "fold").first()["gt"] == "0/1"
    assert combine.combined(rows, "argmax").first()["gt"] == "0/0"


def test_fold_tie_goes_to_info(spark):
    rows = genos(spark, [(0.5, (0.95, 0.05, 0)), (0.7, (0.05, 0.95, 0)), (0.7, (0, 0.05, 0.95))])
    c = combine.combined(rows, "fold").first()
    assert (c["gt"], c["assaytype"], c["same_prob"], c["n_panels"], c["n_calls"]) == ("0/1", "a1", 2, 3, 3)
    first = combine.combined(rows, "argmax").first()
    assert (first["gt"], first["assaytype"]) == ("0/0", "a0")


def test_file_merge_takes_panels_in_descending_name_order(spark):
    rows = spark.createDataFrame([("1", 5, "v", "s", a, "A", "G", 1.0, p) for a, p in (("ab", [0.95, 0.05, 0.0]), ("ac", [0.05, 0.95, 0.0]))], "chromosome string, position int, rsid string, sample_id string, assaytype string, ref string, alt string, info double, probs array<double>")
    assert [(r["gt"], r["assaytype"]) for r in combine.chromosome_merge(rows, err_pct=101.0).collect()] == [("0/1", "ac")]
    assert combine.chromosome_merge(rows, err_pct=100.0).count() == 0


def test_file_merge_pairs_the_records_of_a_place_by_occurrence(spark):
    hom, het, alt = [0.95, 0.05, 0.0], [0.03, 0.97, 0.0], [0.0, 0.01, 0.99]
    schema = "chromosome string, position int, rsid string, sample_id string, assaytype string, ref string, alt string, info double, probs array<double>"
    rows = [("1", 5, v, s, a, "A", alt_, 1.0, p) for v, alt_, a, s, p in [("v1", "G", "a", "s1", hom), ("v1", "G", "a", "s2", hom), ("v2", "T", "a", "s1", het), ("v2", "T", "a", "s2", alt), ("v1", "G", "b", "s2", hom), ("v2", "T", "b", "s3", alt), ("v2", "T", "b", "s2", alt), (None, "C", "a", "s1", alt)]]
    rows += [("1", 9, None, "s1", "a", "A", "G", 1.0, hom)]
    got = {(r["place"], r["occurrence"], r["sample_id"]): (r["gt"], r["n_panels"]) for r in combine.chromosome_merge(spark.createDataFrame(rows, schema)).collect()}
    # panel a has the records C, G and T there, b has G and T: b comes first, so the alleles of a differ from those of b's records
    assert got == {("1:5", 1, "s2"): ("0/0", 1), ("1:5", 2, "s2"): ("1/1", 1), ("1:5", 2, "s3"): ("1/1", 1), ("1:5", 3, "s1"): ("0/1", 1), ("1:5", 3, "s2"): ("1/1", 1), ("1:9", 1, "s1"): ("0/0", 1)}
    two = [r for r in rows if r[6] != "C"]
    got = {(r["place"], r["occurrence"], r["sample_id"]): (r["gt"], r["n_panels"]) for r in combine.chromosome_merge(spark.createDataFrame(two, schema)).collect()}
    assert got == {("1:5", 1, "s1"): ("0/0", 1), ("1:5", 1, "s2"): ("0/0", 2), ("1:5", 2, "s1"): ("0/1", 1), ("1:5", 2, "s2"): ("1/1", 2), ("1:5", 2, "s3"): ("1/1", 1), ("1:9", 1, "s1"): ("0/0", 1)}
    # in the order of the file, where that is known, also where records are alike
    filed = spark.createDataFrame([(*r, i) for i, r in enumerate([("1", 5, "v", "s", a, "A", x, 1.0, p) for a, x, p in (("a", "T", het), ("a", "G", hom), ("b", "T", het), ("b", "G", hom), ("b", "G", alt))])], schema + ", file_ord int")
    assert sorted((r["occurrence"], r["gt"], r["n_panels"]) for r in combine.chromosome_merge(filed).collect()) == [(1, "0/1", 2), (2, "0/0", 2), (3, "1/1", 1)]


def test_repeated_rows_of_a_panel_count_once(spark):
    rows = genos(spark, [(1, (0.95, 0.05, 0))]).union(genos(spark, [(1, (0.97, 0.03, 0))]))
    c = combine.combined(rows, "fold").first()
    assert (c["n_panels"], round(c["p"], 2)) == (1, 0.97)


def test_one_panel_is_itself_and_empty_is_empty(spark):
    rows = genos(spark, [(1, (0.2, 0.3, 0.5))])
    assert combine.combined(rows).first()["gt"] == "./."
    assert combine.combined(rows.limit(0)).count() == 0


def test_no_call_at_all_has_null_metrics(spark):
    m = metrics.record_metrics(metrics.call_counts(spark.createDataFrame([("v", "./."), ("v", "./.")], "rsid string, gt string"), "rsid")).first()
    assert m["maf"] is None and m["hwep"] is None and m["cr"] == 0.0 and m["n"] == 0
    flagged = qc.qc_flags(spark.createDataFrame([("v", 1, None, None, 0.0, 1.0, 0, 0.1)], "rsid string, position int, maf double, hwep double, cr double, info double, n long, ref_maf double")).first()
    assert flagged["bad_nocall"] and not flagged["passes"]


def test_flip_decisions(spark):
    w = spark.createDataFrame([("1", "G", 0.2, 1.0), ("2", "C", 0.2, 1.0), ("3", "T", 0.2, 1.0), ("4", "T", 0.8, 1.0), ("5", "A", 0.2, 1.0), ("6", "C", 0.2, 1.0), ("7", "A", 0.1, 1.0)], "rsid string, ea string, eaf double, wgt double")
    local = spark.createDataFrame([("1", "A", "G", "G", 0.1), ("2", "A", "G", "G", 0.1), ("3", "T", "A", "A", 0.1), ("4", "T", "A", "A", 0.1), ("5", "A", "G", "G", 0.1), ("6", "A", "T", "T", 0.1)], "rsid string, ref string, alt string, minor string, maf double")
    got = {r["rsid"]: r["decision"] for r in grs.strand_decisions(w, local).collect()}
    assert got == {"1": "KEEP", "2": "KEEP", "3": "KEEP", "4": "FLIP", "5": "FLIP", "6": "REJECT", "7": "NOTFOUND"}


def test_score_difference_is_constant(spark):
    rows = spark.createDataFrame([("v", "s1", "A", "G", "0/1"), ("v", "s2", "A", "G", "1/1"), ("v", "s3", "A", "G", "./."), ("w", "s1", "A", "C", "0/0")], "rsid string, sample_id string, ref string, alt string, gt string")
    out = {r["sample_id"]: r for r in grs.scores(rows, spark.createDataFrame([("v", "A", 0.5), ("w", "T", 9.0)], "rsid string, ea string, wgt double")).collect()}
    assert [out[s]["snp_count"] for s in ("s1", "s2", "s3")] == [1, 1, 0]
    assert all(out[s]["score_flip"] - out[s]["score_sign"] == 2 * 0.5 for s in ("s1", "s2")) and out["s3"]["score_sign"] == 0.0


def test_p_values():
    assert abs(assoc.t_two_sided(2.0, 10) - 0.07338803477074039) < 1e-12
    assert abs(assoc.t_two_sided(0.0, 5) - 1.0) < 1e-12
    assert abs(assoc.t_two_sided(12.7062047364, 1) - 0.05) < 1e-9


def test_chunks(spark):
    rows = [("01", p) for p in range(0, 1_000, 10)] + [("01", 5_000), ("02", 5)]
    out = sorted(tuple(r) for r in chunks.chunk_places(spark.createDataFrame(rows, "chromosome string, position int"), 300, 20).collect())
    assert sum(r[3] for r in out) == len(rows) and [r[0] for r in out] == ["01"] * 3 + ["02"]
    cut = chunks.chunk_places(spark.createDataFrame(rows, "chromosome string, position int"), 10_000, 20, {"01": 500}).collect()
    assert sorted((r["first"], r["last"]) for r in cut if r["chromosome"] == "01") == [(0, 490), (500, 5_000)]


def test_maps(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "x string")
    with pytest.raises(ValueError, match="not in the map"):
        annotate.mapped(ids, "x", spark.createDataFrame([("a", "1")], "old string, new string"))
    out = annotate.mapped(ids, "x", spark.createDataFrame([("a", "1"), ("b", "2")], "old string, new string"))
    assert sorted(r[0] for r in out.collect()) == ["1", "2"]


def test_genes_near_match_brute_force(spark):
    places = [("1", p) for p in (5, 999_990, 1_000_010, 2_500_000)]
    genes = [("1", 1_000_000, 1_000_020), ("1", 10, 2_600_000), ("2", 0, 10_000_000), ("1", None, 5)]
    out = annotate.genes_near(spark.createDataFrame(places, "chromosome string, position int"), spark.createDataFrame(genes, "chrom string, txstart int, txend int"), 10, 5)
    want = sorted((p, s) for _, p in places for c, s, e in genes if c == "1" and s is not None and s <= p + 10 and e >= p - 5)
    assert sorted((r["position"], r["txstart"]) for r in out.collect()) == want


def test_request_is_bounded(spark):
    with pytest.raises(ValueError, match="at most"):
        reshape.transposed(spark.range(1), spark.range(1), [f"rs{i}" for i in range(501)])


def test_conversions_keep_panels_apart(spark):
    rows = spark.createDataFrame([("v", "s1", "a", "0/0", [1.0, 0.0, 0.0]), ("v", "s1", "b", "1/1", [0.0, 0.0, 1.0]), ("v", "s2", "b", "0/0", [1.0, 0.0, 0.0])], "rsid string, sample_id string, assaytype string, gt string, probs array<double>")
    flips = spark.createDataFrame([("a", "v")], "assaytype string, rsid string")
    assert sorted((r["assaytype"], r["sample_id"], r["number"]) for r in annotate.flipped_calls(rows, flips).collect()) == [("a", "s1", 2), ("b", "s1", 2), ("b", "s2", 0)]
    slots = spark.createDataFrame([("a", "s1", 0), ("b", "s1", 1), ("b", "s2", 0), ("b", "s3", 2)], "assaytype string, sample_id string, column int")
    heads = rows.select("assaytype", "rsid").distinct().withColumns({c: F.lit(".") for c in ("chromosome", "position", "ref", "alt", "qual", "filter", "info", "format")})
    lines = {r["assaytype"]: r["line"].split("\t")[9:] for r in reshape.record_lines(rows, slots, heads, F.col("gt")).collect()}
    assert lines == {"a": ["0/0"], "b": ["0/0", "1/1", "."]}
    got = {r["assaytype"]: r["line"] for r in reshape.probability_rows(rows, slots).collect()}
    assert got == {"a": "--- v 1.0000 0.0000 0.0000", "b": "--- v 0.0000 0.0000 1.0000 1.0000 0.0000 0.0000 0.0000 0.0000 0.0000"}
    assert sorted((r["assaytype"], r["sample_id"], r["v"]) for r in reshape.plain_calls(rows, ["v"]).collect()) == [("a", "s1", 0), ("b", "s1", 2), ("b", "s2", 0)]
