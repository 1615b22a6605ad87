"""Matching of variants and probes, and surviving entries, against brute force and on hand-made rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import entity_match as em
from panelforge.llm import survivor as sv
from panelforge.session import table

VARIANTS = "vid long, assaytype string, rsid string, chromosome string, startposition int, endposition int, allelea string, alleleb string, ref_maf double, infoscore double, imputed int, cr double, maf double, hwep double, missing int, numsamples int, errpct double, loaded_at timestamp, retired_at timestamp, chrom string, pos int, gid int"
PROBES = "probe_id long, lab string, chromosome string, startposition int, allelea string, alleleb string, strand string, freq_b double, n_typed int, submitted_at timestamp, kind string, a int"
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def variants(spark, rows):
    full = []
    for vid, panel, rsid, chrom, pos, a, b, *more in rows:
        m = dict(zip(("cr", "maf", "hwep", "infoscore", "ref_maf"), more))
        full.append((vid, panel, rsid, chrom, pos, pos, a, b, m.get("ref_maf"), m.get("infoscore"), None, m.get("cr"), m.get("maf"), m.get("hwep"), None, 10, None, None, None, "z", 1, 1))
    return spark.createDataFrame(full, VARIANTS)


def probes(spark, rows):
    return spark.createDataFrame([(i, "lab", c, p, a, b, s, f, None, None, "k", 1) for i, c, p, a, b, s, f in rows], PROBES)


def pairs(df):
    got = [(r["vid"], r["probe_id"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ways_of_writing(spark):
    v = variants(spark, [(1, "affy", "rs1", "01", 100, "A", "G", 1.0, 0.2), (2, "x", None, "chr1", 100, "g", "a "), (3, "x", "r", "X", 500, "G", "GTC"), (4, "x", "r", "2", 50, "TT", "T"), (5, "x", "r", None, 100, "A", "G"), (6, "x", "r", "1", 0, "A", "G"), (7, "x", "r", "1", 100, ".", "G"), (8, "x", "r", "1", 105, "A", "G"), (9, None, None, "1", 100, "A", "C")])
    p = probes(
        spark,
        [
            (1, "1", 100, "A", "G", "+", 0.2), (2, "CHR1", 99, "t", "c", None, None), (3, " 01 ", 102, "C", "T", "-", 0.9), (4, "23", 501, "-", "TC", "+", None), (5, "chrX", 500, "D", "I", "+", float("nan")), (6, "X", 499, "CG", "CGTC", "+", 0.1), (7, "23", 500, "CAG", "C", "-", 0.1), (8, "1", 100, "A", "0", "+", None),
            (9, "1", 100, None, "C", "+", None), (10, "1", 100, "N", "", "+", None), (11, "0", 0, "A", "G", "+", None), (12, None, 100, "A", "G", "+", None), (13, "2", 51, "T", "-", "+", 0.5), (14, "1", 107, "A", "G", "+", None), (15, "1", 110, "A", "G", "+", None), (16, "1", 100, "A" * 5_000, "A", "+", None), (17, "1", 100, "-", None, "+", None),
        ],
    )
    got = pairs(em.match(v, p))
    want = {(x, y) for y in (1, 2, 3) for x in (1, 2)} | {(3, y) for y in (4, 5, 6, 7)} | {(4, 13), (8, 14)} | {(x, 8) for x in (1, 2, 9)} | {(x, 9) for x in (1, 2, 9)}
    assert got == want


def test_confidence_and_copies(spark):
    v = variants(spark, [(i, "x", None, "1", 100, "A", "C") for i in range(40)])
    p = probes(spark, [(i, "1", 100, "C", "A", "+", None) for i in range(30)])
    out = em.match(v, p)
    assert len(pairs(out)) == 1_200 and all(0.0 <= r["confidence"] <= 1.0 for r in out.collect())


def test_the_model_decides(spark, data, monkeypatch):
    v, p = table(spark, data, "variants"), table(spark, data, "probes")
    usual = pairs(em.match(v, p))
    monkeypatch.setattr(em, "train", lambda *a, **k: em.Model((-9.0, *[0.0] * len(em.FEATURES)), (0.0, 1.0), 0.3, 0.9))
    assert usual and pairs(em.match(v, p)) == set()


def test_confidence_of_held_out_pairs_is_reliable(spark, data):
    rows = em.reliability(table(spark, data.replace("0.001", "0.01"), "variants"), table(spark, data.replace("0.001", "0.01"), "probes")).collect()
    judged = [r for r in rows if r["n_labelled"] >= 20]
    assert judged and all(abs(r["mean_confidence"] - r["matched_share"]) < 0.1 for r in judged)


def test_labels_with_known_noise():
    rnd = np.random.default_rng(0)
    x = np.hstack([np.ones((4_000, 1)), rnd.integers(0, 2, (4_000, 2)).astype(float)])
    match = x[:, 1] * x[:, 2] == 1
    y = np.where(rnd.random(4_000) < np.where(match, 0.85, 0.3), 1.0, 0.0)
    w, agree = em._under_noise(x, y, np.array([-2.0, 1.0, 1.0]), 1.0, 0.3, 0.9)
    p = 1 / (1 + np.exp(-x @ w))
    assert 0.8 < agree and p[match].min() > 0.7 and p[~match].max() < 0.5


def test_empty(spark):
    v, p = variants(spark, [(1, "x", None, "1", 100, "A", "C")]), probes(spark, [(1, "1", 100, "C", "A", "+", None)])
    assert em.match(v.limit(0), p).count() == 0 and em.match(v, p.limit(0)).count() == 0


def test_blocking_misses_nothing_within_reach(spark):
    rnd = random.Random(3)
    v = [("1", rnd.randrange(1, 4_000), *rnd.sample("ACGT", 2), None) for _ in range(500)]
    p = [("1", max(1, x[1] + rnd.randrange(-2, 3)), *rnd.sample(x[2:4], 2), "full", None) for x in rnd.sample(v, 300)]
    vd = em._trimmed(spark.createDataFrame(v, "chrom string, pos long, a string, b string, maf double").distinct())
    pd = em._trimmed(spark.createDataFrame(p, "chrom string, pos long, a string, b string, kind string, freq double").distinct())
    found = em.compared(em.candidates(vd, pd)).where("fits")
    got = [tuple(r) for r in found.select("v_pos", "v_a", "v_b", "p_pos", "p_a", "p_b").collect()]
    forms = lambda a, b: {frozenset((a, b)), frozenset((a.translate(COMPLEMENT), b.translate(COMPLEMENT)))}
    want = {(x[1], x[2], x[3], y[1], y[2], y[3]) for x, y in itertools.product(set(v), set(p)) if abs(x[1] - y[1]) <= 2 and frozenset(y[2:4]) in forms(x[2], x[3])}
    assert len(got) == len(set(got)) and set(got) == want


def test_whole_tables_against_all_pairs(spark, data):
    v, p = table(spark, data, "variants"), table(spark, data, "probes")
    left = em._trimmed(em.describe_variants(v)).select("vid", *[F.col(c).alias(f"v_{c}") for c in ("chrom", "pos", "a", "b", "x", "y", "place", "token", "maf")])
    right = em._trimmed(em.describe_probes(p)).select("probe_id", *[F.col(c).alias(f"p_{c}") for c in ("chrom", "pos", "a", "b", "x", "y", "place", "token", "kind", "freq")])
    every = left.join(right, (F.col("v_chrom") == F.col("p_chrom")) & (F.abs(F.col("v_pos") - F.col("p_pos")) <= 4))
    want = {(r["vid"], r["probe_id"]) for r in em.compared(every).where("fits and (p_kind = 'full' or off_by = 0)").collect()}
    got = pairs(em.match(v, p))
    assert want and want <= got and len(got - want) <= 2


# --- surviving entries ---------------------------------------------------------------------------------------------------


def groups_of(spark, rows):
    out = {}
    for r in sv.group_entries(variants(spark, rows)).collect():
        out.setdefault(r["gid"], set()).add(r["vid"])
    return sorted(map(sorted, out.values()))


def test_groups(spark):
    rows = [
        (1, "Affy ", "rs1", "01", 100, "A", "G", 0.9, 0.1), (2, "affy", None, "1", 100, "c", "T", 0.8), (3, "broad", "rs1", "1", 100, "A", "G"), (4, "affy", "rs1", "chr1", 100, "A", "C"), (5, "AFFY", "rs1", "1", None, "T", "C"), (6, "affy", "RS1,1:100_A_C", None, None, "A", "C"),
        (7, "affy", "rs1", "1", 101, "G", "A"), (8, "affy", None, "1", 101, "G", "C"), (9, "affy", "rs2", None, None, "A", "T"), (10, "affy", "rs2", "5", None, "T", "A"), (11, "affy", "rs3", "1", None, None, ""), (12, "affy", "rs3", "1", 7, ".", "T"), (13, None, "rs1", "1", 100, "A", "G"), (14, "affy", ".", None, None, None, None), (15, "affy", "rs1", "1", 100, "", "C"),
    ]
    assert groups_of(spark, rows) == [[1, 2, 5, 7], [3], [4, 6, 15], [8], [9, 10], [11, 12], [14]]


def test_chain_of_neighbours(spark):
    rows = [(i, "affy", "rs1", "1", 100 + i, "A", "G") for i in range(6)] + [(9, "affy", "rs2", "1", 106, "A", "G")]
    assert groups_of(spark, rows) == [[0, 1, 2, 3, 4, 5], [9]]


def test_metrics_decide_between_alleles(spark):
    rows = [(1, "affy", "rs1", "1", 100, "A", "G", 0.91, 0.1, 0.5), (2, "affy", "rs1", "1", 100, "A", "C", 0.92, 0.2, 0.6), (3, "affy", "rs1", None, None, None, "A", 0.93, 0.2, 0.6), (4, "affy", "rs1", "1", 100, "A", None, 0.91, 0.1, None)]
    assert groups_of(spark, rows) == [[1, 4], [2, 3]]


def test_pairs_and_survivors(spark):
    rows = [(1, "Affy", "rs12,1:5_A_G", "1", 5, "A", "G", 0.95, 0.1), (2, "affy", "rs12", "01", 5, "A", "G", 0.97, 0.1), (3, "affy", "rs12", "01", 6, "G", "A", 97.0, None), (4, "affy", "rs12", "01", 5, "A", "G", 0.97, float("nan")), (5, "exome", None, None, None, None, None)]
    v = variants(spark, rows)
    g = sv.group_entries(v)
    assert {tuple(r) for r in sv.duplicate_pairs(g).collect()} == {(a, b) for a, b in itertools.combinations(range(1, 5), 2)}
    out = {r["vid"]: r for r in sv.survivors(v, g).collect()}
    assert set(out) == {1, 5}
    s = out[1]
    assert (s["n_entries"], s["assaytype"], s["rsid"], s["chromosome"], s["startposition"], s["allelea"], s["cr"], s["maf"]) == (4, "affy", "rs12", "01", 5, "A", 0.97, 0.1)
    assert out[5]["rsid"] is None and out[5]["assaytype"] == "exome"


def test_no_entries(spark):
    v = variants(spark, [(1, "x", None, "1", 100, "A", "C")]).limit(0)
    g = sv.group_entries(v)
    assert g.count() == 0 and sv.duplicate_pairs(g).count() == 0 and sv.survivors(v, g).count() == 0


def test_several_ids_hang_together(spark):
    rows = [(1, "affy", "rs5", None, None, "A", "G"), (2, "affy", "rs3,rs5", None, None, "A", "G"), (3, "affy", "rs3", None, None, "A", "G"), (4, "affy", "rs5", None, None, "A", "T"), (5, "broad", "rs5", None, None, "A", "G"), (6, "exome", "rs9,rs8", None, None, None, None), (7, "exome", "rs9", None, None, None, None), (8, "exome", "rs7,rs8", None, None, None, None), (9, "exome", "rs7,rs6", None, None, None, None), (10, "exome", "rs60", None, None, None, None)]
    assert groups_of(spark, rows) == [[1, 2, 3], [4], [5], [6, 7, 8, 9], [10]]


def test_hot_group_and_hot_name(spark):
    rows = [(i, "affy", "rs1", "1", 100, "A", "G") for i in range(1_300)] + [(5_000 + i, "affy", "rs1", None, None, None, None) for i in range(20)]
    g = sv.group_entries(variants(spark, rows))
    assert sv.duplicate_pairs(g).distinct().count() == 1_320 * 1_319 // 2


def test_bundles_follow_the_weight(spark, monkeypatch):
    """A group of many distinct values is aligned in rounds; the heavy value still wins and exists."""
    rows = [(i, "affy", f"rs{1000 + i}", "1", 5, "A", "G") for i in range(60)] + [(100 + i, "affy", "rs1234", "1", 5, "A", "G") for i in range(90)]
    v = variants(spark, rows)
    monkeypatch.setattr(sv, "BUNDLE", 8)
    g = sv.group_entries(v)
    s = sv.survivors(v, g).collect()
    assert [(r["n_entries"], r["rsid"]) for r in s] == [(150, "rs1234")]


def test_bundled_and_unbundled_agree_on_mixed_values(spark, monkeypatch):
    rnd = random.Random(4)
    values = []
    for gid in range(40):
        true = "".join(rnd.choice(["rs", "1", "2", "3", ",", "x", "7"]) for _ in range(8))
        for k in range(30):
            noisy = list(true)
            if k >= 8:  # most values are spoilt, no one of them has a majority
                noisy[rnd.randrange(len(noisy))] = rnd.choice("0459-")
            values.append((gid, "rsid", "".join(noisy), 1.0 + rnd.random(), None))
    df = spark.createDataFrame(values, "gid long, field string, value string, weight double, latest timestamp").groupBy("gid", "field", "value").agg(F.sum("weight").alias("weight"), F.max("latest").alias("latest"))
    whole = {r["gid"]: r["value"] for r in sv.consensus_values(df).collect()}
    monkeypatch.setattr(sv, "BUNDLE", 4)
    parts = {r["gid"]: r["value"] for r in sv.consensus_values(df).collect()}
    assert len(whole) == 40 and sum(whole[g] == parts[g] for g in whole) >= 38


def score_of(p, q, ways):
    """Score of an alignment, computed afresh."""
    wp, wq = sum(p[0].values()), sum(q[0].values())
    rows, out, i, j = sv._Rows(q, wp, wq), 0, 0, 0
    for a, b in ways:
        out += int(rows.row(p[i])[j]) if a and b else -sv.GAP_COST
        i, j = i + a, j + b
    assert (i, j) == (len(p), len(q))
    return out


def test_all_ways_of_aligning_are_equally_good(monkeypatch):
    rnd = random.Random(1)
    for _ in range(60):
        p, q = ([{rnd.choice("abcd,"): 1.0 + k % 2} for _ in range(rnd.randrange(1, 30))] for k in (0, 1))
        p = [dict.fromkeys(c, p[0][next(iter(p[0]))]) for c in p]
        small, large = sv._ways_small(p, q, *(sum(x[0].values()) for x in (p, q))), sv._ways(p, q, *(sum(x[0].values()) for x in (p, q)))
        assert small == large
        monkeypatch.setattr(sv, "TABLE_CELLS", 20)
        assert score_of(p, q, sv._ways(p, q, *(sum(x[0].values()) for x in (p, q)))) == score_of(p, q, small)
        monkeypatch.undo()


@pytest.mark.parametrize("n", [100, 101, 2_500])
def test_values_of_any_length_are_aligned(n):
    """More tokens than any allele: a digit lost in one value and wrong in another is outvoted."""
    one = lambda s, w=1.0: [{t: w} for t in sv.tokens_of(s)]
    true = ",".join(str(i % 10) for i in range(n))
    assert len(sv.tokens_of(true)) == 2 * n - 1
    lost, wrong = true[: n // 2 * 2] + true[n // 2 * 2 + 2 :], true[:4] + "x" + true[5:]
    p = sv.align(sv.align(one(true), one(lost)), one(wrong))
    assert sv.consensus(p) == true


def test_long_texts_are_compared_whole(spark):
    long = "A" * 3_000
    rows = [(1, "affy", "rs1", "1", 5, long + "CT", "G"), (2, "affy", "rs1", "1", 5, long + "CT", "G"), (3, "affy", "rs1", "1", 5, long.lower() + "ct", "G"), (4, "affy", "rs1", "1", 5, long + "Ct", "G")]
    v = variants(spark, rows)
    assert [r["allelea"] for r in sv.survivors(v, sv.group_entries(v)).collect()] == [long + "CT"]


def test_originals_survive(spark):
    """Groups planted around a known entry: each copy has fields spoilt or lost, the original's values must come back."""
    rnd = random.Random(7)
    true, rows = {}, []
    for g in range(60):
        a, b = rnd.sample("ACGT", 2)
        fact = (f"rs{rnd.randrange(10**5, 10**7)}", f"{rnd.randrange(1, 22):02d}", 1_000 * g + 5, a, b, round(rnd.uniform(0.9, 1), 4), round(rnd.uniform(0.01, 0.5), 4))
        true[g] = fact
        for k in range(7):
            rsid, chrom, pos, *_ , cr, maf = fact
            spoilt = lambda x, y: y if rnd.random() < 0.25 else x
            rows.append((g * 100 + k, spoilt("affy", "AFFY "), spoilt(rsid, rsid + str(rnd.randrange(10))), spoilt(chrom, f"chr{int(chrom)}"), pos, a, b, spoilt(cr, cr * 100), spoilt(maf, None), None, None, None))
    v = variants(spark, rows)
    out = {r["vid"] // 100: r for r in sv.survivors(v, sv.group_entries(v)).collect()}
    assert set(out) == set(true)
    good = sum((r["rsid"], r["chromosome"], r["startposition"], r["allelea"], r["alleleb"], r["cr"], r["maf"]) == true[g] for g, r in out.items())
    cells = sum(x == y for g, r in out.items() for x, y in zip((r["rsid"], r["chromosome"], r["startposition"], r["allelea"], r["alleleb"], r["cr"], r["maf"]), true[g]))
    assert cells / (7 * len(out)) >= 0.95 and good / len(out) >= 0.8


def test_alignment():
    one = lambda s, w=1.0: [{t: w} for t in sv.tokens_of(s)]
    p = sv.align(sv.align(one("rs123", 3.0), one("rs1234")), one("rs123,x"))
    assert sv.consensus(p) == "rs123"
