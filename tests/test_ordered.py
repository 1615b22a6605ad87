"""Global ordered passes against plain Python, with hot entities spread over many partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators.intervals import gene_gaps, gene_stretches
from panelforge.operators import ordered
from panelforge.operators.ordered import asof_match, interval_gaps, interval_pieces, merge_intervals
from panelforge.operators.skew import salted_join


def brute(rows):
    stretches, gaps = [], []
    for k in {r[0] for r in rows}:
        top = lo = None
        for s, e in sorted((s, e) for q, s, e in rows if q == k and s < e):
            if top is None or s > top:
                if top is not None:
                    gaps.append((k, top, s))
                    stretches.append((k, lo, top))
                lo, top = s, e
            top = max(top, e)
        if top is not None:
            stretches.append((k, lo, top))
    return sorted(stretches), sorted(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_of_a_hot_entity(spark, seed):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), s := rnd.randrange(3_000), s + rnd.choice([-3, 0, 1, 5, 40])) for _ in range(600)]
    rows += rows[:100]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    df = spark.createDataFrame(rows, "k string, s long, e long")
    pieces = interval_pieces(df, ["k"], "s", "e")
    stretches, gaps = brute(rows)
    assert sorted(map(tuple, merge_intervals(pieces, ["k"]).collect())) == stretches
    assert sorted(map(tuple, interval_gaps(pieces, ["k"]).collect())) == gaps
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_interval_covers_partitions_to_come(spark):
    rows = [("a", 0, 10_000), *[("a", i, i + 1) for i in range(1, 500)], ("a", 10_000, 10_001), ("a", 10_050, 10_060)]
    pieces = interval_pieces(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e")
    assert [tuple(r) for r in interval_gaps(pieces, ["k"]).collect()] == [("a", 10_001, 10_050)]


GENES = "genename string, chrom string, txstart int, txend int, _s int, lo string, _pid int"


def test_genes_with_nulls_spellings_and_clashing_columns(spark):
    rows = [(" abc1", "chr01", 10, 20), ("ABC1 ", "1", 20, 30), ("Abc1", "01", 35, 40), ("ABC1", "2", 1, 5), (None, "1", 1, 2), ("", "1", 5, 6), ("ABC1", None, 1, 2), ("ABC1", "1", None, 90), ("ABC1", "1", 90, None), ("ABC1", "1", 60, 50), ("ABC1", "1", 32, 32)]
    df = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], GENES)
    assert [tuple(r) for r in gene_gaps(df).collect()] == [("ABC1", "1", 30, 35)]
    assert sorted(map(tuple, gene_stretches(df).collect())) == [("ABC1", "1", 10, 30), ("ABC1", "1", 35, 40), ("ABC1", "2", 1, 5)]


def test_no_genes(spark):
    df = spark.createDataFrame([], GENES)
    assert gene_gaps(df).count() == 0 and gene_stretches(df).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_asof_of_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.5 else rnd.choice("abcd")
    right = list({(key(), rnd.randrange(1_000)): rnd.randrange(50) for _ in range(80)}.items())
    right = [(k, s, s + n) for (k, s), n in right]
    left = [(i, key(), rnd.randrange(1_100), None if i % 7 == 0 else f"x{i}") for i in range(400)]
    want = {}
    for i, k, at, _ in left:
        before = [(s, u) for q, s, u in right if q == k and s <= at]
        want[i] = max(before) if before else (None, None)
    out = asof_match(spark.createDataFrame(left, "id long, k string, at long, extra string"), spark.createDataFrame(right, "k string, since long, until long"), ["k"], "at", "since", "until", "id")
    got = out.collect()
    assert {r["id"]: (r["match_since"], r["match_until"]) for r in got} == want
    assert {r["id"]: r["extra"] for r in got} == {i: e for i, _, _, e in left}


def test_asof_with_an_empty_side(spark):
    left = spark.createDataFrame([(1, "a", 5)], "id long, k string, at long")
    right = spark.createDataFrame([], "k string, since long, until long")
    assert [tuple(r) for r in asof_match(left, right, ["k"], "at", "since", "until", "id").select("id", "match_since").collect()] == [(1, None)]
    assert asof_match(left.limit(0), right, ["k"], "at", "since", "until", "id").count() == 0


def test_rank_within_keys_across_partitions(spark):
    rows = [(k, x, str(x)) for k, n in (("hot", 5_000), ("a", 1), ("b", 300)) for x in range(n)]
    df = spark.createDataFrame(rows, "k string, x long, s string").repartition(7)
    out = ordered.ranked(df, ["k"], [F.desc("x")])
    assert {(r["k"], r["x"]): r["rank"] for r in out.collect()} == {(k, x): n - 1 - x for k, n in (("hot", 5_000), ("a", 1), ("b", 300)) for x in range(n)}
    assert ordered.ranked(df.limit(0), ["k"], [F.col("x")]).count() == 0


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("a", 1), (None, 2), ("lone", 3)], "k string, v long")
    right = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("a", "z"), (None, "n"), ("other", "o")], "k string, w string")
    for how in ("inner", "left"):
        for limit in (7, 1_000):
            assert sorted(salted_join(left, right, ["k"], how, limit).collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)
    assert salted_join(left.limit(0), right, ["k"]).count() == 0
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "right")
