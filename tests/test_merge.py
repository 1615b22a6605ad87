"""Combination of whole records against the combination in long form."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import combine, merge, metrics
from panelforge.sources import vcf

SCHEMA = "rsid string, assay_ord int, assaytype string, chromosome string, position int, ref string, alt string, info double, sample_id string, probs array<double>"
HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t001\t002\t003\n"
BODY = "1\t100\trs1\tA\tG\t.\t.\tINFO=0.7\tGT:GP\t0/0:0.95,0.05,0\t.\t0/1:0,1,0\n2\t200\trs2\tC\tT\t.\t.\t.\tGT:DS:GP\t0/0:0:0.5,0.5,0\t1/1:2:0,0,1\t./.:0:0,0,0\n"


def random_rows():
    rnd = random.Random(5)
    rows = []
    for v in range(12):
        for a in range(4):
            if rnd.random() < 0.8:
                ref, alt = ("A", "G") if rnd.random() < 0.85 else ("G", "A")
                info = rnd.choice([0.5, 0.7, 1.0])
                for s in range(15):
                    if rnd.random() < 0.7:
                        p = rnd.choice([0.8, 0.9, 0.95, 1.0, 0.0])
                        probs = [p, round(1 - p, 2), 0.0] if p else [0.0, 0.0, 0.0]
                        rnd.shuffle(probs)
                        rows.append((f"v{v}", a, f"a{a}", "01", v, ref, alt, info, f"s{s}", probs))
    return rows


@pytest.mark.parametrize("policy", ["argmax", "fold", "pairwise"])
def test_same_as_in_long_form(spark, policy):
    rows = spark.createDataFrame(random_rows(), SCHEMA)
    called = metrics.with_calls(rows)
    merged = merge.merged_records(merge.record_arrays(called), policy)
    cols = ["rsid", "sample_id", "gt", "p", "assaytype", "n_panels", "n_calls", "n_missing", *(["same_prob", "diff_prob"] if policy == "fold" else [])]
    got = merge.combined_cells(merged, {i: f"a{i}" for i in range(4)})
    want = combine.combined(rows, policy)
    keep = "p > 0" if policy == "fold" else "true"  # where nothing wins, the long form has no probability
    assert sorted(map(tuple, got.where(keep).select(*cols).collect())) == sorted(map(tuple, want.where(keep).select(*cols).collect()))
    if policy == "fold":
        counted = merge.combined_counters(merged, 15).select("rsid", "all_geno", "overlap_test", "mismatch", "missing", "unique_geno", "err_pct")
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, combine.combine_metrics(rows).select(*counted.columns).collect()))


def test_call_rate_breaks_ties(spark):
    rows = [("v", a, f"a{a}", "01", 1, "A", "G", 1.0, s, p) for a, s, p in ((0, "s1", [0.95, 0.05, 0.0]), (0, "s2", [0.5, 0.5, 0.0]), (1, "s1", [0.05, 0.95, 0.0]), (1, "s2", [0.95, 0.0, 0.05]))]
    cells = merge.combined_cells(merge.merged_records(merge.record_arrays(metrics.with_calls(spark.createDataFrame(rows, SCHEMA))), "callrate"), {0: "a0", 1: "a1"})
    assert {r["sample_id"]: r["assaytype"] for r in cells.collect()} == {"s1": "a1", "s2": "a1"}
    with pytest.raises(ValueError):
        merge.merged_records(cells, "other")


def test_repeated_records_nulls_and_no_rows(spark):
    rows = [("v", 0, "a0", "01", 1, "A", "G", i, "s1", p) for i, p in ((1.0, [0.95, 0.05, 0.0]), (0.9, [0.0, 0.03, 0.97]))] + [(None, 0, "a0", None, None, None, None, None, "s1", [1.0, 0.0, 0.0]), ("w", 1, None, "01", 1, "A", None, None, None, None)]
    merged = merge.merged_records(merge.record_arrays(metrics.with_calls(spark.createDataFrame(rows, SCHEMA))))
    got = {r["rsid"]: (r["gt"], r["n_panels"]) for r in merge.combined_cells(merged, {0: "a0"}).collect()}
    assert got["v"] == ("1/1", 1) and got[None] == ("0/0", 1) and "w" not in got
    assert merge.merged_records(merge.record_arrays(metrics.with_calls(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_stored_records_need_no_rows(spark, tmp_path):
    for a in ("affy", "broad"):
        (tmp_path / f"{a}.vcf").write_text(HEAD + (BODY if a == "affy" else BODY.replace("0/1:0,1,0", "1/1:0,0,1")))
    parts = [vcf.read_calls(spark, str(tmp_path / f"{a}.vcf"), a) for a in ("affy", "broad")]
    records = parts[0][0].unionByName(parts[1][0]).withColumn("assay_ord", F.when(F.col("assaytype") == "affy", 0).otherwise(1))
    samples = parts[0][1].unionByName(parts[1][1])
    direct = merge.stored_arrays(records, samples)
    spread = merge.record_arrays(metrics.with_calls(vcf.genotypes_of(records, samples)))
    cells = lambda a: sorted(map(tuple, merge.combined_cells(merge.merged_records(a), {0: "affy", 1: "broad"}).collect()))
    assert cells(direct) == cells(spread) and len(cells(direct)) == 5
