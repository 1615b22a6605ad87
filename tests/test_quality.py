"""The general data problems on small tables with nulls, repeats, ties, odd spellings and clashing columns."""

from __future__ import annotations

from datetime import datetime as dt

from panelforge.operators import diff, eav, orphans, strictload

VARIANTS = "vid long, assaytype string, rsid string, loaded_at timestamp, retired_at timestamp, tab string, key string, num long"
GRS = "grs_id long, varid string, loaded_at timestamp, space string"
PATHS = "path_id long, assaytype string, loaded_at timestamp, row_id long"


def day(n):
    return dt(2020, 1, 1 + n)


def test_orphans(spark):
    v = [
        (1, "Affy ", "rs5, 7:10_A_C", day(1), None), (2, "affy", "rs6", day(3), day(5)), (3, "broad", "RS7\t", day(2), day(4)), (4, "broad", "rs7", day(8), None), (5, None, None, day(1), None),
        (6, "exome", "rs9", None, None), (7, "metabo", "rs10", day(6), day(2)), (8, "metabo2", "rs007", day(1), None),
    ]
    variants = spark.createDataFrame([(*r, "x", "y", 1) for r in v], VARIANTS)
    refs = [
        ("rs5", 1, None), ("rs5", 0, "later"), (" RS5\t", 9, None), ("7:10_a_c", 5, None), ("rs6", 3, None), ("rs6", 5, None), ("rs6", 6, "retired"), ("rs7", 3, None), ("rs7", 6, "retired"), ("rs7", 8, None), ("rs7", 1, "later"),
        ("rs8", 9, "unknown"), ("rs9", 9, "unknown"), ("rs10", 9, "unknown"), ("rs07", 9, "unknown"), ("rs007", 9, None), ("", 9, None), (None, 9, None), ("\t ", 9, None), ("rs", 9, "unknown"), ("rs12345678901234567890123", 9, "unknown"), ("x" * 5000, 9, "unknown"), ("rs5", None, "undated"),
    ]
    grs = spark.createDataFrame([(i, k, None if t is None else day(t), "s") for i, (k, t, _) in enumerate(refs)], GRS)
    paths = spark.createDataFrame([(1, " AFFY", day(1), 0), (2, "affy", day(0), 0), (3, "affy6", day(9), 0), (4, "metabo", day(9), 0), (5, "metabo2", day(9), 0), (6, None, day(9), 0)], PATHS)
    got = {(r["tab"], r["row_id"]): r["reason"] for r in orphans.orphans(variants, grs, paths).collect()}
    want = {("grsinput", i): why for i, (_, _, why) in enumerate(refs) if why} | {("filepaths", 2): "later", ("filepaths", 3): "unknown", ("filepaths", 4): "unknown"}
    assert got == want
    report = orphans.orphan_report(orphans.orphans(variants, grs, paths))
    assert sum(r["n_orphans"] for r in report.collect()) == len(want)


def test_orphans_of_empty_tables(spark):
    empty = (spark.createDataFrame([], x) for x in (VARIANTS, GRS, PATHS))
    assert orphans.orphans(*empty).count() == 0
    alone = orphans.orphans(spark.createDataFrame([], VARIANTS), spark.createDataFrame([(1, "rs1", day(1), "s")], GRS), spark.createDataFrame([], PATHS))
    assert [r["reason"] for r in alone.collect()] == ["unknown"]


LEFT = "vid long, name string, n int, x double, _side int, field string"
RIGHT = "vid long, name string, n int, x double"


def test_differences(spark):
    nan = float("nan")
    left = [(1, "a", 1, 1.0), (2, "a", 1, 1.0), (3, "a", None, None), (4, None, 1, nan), (5, "a", 1, 0.5), (6, "a ", 2, nan), (None, "a", 1, 1.0), (8, "", None, float("inf"))]
    right = [(1, "a", 1, 1.0 + 1e-9), (1, "a", 1, 1.0 + 1e-9), (3, "a", None, nan), (4, None, 2, nan), (5, "b", 1, 0.50001), (6, "a", 2, None), (7, "a", 1, 1.0), (7, "a", 1, 1.0), (None, "z", 1, 1.0), (8, None, None, float("inf"))]
    out = diff.table_diff(spark.createDataFrame([(*r, 9, "q") for r in left], LEFT), spark.createDataFrame(right, RIGHT), "vid", 1e-6, "a", "b")
    want = {(2, "missing_in_b"), (7, "missing_in_a"), (3, "x"), (4, "n"), (5, "name"), (5, "x"), (6, "name"), (6, "x"), (8, "name")}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_differences_of_a_key_with_many_copies(spark):
    many = spark.createDataFrame([(1, "a", 1, 1.0)] * 30_000 + [(2, "a", 1, 1.0)], RIGHT)
    one = spark.createDataFrame([(1, "a", 2, 1.0), (2, "a", 1, 1.0)], RIGHT)
    assert [tuple(r) for r in diff.table_diff(one, many, "vid").collect()] == [(1, "n")]
    nan = float("nan")
    versions = spark.createDataFrame([(1, "a", n, x) for x in (nan, None, 2.0, 1.0) for n in (3, None)] * 500, RIGHT)
    assert [tuple(r) for r in diff.table_diff(spark.createDataFrame([(1, "a", None, None)], RIGHT), versions, "vid").collect()] == []
    assert [tuple(r) for r in diff.table_diff(spark.createDataFrame([(1, "a", None, 1.0)], RIGHT), versions.dropna(subset=["x"]), "vid").collect()] == []
    assert diff.table_diff(one.limit(0), many.limit(0), "vid").count() == 0
    assert {tuple(r) for r in diff.table_diff(one.limit(0), one, "vid").collect()} == {(1, "missing_in_left"), (2, "missing_in_left")}


META = "name string, source string, description string, phenoclass string, unit string"
PHENO = "iid string, name string, value string, obs_at timestamp, loaded_at timestamp, conflicts int, _v int"


def pheno(spark, rows):
    return spark.createDataFrame([(i, n, v, o, l, 1, 2) for i, n, v, o, l in rows], PHENO)


def meta(spark):
    return spark.createDataFrame([("waist_circ", "s", "d", "Continuous", "cm"), ("t2d", "s", "d", "Binary", None), ("iid", "s", "d", "Continuous", "kg/m2")], META)


def test_wide(spark):
    t = [day(i) for i in range(9)]
    rows = [
        ("01", "Waist-Circ", "1.80", t[1], t[2]), ("01", " waist circ", "1,8 cm", t[3], t[3]), ("01", "waist_circ", "na", t[4], t[4]), ("01", "waist_circ", "180?", t[4], t[4]), ("01", "T2D", "case", t[1], t[1]), ("01", "t2d", "0", t[2], t[2]), ("01", "tmp1", "5", t[1], t[1]),
        ("1", "waist_circ", "+1.8E2", None, t[2]), ("1", "waist_circ", "90", t[8], t[3]), ("1", "t2d", "1.0", t[1], t[1]), ("1", "iid", "20kg/m2", t[1], t[1]), (None, "t2d", "1", t[1], t[1]), ("2", None, "1", t[1], t[1]), ("3", "t2d", None, None, None), ("3", "iid", "x" * 10_000, t[1], t[1]), ("3", "iid", "1e999", t[1], t[1]),
    ]
    out = {r["iid"]: r.asDict() for r in eav.wide(pheno(spark, rows), meta(spark)).collect()}
    assert set(out) == {"01", "1", "3"}
    assert (out["01"]["waist_circ"], out["01"]["t2d"], out["01"]["conflicts"], out["01"]["cast_failures"]) == (1.8, False, ["t2d"], {"waist_circ": (1, "180?")})
    assert (out["1"]["waist_circ"], out["1"]["t2d"], out["1"]["iid_"], out["1"]["conflicts"], out["1"]["cast_failures"]) == (90.0, None, 20.0, ["waist_circ"], {"t2d": (1, "1.0")})
    assert out["3"]["t2d"] is None and out["3"]["iid_"] is None and set(out["3"]["cast_failures"]) == {"iid"}
    found = eav.contradictory_cells(eav.wide(pheno(spark, rows), meta(spark)))
    assert {tuple(r) for r in found.collect()} == {("01", "t2d"), ("1", "waist_circ")}


def test_wide_of_empty_tables(spark):
    assert eav.wide(pheno(spark, []), meta(spark)).count() == 0
    assert eav.wide(pheno(spark, [("1", "t2d", "1", day(1), day(1))]), spark.createDataFrame([], META)).count() == 0


RAW = "line_id long, feed string, file_name string, line_no int, line string, body string, reason string"

GOOD = [
    ("genemap", "A1 N1 chr1 + 1 2 1 2 1 1, 2,\t"), ("genemap", "A1\tN1\tchr1\t-\t5\t5\t1\t2\t1\t1,\t2,\r"), ("pheno", '"0""1",t2d,"yes"'), ("pheno", "1,nothing,NA"), ("pheno", '1,waist_circ,"1,5 cm"'), ("pheno", ",t2d,"), ("pheno", "1,T2D, Case \r"),
    ("grsinput", "rs1,A,,.5"), ("grsinput", 'rs1,A,"1.0"," -1e-3 "'), ("grsinput", "rs1,A, ,+2.\r"),
]
BAD = [
    ("genemap", "A1 N1 chr1 + 1 2 1 2 1 1,", "field count 10"), ("genemap", "A1 N1 chr1 x 1 2 1 2 1 1, 2,", "strand"), ("genemap", "A1 N1 chr1 + 3 2 1 2 1 1, 2,", "txstart above txend"), ("genemap", "A1 N1 chr1 + 1 2147483648 1 2 1 1, 2,", "txend out of range"), ("genemap", "A1 N1 chr1 + 1 2 1 2.0 1 1, 2,", "cdsend not a number"),
    ("pheno", '1,"t2d,1', "quoting"), ("pheno", '1,"t2d"x,1', "quoting"), ("pheno", "1,t2d", "field count"), ("pheno", "1,t2d,1,5", "field count"), ("pheno", "1,t2d,maybe", "value not readable for its name"), ("pheno", "1,nothing,5", "value not readable for its name"), ("pheno", "x" * 50_000, "field count"),
    ("grsinput", "rs1,A,.5,", "wgt missing"), ("grsinput", "rs1,A,.5,inf", "wgt not a number"), ("grsinput", "rs1,A,.5,1e999", "wgt not finite"), ("grsinput", "rs1,A,1.5,1", "eaf out of range"), ("grsinput", "rs1,A,x,1", "eaf not a number"), ("grsinput", "rs1,A,.5,1,ok", "field count"), ("other", "1", "unknown feed"), (None, "1", "unknown feed"),
]
SKIPPED = [("pheno", None), ("pheno", ""), ("genemap", " \t\r"), ("grsinput", "# x"), ("other", "#")]


def test_strict_load(spark):
    lines = [(f, x) for f, x in GOOD] + [(f, x) for f, x, _ in BAD] + SKIPPED
    raw = spark.createDataFrame([(i, f, "n", i, x, "clash", "clash") for i, (f, x) in enumerate(lines)], RAW)
    got = {r["line_id"]: r["reason"] for r in strictload.rejected(raw, meta(spark)).collect()}
    assert got == {len(GOOD) + i: why for i, (_, _, why) in enumerate(BAD)}
    content = strictload.content_lines(raw)
    loaded = [strictload.load_genemap(content), strictload.load_pheno(content, meta(spark)), strictload.load_grsinput(content)]
    assert sum(x.count() for x in loaded) == len(GOOD)
    assert {r["iid"] for r in loaded[1].collect()} >= {'0"1', ""}


def test_strict_load_of_nothing(spark):
    assert strictload.rejected(spark.createDataFrame([], RAW), meta(spark)).count() == 0
