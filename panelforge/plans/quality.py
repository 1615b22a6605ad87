"""Queries of the general data problems (p3 to p7) and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import diff, eav, intervals, orphans, strictload
from panelforge.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_orphans(s: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(s, d, "variants"), table(s, d, "grsinput"), table(s, d, "filepaths"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return p3_orphans(s, d).select("tab", "row_id")


def p3_report(s: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p3_orphans(s, d))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return diff.table_diff(table(s, d, "variants"), table(s, d, "variants_mirror"), "vid", 1e-6, "variants", "mirror")


def p5_wide(s: SparkSession, d: str) -> DataFrame:
    return eav.wide(table(s, d, "pheno"), table(s, d, "pheno_meta"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return eav.contradictory_cells(p5_wide(s, d))


def p5_unpivoted(s: SparkSession, d: str) -> DataFrame:
    """The wide rows taken apart again: cells with a value, conflicts and failures as rows."""
    wide = p5_wide(s, d)
    conflicts = wide.select("iid", F.explode("conflicts").alias("name"), F.lit("conflict").alias("kind"), F.lit(1).cast("long").alias("n"))
    failures = wide.select("iid", F.explode("cast_failures").alias("name", "_f")).select("iid", "name", F.lit("failure").alias("kind"), F.col("_f.n").alias("n"))
    return conflicts.unionByName(failures)


def p5_typed(s: SparkSession, d: str) -> DataFrame:
    """The typed columns alone."""
    return p5_wide(s, d).drop("conflicts", "cast_failures")


def p5_cast_failures(s: SparkSession, d: str) -> DataFrame:
    """Every unreadable text of a cell."""
    return eav.cast_failures(table(s, d, "pheno"), table(s, d, "pheno_meta")).select("iid", "name", "raw", "n_rows")


def p5_failures(s: SparkSession, d: str) -> DataFrame:
    return eav.failure_report(table(s, d, "pheno"), table(s, d, "pheno_meta"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return intervals.gene_gaps(table(s, d, "genemap"))


def p6_stretches(s: SparkSession, d: str) -> DataFrame:
    return intervals.gene_stretches(table(s, d, "genemap"))


def p7_rejected(s: SparkSession, d: str) -> DataFrame:
    return strictload.rejected(table(s, d, "raw_lines"), table(s, d, "pheno_meta"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return p7_rejected(s, d).select("line_id")


def p7_rejected_lines(s: SparkSession, d: str) -> DataFrame:
    """The rejected lines without the reason, which SQL does not know."""
    return p7_rejected(s, d).drop("reason")


def p7_summary(s: SparkSession, d: str) -> DataFrame:
    return strictload.load_summary(table(s, d, "raw_lines"), table(s, d, "pheno_meta"))


def p7_loaded_genemap(s: SparkSession, d: str) -> DataFrame:
    return strictload.load_genemap(strictload.content_lines(table(s, d, "raw_lines"))).withColumns({c: F.array_join(c, ",") for c in ("exonstarts", "exonends")})


def p7_loaded_pheno(s: SparkSession, d: str) -> DataFrame:
    return strictload.load_pheno(strictload.content_lines(table(s, d, "raw_lines")), table(s, d, "pheno_meta"))


def p7_loaded_grsinput(s: SparkSession, d: str) -> DataFrame:
    return strictload.load_grsinput(strictload.content_lines(table(s, d, "raw_lines"))).select("line_id", "varid", "ea", F.round("eaf", 6).alias("eaf"), F.round("wgt", 6).alias("wgt"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_report, p4_found, p5_wide, p5_typed, p5_found, p5_failures, p5_cast_failures, p5_unpivoted, p6_found, p6_stretches, p7_found, p7_rejected, p7_rejected_lines, p7_summary, p7_loaded_genemap, p7_loaded_pheno, p7_loaded_grsinput)}

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _TRIM.format(c)


_P3 = rf"""
WITH parents AS (
  SELECT 'grsinput' AS tab, lower({_strip('k')}) AS key, loaded_at, retired_at
  FROM (SELECT unnest(string_split(rsid, ',')) AS k, loaded_at, retired_at FROM variants)
  UNION ALL SELECT 'filepaths', lower({_strip('assaytype')}), loaded_at, retired_at FROM variants),
refs AS (
  SELECT 'grsinput' AS tab, grs_id AS row_id, lower({_strip('varid')}) AS key, loaded_at AS ts FROM grsinput
  UNION ALL SELECT 'filepaths', path_id, lower({_strip('assaytype')}), loaded_at FROM filepaths),
orphan AS (
  SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.tab = r.tab AND p.key = r.key AND (p.retired_at IS NULL OR p.retired_at >= p.loaded_at)) THEN 'unknown'
                   WHEN EXISTS (SELECT 1 FROM parents p WHERE p.tab = r.tab AND p.key = r.key AND p.loaded_at <= r.ts AND p.retired_at >= p.loaded_at) THEN 'retired' ELSE 'later' END AS reason
  FROM refs r WHERE r.key <> '' AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.tab = r.tab AND p.key = r.key AND p.loaded_at <= r.ts AND (p.retired_at IS NULL OR p.retired_at >= r.ts)))
"""

_P4_FIELDS = ("assaytype", "rsid", "chromosome", "startposition", "allelea", "alleleb")
_P4_DOUBLES = ("ref_maf", "infoscore", "cr", "errpct")
_P4 = (
    "SELECT vid, 'missing_in_mirror' AS field FROM variants WHERE vid NOT IN (SELECT vid FROM variants_mirror) UNION ALL "
    "SELECT DISTINCT vid, 'missing_in_variants' FROM variants_mirror WHERE vid NOT IN (SELECT vid FROM variants)"
    + "".join(f" UNION ALL SELECT DISTINCT vid, '{c}' FROM variants a JOIN variants_mirror b USING (vid) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in _P4_FIELDS)
    + "".join(
        f" UNION ALL SELECT DISTINCT vid, '{c}' FROM variants a JOIN variants_mirror b USING (vid) WHERE NOT CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN a.{c} IS NULL AND b.{c} IS NULL"
        f" WHEN isnan(a.{c}) OR isnan(b.{c}) THEN isnan(a.{c}) AND isnan(b.{c}) ELSE abs(a.{c} - b.{c}) <= 0.000001 END"
        for c in _P4_DOUBLES
    )
)

_NUM = r"[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)(e[+-]?[0-9]+)?"
_VALUE = rf"""CASE WHEN v IS NULL OR v IN ('', 'na', 'n/a', 'null', 'missing', '.', '-9') THEN NULL
  WHEN m.phenoclass = 'Binary' THEN CASE WHEN v IN ('1', 'yes', 'y', 'true', 'case') THEN 1.0::DOUBLE WHEN v IN ('0', 'no', 'n', 'false', 'control') THEN 0.0::DOUBLE END
  WHEN regexp_extract(v, '^{_NUM}') <> '' AND trim(regexp_replace(v, '^{_NUM}', '')) IN ('', lower(coalesce(m.unit, '')))
  THEN try_cast(replace(regexp_extract(v, '^{_NUM}'), ',', '.') AS DOUBLE) END"""


def _name(c: str) -> str:
    return rf"regexp_replace(lower({_strip(c)}), '[\s_-]+', '_', 'g')"


_CELLS = rf"""
WITH rows_ AS (SELECT iid, {_name('name')} AS n, value AS raw, lower({_strip('value')}) AS v, obs_at, loaded_at FROM pheno),
read_ AS (SELECT iid, m.name, raw, {_VALUE} AS x, v IS NULL OR v IN ('', 'na', 'n/a', 'null', 'missing', '.', '-9') AS missing,
            CASE WHEN obs_at <= coalesce(loaded_at, obs_at) THEN obs_at END AS o, loaded_at, m.phenoclass
          FROM rows_ r JOIN pheno_meta m ON r.n = {_name('m.name')}),
best AS (SELECT iid, name, x FROM (SELECT *, row_number() OVER (PARTITION BY iid, name ORDER BY o IS NOT NULL DESC, o DESC NULLS LAST, loaded_at DESC NULLS LAST, x DESC) AS k
         FROM read_ WHERE x IS NOT NULL) WHERE k = 1),
cells AS (SELECT iid, name, count(*) AS n_rows, count_if(missing) AS n_missing, count_if(x IS NULL AND NOT missing) AS n_failed,
            min(CASE WHEN x IS NULL AND NOT missing THEN raw END) AS failed, min(x) AS lo, max(x) AS hi FROM read_ GROUP BY iid, name)
"""

#: The attributes of pheno_meta, which is fixed.
_CONTINUOUS = "age_at_visit bmi body_weight crp dbp egfr fasting_glucose ferritin fev1 hba1c hdl_chol height ldl_chol pulse_rate sbp triglyc vitamin_d waist_circ".split()
_BINARY = "asthma hypertension smoker_ever statin_use stroke_hx t2d".split()

_ISLANDS = rf"""
WITH g AS (SELECT DISTINCT upper({_strip('genename')}) AS genename, regexp_replace(upper({_strip('chrom')}), '^(CHR)?0*', '') AS chrom, txstart::BIGINT AS s, txend::BIGINT AS e FROM genemap WHERE txstart < txend),
o AS (SELECT *, max(e) OVER (PARTITION BY genename, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g WHERE genename <> '' AND chrom <> ''),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY genename, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
"""

_F = r'([^",]*|"(?:[^"]|"")*")'


def _csv(i: int, n: int) -> str:
    f = f"regexp_extract(body, '^{','.join([_F] * n)}$', {i})"
    return f"""CASE WHEN {f} LIKE '"%' THEN replace(substr({f}, 2, length({f}) - 2), '""', '"') ELSE {f} END"""


_DEC = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_P7 = rf"""
WITH body_ AS (SELECT line_id, feed, line_no, regexp_replace(line, '\r$', '') AS body FROM raw_lines WHERE line IS NOT NULL AND {_strip('line')} <> '' AND line NOT LIKE '#%'),
gf AS (SELECT line_id, regexp_split_to_array({_strip('body')}, '\s+') AS f FROM body_ WHERE feed = 'genemap'),
gn AS (SELECT line_id, f, list_transform(f[5:9], lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN try_cast(x AS INTEGER) END) AS b FROM gf WHERE len(f) = 11 AND f[4] IN ('+', '-')),
genemap_ AS (SELECT * FROM gn WHERE b[1] <= b[2] AND b[3] IS NOT NULL AND b[4] IS NOT NULL AND b[5] IS NOT NULL),
pf AS (SELECT line_id, {_csv(1, 3)} AS iid, {_csv(2, 3)} AS name, {_csv(3, 3)} AS value FROM body_ WHERE feed = 'pheno' AND regexp_matches(body, '^{','.join([_F] * 3)}$')),
pv AS (SELECT *, lower({_strip('value')}) AS v, {_name('name')} AS n FROM pf),
pheno_ AS (SELECT line_id, iid, p.name, value, {_VALUE} AS number, v FROM pv p LEFT JOIN pheno_meta m ON p.n = {_name('m.name')}
  WHERE v IN ('', 'na', 'n/a', 'null', 'missing', '.', '-9') OR (m.name IS NOT NULL AND {_VALUE} IS NOT NULL)),
wf AS (SELECT line_id, {_csv(1, 4)} AS varid, {_csv(2, 4)} AS ea, {_strip(_csv(3, 4))} AS eaf, {_strip(_csv(4, 4))} AS wgt FROM body_ WHERE feed = 'grsinput' AND regexp_matches(body, '^{','.join([_F] * 4)}$')),
grs_ AS (SELECT line_id, varid, ea, CASE WHEN eaf <> '' THEN eaf::DOUBLE END AS eaf, wgt::DOUBLE AS wgt FROM wf
  WHERE regexp_full_match(wgt, '{_DEC}') AND isfinite(try_cast(wgt AS DOUBLE)) AND (eaf = '' OR (regexp_full_match(eaf, '{_DEC}') AND try_cast(eaf AS DOUBLE) BETWEEN 0 AND 1))),
loaded AS (SELECT line_id FROM genemap_ UNION ALL SELECT line_id FROM pheno_ UNION ALL SELECT line_id FROM grs_),
bad AS (SELECT * FROM body_ WHERE line_id NOT IN (SELECT line_id FROM loaded))
"""

ORACLES: dict[str, str] = {
    "p3_found": _P3 + "SELECT tab, row_id FROM orphan",
    "p3_report": _P3 + "SELECT tab, strftime(ts, '%Y-%m') AS month, reason, count(*) AS n_orphans, count(DISTINCT key) AS n_keys FROM orphan GROUP BY ALL",
    "p4_found": _P4,
    "p5_found": _CELLS + "SELECT iid, name FROM cells WHERE lo < hi",
    "p5_typed": _CELLS + "SELECT iid, " + ", ".join([f"max(CASE WHEN name = '{n}' THEN x END) AS {n}" for n in _CONTINUOUS] + [f"max(CASE WHEN name = '{n}' THEN x END) = 1.0 AS {n}" for n in _BINARY]) + " FROM (SELECT DISTINCT iid FROM cells) LEFT JOIN best USING (iid) GROUP BY iid",
    "p5_cast_failures": _CELLS + "SELECT iid, name, raw, count(*) AS n_rows FROM read_ WHERE x IS NULL AND NOT missing AND iid IS NOT NULL GROUP BY iid, name, raw",
    "p5_unpivoted": _CELLS + "SELECT iid, name, 'conflict' AS kind, 1::BIGINT AS n FROM cells WHERE lo < hi UNION ALL SELECT iid, name, 'failure', n_failed::BIGINT FROM cells WHERE n_failed > 0",
    "p5_failures": _CELLS + "SELECT name, count(*) AS n_cells, sum(n_rows)::BIGINT AS n_rows, sum(n_missing)::BIGINT AS n_missing, sum(n_failed)::BIGINT AS n_failed, count_if(lo < hi)::BIGINT AS n_conflicts FROM cells GROUP BY name",
    "p6_found": _ISLANDS + "SELECT genename, chrom, top AS gap_start, s AS gap_end FROM o WHERE s > top",
    "p6_stretches": _ISLANDS + "SELECT genename, chrom, min(s) AS stretch_start, max(e) AS stretch_end FROM i GROUP BY genename, chrom, island",
    "p7_found": _P7 + "SELECT line_id FROM bad",
    "p7_rejected_lines": _P7 + "SELECT line_id, feed, file_name, line_no, body AS line FROM bad JOIN (SELECT line_id, file_name FROM raw_lines) USING (line_id)",
    "p7_summary": _P7 + "SELECT feed, count(*) AS n_lines, count_if(line_id IN (SELECT line_id FROM bad))::BIGINT AS n_rejected, count_if(line_id NOT IN (SELECT line_id FROM bad))::BIGINT AS n_loaded FROM body_ GROUP BY feed",
    "p7_loaded_genemap": _P7 + "SELECT line_id, f[1] AS genename, f[2] AS name, f[3] AS chrom, f[4] AS strand, b[1] AS txstart, b[2] AS txend, b[3] AS cdsstart, b[4] AS cdsend, b[5] AS exoncount, " + ", ".join(f"array_to_string(list_filter(list_transform(string_split(f[{i}], ','), lambda x: try_cast(CASE WHEN regexp_full_match(x, '\\s*[+-]?[0-9]+\\s*') THEN x END AS INTEGER)), lambda x: x IS NOT NULL), ',') AS {n}" for i, n in ((10, "exonstarts"), (11, "exonends"))) + " FROM genemap_",
    "p7_loaded_pheno": _P7 + "SELECT line_id, iid, name, value, number FROM pheno_",
    "p7_loaded_grsinput": _P7 + "SELECT line_id, varid, ea, round(eaf, 6) AS eaf, round(wgt, 6) AS wgt FROM grs_",
}
