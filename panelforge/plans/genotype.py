"""Queries of the genotype store and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import genotype as G
from panelforge.operators import annotate, assoc, catalogue, chunks, combine, grs, merge, metrics, qc, reshape
from panelforge.plans.fixture import ASSAYS, SQL, genotypes, phenotypes, sample_registry, weights
from panelforge.plans.fixture import catalogue as derived_catalogue
from panelforge.session import broadcast_if_small, cut, table
from panelforge.sources import vcf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Ends of the centromeres in megabases, rounded.
CENTROMERES = {1: 125, 2: 94, 3: 91, 4: 51, 5: 49, 6: 61, 7: 60, 8: 46, 9: 50, 10: 41, 11: 54, 12: 36, 13: 18, 14: 18, 15: 19, 16: 37, 17: 25, 18: 18, 19: 27, 20: 28, 21: 14, 22: 15}
#: A request: the ids asked for, in this order.
REQUEST = ("rs1005", "rs1027", "rs1049")


def query(sql: str | None = None, prefix: str = SQL) -> Callable[[Query], Query]:
    """Registers a query under its name, with its DuckDB counterpart."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (prefix if sql.lstrip().upper().startswith(("SELECT", ",")) else "") + sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def long(s: SparkSession, d: str) -> DataFrame:
    """The derived genotypes, written once per query: they stand for the stored table, which a combination reads more than
    once."""
    return cut(genotypes(s, d).withColumn("assay_ord", F.col("assay_no")))


def called(s: SparkSession, d: str) -> DataFrame:
    return metrics.with_calls(genotypes(s, d).withColumn("assay_ord", F.col("assay_no")))


def merged(s: SparkSession, d: str, policy: str = "argmax") -> DataFrame:
    """All records, and the combined one of each variant."""
    return merge.merged_records(merge.record_arrays(called(s, d)), policy)


def combined(s: SparkSession, d: str, policy: str = "argmax") -> DataFrame:
    """The cells of the combined records."""
    return merge.combined_cells(merged(s, d, policy), dict(enumerate(ASSAYS)))


def request(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, x) for i, x in enumerate(REQUEST)], "req_ord int, rsid string")


# --- calls and metrics --------------------------------------------------------------------------------------------------

_COUNTS = """
, counts AS (SELECT assaytype, rsid, any_value(ref) AS ref, any_value(alt) AS alt, any_value(info) AS info, any_value(chromosome) AS chromosome, any_value(position) AS position,
  count_if(gt = '0/0')::BIGINT AS homref, count_if(gt = '0/1')::BIGINT AS het, count_if(gt = '1/1')::BIGINT AS homalt, count_if(gt = './.')::BIGINT AS miss, count(*) AS alln FROM g GROUP BY assaytype, rsid)
"""
_METRICS = _COUNTS + """
, af AS (SELECT *, alln - miss AS n, (homref + het + homalt) / alln::DOUBLE AS cr, (2 * homref + het) / nullif(2 * (alln - miss), 0)::DOUBLE AS raf, (2 * homalt + het) / nullif(2 * (alln - miss), 0)::DOUBLE AS aaf FROM counts)
, hw AS (SELECT assaytype, rsid, het, homref + het + homalt AS m, 2 * least(homref, homalt) + het AS rare FROM counts)
, hl AS (SELECT assaytype, rsid, h = het AS seen, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma(m - h - (rare - h) / 2 + 1) AS w FROM hw, unnest(generate_series(rare % 2, rare, 2)) AS t(h) WHERE m > 0)
, ht AS (SELECT *, max(w) OVER (PARTITION BY assaytype, rsid) AS top, max(CASE WHEN seen THEN w END) OVER (PARTITION BY assaytype, rsid) AS own FROM hl)
, hp AS (SELECT assaytype, rsid, least(1.0, sum(CASE WHEN exp(w - top) <= exp(own - top) * (1 + 1e-9) THEN exp(w - top) ELSE 0 END) / sum(exp(w - top))) AS hwep FROM ht GROUP BY assaytype, rsid)
, m AS (SELECT af.*, least(raf, aaf) AS maf, hwep FROM af LEFT JOIN hp USING (assaytype, rsid))
"""


@query("SELECT assaytype, gt, dosage, count(*) AS n, round(avg(p), 6) AS mean_p FROM (SELECT assaytype, gt, hi AS p, CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END AS dosage FROM g) GROUP BY ALL")
def genotype_calls(s: SparkSession, d: str) -> DataFrame:
    return called(s, d).groupBy("assaytype", "gt", "dosage").agg(F.count("*").alias("n"), r(F.avg("p")).alias("mean_p"))


@query(_COUNTS + "SELECT assaytype, rsid, homref, het, homalt, miss, alln FROM counts")
def genotype_counts(s: SparkSession, d: str) -> DataFrame:
    return metrics.call_counts(called(s, d), "assaytype", "rsid").drop("dot")


@query(_COUNTS + "SELECT assaytype, rsid, homref, het, homalt, miss, alln FROM counts")
def genotype_counts_array(s: SparkSession, d: str) -> DataFrame:
    records = called(s, d).groupBy("assaytype", "rsid").agg(F.collect_list("gt").alias("calls"))
    return metrics.array_counts(records).drop("dot", "calls")


@query(_METRICS + "SELECT assaytype, rsid, n, miss, round(cr, 6) AS cr, round(raf, 6) AS raf, round(aaf, 6) AS aaf, round(maf, 6) AS maf, round(hwep, 8) AS hwep FROM m")
def variant_stats(s: SparkSession, d: str) -> DataFrame:
    m = metrics.record_metrics(metrics.call_counts(called(s, d), "assaytype", "rsid"))
    return m.select("assaytype", "rsid", "n", "miss", *[r(c).alias(c) for c in ("cr", "raf", "aaf", "maf")], r("hwep", 8).alias("hwep"))


@query(_METRICS + "SELECT assaytype, min(round(hwep, 8)) AS lowest, max(round(hwep, 8)) AS highest, count_if(hwep < 0.05)::BIGINT AS n_below FROM m GROUP BY assaytype")
def hwe_exact(s: SparkSession, d: str) -> DataFrame:
    m = metrics.record_metrics(metrics.call_counts(called(s, d), "assaytype", "rsid"))
    return m.groupBy("assaytype").agg(F.min(r("hwep", 8)).alias("lowest"), F.max(r("hwep", 8)).alias("highest"), F.count_if(F.col("hwep") < 0.05).alias("n_below"))


@query(_METRICS + "SELECT assaytype, rsid, CASE WHEN homref < homalt THEN ref ELSE alt END AS minor, round(maf, 6) AS maf FROM m")
def maf_minor_allele(s: SparkSession, d: str) -> DataFrame:
    m = metrics.record_metrics(metrics.call_counts(called(s, d), "assaytype", "rsid", "ref", "alt"))
    return m.select("assaytype", "rsid", metrics.minor_allele(F.col("ref"), F.col("alt")).alias("minor"), r("maf").alias("maf"))


@query(_METRICS + "SELECT rsid, assaytype, chromosome, position, ref, round(raf, 6) AS ref_fr, alt, round(aaf, 6) AS alt_fr, round(maf, 6) AS maf, CASE WHEN info <> 1.0 THEN 1 ELSE 0 END AS imputed, round(cr, 5) AS call_rate, round(info, 5) AS info FROM m")
def web_summary(s: SparkSession, d: str) -> DataFrame:
    m = metrics.record_metrics(metrics.call_counts(called(s, d), "rsid", "assaytype", "chromosome", "position", "ref", "alt", "info"))
    return m.select("rsid", "assaytype", "chromosome", "position", "ref", r("raf").alias("ref_fr"), "alt", r("aaf").alias("alt_fr"), r("maf").alias("maf"), F.when(F.col("info") != 1.0, 1).otherwise(0).alias("imputed"), r("cr", 5).alias("call_rate"), r("info", 5).alias("info"))


@query(_COUNTS + "SELECT assaytype, count(*) AS n_records, sum(homref)::BIGINT AS homref, sum(het)::BIGINT AS het, sum(homalt)::BIGINT AS homalt, sum(miss)::BIGINT AS miss FROM counts GROUP BY assaytype")
def file_totals(s: SparkSession, d: str) -> DataFrame:
    return metrics.file_totals(metrics.call_counts(called(s, d), "assaytype", "rsid"), "assaytype").drop("dot")


@query(
    _COUNTS
    + ", f AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY rsid ORDER BY assaytype) = 1) SELECT c.rsid, f.assaytype AS first_panel, c.assaytype AS panel, round(x, 6) AS chi_square, round(exp(-x / 2), 8) AS p_value, exp(-x / 2) >= 1e-8 AS concordant FROM (SELECT c.rsid, c.assaytype, "
    "(f.homref - c.homref) ** 2 / (c.homref + 1)::DOUBLE + (f.het - c.het) ** 2 / (c.het + 1)::DOUBLE + (f.homalt - c.homalt) ** 2 / (c.homalt + 1)::DOUBLE AS x FROM counts c JOIN f USING (rsid) WHERE c.assaytype > f.assaytype) c JOIN f USING (rsid)"
)
def concordance_chisq(s: SparkSession, d: str) -> DataFrame:
    out = metrics.chi_square_concordance(metrics.call_counts(called(s, d), "rsid", "assaytype"), "rsid", "assaytype")
    return out.withColumn("chi_square", r("chi_square")).withColumn("p_value", r("p_value", 8))


# --- combining ------------------------------------------------------------------------------------------------------------

_ACCEPTED = """
, fst AS (SELECT rsid, ref AS ref1, alt AS alt1 FROM g QUALIFY row_number() OVER (PARTITION BY rsid ORDER BY assay_no, ref, alt) = 1)
, ok AS (SELECT g.* FROM g JOIN fst USING (rsid) WHERE ref = ref1 AND alt = alt1)
, cell AS (SELECT rsid, sample_id, count(*) AS n_panels, count(DISTINCT gt) AS n_calls, count_if(gt = './.')::BIGINT AS n_missing FROM ok GROUP BY rsid, sample_id)
"""
_ARGMAX = _ACCEPTED + ", win AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY rsid, sample_id ORDER BY hi DESC, assay_no) = 1)"
_STEP = """
, s{i} AS (SELECT s.rsid, s.sample_id, CASE WHEN w THEN e.gt ELSE s.gt END AS gt, CASE WHEN w THEN e.hi ELSE s.p END AS p, CASE WHEN w THEN e.info ELSE s.info END AS info, CASE WHEN w THEN e.assaytype ELSE s.at END AS at,
  s.same + CASE WHEN o AND e.hi = s.p THEN 1 ELSE 0 END AS same, s.diff + CASE WHEN o AND e.hi <> s.p AND s.p <> 0 THEN 1 ELSE 0 END AS diff
  FROM s{j} s LEFT JOIN ok e ON e.rsid = s.rsid AND e.sample_id = s.sample_id AND e.assay_no = {k},
  LATERAL (SELECT coalesce(e.gt <> s.gt, false) AS o), LATERAL (SELECT coalesce(o AND ((e.hi = s.p AND e.info > s.info) OR (e.hi <> s.p AND e.hi > s.p)), false) AS w))"""
_FOLD = _ACCEPTED + ", s0 AS (SELECT DISTINCT rsid, sample_id, '' AS gt, 0.0::DOUBLE AS p, 0.0::DOUBLE AS info, '' AS at, 0 AS same, 0 AS diff FROM ok)" + "".join(_STEP.format(i=i + 1, j=i, k=i) for i in range(5)) + """
, folded AS (SELECT s.rsid, s.sample_id, s.gt, s.p, s.at AS assaytype, n_panels, n_calls, n_missing, CASE WHEN n_panels > 1 THEN same ELSE 0 END AS same_prob, CASE WHEN n_panels > 1 THEN diff ELSE 0 END AS diff_prob FROM s5 s JOIN cell USING (rsid, sample_id))
"""


@query(_ARGMAX + "SELECT rsid, sample_id, gt, round(hi, 6) AS p, assaytype, n_panels::INT AS n_panels, n_calls::INT AS n_calls FROM win JOIN cell USING (rsid, sample_id)")
def combine_argmax(s: SparkSession, d: str) -> DataFrame:
    return combined(s, d).select("rsid", "sample_id", "gt", r("p").alias("p"), "assaytype", "n_panels", "n_calls")


@query(_FOLD + "SELECT rsid, sample_id, gt, round(p, 6) AS p, assaytype, n_panels::INT AS n_panels, same_prob, diff_prob FROM folded")
def combine_fold(s: SparkSession, d: str) -> DataFrame:
    return combined(s, d, "fold").select("rsid", "sample_id", "gt", r("p").alias("p"), "assaytype", "n_panels", "same_prob", "diff_prob")


@query(_ACCEPTED + ", cr AS (SELECT assaytype, rsid, avg(CASE WHEN gt = './.' THEN 0.0 ELSE 1.0 END) AS record_cr FROM g GROUP BY ALL), w2 AS (SELECT ok.* FROM ok JOIN cr USING (assaytype, rsid) QUALIFY row_number() OVER (PARTITION BY rsid, sample_id ORDER BY hi DESC, round(record_cr, 9) DESC, assay_no) = 1) SELECT rsid, sample_id, gt, round(hi, 6) AS p, assaytype FROM w2")
def combine_callrate(s: SparkSession, d: str) -> DataFrame:
    return combined(s, d, "callrate").select("rsid", "sample_id", "gt", r("p").alias("p"), "assaytype")


_CM = _FOLD + """
, ag AS (SELECT rsid, count(*) AS all_geno FROM g GROUP BY rsid)
, cm AS (SELECT rsid, all_geno, (SELECT count(DISTINCT sample_id) FROM g) AS unique_geno, count_if(n_panels > 1)::BIGINT AS overlap_test, count_if(n_panels = 2)::BIGINT AS two_overlap, count_if(n_panels > 2)::BIGINT AS gt_two_overlap,
  sum(CASE WHEN n_panels > 1 THEN n_calls - 1 ELSE 0 END)::BIGINT AS mismatch, sum(CASE WHEN n_panels > 1 THEN n_missing ELSE 0 END)::BIGINT AS miss_test, count_if(gt = './.')::BIGINT AS missing, sum(same_prob)::BIGINT AS same_prob_diffs, sum(diff_prob)::BIGINT AS diff_prob_diffs
  FROM folded JOIN ag USING (rsid) GROUP BY rsid, all_geno)
"""
_CM_COLS = ("all_geno", "unique_geno", "overlap_test", "two_overlap", "gt_two_overlap", "mismatch", "miss_test", "missing", "same_prob_diffs", "diff_prob_diffs")


def _fold_counters(s: SparkSession, d: str) -> DataFrame:
    return merge.combined_counters(merged(s, d, "fold"), genotypes(s, d).select("sample_id").distinct().count())


@query(_CM + f"SELECT rsid, {', '.join(_CM_COLS)}, round(coalesce(100.0::DOUBLE * mismatch / nullif(overlap_test, 0), 0), 6) AS err_pct FROM cm")
def combine_metrics(s: SparkSession, d: str) -> DataFrame:
    return _fold_counters(s, d).select("rsid", *_CM_COLS, r("err_pct").alias("err_pct"))


@query(_CM + f"SELECT count(*) AS n_variants, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _CM_COLS)} FROM cm")
def combine_totals(s: SparkSession, d: str) -> DataFrame:
    return combine.total_metrics(_fold_counters(s, d))


@query(_CM + "SELECT rsid, mismatch, overlap_test FROM cm WHERE coalesce(100.0::DOUBLE * mismatch / nullif(overlap_test, 0), 0) < 80.0")
def errpct_gate(s: SparkSession, d: str) -> DataFrame:
    return combine.error_gate(_fold_counters(s, d), 80.0).select("rsid", "mismatch", "overlap_test")


@query(_ACCEPTED + "SELECT DISTINCT rsid, assaytype, ref, alt FROM g JOIN fst USING (rsid) WHERE ref <> ref1 OR alt <> alt1")
def merge_rejects(s: SparkSession, d: str) -> DataFrame:
    return combine.rejected_records(long(s, d))


def _descending(sql: str) -> str:
    """The fold with panels in descending name order."""
    for k in range(5):
        sql = sql.replace(f"e.assay_no = {k},", f"e.assay_no = {4 - k}@,")
    return sql.replace("@,", ",").replace("ORDER BY assay_no, ref, alt", "ORDER BY assay_no DESC, ref, alt")


@query(
    _descending(_FOLD)
    + ", er AS (SELECT rsid FROM folded GROUP BY rsid HAVING coalesce(100.0::DOUBLE * sum(CASE WHEN n_panels > 1 THEN n_calls - 1 ELSE 0 END) / nullif(count_if(n_panels > 1), 0), 0) < 100.0) SELECT chromosome || ':' || position AS place, f.sample_id, f.gt, round(f.p, 6) AS p, f.assaytype FROM folded f JOIN er USING (rsid) JOIN (SELECT DISTINCT rsid, chromosome, position FROM g) USING (rsid)"
)
def chromosome_merge(s: SparkSession, d: str) -> DataFrame:
    return combine.chromosome_merge(long(s, d), err_pct=100.0).select("place", "sample_id", "gt", r("p").alias("p"), "assaytype")


@query()
def combined_variant_metrics(s: SparkSession, d: str) -> DataFrame:
    """The result page: metrics per panel and of the combined record."""
    rows = merge.results(merged(s, d))
    return rows.select("rsid", "assaytype", "chromosome", "position", "ref", "alt", "miss", "n", *[r(c).alias(c) for c in ("raf", "aaf", "cr", "maf", "info", "errpct")], r("hwep", 8).alias("hwep"))


ORACLES["combined_variant_metrics"] = (
    SQL + _ARGMAX + _METRICS.replace("counts AS (SELECT assaytype, rsid,", "both_ AS (SELECT assay_no, assaytype, rsid, ref, alt, info, chromosome, position, gt FROM g UNION ALL SELECT assay_no, 'combined', rsid, ref, alt, info, chromosome, position, gt FROM win), counts AS (SELECT assaytype, rsid,").replace("AS alln FROM g GROUP BY", "AS alln FROM both_ GROUP BY")
    + """, lst AS (SELECT DISTINCT rsid, ref, alt, info FROM ok QUALIFY assay_no = max(assay_no) OVER (PARTITION BY rsid))
    , er AS (SELECT rsid, coalesce(100.0::DOUBLE * sum(CASE WHEN n_panels > 1 THEN n_calls - 1 ELSE 0 END) / nullif(count_if(n_panels > 1), 0), 0) AS errpct FROM cell GROUP BY rsid)
    SELECT rsid, assaytype, chromosome, position, CASE WHEN assaytype = 'combined' THEN l.ref ELSE m.ref END AS ref, CASE WHEN assaytype = 'combined' THEN l.alt ELSE m.alt END AS alt, miss, n, round(raf, 6) AS raf, round(aaf, 6) AS aaf, round(cr, 6) AS cr, round(maf, 6) AS maf,
      round(CASE WHEN assaytype = 'combined' THEN l.info ELSE m.info END, 6) AS info, CASE WHEN assaytype = 'combined' THEN round(errpct, 6) END AS errpct, round(hwep, 8) AS hwep FROM m JOIN lst l USING (rsid) JOIN er USING (rsid)"""
)

ORACLES["request_results"] = f"SELECT list_position({list(REQUEST)}, rsid) - 1 AS req_ord, q.* FROM ({ORACLES['combined_variant_metrics']}) q WHERE rsid IN {REQUEST}"


@query()
def request_results(s: SparkSession, d: str) -> DataFrame:
    """The same for a list of requested ids, in the order of the request; the list is broadcast and prunes the genotypes
    before anything is shuffled."""
    asked = request(s)
    rows = merge.results(merge.merged_records(merge.record_arrays(combine.requested(called(s, d), asked).drop("req_ord"))))
    rows = rows.join(F.broadcast(asked), "rsid").orderBy("req_ord", "assaytype")  # the list is the request itself
    return rows.select("req_ord", "rsid", "assaytype", "chromosome", "position", "ref", "alt", "miss", "n", *[r(c).alias(c) for c in ("raf", "aaf", "cr", "maf", "info", "errpct")], r("hwep", 8).alias("hwep"))


# --- quality control ------------------------------------------------------------------------------------------------------

_QC = _METRICS + """
, fl AS (SELECT m.*, (10 + ((substr(rsid, 3)::INT - 1000) * 13) % 40) / 100.0::DOUBLE AS ref_maf FROM m)
, bad AS (SELECT *, position % 7000 = 0 AS b_posn, maf < 0.15 AS b_maf, hwep < 0.001 AS b_hwe, cr < 0.85 AS b_cr, info < 0.6 AS b_info, maf < ref_maf / 1.5 OR maf > ref_maf * 1.5 AS b_mf FROM fl)
"""


def _flagged(s: SparkSession, d: str) -> DataFrame:
    m = metrics.record_metrics(metrics.call_counts(called(s, d), "assaytype", "rsid", "chromosome", "position", "ref", "alt", "info"))
    m = m.withColumn("ref_maf", (10 + ((F.substring("rsid", 3, 20).cast("int") - 1000) * 13) % 40) / 100.0)
    excluded = derived_catalogue(s, d).where(F.col("position") % 7000 == 0).select("position")
    return qc.qc_flags(m, excluded, maf=0.15, hwe=1e-3, cr=0.85, info=0.6, maffactor=1.5)


@query(_QC + "SELECT assaytype, rsid, round(maf, 6) AS maf, round(cr, 6) AS cr FROM bad WHERE NOT (b_posn OR b_maf OR b_hwe OR b_cr OR b_info OR b_mf)")
def qc_filter(s: SparkSession, d: str) -> DataFrame:
    return qc.qc_filter(_flagged(s, d)).select("assaytype", "rsid", r("maf").alias("maf"), r("cr").alias("cr"))


@query(_QC + "SELECT assaytype, count(*) AS n_read, count_if(NOT (b_posn OR b_maf OR b_hwe OR b_cr OR b_info OR b_mf))::BIGINT AS n_written, count_if(b_posn)::BIGINT AS n_posn, count_if(b_maf)::BIGINT AS n_maf, count_if(b_hwe)::BIGINT AS n_hwe, count_if(b_cr)::BIGINT AS n_cr, count_if(b_info)::BIGINT AS n_info, count_if(b_mf)::BIGINT AS n_maffactor, 0::BIGINT AS n_dot, 0::BIGINT AS n_nocall FROM bad GROUP BY assaytype")
def qc_reason_counts(s: SparkSession, d: str) -> DataFrame:
    return qc.qc_report(_flagged(s, d), "assaytype")


# --- catalogue ------------------------------------------------------------------------------------------------------------

_T = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CHROM = "lpad(CASE WHEN regexp_replace(upper(" + _T.format("{0}") + "), '^(CHR)?0*', '') = 'X' THEN '23' ELSE nullif(regexp_replace(upper(" + _T.format("{0}") + "), '^(CHR)?0*', ''), '') END, 2, '0')"
_CAT = f"""WITH ids AS (SELECT vid, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS rsid FROM (SELECT vid, list_filter(list_transform(string_split(coalesce(rsid, ''), ','), lambda x: lower({_T.format('x')})), lambda x: x NOT IN ('', '.')) AS l FROM variants)),
cat AS (SELECT v.vid, nullif(lower({_T.format('v.assaytype')}), '') AS assaytype, i.rsid, {_CHROM.format('v.chromosome')} AS chromosome, startposition AS position, allelea, alleleb, infoscore, imputed FROM variants v JOIN ids i USING (vid))
"""


@query(_CAT + "SELECT chromosome, assaytype, count(*) AS n_variants FROM cat GROUP BY ALL")
def marker_totals(s: SparkSession, d: str) -> DataFrame:
    return catalogue.marker_totals(catalogue.tidy(table(s, d, "variants")))


@query(_CAT + ", req AS (SELECT DISTINCT lower(" + _T.format("varid") + ") AS rsid FROM grsinput) SELECT vid, assaytype, rsid, chromosome, position, allelea, alleleb FROM cat WHERE rsid IN (SELECT rsid FROM req WHERE rsid IS NOT NULL)")
def variants_by_rsid(s: SparkSession, d: str) -> DataFrame:
    asked = grs.weight_rows(table(s, d, "grsinput")).select(F.col("varid").alias("rsid"))
    return catalogue.by_ids(catalogue.tidy(table(s, d, "variants")), asked).select("vid", "assaytype", "rsid", "chromosome", "position", "allelea", "alleleb")


@query(_CAT + ", req AS (SELECT DISTINCT lower(" + _T.format("varid") + ") AS rsid FROM grsinput) SELECT rsid FROM req WHERE rsid <> '' AND rsid NOT IN (SELECT rsid FROM cat WHERE rsid IS NOT NULL)")
def not_found(s: SparkSession, d: str) -> DataFrame:
    asked = grs.weight_rows(table(s, d, "grsinput")).select(F.col("varid").alias("rsid")).where("rsid <> ''").distinct()
    return combine.not_found(asked, catalogue.tidy(table(s, d, "variants")))


@query("SELECT assaytype, rsid, position, ref, alt FROM (SELECT DISTINCT assaytype, rsid, chromosome, position, ref, alt FROM g) WHERE chromosome = '06' AND position BETWEEN 1000000 AND 1200000")
def variants_in_range(s: SparkSession, d: str) -> DataFrame:
    return catalogue.in_range(derived_catalogue(s, d), "06", 1_000_000, 1_200_000).select("assaytype", "rsid", "position", "ref", "alt")


@query(_CAT + "SELECT vid, assaytype, rsid, position, allelea, alleleb FROM cat WHERE chromosome = '04' AND position BETWEEN 145400000 AND 145600000")
def stored_variants_in_range(s: SparkSession, d: str) -> DataFrame:
    """A range of the stored catalogue; the places reach the scan as a pushed filter."""
    return catalogue.in_range(catalogue.tidy(table(s, d, "variants")), "04", 145_400_000, 145_600_000).select("vid", "assaytype", "rsid", "position", "allelea", "alleleb")


@query(_CAT + "SELECT vid, rsid, CASE WHEN imputed IS NOT NULL OR infoscore <> 1.0 THEN 1 ELSE 0 END AS imputed, CASE WHEN length(allelea) > 10 THEN substr(allelea, 1, 10) || ' ...' ELSE allelea END AS shown, rsid || '_' || assaytype AS selection FROM cat")
def variant_display(s: SparkSession, d: str) -> DataFrame:
    rows = catalogue.with_imputed_flag(catalogue.tidy(table(s, d, "variants")))
    return rows.select("vid", "rsid", "imputed", G.shown_allele(F.col("allelea")).alias("shown"), F.concat("rsid", F.lit("_"), "assaytype").alias("selection"))


@query("SELECT assaytype, count(*) AS n_samples FROM samples GROUP BY assaytype")
def sample_counts(s: SparkSession, d: str) -> DataFrame:
    return catalogue.sample_counts(sample_registry(s, d))


@query("SELECT assaytype, sample_id, list_posn::INT AS list_posn FROM samples")
def samples_in_slot_order(s: SparkSession, d: str) -> DataFrame:
    return sample_registry(s, d).orderBy("assaytype", "list_posn")


@query("SELECT sample_id, count(DISTINCT assaytype) AS n_panels, min(assaytype) AS first_panel FROM samples GROUP BY sample_id")
def sample_union(s: SparkSession, d: str) -> DataFrame:
    return catalogue.sample_union(sample_registry(s, d))


@query("SELECT sample_id, count(DISTINCT assaytype) AS n_panels, min(assaytype) AS first_panel FROM samples GROUP BY sample_id HAVING count(DISTINCT assaytype) >= 2")
def sample_overlap(s: SparkSession, d: str) -> DataFrame:
    return catalogue.overlapping_samples(sample_registry(s, d))


@query("SELECT rsid, sample_id, assaytype, gt, round(hi, 6) AS p FROM g WHERE rsid = 'rs1005' AND sample_id = '000005'")
def sample_genotypes(s: SparkSession, d: str) -> DataFrame:
    return called(s, d).where((F.col("rsid") == "rs1005") & (F.col("sample_id") == "000005")).select("rsid", "sample_id", "assaytype", "gt", r("p").alias("p"))


@query(
    f"WITH f AS (SELECT path_id, nullif(lower({_T.format('assaytype')}), '') AS assaytype, coalesce(fpath_prefix, '') AS p, coalesce(fpath_suffix, '') AS s, unnest(files) AS f FROM filepaths) SELECT path_id, assaytype, lpad(f.chrom, 2, '0') AS chrom, "
    "regexp_replace(concat_ws('/', regexp_replace(p, '/+$', ''), regexp_replace(s, '^/+|/+$', '', 'g'), f.filename), '/{2,}', '/', 'g') AS path FROM f"
)
def file_paths(s: SparkSession, d: str) -> DataFrame:
    return catalogue.file_paths(table(s, d, "filepaths"))


@query(
    _CAT + f", gm AS (SELECT upper({_T.format('genename')}) AS genename, name, {_CHROM.format('chrom')} AS chrom, txstart, txend FROM genemap WHERE txstart <= txend) SELECT vid, rsid, genename, name FROM cat JOIN gm ON cat.chromosome = gm.chrom AND txstart <= position + 5000 AND txend >= position - 5000 WHERE position > 0"
)
def genes_near_position(s: SparkSession, d: str) -> DataFrame:
    places = catalogue.tidy(table(s, d, "variants")).where("position > 0")
    return annotate.genes_near(places, catalogue.genes(table(s, d, "genemap")), 5_000, 5_000).select("vid", "rsid", "genename", "name")


@query(f"SELECT name, count(*) AS n, count(DISTINCT lower({_T.format('varid')})) AS n_ids FROM grsinput GROUP BY name", prefix="")
def stored_weight_names(s: SparkSession, d: str) -> DataFrame:
    return grs.weight_rows(table(s, d, "grsinput")).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("varid").alias("n_ids"))


# --- reshaping ------------------------------------------------------------------------------------------------------------


@query(_ARGMAX + "SELECT sample_id AS \"FID\", sample_id AS \"IID\", " + ", ".join(f"coalesce(max(CASE WHEN rsid = '{i}' THEN CASE gt WHEN '0/0' THEN '0' WHEN '0/1' THEN '1' WHEN '1/1' THEN '2' ELSE '-9' END END), '.') AS {i}" for i in REQUEST) + " FROM (SELECT DISTINCT sample_id FROM g) LEFT JOIN win USING (sample_id) GROUP BY sample_id")
def csv_transpose(s: SparkSession, d: str) -> DataFrame:
    return reshape.transposed(combined(s, d), sample_registry(s, d), list(REQUEST))


_WIDE = ", ".join(f"max(CASE WHEN rsid = '{i}' THEN CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE -9 END END) AS {i}, round(max(CASE WHEN rsid = '{i}' THEN hi END), 6) AS {i}_c, max(CASE WHEN rsid = '{i}' THEN assaytype END) AS {i}_p, max(CASE WHEN rsid = '{i}' THEN alt END) AS {i}_alt" for i in REQUEST)
_WIDE_COLS = [c for i in REQUEST for c in (i, f"{i}_c", f"{i}_p", f"{i}_alt")]


@query(f"SELECT assaytype, sample_id, {_WIDE} FROM g WHERE rsid IN {REQUEST} GROUP BY assaytype, sample_id".replace("max(CASE WHEN rsid", "max(CASE WHEN rsid"))
def csv_web_wide(s: SparkSession, d: str) -> DataFrame:
    wide = reshape.with_confidence(called(s, d).withColumn("_panel", F.col("assaytype")), list(REQUEST), ("_panel", "sample_id"))
    return wide.select(F.col("_panel").alias("assaytype"), "sample_id", *[(r(c) if c.endswith("_c") else F.col(c)).alias(c) for c in _WIDE_COLS])


@query(_ARGMAX + f"SELECT sample_id, {_WIDE} FROM win WHERE rsid IN {REQUEST} GROUP BY sample_id")
def csv_web_wide_combined(s: SparkSession, d: str) -> DataFrame:
    wide = reshape.with_confidence(combined(s, d), list(REQUEST))
    return wide.select("sample_id", *[(r(c) if c.endswith("_c") else F.col(c)).alias(c) for c in _WIDE_COLS])


@query("SELECT assaytype, sample_id, " + ", ".join(f"max(CASE WHEN rsid = '{i}' THEN CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE -9 END END) AS {i}" for i in REQUEST) + f" FROM g WHERE rsid IN {REQUEST} GROUP BY assaytype, sample_id")
def csv_plain(s: SparkSession, d: str) -> DataFrame:
    return reshape.plain_calls(called(s, d), list(REQUEST))


@query(_ARGMAX + f"SELECT sample_id AS \"IID\", rsid, CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 ELSE 2 END AS value FROM win WHERE gt <> './.' AND rsid IN {REQUEST}")
def csv_unpivot(s: SparkSession, d: str) -> DataFrame:
    wide = reshape.transposed(combined(s, d), sample_registry(s, d), list(REQUEST)).replace(".", None)
    return reshape.unpivoted(wide, "IID", list(REQUEST))


@query("SELECT assaytype, rsid, '--- ' || rsid || ' ' || string_agg(CASE WHEN x.p0 IS NULL THEN '0.0000 0.0000 0.0000' ELSE format('{:.4f} {:.4f} {:.4f}', x.p0, x.p1, x.p2) END, ' ' ORDER BY sample_id) AS line FROM (SELECT DISTINCT assaytype, rsid FROM g) r JOIN samples a USING (assaytype) LEFT JOIN (SELECT assaytype, rsid, sample_id, p0, p1, p2 FROM g) x USING (assaytype, rsid, sample_id) GROUP BY assaytype, rsid")
def gen_rows(s: SparkSession, d: str) -> DataFrame:
    return reshape.probability_rows(called(s, d), sample_registry(s, d))


@query(
    "SELECT assaytype, rsid, concat_ws(chr(9), chromosome, position, rsid, ref, alt, '.', '.', 'INFO=1.0', 'GT:GP:AT', string_agg(CASE WHEN x.gt IS NULL THEN '.' ELSE format('{}:{:.4f},{:.4f},{:.4f}:{}', x.gt, x.p0, x.p1, x.p2, upper(assaytype[1])) END, chr(9) ORDER BY list_posn)) AS line "
    "FROM (SELECT DISTINCT assaytype, rsid, chromosome, position, ref, alt FROM g) r JOIN samples a USING (assaytype) LEFT JOIN (SELECT assaytype, rsid, sample_id, gt, p0, p1, p2 FROM g) x USING (assaytype, rsid, sample_id) GROUP BY assaytype, rsid, chromosome, position, ref, alt"
)
def vcf_render(s: SparkSession, d: str) -> DataFrame:
    rows = called(s, d)
    heads = rows.select("assaytype", "rsid", "chromosome", "position", "ref", "alt").distinct().withColumns({"qual": F.lit("."), "filter": F.lit("."), "info": F.lit("INFO=1.0"), "format": F.lit("GT:GP:AT")})
    slots = sample_registry(s, d).select("assaytype", "sample_id", F.col("list_posn").alias("column"))
    return reshape.record_lines(rows.select("rsid", "sample_id", "gt", "probs", "assaytype"), slots, heads)


@query("SELECT assaytype, rsid, sample_id, gt AS file_gt, round(hi, 4) AS prob, assaytype AS platform, alt, position FROM g")
def vcf_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Call-file lines of every panel, read again: the file's own call, probability, panel tag and fields."""
    lines = vcf_render(s, d).select("assaytype", F.col("line").alias("value"), F.lit(0).cast("long").alias("line_ord"))
    rows = vcf.genotypes_of(vcf.records_of(lines, F.col("assaytype")), sample_registry(s, d))
    tag = G.geno_field(F.col("geno"), G.format_index(F.col("format"), "AT"))
    return rows.select("assaytype", "rsid", "sample_id", "file_gt", r(G.top_probability(F.col("probs")), 4).alias("prob"), G.assay_of_tag(tag).alias("platform"), "alt", "position")


@query("SELECT iid, value FROM pheno WHERE name = 'bmi'", prefix="")
def phenotype_by_name(s: SparkSession, d: str) -> DataFrame:
    return catalogue.named(table(s, d, "pheno"), "bmi").select("iid", "value")


@query("SELECT name, count(*) AS n, name IN (SELECT name FROM grsinput WHERE loaded_at < TIMESTAMP '2022-07-01') AS refused FROM grsinput WHERE loaded_at >= TIMESTAMP '2022-07-01' GROUP BY name", prefix="")
def store_new_names(s: SparkSession, d: str) -> DataFrame:
    """Weights that arrive later are stored only under names that are not there yet."""
    rows = table(s, d, "grsinput")
    limit = F.to_timestamp_ntz(F.lit("2022-07-01 00:00:00"))
    fresh, refused = catalogue.new_names(rows.where(F.col("loaded_at") < limit), rows.where(F.col("loaded_at") >= limit))
    return fresh.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True))).groupBy("name", "refused").agg(F.count("*").alias("n"))


# --- risk scores ----------------------------------------------------------------------------------------------------------

_GRS = _ARGMAX + ", lst AS (SELECT DISTINCT rsid, ref, alt FROM ok), sc AS (SELECT w.*, ea, wgt, CASE w.gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END AS dose FROM win w JOIN weights USING (rsid) WHERE ea IN (ref, alt)) "


@query(_GRS + "SELECT sample_id, count_if(gt <> './.')::BIGINT AS snp_count, round(sum(CASE WHEN gt <> './.' THEN dose * wgt * CASE WHEN ea = ref THEN -1 ELSE 1 END ELSE 0 END), 6) AS score_sign, round(sum(CASE WHEN gt <> './.' THEN CASE WHEN ea = alt THEN dose ELSE 2 - dose END * wgt ELSE 0 END), 6) AS score_flip FROM sc GROUP BY sample_id")
def grs_scores(s: SparkSession, d: str) -> DataFrame:
    return grs.scores(combined(s, d), weights(s, d)).select("sample_id", "snp_count", r("score_sign").alias("score_sign"), r("score_flip").alias("score_flip"))


_LOCAL = _METRICS + ", loc AS (SELECT rsid, ref, alt, CASE WHEN homref < homalt THEN ref ELSE alt END AS minor, maf FROM m WHERE assaytype = 'illumina')"
_DECIDE = _LOCAL + """, wd AS (SELECT w.*, l.ref, l.alt, CASE WHEN l.minor = l.ref THEN 1 - l.maf ELSE l.maf END AS rf, translate(l.alt, 'ACGT', 'TGCA') AS ca, translate(l.ref, 'ACGT', 'TGCA') AS cr0, translate(w.ea, 'ACGT', 'TGCA') AS ce FROM weights w LEFT JOIN loc l USING (rsid)),
dec AS (SELECT rsid, ea, eaf, wgt, ref, alt, CASE WHEN ref IS NULL THEN 'NOTFOUND' WHEN NOT (ea IN (ref, alt) OR ce IN (ref, alt)) THEN 'REJECT' WHEN ea = alt THEN 'KEEP' WHEN ea = ca AND ref <> ca THEN 'KEEP' WHEN ea = ca AND ((eaf < 0.5 AND rf < 0.5) OR (eaf > 0.5 AND rf > 0.5)) THEN 'KEEP' ELSE 'FLIP' END AS decision FROM wd)
"""


@query(_DECIDE + "SELECT rsid, ea, round(eaf, 6) AS eaf, ref, alt, decision, round(CASE WHEN decision = 'FLIP' THEN -wgt ELSE wgt END, 6) AS signed_wgt FROM dec")
def grs_strand_decisions(s: SparkSession, d: str) -> DataFrame:
    out = _decisions(s, d)
    return out.select("rsid", "ea", r("eaf").alias("eaf"), "ref", "alt", "decision", r("signed_wgt").alias("signed_wgt"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    m = metrics.record_metrics(metrics.call_counts(called(s, d).where("assaytype = 'illumina'"), "rsid", "ref", "alt"))
    return grs.strand_decisions(weights(s, d), m.withColumn("minor", metrics.minor_allele(F.col("ref"), F.col("alt"))))


_SS = _DECIDE + _ACCEPTED.replace("\n, fst", ", fst", 1) + ", win AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY rsid, sample_id ORDER BY hi DESC, assay_no) = 1) "


@query(_SS + "SELECT sample_id, count(*) AS snp_count, round(sum(CASE w.gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END * CASE WHEN decision = 'FLIP' THEN -wgt ELSE wgt END), 6) AS score, CASE WHEN count(*) >= (SELECT count(*) FROM dec WHERE decision <> 'REJECT') // 2 THEN 'OUTPUT' ELSE 'LOWCOUNT' END AS status FROM win w JOIN dec ON w.rsid = dec.rsid WHERE decision <> 'REJECT' AND w.gt <> './.' GROUP BY sample_id")
def grs_completeness(s: SparkSession, d: str) -> DataFrame:
    return grs.strand_scores(combined(s, d), _decisions(s, d)).select("sample_id", "snp_count", r("score").alias("score"), "status")


# --- association ----------------------------------------------------------------------------------------------------------

_AS = _ARGMAX + ", aj AS (SELECT rsid, CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 ELSE 2 END::DOUBLE AS x, continuous::DOUBLE AS y, \"binary\" AS b FROM win JOIN phenotypes ON iid = sample_id WHERE gt <> './.') "


@query(_AS + "SELECT rsid, count(*) AS n, round(regr_slope(y, x), 4) AS beta, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM aj GROUP BY rsid")
def assoc_linear(s: SparkSession, d: str) -> DataFrame:
    out = assoc.associate(combined(s, d), phenotypes(s, d), "continuous", "Continuous")
    return out.select("rsid", "n", r("beta", 4).alias("beta"), r("intercept", 4).alias("intercept"), r("r2").alias("r2"))


@query(
    _AS + ", t AS (SELECT rsid, sum(CASE WHEN b = 1 THEN x ELSE 0 END) AS a, sum(CASE WHEN b = 1 THEN 2 - x ELSE 0 END) AS b2, sum(CASE WHEN b = 0 THEN x ELSE 0 END) AS c, sum(CASE WHEN b = 0 THEN 2 - x ELSE 0 END) AS d FROM aj GROUP BY rsid) SELECT rsid, a::BIGINT AS case_alt, b2::BIGINT AS case_ref, c::BIGINT AS control_alt, d::BIGINT AS control_ref, "
    "round(a * d / nullif(b2 * c, 0), 6) AS odds_ratio, round((a + b2 + c + d) * (a * d - b2 * c) ** 2 / nullif((a + b2) * (c + d) * (a + c) * (b2 + d), 0), 6) AS chi_square FROM t"
)
def assoc_allelic(s: SparkSession, d: str) -> DataFrame:
    out = assoc.associate(combined(s, d), phenotypes(s, d), "binary", "Binary")
    return out.select("rsid", "case_alt", "case_ref", "control_alt", "control_ref", r("odds_ratio").alias("odds_ratio"), r("chi_square").alias("chi_square"))


@query()
def assoc_p_values(s: SparkSession, d: str) -> DataFrame:
    """Both tests with their p values, which SQL cannot compute."""
    cells = combined(s, d)
    a = assoc.associate(cells, phenotypes(s, d), "continuous", "Continuous").select("rsid", F.col("p_value").alias("p_linear"))
    b = assoc.associate(cells, phenotypes(s, d), "binary", "Binary").select("rsid", F.col("p_value").alias("p_allelic"))
    return a.join(b, "rsid")


# --- annotation and conversion ----------------------------------------------------------------------------------------------


@query("SELECT assaytype, chromosome, position, coalesce(k.rsid, '.') AS rsid FROM (SELECT DISTINCT assaytype, chromosome, position FROM g) LEFT JOIN (SELECT chromosome, position, min(rsid) AS rsid FROM g WHERE assaytype = 'metabo' GROUP BY ALL) k USING (chromosome, position)")
def annotate_rsid(s: SparkSession, d: str) -> DataFrame:
    c = derived_catalogue(s, d)
    return annotate.annotate_ids(c.select("assaytype", "chromosome", "position").withColumn("rsid", F.lit(".")), c.where("assaytype = 'metabo'"))


@query("SELECT rsid, assaytype, ref, substr('ACGT', ((position - 1) % 4 + chromosome::INT) % 4 + 1, 1) AS base FROM (SELECT DISTINCT rsid, assaytype, chromosome, position, ref FROM g) WHERE substr('ACGT', ((position - 1) % 4 + chromosome::INT) % 4 + 1, 1) <> ref")
def ref_allele_check(s: SparkSession, d: str) -> DataFrame:
    c = derived_catalogue(s, d)
    start = (F.floor((F.col("position") - 1) / annotate.CHUNK) * annotate.CHUNK + 1).cast("int")
    turn = F.col("chromosome").cast("int") % 4
    bases = F.concat(F.substring(F.lit("ACGT"), turn + 1, F.lit(4)), F.substring(F.lit("ACGT"), F.lit(1), turn))
    genome = c.select("chromosome", start.alias("start_posn")).distinct().withColumn("genome_string", F.repeat(bases, annotate.CHUNK // 4))
    return annotate.reference_mismatches(c, genome).select("rsid", "assaytype", "ref", "base")


@query("SELECT sample_id, CASE WHEN sample_id::INT % 2 = 0 THEN 'E' || sample_id WHEN sample_id::INT % 3 = 0 THEN 'T' || sample_id ELSE sample_id END AS mapped FROM (SELECT DISTINCT sample_id FROM g)")
def id_map_fallback(s: SparkSession, d: str) -> DataFrame:
    ids = genotypes(s, d).select("sample_id").distinct()
    n = F.col("sample_id").cast("int")
    make = lambda keep, p: ids.where(keep).select(F.col("sample_id").alias("old"), F.concat(F.lit(p), "sample_id").alias("new"))
    return annotate.mapped_with_fallback(ids, "sample_id", make(n % 2 == 0, "E"), make(n % 3 == 0, "T"))


@query("SELECT a.rsid, a.sample_id, a.gt AS gt_a, b.gt AS gt_b FROM g a JOIN g b USING (rsid, sample_id) WHERE a.assaytype = 'affy' AND b.assaytype = 'broad' AND a.gt <> b.gt")
def csv_compare(s: SparkSession, d: str) -> DataFrame:
    c = called(s, d)
    return annotate.compare_calls(c.where("assaytype = 'affy'"), c.where("assaytype = 'broad'"))


@query(_ACCEPTED + "SELECT g.rsid, g.sample_id, g.assaytype, CASE g.gt WHEN './.' THEN -9 WHEN '0/1' THEN 1 ELSE CASE WHEN (g.gt = '0/0') <> (ref <> ref1) THEN 0 ELSE 2 END END AS number FROM g JOIN fst USING (rsid)")
def flip_genotypes(s: SparkSession, d: str) -> DataFrame:
    swapped = combine.rejected_records(long(s, d))
    return annotate.flipped_calls(called(s, d), swapped).select("rsid", "sample_id", "assaytype", "number")


@query(_ACCEPTED + "SELECT g.rsid, g.sample_id, g.assaytype, round(CASE WHEN ref <> ref1 THEN p2 ELSE p0 END, 6) AS p0, round(p1, 6) AS p1, round(CASE WHEN ref <> ref1 THEN p0 ELSE p2 END, 6) AS p2 FROM g JOIN fst USING (rsid)")
def flip_probabilities(s: SparkSession, d: str) -> DataFrame:
    out = annotate.flipped_records(called(s, d), combine.rejected_records(long(s, d)))
    return out.select("rsid", "sample_id", "assaytype", *[r(F.col("probs")[i]).alias(f"p{i}") for i in range(3)])


@query("SELECT assaytype, sample_id, CASE WHEN (list_posn + 1) % 10 = 0 THEN sample_id ELSE '2' || substr(sample_id, 2) END AS new_id FROM samples")
def nth_row_remap(s: SparkSession, d: str) -> DataFrame:
    return annotate.every_nth_kept(sample_registry(s, d), 10).select("assaytype", "sample_id", "new_id")


@query("SELECT chromosome, position, CASE WHEN b.ref IS NULL THEN 'a' WHEN a.ref IS NULL THEN 'b' ELSE 'both' END AS side, CASE WHEN a.ref IS NOT NULL AND b.ref IS NOT NULL THEN a.ref = b.ref AND a.alt = b.alt END AS concordant FROM (SELECT DISTINCT chromosome, position, ref, alt FROM g WHERE assaytype = 'affy') a FULL JOIN (SELECT DISTINCT chromosome, position, ref, alt FROM g WHERE assaytype = 'illumina') b USING (chromosome, position)")
def two_way_merge(s: SparkSession, d: str) -> DataFrame:
    c = derived_catalogue(s, d)
    return annotate.two_way_merge(c.where("assaytype = 'affy'"), c.where("assaytype = 'illumina'")).select("chromosome", "position", "side", "concordant")


@query("SELECT chromosome, 'chr' || chromosome::INT AS renamed, count(*) AS n FROM (SELECT DISTINCT chromosome, rsid FROM g) GROUP BY ALL")
def chromosome_rename(s: SparkSession, d: str) -> DataFrame:
    c = derived_catalogue(s, d).select("chromosome", "rsid").distinct().withColumn("renamed", F.col("chromosome"))
    names = c.select(F.col("chromosome").alias("old"), F.concat(F.lit("chr"), F.col("chromosome").cast("int").cast("string")).alias("new")).distinct()
    return annotate.mapped(c, "renamed", names).groupBy("chromosome", "renamed").agg(F.count("*").alias("n"))


@query(
    ", h AS (SELECT DISTINCT rsid, chromosome, position, variant_no, CASE WHEN variant_no % 3 = 0 THEN ['A', 'C', 'A', 'C'][variant_no % 4 + 1] ELSE ['G', 'T', 'T', 'G'][variant_no % 4 + 1] END AS allele FROM g), "
    "k AS (SELECT rsid, min(ref) AS ref FROM g GROUP BY rsid) SELECT CASE variant_no % 4 WHEN 0 THEN h.rsid || '_' || allele WHEN 1 THEN chromosome::INT || ':' || position || '_' || allele WHEN 2 THEN chromosome || ':' || position || ':' || allele ELSE 'rs0' || variant_no || '_' || allele END AS name, "
    "CASE WHEN variant_no % 4 < 3 THEN h.rsid END AS rsid, variant_no % 4 < 3 AND allele = ref AS flip FROM h JOIN k USING (rsid)"
)
def header_correction(s: SparkSession, d: str) -> DataFrame:
    c = derived_catalogue(s, d)
    v = F.col("variant_no")
    allele = F.when(v % 3 == 0, F.get(F.array(*map(F.lit, "ACAC")), v % 4)).otherwise(F.get(F.array(*map(F.lit, "GTTG")), v % 4))
    place = lambda chrom, sep: F.concat(chrom, F.lit(":"), F.col("position").cast("string"), F.lit(sep), allele)
    name = F.when(v % 4 == 0, F.concat("rsid", F.lit("_"), allele)).when(v % 4 == 1, place(F.col("chromosome").cast("int").cast("string"), "_")).when(v % 4 == 2, place(F.col("chromosome"), ":")).otherwise(F.concat(F.lit("rs0"), v.cast("string"), F.lit("_"), allele))
    return annotate.corrected_headers(c.select(name.alias("name")).distinct(), c)


@query(_METRICS + "SELECT assaytype, g.rsid, g.sample_id, raf < aaf AS normalised, CASE g.gt WHEN './.' THEN -9 WHEN '0/1' THEN 1 ELSE CASE WHEN (g.gt = '0/0') <> (raf < aaf) THEN 0 ELSE 2 END END AS number FROM g JOIN m USING (assaytype, rsid)")
def normalised_calls(s: SparkSession, d: str) -> DataFrame:
    c = called(s, d)
    m = metrics.record_metrics(metrics.call_counts(c, "assaytype", "rsid")).select("assaytype", "rsid", "raf", "aaf")
    return annotate.normalised_calls(c, m).select("assaytype", "rsid", "sample_id", "normalised", "number")


@query(_GRS + ", l AS (SELECT sample_id, count_if(gt <> './.') AS n, round(sum(CASE WHEN gt <> './.' THEN dose * wgt * CASE WHEN ea = ref THEN -1 ELSE 1 END ELSE 0 END), 6) + 0.0 AS a, round(sum(CASE WHEN gt <> './.' THEN CASE WHEN ea = alt THEN dose ELSE 2 - dose END * wgt ELSE 0 END), 6) + 0.0 AS b FROM sc GROUP BY sample_id) SELECT format('001:{},{},{:.6f}', sample_id, n, a::DOUBLE) AS line FROM l UNION ALL SELECT format('002:{},{},{:.6f}', sample_id, n, b::DOUBLE) FROM l")
def grs_lines(s: SparkSession, d: str) -> DataFrame:
    """Both scores as labelled text lines."""
    sc = grs.scores(combined(s, d), weights(s, d))
    line = lambda tag, c: sc.select(F.concat(F.lit(tag), F.format_string("%s,%d,%.6f", "sample_id", "snp_count", r(c) + F.lit(0.0))).alias("line"))
    return line("001:", "score_sign").unionByName(line("002:", "score_flip"))


@query()
def stats_lines(s: SparkSession, d: str) -> DataFrame:
    """chr,posn,varid,CR,MAF,HWEP,INFO,N,MISS as text lines (engines round ties of two digits differently)."""
    m = metrics.record_metrics(metrics.call_counts(called(s, d), "assaytype", "chromosome", "position", "rsid", "info"))
    return m.select("assaytype", F.format_string("%s,%d,%s,%.2f,%.6f,%.8f,%.6f,%d,%d", G.bare_chromosome(F.col("chromosome")), "position", "rsid", "cr", "maf", "hwep", "info", "n", "miss").alias("line"))


@query(_ARGMAX + ", w AS (SELECT sample_id, " + ", ".join(f"coalesce(max(CASE WHEN rsid = '{i}' THEN CASE gt WHEN '0/0' THEN '0' WHEN '0/1' THEN '1' WHEN '1/1' THEN '2' ELSE '-9' END END), '.') AS {i}" for i in REQUEST) + " FROM (SELECT DISTINCT sample_id FROM g) LEFT JOIN win USING (sample_id) GROUP BY sample_id) SELECT sample_id AS \"FID\", sample_id AS \"IID\", rs1005, rs1049 FROM w")
def csv_cut_columns(s: SparkSession, d: str) -> DataFrame:
    """Named columns of a wide table in name order; unknown names are ignored."""
    wide = reshape.transposed(combined(s, d), sample_registry(s, d), list(REQUEST)).drop("FID")
    return reshape.cut_columns(wide, ["rs1049", "rs1005", "rs999999999"])


@query()
def snp_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the stored catalogue's places per chromosome, of five megabases and two hundred variants at least, none
    across a centromere."""
    return chunks.chunk_places(catalogue.tidy(table(s, d, "variants")).where("position > 0"), 5_000_000, 200, {f"{c:02d}": m * 1_000_000 for c, m in CENTROMERES.items()})




# --- what the derived genotypes do not have by themselves ----------------------------------------------------------------------

#: Two variants at each place: a panel has two records there.
_PAIRED = SQL.replace("g AS (SELECT assay_no,", "g0 AS (SELECT assay_no,").replace(
    "samples AS (SELECT assaytype,",
    "moved AS (SELECT * REPLACE (lpad((1 + variant_no // 2 % 22)::VARCHAR, 2, '0') AS chromosome, (1000000 + 1000 * (variant_no // 2))::INT AS position) FROM g0),\n"
    "numbered AS (SELECT assaytype, chromosome, position, ref, alt, rsid, row_number() OVER (PARTITION BY assaytype, chromosome, position ORDER BY ref, alt, rsid) AS occurrence FROM (SELECT DISTINCT assaytype, chromosome, position, ref, alt, rsid FROM moved)),\n"
    "g AS (SELECT m.* REPLACE (m.chromosome || ':' || m.position || '#' || n.occurrence AS rsid) FROM moved m JOIN numbered n USING (assaytype, chromosome, position, ref, alt, rsid)),\nsamples AS (SELECT assaytype,",
)


@query(
    _PAIRED + _descending(_FOLD) + " SELECT split_part(rsid, '#', 1) AS place, split_part(rsid, '#', 2)::INT AS occurrence, sample_id, gt, round(p, 6) AS p, assaytype FROM folded WHERE rsid IN (SELECT rsid FROM folded GROUP BY rsid HAVING coalesce(100.0::DOUBLE * sum(CASE WHEN n_panels > 1 THEN n_calls - 1 ELSE 0 END) / nullif(count_if(n_panels > 1), 0), 0) < 1000.0)"
)
def chromosome_merge_paired(s: SparkSession, d: str) -> DataFrame:
    """The whole-file merge where every panel has two records at a place: the i-th go with the i-th."""
    pair = F.floor(F.col("variant_no") / 2).cast("int")
    rows = genotypes(s, d).withColumn("chromosome", F.lpad((1 + pair % 22).cast("string"), 2, "0")).withColumn("position", (1_000_000 + 1_000 * pair).cast("int"))
    out = combine.chromosome_merge(cut(rows.withColumn("assay_ord", F.col("assay_no"))), err_pct=1000.0)
    return out.select("place", F.col("occurrence").cast("int").alias("occurrence"), "sample_id", "gt", r("p").alias("p"), "assaytype")


_ODD = _DECIDE.replace("FROM weights w", "FROM (SELECT CASE WHEN (substr(rsid, 3)::INT - 1000) % 7 = 0 THEN 'rs9' || substr(rsid, 3) ELSE rsid END AS rsid, CASE WHEN (substr(rsid, 3)::INT - 1000) % 5 = 0 THEN 'I' ELSE ea END AS ea, eaf, wgt FROM weights) w")


@query(_ODD + "SELECT rsid, ea, ref, alt, decision, round(CASE WHEN decision = 'FLIP' THEN -wgt ELSE wgt END, 6) AS signed_wgt FROM dec")
def grs_odd_weights(s: SparkSession, d: str) -> DataFrame:
    """Strand decisions on weights among which some variants are unknown and some effect alleles impossible."""
    odd = _odd(s, d)
    m = metrics.record_metrics(metrics.call_counts(called(s, d).where("assaytype = 'illumina'"), "rsid", "ref", "alt"))
    out = grs.strand_decisions(odd, m.withColumn("minor", metrics.minor_allele(F.col("ref"), F.col("alt"))))
    return out.select("rsid", "ea", "ref", "alt", "decision", r("signed_wgt").alias("signed_wgt"))


def _odd(s: SparkSession, d: str) -> DataFrame:
    n = F.substring("rsid", 3, 20).cast("int") - 1000
    return weights(s, d).select(F.when(n % 7 == 0, F.concat(F.lit("rs9"), F.substring("rsid", 3, 20))).otherwise(F.col("rsid")).alias("rsid"), F.when(n % 5 == 0, "I").otherwise(F.col("ea")).alias("ea"), "eaf", "wgt")


@query("SELECT DISTINCT g.rsid, g.ref, g.alt, 'I' AS ea FROM g JOIN weights USING (rsid) WHERE (substr(rsid, 3)::INT - 1000) % 7 > 0 AND (substr(rsid, 3)::INT - 1000) % 5 = 0")
def grs_rejected_weights(s: SparkSession, d: str) -> DataFrame:
    """Of the same weights those whose effect allele is neither allele of the variant."""
    return grs.rejected_weights(called(s, d), _odd(s, d))


@query("SELECT assaytype, sample_id, " + ", ".join(f"max(CASE WHEN rsid = '{i}' THEN CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE -9 END END) AS {i}" for i in REQUEST) + f" FROM g WHERE rsid IN {REQUEST} GROUP BY assaytype, sample_id")
def csv_plain_listed(s: SparkSession, d: str) -> DataFrame:
    """The same table from records whose id is a list."""
    rows = called(s, d).withColumn("rsid", F.concat_ws(",", "rsid", F.concat_ws(":", "chromosome", "position")))
    return reshape.plain_calls(rows, list(REQUEST))


# --- further views of the store -----------------------------------------------------------------------------------------------


@query(_METRICS + "SELECT rsid, assaytype, chromosome, position, ref, round(raf, 6) AS ref_fr, alt, round(aaf, 6) AS alt_fr, round(maf, 6) AS maf, CASE WHEN info <> 1.0 THEN 1 ELSE 0 END AS imputed, round((homref + het + homalt) / alln::DOUBLE, 5) AS call_rate, round(hwep, 8) AS hwe_pval, round(info, 5) AS info, homref, het, homalt, miss AS missing, alln AS sample_count, homref + het + homalt AS geno_count FROM m")
def download_summary(s: SparkSession, d: str) -> DataFrame:
    """The summary of a download with the counts by call."""
    m = metrics.record_metrics(metrics.call_counts(called(s, d), "rsid", "assaytype", "chromosome", "position", "ref", "alt", "info"))
    return m.select(
        "rsid", "assaytype", "chromosome", "position", "ref", r("raf").alias("ref_fr"), "alt", r("aaf").alias("alt_fr"), r("maf").alias("maf"), F.when(F.col("info") != 1.0, 1).otherwise(0).alias("imputed"), r("cr", 5).alias("call_rate"), r("hwep", 8).alias("hwe_pval"), r("info", 5).alias("info"),
        "homref", "het", "homalt", F.col("miss").alias("missing"), F.col("alln").alias("sample_count"), (F.col("homref") + F.col("het") + F.col("homalt")).alias("geno_count"),
    )


ORACLES["combo_stats"] = f"SELECT q.rsid, 'combo' AS assaytype, q.chromosome, q.position, q.ref, q.alt, k.minor, q.maf, q.cr AS call_rate, q.hwep AS hwe_pval FROM ({ORACLES['combined_variant_metrics']}) q JOIN ({SQL + _ARGMAX}, lst AS (SELECT DISTINCT rsid, ref, alt FROM ok) SELECT rsid, CASE WHEN count_if(gt = '0/0') < count_if(gt = '1/1') THEN any_value(lst.ref) ELSE any_value(lst.alt) END AS minor FROM win JOIN lst USING (rsid) GROUP BY rsid) k USING (rsid) WHERE q.assaytype = 'combined'"


@query()
def combo_stats(s: SparkSession, d: str) -> DataFrame:
    """Statistics of the combined records."""
    rows = merge.results(merged(s, d)).where("assaytype = 'combined'")
    return rows.select("rsid", F.lit("combo").alias("assaytype"), "chromosome", "position", "ref", "alt", "minor", r("maf").alias("maf"), r("cr").alias("call_rate"), r("hwep", 8).alias("hwe_pval"))


@query(_COUNTS + ", sl AS (SELECT assaytype, count(*) AS n_slots FROM samples GROUP BY assaytype) SELECT assaytype, rsid, n_slots AS raw_n, homref AS raw_homref, het AS raw_het, homalt AS raw_homalt, miss AS raw_miss, n_slots - alln AS raw_dot, round((n_slots - miss) / n_slots::DOUBLE, 6) AS raw_cr FROM counts JOIN sl USING (assaytype)")
def raw_gt_counts(s: SparkSession, d: str) -> DataFrame:
    """The file's own calls of every record line, counted without a threshold."""
    lines = vcf_render(s, d).select("assaytype", F.col("line").alias("value"), F.lit(0).cast("long").alias("line_ord"))
    out = vcf.raw_counts(vcf.records_of(lines, F.col("assaytype")))
    return out.select("assaytype", "rsid", "raw_n", "raw_homref", "raw_het", "raw_homalt", "raw_miss", "raw_dot", r("raw_cr").alias("raw_cr"))


@query("SELECT sample_id, row_number() OVER (ORDER BY p, l) - 1 AS \"column\" FROM (SELECT sample_id, min(k) AS p, arg_min(list_posn, k) AS l FROM (SELECT sample_id, list_posn, list_position(['metabo', 'exome', 'illumina', 'broad', 'affy'], assaytype) AS k FROM samples) GROUP BY sample_id)")
def combined_columns(s: SparkSession, d: str) -> DataFrame:
    return catalogue.combined_columns(sample_registry(s, d), ["metabo", "exome", "illumina", "broad", "affy"])


@query(_CAT + ", req AS (SELECT DISTINCT lower(" + _T.format("varid") + ") AS rsid FROM grsinput) SELECT vid, assaytype, rsid FROM cat WHERE assaytype IN ('affy', 'exome') AND rsid IN (SELECT rsid FROM req WHERE rsid IS NOT NULL)")
def variants_on_panels(s: SparkSession, d: str) -> DataFrame:
    asked = grs.weight_rows(table(s, d, "grsinput")).select(F.col("varid").alias("rsid"))
    return catalogue.by_ids(catalogue.tidy(table(s, d, "variants")), asked, ["affy", "exome"]).select("vid", "assaytype", "rsid")


@query(_CAT + f"SELECT vid, assaytype, rsid FROM cat WHERE (chromosome, position, allelea, alleleb) IN (SELECT ({_CHROM.format('chromosome')}, startposition, allelea, alleleb) FROM variants_mirror WHERE {_CHROM.format('chromosome')} IS NOT NULL AND startposition IS NOT NULL AND allelea IS NOT NULL AND alleleb IS NOT NULL)")
def variants_at_places(s: SparkSession, d: str) -> DataFrame:
    """Stored variants by place and alleles, as the mirror writes them."""
    mirror = table(s, d, "variants_mirror")
    wanted = mirror.select(catalogue.tidy_chromosome(F.col("chromosome")).alias("chromosome"), F.col("startposition").alias("position"), "allelea", "alleleb")
    return catalogue.at_places(catalogue.tidy(table(s, d, "variants")), wanted).select("vid", "assaytype", "rsid")


@query("SELECT DISTINCT assaytype, rsid, chromosome, position, rsid AS record_rsid FROM g")
def catalogue_records(s: SparkSession, d: str) -> DataFrame:
    """Catalogue rows beside the records that call-file lines hold of them."""
    lines = vcf_render(s, d).select("assaytype", F.col("line").alias("value"), F.lit(0).cast("long").alias("line_ord"))
    stored = derived_catalogue(s, d).select("assaytype", "rsid", "chromosome", "position", F.col("ref").alias("allelea"), F.col("alt").alias("alleleb"))
    return catalogue.with_records(stored, vcf.records_of(lines, F.col("assaytype"))).select("assaytype", "rsid", "chromosome", "position", "record_rsid")


@query("SELECT c.assaytype, rsid, n_samples FROM (SELECT DISTINCT assaytype, rsid FROM g) c JOIN (SELECT assaytype, count(*) AS n_samples FROM samples GROUP BY assaytype) USING (assaytype)")
def variants_with_sample_counts(s: SparkSession, d: str) -> DataFrame:
    return catalogue.with_sample_counts(derived_catalogue(s, d).select("assaytype", "rsid"), sample_registry(s, d))


@query(_CAT + f", fp AS ({ORACLES['file_paths'].replace('WITH f AS', 'WITH f AS')}), lf AS (SELECT assaytype, chrom, arg_max(path, path_id) AS path FROM fp GROUP BY ALL) SELECT vid, cat.rsid, path FROM cat LEFT JOIN lf ON cat.assaytype = lf.assaytype AND cat.chromosome = lf.chrom")
def variants_with_files(s: SparkSession, d: str) -> DataFrame:
    return catalogue.with_file(catalogue.tidy(table(s, d, "variants")), catalogue.file_paths(table(s, d, "filepaths")).distinct()).select("vid", "rsid", "path")


@query(_CAT + "SELECT rsid, vid, assaytype FROM (SELECT *, row_number() OVER (PARTITION BY rsid ORDER BY vid) AS k FROM cat WHERE rsid IS NOT NULL) WHERE k = 1")
def variant_by_id_first(s: SparkSession, d: str) -> DataFrame:
    rows = catalogue.tidy(table(s, d, "variants")).where("rsid is not null").select("rsid", "vid", "assaytype")
    return catalogue.first_found(rows, ["rsid"], ["vid"])


@query(_CAT + "SELECT DISTINCT rsid FROM cat WHERE chromosome = '04' AND position BETWEEN 145400000 AND 145600000 AND rsid IS NOT NULL")
def ids_in_range(s: SparkSession, d: str) -> DataFrame:
    return catalogue.ids_in_range(catalogue.tidy(table(s, d, "variants")), "04", 145_400_000, 145_600_000)


@query(f"WITH gm AS (SELECT upper({_T.format('genename')}) AS genename, name, {_CHROM.format('chrom')} AS chrom, txstart, txend FROM genemap) SELECT * FROM gm WHERE genename IN (SELECT genename FROM gm GROUP BY genename HAVING count(*) > 3)", prefix="")
def genes_by_name(s: SparkSession, d: str) -> DataFrame:
    """The transcripts of the genes that have more than three, by name."""
    genes = catalogue.genes(table(s, d, "genemap"))
    names = genes.groupBy("genename").agg(F.count("*").alias("n")).where("n > 3").select(F.lower("genename").alias("genename"))
    return catalogue.genes_by_name(genes, names).select("genename", "name", "chrom", "txstart", "txend")


_RAW = ", ".join(f"max(CASE WHEN rsid = '{i}' THEN CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE -9 END END) AS {i}, round(max(CASE WHEN rsid = '{i}' THEN hi END), 4) AS {i}_prob, max(CASE WHEN rsid = '{i}' THEN assaytype END) AS {i}_plat, max(CASE WHEN rsid = '{i}' THEN alt END) AS {i}_min" for i in REQUEST)


@query(f"SELECT assaytype, sample_id, {_RAW} FROM g WHERE rsid IN {REQUEST} GROUP BY assaytype, sample_id")
def csv_transpose_raw(s: SparkSession, d: str) -> DataFrame:
    """The calls of every panel's lines as they stand, with probability, panel and counted allele."""
    lines = vcf_render(s, d).select("assaytype", F.col("line").alias("value"), F.lit(0).cast("long").alias("line_ord"))
    out = reshape.transposed_raw(vcf.genotypes_of(vcf.records_of(lines, F.col("assaytype")), sample_registry(s, d)), list(REQUEST), by=("assaytype", "sample_id"))
    return out.select(*[r(c, 4).alias(c) if c.endswith("_prob") else F.col(c) for c in out.columns])


@query("SELECT a.rsid, a.sample_id, 'X' || a.sample_id AS other_id, a.gt AS gt_a, b.gt AS gt_b FROM g a JOIN g b USING (rsid, sample_id) WHERE a.assaytype = 'affy' AND b.assaytype = 'broad' AND a.gt <> b.gt AND a.sample_id IN (SELECT iid FROM phenotypes WHERE \"binary\" = 0)")
def csv_compare_mapped(s: SparkSession, d: str) -> DataFrame:
    """Two panels whose samples have different ids, compared through a map that has the controls only."""
    c = called(s, d)
    ids = phenotypes(s, d).where(F.col("binary") == 0).select(F.col("iid").alias("old"), F.concat(F.lit("X"), "iid").alias("new"))
    return annotate.compare_mapped(c.where("assaytype = 'affy'"), c.where("assaytype = 'broad'").withColumn("sample_id", F.concat(F.lit("X"), "sample_id")), ids)


@query(
    _COUNTS + ", f AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY rsid ORDER BY assaytype) = 1), o AS (SELECT c.rsid, c.ref <> f.ref OR c.alt <> f.alt AS d, c.assaytype > f.assaytype AS further, "
    "(f.homref - c.homref) ** 2 / (c.homref + 1)::DOUBLE + (f.het - c.het) ** 2 / (c.het + 1)::DOUBLE + (f.homalt - c.homalt) ** 2 / (c.homalt + 1)::DOUBLE AS x FROM counts c JOIN f USING (rsid)) "
    "SELECT count(DISTINCT rsid) AS n_variants, count(DISTINCT CASE WHEN further THEN rsid END) AS n_overlap, count_if(d)::BIGINT AS n_allele_discord, count_if(further AND exp(-x / 2) < 1e-8)::BIGINT AS n_chi_discord FROM o"
)
def merge_counters(s: SparkSession, d: str) -> DataFrame:
    return combine.merge_counters(metrics.call_counts(called(s, d), "rsid", "assaytype", "ref", "alt"))


@query(
    _ACCEPTED + ", sl AS (SELECT rsid, sample_id, count(*) AS slots FROM (SELECT DISTINCT rsid, assaytype FROM ok) JOIN samples USING (assaytype) GROUP BY ALL HAVING count(*) > 1), hd AS (SELECT rsid, sample_id, count(*) AS held FROM ok GROUP BY ALL), na AS (SELECT rsid, sum(slots - coalesce(held, 0)) AS n FROM sl LEFT JOIN hd USING (rsid, sample_id) GROUP BY rsid) "
    "SELECT rsid, coalesce(n, 0)::BIGINT AS no_assay FROM (SELECT DISTINCT rsid FROM ok) LEFT JOIN na USING (rsid)"
)
def no_assay_counts(s: SparkSession, d: str) -> DataFrame:
    return combine.no_assay_counts(long(s, d), sample_registry(s, d))


@query("SELECT assaytype, string_agg(sample_id, ',' ORDER BY list_posn) AS line FROM samples GROUP BY assaytype")
def sample_list_line(s: SparkSession, d: str) -> DataFrame:
    return reshape.list_line(sample_registry(s, d), "sample_id", "list_posn", by=("assaytype",))


@query("SELECT assaytype, list_posn::INT AS place, sample_id AS name FROM samples")
def sample_header_names(s: SparkSession, d: str) -> DataFrame:
    return reshape.header_names(sample_list_line(s, d).withColumnRenamed("line", "value"))
