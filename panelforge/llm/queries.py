"""Queries of the problems on text and learned matching, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import abuse, bpe, entity_match, mix, survivor
from panelforge.session import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def p1_matches(s: SparkSession, d: str) -> DataFrame:
    """Matching rows with the confidence of the match."""
    return entity_match.match(table(s, d, "variants"), table(s, d, "probes"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return p1_matches(s, d).select("vid", "probe_id")


def p1_reliability(s: SparkSession, d: str) -> DataFrame:
    """How far the confidence of held-out candidates can be relied on."""
    return entity_match.reliability(table(s, d, "variants"), table(s, d, "probes"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return survivor.duplicate_pairs(survivor.group_entries(table(s, d, "variants")))


def p2_survivors(s: SparkSession, d: str) -> DataFrame:
    """One surviving entry per variant and panel."""
    variants = table(s, d, "variants")
    return survivor.survivors(variants, survivor.group_entries(variants))


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(s, d, "documents"), vocabulary_path())


def p8_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Per source: documents that come back equal, different, not at all or twice when they are encoded and decoded."""
    return bpe.round_trip(table(s, d, "documents"), vocabulary_path())


def p8_sizes(s: SparkSession, d: str) -> DataFrame:
    """Documents and characters per source, counted beside the tokens."""
    return p8_counts(s, d).select("source", "n_docs", "n_chars")


def p8_counts(s: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and characters per source."""
    counted = bpe.count_tokens(table(s, d, "documents"), vocabulary_path(), keep=["source", "n_chars"])
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_chars").cast("long")).alias("n_chars"), F.max("n_tokens").alias("longest"))


def _mixed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, mixture, targets)."""
    targets = table(s, d, "mix_targets")
    sizes = mix.source_sizes(table(s, d, "documents"), vocabulary_path())
    return sizes, mix.mixture(sizes, targets), targets


def p9_mixture(s: SparkSession, d: str) -> DataFrame:
    return _mixed(s, d)[1]


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mix.shares(*_mixed(s, d))


def p9_checked(s: SparkSession, d: str) -> DataFrame:
    return mix.checked(*_mixed(s, d))


def p10_scores(s: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(s, d, "documents"), table(s, d, "abuse_labels"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return p10_scores(s, d).where("abusive").select("doc_id")


def p10_rates(s: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p10_scores(s, d))


def p10_coverage(s: SparkSession, d: str) -> DataFrame:
    """Documents per source that were scored, and those among them without any text, whose score is 0."""
    texts = table(s, d, "documents").select("doc_id", F.coalesce(F.trim("text"), F.lit("")).alias("_t"))
    scored = p10_scores(s, d).join(texts.select("doc_id", (F.col("_t") == "").alias("_empty")), "doc_id")
    return scored.groupBy("source").agg(F.count("score").alias("n_scored"), F.count_if(F.col("_empty") & (F.col("score") == 0.0)).alias("n_empty_at_0"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_matches, p1_reliability, p2_found, p2_survivors, p8_ids, p8_round_trip, p8_counts, p8_sizes, p9_mixture, p9_shares, p9_checked, p10_found, p10_scores, p10_rates, p10_coverage)}

ORACLES: dict[str, str] = {
    # exactness against another implementation and the round trip are tested in tests/llm; SQL knows no byte pairs
    "p8_round_trip": "SELECT source, count(*) AS n_docs, count(*) AS n_equal, 0::BIGINT AS n_other, 0::BIGINT AS n_lost, 0::BIGINT AS n_twice FROM documents GROUP BY source",
    "p10_coverage": "SELECT source, count(*) AS n_scored, count_if(trim(coalesce(text, '')) = '')::BIGINT AS n_empty_at_0 FROM documents GROUP BY source",
    "p9_checked": "SELECT d.source, count(*) AS n_docs, count(t.source) AS n_weighed, 0::BIGINT AS n_too_often, 0::BIGINT AS n_empty_used FROM documents d LEFT JOIN (SELECT DISTINCT source FROM mix_targets WHERE target_share > 0 AND max_repeats > 0) t ON d.source = t.source GROUP BY d.source",
    "p8_sizes": "SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source",
}
