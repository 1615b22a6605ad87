"""The registered queries of the subpackage on the smallest tables."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

from panelforge.llm import mix, queries  # noqa: E402


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs(spark, duck, data, name):
    rows = queries.QUERIES[name](spark, data).collect()
    if name in queries.ORACLES:
        assert sorted(map(tuple, rows), key=str) == sorted(duck.execute(queries.ORACLES[name]).fetchall(), key=str)
    elif name in ("p8_ids", "p10_scores"):
        assert len({r["doc_id"] for r in rows}) == len(rows) == duck.execute("select count(*) from documents").fetchall()[0][0]
    else:
        assert rows


def test_sizes_of_documents_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "hello world", 7, 0.5), (2, "a", None, 7, 0.5), (3, None, "x", 7, 0.5), (4, "b", "y", 7, 0.5)], "doc_id long, source string, text string, n_tokens long, rate double")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    sizes = mix.source_sizes(docs, queries.vocabulary_path())
    assert sorted(map(tuple, sizes.select("doc_id", "n_tokens").collect())) == [(1, 2), (2, 0), (3, 1), (4, 1)]
    assert {r["doc_id"]: r["copies"] for r in mix.mixture(sizes, targets).collect()} == {1: 1, 2: 0}
