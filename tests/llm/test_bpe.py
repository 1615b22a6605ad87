"""The encoder against another implementation and as an exact round trip."""

from __future__ import annotations

import random

import pytest

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from panelforge.llm import bpe  # noqa: E402

#: The split pattern as it is published with the vocabularies.
PUBLISHED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATHS = [tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


@pytest.fixture(scope="module", params=PATHS)
def pair(request):
    tokens = bpe.read_ranks(request.param)
    other = tiktoken.Encoding("other", pat_str=PUBLISHED, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return bpe.Encoder(bpe.load_vocabulary(request.param)), other


def same(pair, texts):
    ours, other = pair
    ids, n = ours.encode(texts)
    at = 0
    for t, k in zip(texts, n):
        assert ids[at : at + k].tolist() == other.encode_ordinary(t or ""), repr(t)[:80]
        at += k
    assert at == len(ids)


def test_random_alphabets(pair):
    rnd = random.Random(0)
    for alphabet in ("a", "ab", "aA bB\n", "0123456789", "=-_ \t", "é中а 👋🏽a", "hello world ", "\x00​﻿z", "'sS 'tT're", "a b\n\x1c\x1d\x1e\x1f", "é \n\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2028\u3000a", "\t\v\f\r\n a1."):
        same(pair, ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 7, 95, 96, 97, 400]))) for _ in range(60)])


def test_null_empty_special_and_long(pair):
    same(pair, [None, "", " ", "\n", "<|endoftext|>", "a" * 30_000, "ab " * 5_000, " " * 5_000 + "x", "x\r\n\r\n  y"])


def test_long_texts_are_cut_safely(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 7)
    same(pair, ["a\n\n\x1d b\x1c c \x1f" * 9, "é\x1d\x85 b\u2003\u3000 c" * 9])
    same(pair, ["one two  three\n\n four 'll 12345 \t x" * 20, "nowhitespaceatallinthislongtext" * 5, "a \n \n b"])


def test_separators_are_no_white_space(pair):
    same(pair, ["a\n\n\x1d b", "a\n\n\x1d b é", "\x1c \x1d\x1e  \x1f", "a \x1c"])
    assert pair[0].encode(["a\n\n\x1d b"])[0].tolist() == pair[1].encode_ordinary("a\n\n\x1d b")


def test_forgetting_changes_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    same(pair, ["the cat sat", "on the mat", "the cat sat"])
    same(pair, ["the dog sat"])


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "hello world", "x", 1), (2, None, "x", 2), (3, "", None, 3), (4, "naïve café 👋🏽\r\n" * 400, "y", 4), (5, "hello world", "y", 5)], "doc_id long, text string, source string, ids int")
    out = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs, PATHS[0]).collect()}
    assert set(out) == {1, 2, 3, 4, 5} and out[2] == [] and out[3] == [] and out[1] == out[5]
    back = {r["doc_id"]: r["text"] for r in bpe.decode_corpus(bpe.encode_corpus(docs, PATHS[0]), PATHS[0]).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(docs, PATHS[0], keep=["source"]).collect()}
    assert counts == {k: len(v) for k, v in out.items()}
    assert bpe.encode_corpus(docs.limit(0), PATHS[0]).count() == 0


def test_round_trip_counts(spark):
    docs = spark.createDataFrame([(1, "hello \x1d world", "x"), (2, None, "x"), (3, "", None), (4, "naïve\r\n" * 40, "y"), (4, "naïve", "y")], "doc_id long, text string, source string")
    got = {r["source"]: tuple(r)[1:] for r in bpe.round_trip(docs, PATHS[0]).collect()}
    assert got == {"x": (2, 2, 0, 0, 0), None: (1, 1, 0, 0, 0), "y": (2, 2, 0, 0, 0)}
    assert bpe.round_trip(docs.limit(0), PATHS[0]).count() == 0
