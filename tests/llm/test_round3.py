"""Shared lines, divergence of sources and vector codes against plain versions, awkward rows included."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import awkward, brute
from volclock.llm import codes, divergence, lines

SHARED = "This very line stands in MANY of the documents, Ünïcode and all"


def _line_rows() -> list[tuple]:
    rng = random.Random(3)
    own = ["short", "", f"  {SHARED}\t", SHARED.lower().replace("ü", "Ü"), SHARED, "a" * 39, "b" * 40, "é" * 40, "  " + "b" * 40 + "\r", "x " * 30]
    rows = [(i, "\n".join(rng.choice(own) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [rows[3], rows[3], (3, SHARED), (None, SHARED + "\n" + SHARED), (None, "b" * 40), (100, None), (101, ""), (102, "\n"), (103, "\n".join([SHARED, *own] * 2000))]
    return rows


@pytest.mark.parametrize("least_docs", [1, 5, 39])
def test_common_lines(spark, least_docs):
    rows = _line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.without_common_lines(df, 40, least_docs).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute.common_lines(rows, 40, least_docs)


def test_common_lines_by_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(lines, "small", lambda df: df.hint("merge"))
    rows = _line_rows()
    got = lines.without_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute.common_lines(rows, 40, 5)


def test_common_lines_of_awkward_rows(spark):
    docs = awkward.documents(spark).selectExpr("*", "'mine' as n_lines", "'too' as line", "doc_id as doc", "map('a', doc_id) as pos", "1 as `gone`")
    got = lines.without_common_lines(docs, 3, 2)
    assert got.columns == [*docs.columns, "_n_lines", "n_dropped"]
    rows = [(r[0], r[1]) for r in awkward.rows()]
    assert Counter((r["doc_id"], r["_n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute.common_lines(rows, 3, 2)
    assert all(r["n_lines"] == "mine" and r["doc"] == r["doc_id"] for r in got.collect())
    assert lines.without_common_lines(awkward.empty(spark)).collect() == []


def _divergence(df, least_docs, top):
    return sorted(tuple(r) for r in divergence.divergence(df, least_docs, top).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least_docs", [1, 2, 10])
def test_divergence(spark, least_docs):
    rng = random.Random(least_docs)
    vocabulary = ["alpha", "Beta", "GAMMA", "d", "Éa", "eá", "x1y", "don't", "[k]", "名前", "ß"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "ü"]), " ".join(rng.choices(vocabulary, [9, 7, 5, 3, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 40)))) for _ in range(150)]
    rows += [("en", "none", None), ("en", "digits", "1 2 3"), ("xx", "p", "once"), ("xx", "q", ""), ("yy", "only", "word " * 30), *[("en", "a", "tie tie")] * 12]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'t' as term", "lang as part", "2 as p0")
    assert _divergence(df, least_docs, 3) == brute.divergence(rows, least_docs, 3)


def test_divergence_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2)
    rows = [(r[2], r[3], r[1]) for r in awkward.rows()]
    batches = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert _divergence(batches, 2, 10) == brute.divergence(rows, 2, 10)
    assert _divergence(awkward.empty(spark), 2, 10) == []


def _code_rows() -> list[tuple]:
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([1, 2, None])) for i in range(60, 0, -1)]
    rows += [(100 + i, [rng.randrange(-3, 4) / 4096 for _ in range(32)], 5) for i in range(30)]  # ties
    rows += [(200 + i, [0.5] * 8, 7) for i in range(5)] + [(300, [1.0, -1.0] * 4, 7), rows[0], rows[0], (1, [0.25] * 16, 3), (None, [0.125] * 16, None)]
    rows += [(400, None, 1), (401, [], 1), (402, [1.0] * 7, 1), (403, [math.nan] * 16, 1), (404, [math.inf] + [0.0] * 15, 1), (405, [None] + [0.0] * 15, 1), (406, [1e300] * 16, 1), (407, [4095.9] * 16, 9), (408, [-4096.0] * 16, 9)]
    return rows


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_vector_codes(spark, rounds):
    rows = _code_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as code", "'x' as ints", "2 as size", "3 as _label").repartition(4)
    got = codes.compressed(df, rounds=rounds)
    assert Counter(tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == brute.vector_codes(rows, 8, 16, rounds, 4096)


def test_vector_codes_of_nothing(spark):
    assert codes.compressed(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert codes.compressed(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 8, 12, 64])
@pytest.mark.parametrize("spread", [1, 50, 1 << 24])
def test_bounds_lose_no_nearest_entry(size, spread):
    rng = np.random.default_rng(size)
    x = rng.integers(-spread, spread + 1, (500, size)) + np.repeat(rng.integers(-spread, spread + 1, (500, 1)), size, axis=1) // 2
    book = np.concatenate([x[:12], x[:2], x[3:5]])
    best, distance, measured = codes.nearest(x, book)
    every = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert size == 1 or measured < every.size  # bounds spare distances
