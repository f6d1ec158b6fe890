from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, TINY
from tests.llm import awkward, brute
from volclock.llm import ngram_join, scratch, substring


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("ngram, numerator", [(3, 90), (5, 80)])
def test_near_groups(spark, ngram, numerator):
    for docs in (awkward.documents(spark), spark.read.parquet(f"{TINY}/documents.parquet")):
        expected = brute.near_groups(texts(docs), ngram, numerator, 100)
        found = ngram_join.similar_groups(docs, ngram, numerator, 100).select("doc_id", "n_shingles", "component_id")
        assert got(found) == expected


@pytest.mark.parametrize("few", [1, 1 << 40])
def test_near_groups_with_and_without_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    docs = awkward.documents(spark)
    expected = brute.near_groups(texts(docs), 5, 80, 100)
    assert got(ngram_join.similar_groups(docs).select("doc_id", "n_shingles", "component_id")) == expected


def test_near_groups_small(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = brute.near_groups(texts(docs), 3, 90, 100)
    assert got(ngram_join.similar_groups(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")) == expected


def test_one_of_each_group(spark):
    docs = awkward.documents(spark)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    by_id = Counter(r["doc_id"] for r in kept.collect())
    groups = brute.near_groups(texts(docs), 5, 80, 100)
    for d, n, c in groups:
        if d is not None:
            assert by_id[d] == (d == c or n == 0)
    assert ngram_join.one_of_each_group(awkward.empty(spark)).collect() == []


def test_one_of_each_group_by_text(spark):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcde")
    rows = [(1, a), (1, b), (2, a + " more"), (2, c), (None, a), (None, None), (5, ""), (5, ""), (6, d), (6, d), (None, e), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(tuple(r) for r in ngram_join.one_of_each_group(docs).collect())
    assert kept == Counter([(1, a), (1, b), (2, c), (None, None), (5, ""), (5, ""), (6, d), (None, e)])


def test_substring(spark):
    for docs, window in ((awkward.documents(spark), 35), (awkward.documents(spark), 10), (spark.read.parquet(f"{SMALL}/documents.parquet"), 35)):
        assert got(substring.removal_report(docs, window=window)) == brute.substring(texts(docs), window)


@pytest.mark.parametrize("crowded, window", [(0, 35), (1, 35), (2, 35), (3, 10)])
def test_substring_crowded_and_full_filter(spark, crowded, window):
    docs = awkward.documents(spark)
    assert got(substring.removal_report(docs, crowded=crowded, bits=1 << 16, window=window)) == brute.substring(texts(docs), window)


def test_without_repeats(spark):
    docs = awkward.documents(spark)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    expected = {(d, h) for d, _, _, h in brute.substring(texts(docs), 35)}
    import hashlib

    assert {(d, hashlib.sha256(" ".join(brute.words(t)).encode()).hexdigest()) for d, t in texts(out)} == expected
    assert substring.without_repeats(awkward.empty(spark)).collect() == []
    assert substring.removal_report(awkward.empty(spark)).collect() == []


def test_words_that_differ_in_a_pattern(spark):
    """A Thue-Morse word and its complement, which hash alike as polynomials modulo 2^64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper()), (4, "x" * 65), (5, "X" * 65), (6, "é" * 40), (7, "É" * 40)]
    found = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_equal_ranks_go_by_token(monkeypatch):
    """With one rank for all tokens, prefixes are the smallest tokens, in every set alike."""
    import numpy as np

    from volclock.llm.wordhash import WordHasher

    monkeypatch.setattr(ngram_join.Order, "ranks", staticmethod(lambda tokens, frequencies, order: np.zeros(len(tokens), np.uint64)))
    sets = ngram_join.Sets([" ".join(f"w{i}" for i in range(60)).encode()], WordHasher(), 1)
    (prefix,) = sets.prefixes(np.zeros(60, np.uint64), 0, 80, 100)
    assert prefix.tolist() == np.sort(sets.tokens)[: ngram_join.prefix_length(60, 80, 100)].tolist()


def test_one_of_each_group_with_maps(spark):
    docs = awkward.documents(spark)
    more = docs.selectExpr("*", "map('a', map(coalesce(doc_id, 0), text)) as m", "array(named_struct('x', map(1, doc_id))) as more")
    kept = ngram_join.one_of_each_group(more)
    assert kept.columns == more.columns
    assert Counter(tuple(r)[:10] for r in kept.collect()) == Counter(tuple(r) for r in ngram_join.one_of_each_group(docs).collect())


def test_shuffles_end_with_their_table(spark):
    """What was shuffled for a tidy table is gone soon after it is written; the session's setting stays."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before, setting = disk.getAllBlocks().size(), spark.conf.get(scratch.CLEANUP, None)
    with scratch.Temporary(spark, tidy=True) as temporary:
        df = spark.range(50_000).groupBy((F.col("id") % 40_000).alias("k")).agg(F.count("*").alias("n"))
        assert temporary.stored(df, "tidy").count() == 40_000
        end = time.time() + 20
        while (left := disk.getAllBlocks().size()) > before + 8 and time.time() < end:
            time.sleep(0.2)  # the count above shuffles a row of each of its few tasks
    assert left <= before + 8 and spark.conf.get(scratch.CLEANUP, None) == setting


def test_rounds_share_the_tokens(spark, monkeypatch):
    """Each pair is met in one round or in several; groups are the same whatever their number."""
    docs, found = awkward.documents(spark), []
    for n in (1, 5):
        monkeypatch.setattr(ngram_join, "ROUNDS", n)
        found.append(got(ngram_join.similar_groups(docs, 3, 90)))
    assert found[0] == found[1]
