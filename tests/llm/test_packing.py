from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tests.llm import awkward
from volclock.llm import packing


def check(docs, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    expected = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[r["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        found[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == expected
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_awkward(spark):
    for capacity in (2048, 64):
        docs = awkward.documents(spark)
        check(docs, packing.pack_documents(docs, packing.public_vocabulary(), capacity).collect(), capacity)
    assert packing.pack_documents(awkward.empty(spark), packing.public_vocabulary()).collect() == []


def test_few_sequences(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    used, least = check(docs, packing.pack_documents(docs, packing.public_vocabulary()).collect(), 2048)
    assert used <= 1.01 * least + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=40))
def test_plan(counts):
    bins = packing.plan(counts, 100, 8)
    placed = defaultdict(int)
    for content, n in bins:
        assert n > 0 and sum(content) <= 100
        for length in content:
            placed[length] += n
    assert dict(placed) == counts
