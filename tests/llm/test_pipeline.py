"""The chain of stages: each one against a plain version on what its predecessor kept."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from tests.conftest import TINY
from tests.llm import awkward, brute
from tests.llm.test_packing import check
from volclock.llm import mixing, packing, quality_rules
from volclock.llm.scratch import stored


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def chained(spark, docs, sf_dir):
    """Checks all stages in a row and returns the last one's rows."""
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    inputs = {}
    for name, stage in stages.items():
        inputs[name] = docs
        docs = stored(stage(spark, docs, sf_dir), "chain-" + name.replace(" ", "-"))
        assert name == "packing" or docs.columns == names

    kept = Counter(r["doc_id"] for r in quality_rules.quality_report(inputs["quality rules"]).filter("kept").collect())
    assert Counter(d for d, _ in texts(inputs["near duplicates"])) == kept
    assert all(len(brute.words(t)) >= quality_rules.MIN_WORDS for _, t in texts(inputs["near duplicates"]))

    before = texts(inputs["near duplicates"])
    groups = {c for _, n, c in brute.near_groups(before, 5, 80, 100) if n and c is not None}
    assert {d for d, _ in texts(inputs["repeated passages"]) if d is not None} == groups

    want = Counter((d, n, gone) if not gone else (d, n, gone, sha) for d, n, gone, sha in brute.substring(texts(inputs["repeated passages"]), 35).elements())
    lengths = {d: len(brute.words(t)) for d, t in texts(inputs["repeated passages"])}
    got = Counter()
    for d, t in texts(inputs["mixture"]):
        gone = lengths[d] - len(brute.words(t))
        got[(d, lengths[d], gone, hashlib.sha256(t.encode()).hexdigest()) if gone else (d, lengths[d], gone)] += 1
    assert got == want

    epochs = Counter()
    for r in mixing.mix_sizes(inputs["mixture"]).collect():
        epochs[r["doc_id"]] += r["epochs"]
    assert Counter(d for d, _ in texts(inputs["packing"])) == +epochs

    rows = docs.collect()
    check(inputs["packing"], rows, packing.CAPACITY)
    return rows


def plain_rows(rows):
    return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


def test_chain(spark):
    rows = chained(spark, spark.read.parquet(f"{TINY}/documents.parquet"), TINY)
    assert rows and plain_rows(corpus_pipeline.run(spark, TINY).collect()) == plain_rows(rows)


def test_chain_awkward(spark):
    assert chained(spark, awkward.documents(spark), TINY)


def test_chain_empty(spark):
    assert chained(spark, awkward.empty(spark), TINY) == []
