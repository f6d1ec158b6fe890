"""Stages of the pipeline leave the caller's columns alone; the chain against plain versions."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import awkward, brute
from volclock.llm import mixing, ngram_join, quality_rules, substring

CLASHING = (
    "_w _h _s _d _some _lines _lang _source m_length_max base_failed n_words row times own full_epochs last_key last_bucket _mix_source _q "
    "ranges _ranges _key a b lo hi mini packed digest text_key row_key _gone group root node cls token n prefix hub rep"
).split()


def clashing(df):
    """Adds columns with names that the operators use, whose values tell the row."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.concat_ws("|", F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING if c.lower() not in have])


@pytest.mark.parametrize("stage", [quality_rules.keep_good, ngram_join.one_of_each_group, substring.without_repeats, mixing.mix])
def test_clashing_names(spark, stage):
    plain, more = stage(awkward.documents(spark)), stage(clashing(awkward.documents(spark)))
    names = awkward.documents(spark).columns
    assert more.columns == clashing(awkward.documents(spark)).columns
    rows = more.collect()
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(tuple(r) for r in plain.collect())
    own = [c for c in more.columns if c not in names]
    assert all(r[c] == f"{c}|{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in own)


def test_keep_good_is_what_the_report_keeps(spark):
    docs = awkward.documents(spark)
    kept = Counter(r["doc_id"] for r in quality_rules.quality_report(docs).filter("kept").collect())
    assert Counter(r["doc_id"] for r in quality_rules.keep_good(docs).collect()) == kept
    assert all(len(brute.words(r["text"])) >= quality_rules.MIN_WORDS for r in quality_rules.keep_good(docs).collect())
