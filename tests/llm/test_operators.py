from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tests.conftest import SMALL
from tests.llm import awkward, brute
from volclock.llm import ann, language_id, license_scan, mixing, quality_model, quality_rules, queries, quotes
from volclock.llm.oracles import ORACLE_SQL


def test_mixing_awkward(spark):
    docs = awkward.documents(spark)
    rows = mixing.mix_sizes(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] == r["epochs"] * r["size"] and r["epochs"] <= 3 for r in rows)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_sizes(awkward.empty(spark)).collect() == [] and mixing.mix(awkward.empty(spark)).collect() == []


@pytest.mark.parametrize("copies", [1, 300])
def test_mixing_repeated_rows(spark, tmp_path, copies):
    """Copies of one row, more than one row stands for, against SQL's row by row queue."""
    hot = [(1, "ten words " * 50, "a")] * copies + [(1, "ten words " * 50, "b"), (2, "x", "a"), (2, None, None)]
    docs = spark.createDataFrame(hot + [(i, f"w{i} " * (i % 90 + 100), "bc"[i % 2]) for i in range(10, 400)], "doc_id long, text string, source string")
    for name, table in {"hot": docs, "awkward": awkward.documents(spark)}.items():
        (tmp_path / name).mkdir()
        table.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / name / "documents.parquet")
        same(queries.op1_mixing(spark, f"{tmp_path}/{name}"), ORACLE_SQL["op1_mixing"], f"{tmp_path}/{name}")
    taken = {r["source"]: r for r in mixing.mix_sizes(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r["taken"] - r["target"]) <= 200 for r in taken.values())
    mixed = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert mixed == {s: r["taken"] for s, r in taken.items() if r["taken"]}


def test_mixing_spreads_copies(spark, monkeypatch):
    """However many copies a row stands for, the queue is the same."""
    sizes = spark.createDataFrame([("a", 7, 5)] * 100 + [("b", 9, 6)] * 3 + [(None, 400, 8)], "source string, size long, key long")
    wanted = sorted(map(str, mixing.fair_queue(sizes).collect()))
    for copies in (1, 3):
        monkeypatch.setattr(mixing, "COPIES", copies)
        assert sorted(map(str, mixing.fair_queue(sizes).collect())) == wanted


def test_quality_awkward(spark):
    docs = awkward.documents(spark)
    got = [tuple(r)[2:] for r in quality_rules.quality_report(docs).select("doc_id", "lang", *quality_rules.BASE).collect()]
    assert sorted(got) == sorted(brute.quality(r["text"]) for r in docs.collect())
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(awkward.empty(spark)).collect() == []


def test_licenses(spark):
    mit = license_scan.NOTICES["mit"][0]
    texts = [None, "", "Under the MIT license. CC-BY-NC; apache license, version 2.0", "x " * 50 + mit + " y" * 30, mit.replace("free of charge", "at a price"), "under the\nMIT\tlicense " * 2]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert rows[0]["n_words"] == 0 and rows[0]["labels"] == "" and rows[0]["first_word"] is None
    assert (rows[2]["n_base"], rows[2]["first_word"], rows[2]["last_word"], rows[2]["base_labels"]) == (3, 0, 7, "apache-2,cc-by-nc,mit")
    assert rows[3]["labels"] == "mit" and rows[3]["n_base"] == 0 and rows[4]["labels"] == ""
    assert (rows[5]["n_base"], rows[5]["last_word"]) == (2, 4)
    assert license_scan.scan_licenses(awkward.empty(spark)).collect() == []
    assert license_scan.scan_licenses(awkward.documents(spark)).count() == awkward.documents(spark).count()


def test_license_references(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "under the GNU Affero General Public License v3": "agpl-3",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
        "Mozilla Public License, v. 2.0": "mpl-2",
        "available under CC BY-SA 4.0": "cc-by-sa",
        "Creative Commons Attribution 4.0": "cc-by",
        "the GNU Lesser General Public License, version 3": "",
        "the general public asked for a license, version 3": "",
    }
    docs = spark.createDataFrame([(i, f"some words. {t} more") for i, t in enumerate(lines)], "doc_id long, text string")
    rows = sorted(license_scan.scan_licenses(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["labels"] for r in rows] == list(lines.values())
    assert [r["n_base"] for r in rows] == [0, 1, 1, 1] + [0] * 7 and rows[0]["score"] == 1.0

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = license_scan.scan_licenses(table).join(table.select("doc_id", "text"), "doc_id")
    for line, label in list(lines.items())[:4]:
        held = found.filter(F.col("text").contains(line))
        assert held.count() > 0 and held.filter(~F.array_contains(F.split("labels", ","), label)).isEmpty()


def test_license_absent_words(spark):
    """A notice whose rarest words no document holds is found by its other words."""
    text, phrases = license_scan.NOTICES["gpl-3"]
    words = text.split()
    for gone in ("program", "redistribute", "modify", "option", "later", "terms"):
        words = [w for w in words if gone not in w.lower()]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "else")] + [(i, "either version of the free software license is published by the foundation under gnu general public") for i in range(3, 60)], "doc_id long, text string")
    rows = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs, references={}).collect()}
    assert rows[1] == "gpl-3" and rows[2] == rows[3] == ""


def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    rows = {r["doc_id"]: r for r in language_id.identify(awkward.documents(spark)).collect()}
    assert rows[0]["lang_pred"] == rows[5]["lang_pred"] == "und"
    assert language_id.identify(awkward.empty(spark)).collect() == []


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", quality_model.toxic_poor_good(F.col("quality"), F.col("toxic")).alias("grade"))
    out = quality_model.graded(docs, quality_model.fitted(docs, ratings)).join(ratings, "doc_id")
    assert out.filter("grade = 2").agg(F.avg(F.col("kept").cast("double"))).first()[0] > 0.97
    assert out.filter("grade < 2").agg(F.avg(F.col("kept").cast("double"))).first()[0] < 0.2
    none = ratings.limit(0)
    assert quality_model.graded(awkward.documents(spark), quality_model.fitted(awkward.empty(spark), none)).count() == awkward.documents(spark).count()


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype("f4")
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (420, [0.0] * 8, 0), (440, [float("nan")] * 8, 0), (460, [None] * 8, 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query long")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, cell=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == list(range(0, 300, 20))
    y = x.astype("f8")
    shares = []
    for q, found in got.items():
        s = (y * y[q]).sum(axis=1)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        shares.append(len(set(best) & set(found)) / 20)
    assert np.mean(shares) >= 0.9
    copies = [v for v in got[100] if 100 < v < 160]  # ties: the smallest ids first
    assert copies == list(range(101, 101 + len(copies)))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_nearest_repeated_rows(spark):
    ids = [ann.SALTS * i for i in range(40)]  # all in one salt
    rows = [(i, [1.0, 2.0]) for i in ids for _ in range(60 if i == 0 else 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    (entry,) = ann.entries(ann.usable(df), 20).collect()
    assert entry["ids"] == ids[:21]


def test_nearest_of_each_length(spark, monkeypatch):
    """Lengths are searched on their own; copies of crowded cells change nothing."""
    rng = np.random.default_rng(5)
    x = {i: rng.standard_normal(3 if i < 200 else 2) for i in range(0, 240)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>")
    want = {}
    for q in range(0, 240, 20):
        s = {i: float((x[i] * x[q]).sum()) for i in x if i != q and len(x[i]) == len(x[q])}
        want[q] = sorted(s, key=lambda i: (-s[i], i))[:20]
    for most in (ann.QUERIES, 2):
        monkeypatch.setattr(ann, "QUERIES", most)
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == want


def test_language_learns_from_letters_only(spark):
    rows = [(f"the quick fox number {i} runs over there", "en") for i in range(40)] + [(f"der schnelle fuchs {i} ist nicht dort", "de") for i in range(40)]
    blank = [(t, "zz") for t in ("", "  ", "1234", "!? 5", None)]
    docs = spark.createDataFrame(rows + blank, "text string, lang string")
    model = language_id.learned_centroids(docs)
    assert set(model["langs"]) == {"de", "en"}
    same = language_id.learned_centroids(spark.createDataFrame(rows[::-1], "text string, lang string"))
    assert model["langs"] == same["langs"] and np.allclose(model["centroids"], same["centroids"], atol=1e-5)


def test_quotes_all_links(spark):
    said = {1: "the first conversation starts", 2: "> the first conversation starts\nsecond says other things", 3: "> second says other things\nthird is here now"}
    rows = [(c, 0, t) for c, t in said.items()] + [(4, 0, "> the first conversation starts\nyes\n> third is here now\nno")]
    rows += [(10, 0, "something quite apart"), (11, 0, "another apart thing"), (12, 0, "> something quite apart\n>\n> another apart thing\nboth of these")]
    rng = np.random.default_rng(8)
    for c in range(20, 90):
        for t in range(2):
            text = [f"own words of {c} and {t}", "", f"more of {c} in {t}"]
            for d in rng.choice(np.arange(20, c), min(c - 20, int(rng.integers(0, 4))), replace=False).tolist() if c % 7 else []:
                k = int(rng.integers(0, 5))
                quote = [["> own words of {} and 0"], ["> own words of {} and 1", "> ", "> more of {} in 1"], ["> > more of {} in 0"], ["> not said", "> more of {} in 1"], ["> own words of {} and 0", ">", "> own words of 20 and 1"]][k]
                text += [q.format(d) for q in quote] + [f"so {c} {t} {d}"]
            rows.append((c, t, "\n".join(text)))
    rows += [(c, 0, f"> chain link {c - 1}\nchain link {c}") for c in range(201, 221)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    out = quotes.formatted(df).orderBy("thread_id", "level", "conv_id", "turn").collect()
    got = {(r["conv_id"], r["turn"]): (r["thread_id"], r["level"], [tuple(x) for x in r["links"] or []]) for r in out}
    assert got == brute.threads(rows, quotes.split_levels)
    assert got[4, 0] == (1, 3, [(1, 0), (3, 0)]) and got[12, 0] == (10, 1, [(10, 0), (11, 0)]) and got[11, 0][0] == 10 and got[220, 0][1] == 19
    place = {(r["conv_id"], r["turn"]): i for i, r in enumerate(out)}
    assert all(place[to] < place[m] for m, (_, _, links) in got.items() for to in links)
    assert all(r["n_links"] == len(r["links"] or []) for r in out)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friends\nsecond line of text"), (1, 1, "assistant", "> Hello there my friends\nI reply to that now"),
        (1, 2, "user", "Bob wrote:\n>> Hello there my friends\n> I reply to that now\nmore words from me"), (2, 0, "user", "> more words from me\nother conversation answer"),
        (3, 0, "user", "> other conversation\n> answer\nyes"), (None, 1, None, None), (4, 0, "user", "plain"), (4, 0, "user", "plain"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.formatted(df).collect()}
    assert out[1, 1]["text"] == "I reply to that now" and (out[1, 1]["to_conv"], out[1, 1]["to_turn"]) == (1, 0)
    assert (out[1, 2]["to_turn"], out[1, 2]["deepest"], out[1, 2]["text"]) == (1, 2, "more words from me")
    assert [out[c, 0]["thread_id"] for c in (2, 3, 4)] == [1, 1, 4] and [out[c, 0]["level"] for c in (2, 3, 4)] == [1, 2, 0]
    assert quotes.formatted(df).count() == len(rows) and quotes.formatted(df.limit(0)).collect() == []


@pytest.mark.parametrize("p, m, x", [(0.95, 8, 15.507), (0.5, 2, 1.386)])
def test_chi_square(p, m, x):
    assert abs(ann.chi_square_quantile(p, m) - x) < 1e-3


def test_language_number_signs_are_no_letters(spark):
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(["the quick brown fox", "der schnelle braune Fuchs"] * 20)]
    asked = [(1000, "² ½ ①"), (1001, "Ⅷ"), (1002, "１２"), (1003, "ª"), (1004, "fox Ⅷ")]
    docs = spark.createDataFrame(rows + [(d, t, None) for d, t in asked], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert [got[d] for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1003] != "und" and got[1004] != "und"
