"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed letter 1-, 2- and 3-grams, weighed by tf-idf and brought to
length 1. Document frequencies come from all learning documents. Each language has up to
``CENTROIDS`` centroids from spherical k-means over a bounded sample of its documents
(``SAMPLE``), and each centroid a least cosine: the one that a hundredth of its own sample
stays below. A text takes the language of the centroid with the largest cosine and is marked
as rejected if that cosine is too small.

Defined results: null text, and text without letters, is ``und`` with score 0, as is every text
if nothing could be learned; rows with null lang, null text or no letter are not learned from;
whole texts count, however long; repeated rows give equal rows; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volclock.llm.scratch import stored

DIMENSIONS = 1 << 14
#: So many documents of each language are taken for clustering, about, and never more than
#: twice as many; they are chosen by hash.
SAMPLE = 2000
CENTROIDS = 4
ROUNDS = 12
REJECT_SHARE = 0.01
UNKNOWN = "und"

#: Letters are the Unicode categories L*, so that number signs such as superscripts are none.
_OTHER = regex.compile(r"\P{L}+")
_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_counts(text: str, dimensions: int) -> np.ndarray:
    """How often each hashed n-gram of letters occurs in the whole text."""
    c = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = (c + np.uint32(1)) * _FACTORS[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _FACTORS[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _FACTORS[2] + c[2:]
    h = np.concatenate([one, two, three])
    h ^= h >> np.uint32(16)
    h *= _FACTORS[1]
    return np.bincount(h >> np.uint32(32 - (dimensions - 1).bit_length()), minlength=dimensions)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    return unit((ngram_counts(text, len(idf)) * idf).astype(np.float32))


def inverse_frequencies(docs: DataFrame, dimensions: int) -> np.ndarray:
    """idf of each dimension over all ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(dimensions + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                held[:-1] += ngram_counts(text.as_py() or "", dimensions) > 0
            held[-1] += batch.num_rows
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], ["at", "n"])

    # at most one row for each dimension
    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(dimensions + 1)
    held[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return (np.log((held[-1] + 1) / (held[:-1] + 1)) + 1).astype(np.float32)


def clusters(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and the cosine of each row with its own."""
    chosen = [0]
    for _ in range(1, min(k, len(x))):  # the row farthest from all centroids so far comes next
        far = (x @ x[chosen].T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        chosen.append(int(np.argmin(far)))
    centroids = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c for j, c in enumerate(centroids)])
        centroids = unit(sums)
    cosines = x @ centroids.T
    return centroids, np.stack([np.argmax(cosines, axis=1), np.max(cosines, axis=1)])


def learned_centroids(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> dict:
    """From text and lang of ``docs``: langs, centroids, least (cosine of each) and idf."""
    usable = docs.filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}")).select("text", "lang")
    idf = inverse_frequencies(usable, dimensions)
    sizes = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sized = stored(sizes, "lang-sizes").withColumnRenamed("lang", "_lang")
    chosen = usable.join(sized, F.col("lang") == F.col("_lang")).filter(part * F.col("_n") < sample).select("text", "lang")

    def of_language(pdf: pd.DataFrame) -> pd.DataFrame:
        # in the order of a hash, so that reruns agree and no part of the alphabet is favoured
        texts = sorted(set(pdf["text"]), key=lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())[: 2 * sample]
        x = np.stack([vector(t, idf) for t in texts])
        centroids, (own, cosine) = clusters(x, k, rounds)
        least = [float(np.quantile(cosine[own == j], REJECT_SHARE)) if (own == j).any() else 0.0 for j in range(len(centroids))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "least": least, "centroid": [c.astype("<f4").tobytes() for c in centroids]})

    # a few rows for each language
    schema = "lang string, least double, centroid binary"
    rows = sorted(chosen.distinct().groupBy("lang").applyInPandas(of_language, schema).collect(), key=lambda r: (r["lang"], bytes(r["centroid"])))
    return {
        "langs": [r["lang"] for r in rows],
        "least": [r["least"] for r in rows],
        "centroids": np.stack([np.frombuffer(r["centroid"], "<f4") for r in rows]) if rows else np.zeros((0, dimensions), np.float32),
        "idf": idf,
    }


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """Per document: doc_id, lang_pred, score (cosine with the nearest centroid) and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        centroids, idf = m["centroids"], m["idf"]
        for batch in batches:
            langs, scores, rejected = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                if not len(centroids) or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                cosine = centroids @ vector(text, idf)
                best = int(np.argmax(cosine))
                langs.append(m["langs"][best])
                scores.append(min(1.0, max(0.0, float(cosine[best]))))
                rejected.append(bool(cosine[best] < m["least"][best]))
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def is_held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the part of ``docs`` that isn't held out and predict all of it."""
    model = learned_centroids(docs.filter(~is_held_out(docs["doc_id"])))
    found = predicted(docs, model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
