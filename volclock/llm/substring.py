"""Removal of word sequences that occur more than once, by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of its
``mer``-word runs. Consecutive windows with the same minimiser form a super-k-mer, which
travels as one packed string (its words) to the bucket of that minimiser; equal windows have
equal minimisers, so they meet there, and sorting counts them exactly.

- Minimisers that occur once in the corpus cannot hold a repeated window. They are counted
  first, and a Bloom filter of fixed size tells which super-k-mers need to travel. When the
  filter is full more of them travel; the result is the same.
- Equal super-k-mers are counted before they are looked into, so thousands of copies of a
  text are one row.
- Where a minimiser still has more than ``CROWDED`` different super-k-mers (around a passage
  that very many documents share) they are cut anew by the minimisers of longer runs of words
  (``LEVELS``) and dealt to the buckets of those, level by level. The last
  level's run is the window itself: equal ones are counted by partial aggregates. So no bucket
  that a task sorts grows with the corpus.

Defined results: null or empty text has no words and stays as it is; a text shorter than a
window loses nothing; texts of any length are looked at whole; rows with equal texts, repeated rows included, count as different places
and lose the same words; an empty table gives an empty result. Columns of the caller keep their values, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm import bloom
from volclock.llm.bloom import Bloom
from volclock.llm.scratch import Temporary, stored
from volclock.llm.text import fresh
from volclock.llm.wordhash import WordHasher, Words, chunks, mix64

WINDOW = 35
MER = 8
#: Different super-k-mers of one bucket, each of at most MOST_WINDOWS windows.
CROWDED = 1000
#: Words in the runs that crowded buckets are dealt on by, as far as shorter than a window.
LEVELS = (20, 29)
#: A super-k-mer is cut into parts of at most so many windows.
MOST_WINDOWS = 256


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each k consecutive values."""
    out, have = x, 1
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sliding_max(x: np.ndarray, k: int) -> np.ndarray:
    return ~sliding_min(~x, k)


def pieces(words: Words, least: np.ndarray, inside: np.ndarray, use: np.ndarray, most: int = MOST_WINDOWS) -> Iterator[tuple[int, int]]:
    """First and one past the last window of each stretch of one minimiser within one text, in
    parts of at most ``most``, where ``use`` says so for its windows."""
    of = words.texts()
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1 : len(least)] != of[: len(least) - 1]) | ~inside[:-1] | ~inside[1:]
    starts = np.nonzero(new)[0]
    ends = np.append(starts[1:], len(least))
    wanted = use[starts]
    for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
        for i in range(a, b, most):
            yield i, min(i + most, b)


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def minimisers(words: Words, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all mers; the minimiser of each window; which windows lie in one text)."""
    mers = words.runs(mer)
    least = sliding_min(mers, window - mer + 1)
    of = words.texts()
    return mers, least, of[: len(least)] == of[window - 1 :]


def _minimiser_hashes(window: int, mer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for _, texts in chunks(batch):
                words = hasher(texts)
                if len(words.hashes) < window:
                    continue
                mers, least, inside = minimisers(words, window, mer)
                # a mer is chosen if it equals the minimum of a window around it
                least = np.where(inside, least, np.uint64(0))
                w = window - mer + 1
                padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
                chosen = mers[sliding_max(padded, w) == mers]
                value, n = np.unique(chosen, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["mini", "n"])

    return run


def repeated_minimisers(docs: DataFrame, temporary: Temporary, window: int, mer: int, bits: int):
    """A Bloom filter, sent to all workers, of the minimisers that occur more than once."""
    counted = docs.select("text").mapInArrow(_minimiser_hashes(window, mer), "mini long, n long")
    repeated = temporary.stored(counted.groupBy("mini").agg(F.sum("n").alias("n")).filter("n > 1").select("mini"), "sub-repeated")
    sent = docs.sparkSession.sparkContext.broadcast(Bloom.of(repeated, bits))
    temporary.drop(repeated)
    return sent


def _super_kmers(window: int, mer: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            keys = batch.column(1)
            for part, texts in chunks(batch):
                words = hasher(texts)
                if len(words.hashes) < window:
                    continue
                _, least, inside = minimisers(words, window, mer)
                mini, of = least.view(np.int64), words.texts()
                rows: list[tuple] = []
                for a, b in pieces(words, least, inside, inside & wanted.value.holds(mini)):
                    packed, t = words.text(a, b + window - 1), int(of[a])
                    rows.append((int(mini[a]), _digest(packed), packed, keys[part.start + t].as_py(), a - int(words.first[t])))
                if rows:
                    types = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64())
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["mini", "digest", "packed", "key", "start"])

    return run


def _cut_anew(window: int, mer: int):
    """From mini, digest, packed and n: pieces by the minimisers of longer runs, each with the
    string that it comes from (whole) and its first window there (at). The key of a piece holds
    all minimisers so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part, texts in chunks(batch, 2):
                words = hasher(texts)
                _, least, inside = minimisers(words, window, mer)
                of = words.texts()
                before, whole, n = (batch.column(i)[part] for i in (0, 1, 3))
                rows: list[tuple] = []
                for a, b in pieces(words, least, inside, inside, 1 if mer == window else MOST_WINDOWS):
                    packed, t = words.text(a, b + window - 1), int(of[a])
                    key = mix64(np.array([before[t].as_py()], np.int64).view(np.uint64) ^ least[a : a + 1]).view(np.int64)
                    rows.append((int(key[0]), _digest(packed), packed, n[t].as_py(), whole[t].as_py(), a - int(words.first[t])))
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["mini", "digest", "packed", "n", "whole", "at"])

    return run


def _windows(packed: bytes, window: int) -> Iterator[bytes]:
    at = [-1]
    while (i := packed.find(b" ", at[-1] + 1)) >= 0:
        at.append(i)
    at.append(len(packed))
    for i in range(len(at) - window):
        yield packed[at[i] + 1 : at[i + window]]


def _ranges(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of consecutive numbers: first and last."""
    for _, run in groupby(enumerate(numbers), lambda x: x[1] - x[0]):
        run = [x for _, x in run]
        yield run[0], run[-1]


def _repeats_in_bucket(window: int):
    """From rows sorted by minimiser: the windows of each super-k-mer that occur elsewhere."""

    def of_bucket(held: list[tuple[bytes, bytes, int]]) -> Iterator[tuple[bytes, int, int]]:
        if len(held) == 1 and held[0][2] == 1 and held[0][1].count(b" ") == window - 1:
            return
        rows = sorted((w, k, i) for k, (_, packed, _) in enumerate(held) for i, w in enumerate(_windows(packed, window)))
        found: dict[int, list[int]] = {}
        for _, same in groupby(rows, lambda x: x[0]):
            same = list(same)
            if len(same) > 1 or held[same[0][1]][2] > 1:
                for _, k, i in same:
                    found.setdefault(k, []).append(i)
        for k, numbers in found.items():
            for a, b in _ranges(sorted(numbers)):
                yield held[k][0], a, b

    def batch_of(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["digest", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []
        now, out = None, []
        for batch in batches:
            for mini, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mini != now:
                    out.extend(of_bucket(held))
                    held, now = [], mini
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                held.append(tuple(row))
        out.extend(of_bucket(held))
        if out:
            yield batch_of(out)

    return run


def _repeats(kmers: DataFrame, temporary: Temporary, window: int, levels: tuple[int, ...], crowded: int) -> DataFrame:
    """digest, lo and hi: first and last of consecutive repeated windows of the super-k-mers in
    ``kmers`` (mini, digest, packed, n: how often). Without a level left they are windows."""
    if not levels:
        return kmers.filter("n > 1").select("digest", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    size = kmers.groupBy("mini").agg(F.count("*").alias("_size"))
    sized = kmers.join(size, "mini")
    cool = sized.filter(F.col("_size") <= crowded).select("mini", "digest", "packed", "n")
    cool = cool.repartition("mini").sortWithinPartitions("mini").mapInArrow(_repeats_in_bucket(window), "digest binary, lo long, hi long")
    warm = temporary.stored(sized.filter(F.col("_size") > crowded).select("mini", "digest", "packed", "n"), "sub-crowded")
    if warm.isEmpty():
        return cool
    schema = "mini long, digest binary, packed binary, n long, whole binary, at long"
    cut = temporary.stored(warm.mapInArrow(_cut_anew(window, levels[0]), schema), "sub-cut")
    anew = temporary.stored(cut.groupBy("mini", "digest", "packed").agg(F.sum("n").alias("n")), "sub-anew")
    found = temporary.stored(_repeats(anew, temporary, window, levels[1:], crowded), "sub-found")
    placed = cut.select(F.col("digest").alias("piece"), "whole", "at").join(found, F.col("piece") == F.col("digest"))
    return cool.unionByName(placed.select(F.col("whole").alias("digest"), (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, mer: int = MER, bits: int = bloom.MOST, crowded: int = CROWDED) -> DataFrame:
    """key (md5 of the text), ranges: array of (first word, last word + 1) to remove, not merged."""
    with Temporary(docs.sparkSession) as temporary:
        wanted = repeated_minimisers(docs, temporary, window, mer, bits)
        keyed = docs.select("text", F.md5("text").alias("key")).filter("text is not null")
        schema = "mini long, digest binary, packed binary, key string, start long"
        places = temporary.stored(keyed.mapInArrow(_super_kmers(window, mer, wanted), schema), "sub-kmers")
        kmers = temporary.stored(places.groupBy("mini", "digest", "packed").agg(F.count("*").alias("n")), "sub-counted")
        # the last level's run is the window
        levels = (*[n for n in LEVELS if mer < n < window], window)
        repeats = temporary.stored(_repeats(kmers, temporary, window, levels, crowded), "sub-repeats")
        spans = places.select("digest", "key", "start").distinct().join(repeats, "digest")
        spans = spans.select("key", F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + window).alias("b")).alias("r"))
        return stored(spans.groupBy("key").agg(F.collect_list("r").alias("ranges")), "sub-ranges")


def kept_words(text: bytes, ranges: list[dict]) -> tuple[int, int, list[bytes], list[bytes]]:
    """Number of words, number removed, the kept words, and the removed passages."""
    words = text.split()
    gone: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if gone and a <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    kept: list[bytes] = []
    at = 0
    for a, b in gone:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), kept, [b" ".join(words[a:b]) for a, b in gone]


def with_ranges(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one more column, the last: the ranges, null where nothing repeats."""
    key, name = fresh(docs, "key", "ranges")
    ranges = repeated_ranges(docs, **parameters).toDF(key, name)
    return docs.withColumn(key, F.md5("text")).join(ranges, key, "left").select(*docs.columns, name)


def removal_report(docs: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, ranges in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                n, gone, kept, _ = kept_words(text.as_py() or b"", ranges.as_py() or [])
                n_words.append(n)
                n_removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_ranges(lean, **parameters).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the repeated words taken out of text. Texts that lose nothing keep their
    white space, the others have their kept words joined by one space."""

    ranged = with_ranges(docs, **parameters)
    names, schema = docs.columns, docs.schema
    at, last = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t.as_py() if not r.is_valid else b" ".join(kept_words(t.as_py(), r.as_py())[2])
                for t, r in zip(batch.column(at).cast(pa.binary()), batch.column(last), strict=True)
            ]
            columns = batch.columns[:last]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranged.mapInArrow(run, schema)
