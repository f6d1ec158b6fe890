"""Short codes of vectors: each of several parts is replaced by its nearest codebook entry.

Codebooks are learnt in rounds over the whole table. Finding the nearest entry goes from coarse to
fine: the means of ever smaller blocks and the norms of what the means leave bound a distance from
below, entries beyond the best known distance go, and only those left are measured, in whole
numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm.scratch import Temporary, stored
from volclock.llm.text import small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components beyond this have squared distances that may not fit 64 bits.
LARGEST = 1 << 24
#: By this share of the squared norms a bound is lowered, far beyond the rounding of doubles.
SLACK = 1e-9

#: By vector length: parts x entries x components of a part.
Codebooks = dict[int, np.ndarray]


def _blocks(size: int) -> list[int]:
    """Numbers of blocks, coarse to fine: 1, 2, 4 and so on, while two components share one."""
    return [k for k in (1 << i for i in range(size.bit_length())) if 2 * k <= size and size % k == 0]


def _summary(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of x: k block means, each times the root of its length, and the norm of the rest."""
    cut = x.reshape(len(x), k, -1)
    means = cut.mean(axis=2, keepdims=True)
    return means[:, :, 0] * np.sqrt(cut.shape[2]), np.sqrt(((cut - means) ** 2).sum(axis=(1, 2)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For rows of whole numbers: index of the nearest entry of ``book`` (ties to the lower one),
    the squared distance, and how many distances were taken in full.

    Splitting x - c into block means and a rest, |x - c|^2 >= |means|^2 + (|rest x| - |rest c|)^2.
    """
    n, entries = len(x), len(book)
    fx, fc = x.astype(np.float64), book.astype(np.float64)
    slack = SLACK * ((fx**2).sum(axis=1)[:, None] + (fc**2).sum(axis=1)[None, :] + 1)
    levels = [(_summary(fx, k), _summary(fc, k)) for k in _blocks(x.shape[1])] or [((fx[:, :0], np.zeros(n)), (fc[:, :0], np.zeros(entries)))]

    def bound(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (mx, rx), (mc, rc) = levels[level]
        return ((mx[i] - mc[j]) ** 2).sum(axis=1) + (rx[i] - rc[j]) ** 2 - slack[i, j]

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((x[i] - book[j]) ** 2).sum(axis=1)

    rows, every = np.repeat(np.arange(n), entries), np.tile(np.arange(entries), n)
    low = bound(0, rows, every)
    guess = low.reshape(n, entries).argmin(axis=1)
    limit = exact(np.arange(n), guess)
    alive = (low <= limit[rows]) & (every != guess[rows])
    i, j = rows[alive], every[alive]
    for level in range(1, len(levels)):
        alive = bound(level, i, j) <= limit[i]
        i, j = i[alive], j[alive]
    distance = np.full((n, entries), np.iinfo(np.int64).max)
    distance[np.arange(n), guess] = limit
    distance[i, j] = exact(i, j)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(n), best], n + len(i)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and vectors of the rows of each length in a batch."""
    column = batch.column(batch.schema.names.index("ints"))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield int(size), at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), int(size))


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """size, part, entry, place, total, n: per entry the sum of the components assigned to it."""
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, _, x in _matrices(batch):
                book = held.value[size]
                total, n = totals.setdefault(size, (np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)))
                for part, piece in enumerate(np.split(x, len(book), axis=1)):
                    best = nearest(piece, book[part])[0]
                    np.add.at(total[part], best, piece)
                    n[part] += np.bincount(best, minlength=book.shape[1])
        for size, (total, n) in totals.items():
            part, entry, place = (a.ravel() for a in np.indices(total.shape))
            columns = [np.full(total.size, size), part, entry, place, total.ravel(), np.broadcast_to(n[:, :, None], total.shape).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["size", "part", "entry", "place", "total", "n"])

    made = vectors.select("ints").mapInArrow(run, "size long, part long, entry long, place long, total long, n long")
    return made.groupBy("size", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _improved(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry that has parts becomes the floor of their mean. What comes to the driver is as
    large as the codebooks."""
    out = {size: book.copy() for size, book in books.items()}
    got = sums.filter("n > 0").toArrow()
    size, part, entry, place, total, n = (got[c].to_numpy() for c in ("size", "part", "entry", "place", "total", "n"))
    for one, book in out.items():
        at = size == one
        book[part[at], entry[at], place[at]] = total[at] // n[at]
    return out


def fingerprint(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def _smallest(vectors: DataFrame, entries: int) -> DataFrame:
    """vec_id, ints, rank: of each vector length the first rows by vec_id (null last) and
    components, repeated rows once. Tasks hand on as many rows for each length at most."""

    def key(row: tuple) -> tuple:
        return row[0] is None, row[0], row[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for size, at, x in _matrices(batch):
                ids = batch.column(0).take(pa.array(at))
                own = held.setdefault(size, [])
                for i in pc.sort_indices(ids, null_placement="at_end").to_pylist():
                    last = own[-1] if len(own) == entries else None
                    one = ids[i].as_py()
                    if last and (one is None, one) > (last[0] is None, last[0]):
                        break
                    row = (one, x[i].tolist())
                    if row not in own:
                        own.append(row)
                        own.sort(key=key)
                        del own[entries:]
        rows = [row for own in held.values() for row in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["vec_id", "ints"])

    found = vectors.select("vec_id", "ints").mapInArrow(run, vectors.select("vec_id", "ints").schema)
    order = Window.partitionBy(F.size("ints")).orderBy(F.asc_nulls_last("vec_id"), "ints")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= entries)


def _first_books(rows: list, parts: int) -> Codebooks:
    out: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(len(row["ints"]), []).append(row["ints"])
    return {size: np.array(own, np.int64).reshape(len(own), parts, size // parts).transpose(1, 0, 2).copy() for size, own in out.items()}


def _coded(vectors: DataFrame, books: Codebooks, names: list[str]) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast(({size: fingerprint(book) for size, book in books.items()}, books))
    code, error, digest = names[-3:]
    kept = [c for c in vectors.columns if c != "ints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, by_size = held.value
        for batch in batches:
            codes, errors, digests = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, "", object)
            for size, at, x in _matrices(batch):
                book = by_size[size]
                found = [nearest(piece, book[part]) for part, piece in enumerate(np.split(x, len(book), axis=1))]
                codes[at] = ["".join(f"{b:02x}" for b in row) for row in np.stack([b for b, _, _ in found], axis=1).tolist()]
                errors[at] = sum(d for _, d, _ in found)
                digests[at] = prints[size]
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(errors), pa.array(digests, pa.string())], [*kept, code, error, digest])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "ints"]
    return vectors.mapInArrow(run, ", ".join([*fields, f"`{code}` string", f"`{error}` long", f"`{digest}` string"]))


def compressed(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances to the entries
    in whole numbers), label_error (error of all rows with that label) and codebooks_sha256.

    Components become floor(scale x). No part take: vectors that are null or empty or hold null or
    non-finite components, or components so large (2^24 or more in size after scaling, so 4096
    here) that squared distances may not fit 64 bits, and vectors whose length ``parts`` doesn't
    divide. Vectors of each length have codebooks of their own; these start as the rows of the
    smallest vec_ids (null last, equal ids by their components), repeated rows once; with fewer
    rows there are fewer entries. Repeated rows all come back. label_error is null where it
    doesn't fit 64 bits. An empty table gives an empty one; further columns are ignored.

    Each round is one scan of the stored whole-number vectors, whose tasks hand on one sum for each
    entry and component. Only codebooks, of a size that doesn't depend on the rows, are broadcast.
    """
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < LARGEST / scale))
    ids = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.when(fine, F.transform(v, lambda x: F.floor(x * scale).cast("int"))).alias("ints")).filter("ints is not null")
    with Temporary(spark) as temporary:
        vectors = temporary.stored(ids, "whole-vectors")
        books = _first_books(_smallest(vectors, entries).collect(), parts)
        for _ in range(rounds if books else 0):
            books = _improved(books, _sums(vectors, books))
        coded = stored(_coded(vectors, books, ["code", "error", "codebooks_sha256"]), "coded-vectors")
    by_label = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    joined = coded.join(small(by_label), coded["label"].eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
