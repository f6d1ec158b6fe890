"""Best-fit packing of tokenised documents into fixed sequences, by linear grouping.

1. Every document is tokenised once, on the executors, and cut into pieces of at most
   ``capacity`` tokens; only lengths and checksums go on.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus size) goes
   to the driver, which plans the packing of *lengths*:
   linear grouping sorts the large ones, splits them into groups of equal cardinality and
   rounds each up to its group's longest; configurations of those few sizes are optimised by
   column generation on the linear relaxation, used as often as its rounded-down solution
   says, and best fit decreasing takes what is left over; actual lengths replace the rounded
   ones, longest first; and the small pieces are placed by best fit into the room that
   remains. Bins that hold the same lengths are one entry with a count, so a plan has some
   thousands of entries at most.
3. Pieces of one length are interchangeable. Each gets its rank among those of its length
   (a prefix sum over key buckets, so no length has to fit in one task), and the plan says
   which sequence and offset that rank has.

Defined results: null and empty texts are one piece with the end token alone; a null doc_id
is kept; repeated rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm.scratch import stored

CAPACITY = 2048
END_ID = 0
#: Lengths above this share of the capacity are large.
LARGE_SHARE = 0.125
GROUPS = 48
BUCKETS = 256
LONGEST_RUN = 5000

# The characters that Unicode calls white space, as in the tokenizer's pattern.
OTHER_SPACE = r"\t\x0b-\r\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r" \n" + OTHER_SPACE


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    Where the same vocabulary lies beside the tokenizer's file as ranks, those are used, which
    is several times faster; texts that name a special token, or hold a run of more than
    ``LONGEST_RUN`` characters without a space, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path = path
        self._tokenizer = None
        self.ranks = self._ranked(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._tokenizer = None  # read again if a text needs it
        self.long_run = re.compile(rf"[^{SPACE}]{{{LONGEST_RUN}}}|[{SPACE}]{{{LONGEST_RUN}}}")

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        if os.path.realpath(path) != os.path.realpath(public_vocabulary()):
            return None
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
        return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def __call__(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special) or self.long_run.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), dtype="<u4").tobytes()


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _strings(column: pa.Array) -> Iterator[str]:
    for text in column:
        yield text.as_py() or ""


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int).

    The first piece of a long document takes what is left over, all others are full.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), _strings(batch.column(1)), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                start = 0
                for piece in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), np.frombuffer(part, "<u4").astype("i4") if with_ids else None))
                    start += length
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([r[5] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# The plan. A bin is a tuple of lengths in the order in which they lie in the sequence.


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of (nearly) equal cardinality, longest first: (its longest, [(length, n), ...])."""
    total = sum(counts.values())
    found: list[tuple[int, list[tuple[int, int]]]] = []
    edges = [total * (i + 1) // groups for i in range(groups)]
    seen = 0
    members: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while edges and edges[0] <= seen:
                edges.pop(0)
                if members:
                    found.append((members[0][0], members))
                    members = []
            n = min(left, edges[0] - seen)
            members.append((length, n))
            seen += n
            left -= n
    if members:
        found.append((members[0][0], members))
    return found


def best_pattern(sizes: list[int], worth: np.ndarray, demand: list[int], capacity: int) -> np.ndarray:
    """The configuration of most worth that fits (an unbounded knapsack over lengths)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for i, size in enumerate(sizes):
        if worth[i] <= 1e-9:
            continue
        for _ in range(capacity // size):
            shifted = best[: capacity + 1 - size] + worth[i]
            better = shifted > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = shifted[better]
            last[size:][better] = i
    pattern = np.zeros(len(sizes))
    room = int(np.argmax(best))
    while room > 0 and last[room] >= 0 and pattern @ np.array(sizes) + sizes[last[room]] <= capacity:
        pattern[last[room]] += 1
        room -= sizes[last[room]]
    return pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used: column generation, rounded down.

    The basis starts with one configuration for each size; each round prices a new one by the
    dual values, and a ratio test lets it replace another (the revised simplex method).
    """
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = inverse @ need
        worth = np.ones(m) @ inverse
        pattern = best_pattern(sizes, worth, demand, capacity)
        if worth @ pattern <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratios = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = pattern
    use = np.linalg.solve(basis, need)
    return [(basis[:, i].copy(), int(np.floor(max(use[i], 0) + 1e-9))) for i in range(m)]


class Room:
    """Bins with the same content as one entry, found by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(self, content: tuple[int, ...], n: int) -> None:
        room = self.capacity - sum(content)
        if room not in self.bins:
            bisect.insort(self.rooms, room)
            self.bins[room] = []
        held = self.bins[room]
        if held and held[-1][0] == content:
            held[-1] = (content, held[-1][1] + n)
        else:
            held.append((content, n))

    def place(self, length: int, n: int) -> None:
        """Put n pieces where they leave the least room; as many in a bin as go in."""
        while n:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                full, rest = divmod(n, each)
                if full:
                    self.add((length,) * each, full)
                if rest:
                    self.add((length,) * rest, 1)
                return
            room = self.rooms[at]
            held = self.bins[room]
            content, have = held.pop()
            each = min(room // length, n)
            used = min(have, n // each)
            if have > used:
                held.append((content, have - used))
            if not held:
                del self.bins[room]
                self.rooms.pop(at)
            self.add(content + (length,) * each, used)
            n -= used * each


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> list[tuple[tuple[int, ...], int]]:
    """How to pack ``counts[length]`` pieces of each length: (lengths of a bin, number of such bins)."""
    done: list[tuple[tuple[int, ...], int]] = []
    counts = {k: v for k, v in counts.items() if v}
    full = counts.pop(capacity, 0)
    if full:
        done.append(((capacity,), full))
    large = {k: v for k, v in counts.items() if k > large_share * capacity}
    room = Room(capacity)
    if large:
        grouped = linear_groups(large, groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for size, members in grouped:  # groups that round to the same size are one size
            merged.setdefault(size, []).extend(members)
        sizes = list(merged)
        queues = [list(merged[s]) for s in sizes]
        demand = [sum(n for _, n in q) for q in queues]
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [i for i in range(len(sizes)) for _ in range(int(round(pattern[i])))]
            each = Counter(slots)
            while times and slots:
                # so many bins have the same actual lengths in all their slots
                step = min([times, *(max(1, queues[i][0][1] // k) for i, k in each.items() if queues[i])])
                content = []
                for i in slots:
                    if queues[i]:
                        length, n = queues[i][0]
                        content.append(length)
                        queues[i][0:1] = [(length, n - step)] if n > step else []
                if content:
                    room.add(tuple(sorted(content, reverse=True)), step)
                times -= step
        left: dict[int, int] = {}
        for q in queues:
            for length, n in q:
                left[length] = left.get(length, 0) + n
        for length in sorted(left, reverse=True):
            room.place(length, left[length])
    for length in sorted((k for k in counts if k not in large), reverse=True):
        room.place(length, counts[length])
    return done + [x for held in room.bins.values() for x in held]


def plan_rows(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of ranks, in order of rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for content, n in bins:
        offset = 0
        for length in content:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset))
            ranks[length] = rank + n
            offset += length
        sequence += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def packed(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` (stored; with length) with sequence_id and offset."""
    columns = pieces.columns
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    keyed = pieces.withColumns({"_key": key, "_bucket": F.pmod(key, F.lit(buckets))})
    sums = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    sums = stored(sums, "pack-counts")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = plan_rows(plan(histogram, capacity, groups))

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("_key")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_bucket"])
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_start")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                here = np.nonzero(length == value)[0]
                first, to, at = rows[int(value)]
                run_of = np.searchsorted(first, rank[here], "right") - 1
                sequence[here] = to[run_of] + rank[here] - first[run_of]
                offset[here] = at[run_of]
            out = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, [*columns, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32,
    (ids,) sequence_id and offset."""
    return packed(stored(tokenised(docs, path, capacity, end_id, with_ids), "pack-pieces"), capacity, groups)
