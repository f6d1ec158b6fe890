"""Jaccard self-join on word n-grams, filtered under several global orders.

If two sets have a Jaccard similarity of at least t, then under ANY order of all tokens their
prefixes (the first n - ceil(t n) + 1 tokens of a set of n) share a token. The orders used
here sort tokens by a frequency table first (rare ones to the front) and then by one hash
each. Candidates come from the first order's prefixes, together with their places there; those
that don't share enough prefix tokens under the other orders are dropped; the rest is verified
on the whole sets.

- Texts with equal sets are one class; only classes are joined.
- The frequency table merges summaries of the repeated tokens of all documents and holds at
  most ``TABLE`` of the most frequent. It decides on the order only: its bounds cost no results.
- A match of two prefixes counts only where it can be the first token that both sets share:
  sizes, places and a signature of parities are part of the join's condition, so that of a
  long list of documents only likely pairs become rows.
- Thousands of near copies share thousands of tokens. Their pairs are not enumerated: classes
  are verified against one hub of each long list first, and after that only candidates
  from different components, which is all that the components of the graph depend on.

Defined results: null text, and text without words, has an empty set and links with nothing; a
text with fewer words than the n-gram is one token; texts of any length are used whole; a null
doc_id is a document like others; repeated rows are linked with each other; an empty table
gives an empty result. Columns of the caller keep their values, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volclock.llm.bloom import Bloom
from volclock.llm.components import components
from volclock.llm.scratch import Temporary, stored
from volclock.llm.text import fresh
from volclock.llm.wordhash import LOWER, WordHasher, chunks, mix64

NGRAM, NUMERATOR, DENOMINATOR = 5, 80, 100
ORDERS = 3
#: Tokens in the frequency table: at most 16 MB come to the driver and to every worker.
TABLE = 1_000_000
#: So many tokens are summarised at a time, by the counts of at most so many of them.
SUMMARISED, SUMMARY = 1 << 21, 1 << 16
#: The classes of a token in at most so many prefixes are paired at once; longer lists go through
#: a hub first.
FEW = 3
#: What is left after the hubs is joined in so many rounds, each of its share of the tokens, so that
#: only one round's rows are on the disks of the shuffle at a time.
ROUNDS = 4
#: Words of 64 bits in a signature.
PARITY = 4
#: A task emits the prefix of a class once, as far as it remembers its last classes.
REMEMBERED = 200_000


class Sets:
    """The sorted sets of hashed n-grams of some texts, one after the other in ``tokens``."""

    def __init__(self, texts: list[bytes], hasher: WordHasher, ngram: int):
        words = hasher(texts)
        grams = words.runs(ngram)
        found = []
        for a, b in pairwise(words.first.tolist()):
            if b - a >= ngram:
                found.append(np.sort(grams[a : b - ngram + 1]))
            else:
                digest = hashlib.blake2b(words.hashes[a:b].tobytes(), digest_size=8).digest()
                found.append(np.frombuffer(digest if b > a else b"", np.uint64))
        tokens, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
        self.tokens = tokens[new]
        self.sizes = np.bincount(of[new], minlength=len(found))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def of(self, values: np.ndarray) -> list[np.ndarray]:
        """``values``, which go with ``tokens``, for each set."""
        return [values[a:b] for a, b in pairwise(self.first.tolist())]

    def digests(self) -> list[bytes | None]:
        return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in self.of(self.tokens)]

    def parities(self) -> list[np.ndarray]:
        """Whether an odd number of tokens falls on each of 64 * PARITY bits. Two signatures
        differ in at most as many bits as the sets differ in tokens."""
        out = np.zeros((PARITY, len(self.sizes)), np.uint64)
        some = self.sizes > 0
        if len(self.tokens):
            at = mix64(self.tokens)
            bits, word = np.uint64(1) << (at & np.uint64(63)), (at >> np.uint64(6)) % np.uint64(PARITY)
            for k in range(PARITY):
                out[k, some] = np.bitwise_xor.reduceat(np.where(word == k, bits, np.uint64(0)), self.first[:-1][some])
        return list(out.view(np.int64))

    def prefixes(self, frequencies: np.ndarray, k: int, numerator: int, denominator: int) -> list[np.ndarray]:
        """The first tokens of each set under the order k, in that order."""
        out = []
        for tokens, ranks in zip(self.of(self.tokens), self.of(Order.ranks(self.tokens, frequencies, k)), strict=True):
            length = prefix_length(len(tokens), numerator, denominator) if len(tokens) else 0
            least = np.sort(np.argpartition(ranks, length - 1)[:length]) if 0 < length < len(tokens) else np.arange(length)
            if 0 < length < len(tokens) and np.count_nonzero(ranks <= ranks[least].max()) > length:
                least = np.argsort(ranks, kind="stable")[:length]  # equal ranks at the end: smaller tokens first
            out.append(tokens[least[np.argsort(ranks[least], kind="stable")]])
        return out


def prefix_length(n: int, numerator: int, denominator: int) -> int:
    return n - -(-numerator * n // denominator) + 1


class Order:
    """Global orders of tokens: rare ones by a hash, then the table's by their frequency."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.tokens, self.counts = table

    def frequencies(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], np.uint64(0))

    @staticmethod
    def ranks(tokens: np.ndarray, frequencies: np.ndarray, order: int) -> np.ndarray:
        salted = mix64(tokens ^ np.uint64((order + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(24)
        return salted + (frequencies << np.uint64(40))


def summary(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The heavy ones of some tokens with their counts, none of which is over the true one, and
    none under it by more than one, or a ``SUMMARY``-th of all tokens (Misra and Gries)."""
    value, n = np.unique(tokens, return_counts=True)
    n -= max(1, int(np.partition(n, -SUMMARY - 1)[-SUMMARY - 1])) if len(n) > SUMMARY else 1
    return value[n > 0], n[n > 0] + 1


def frequency_table(docs: DataFrame, temporary: Temporary, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of all documents, sorted, with their counts (24 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=LOWER)
        held: list[np.ndarray] = []

        def heavy() -> pa.RecordBatch:
            value, n = summary(np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["token", "n"])

        for batch in batches:
            for _, texts in chunks(batch):
                held.append(Sets(texts, hasher, ngram).tokens)
                if sum(map(len, held)) >= SUMMARISED:
                    yield heavy()
        if held:
            yield heavy()

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = temporary.stored(counted, "jac-counts")
    # the least count that the table has room for, from at most 4096 rows
    levels = counted.groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect()
    room = [r["n"] for r, held in zip(levels, accumulate(r["count"] for r in levels), strict=True) if held <= TABLE]
    top = counted.filter(F.col("n") >= (room[-1] if room else 1 << 62)).toArrow()
    temporary.drop(counted)
    tokens = top["token"].to_numpy().view(np.uint64)
    counts = np.minimum(top["n"].to_numpy(), (1 << 24) - 1).astype(np.uint64)
    by_token = np.argsort(tokens)
    return tokens[by_token], counts[by_token]


def _lists(values: list[np.ndarray], absent: list[bool] | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)), mask=pa.array(absent) if absent else None)


SIGNATURE = [f"s{i}" for i in range(PARITY)]
OTHERS = [f"p{k}" for k in range(1, ORDERS)]


def token_sets(docs: DataFrame, ngram: int, numerator: int, denominator: int, table) -> DataFrame:
    """Per document: doc_id, n (size of its set), cls (digest of its set), s0, s1, ... (parities),
    prefix under the first order, and p1, p2, ... under the others as sorted half hashes. The
    prefixes are null where the task has just shown them for the same set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order, shown = WordHasher(fold=LOWER), Order(table.value), set()
        for batch in batches:
            for part, texts in chunks(batch, 1):
                sets = Sets(texts, hasher, ngram)
                digests, frequencies, absent = sets.digests(), order.frequencies(sets.tokens), []
                for d in digests:
                    absent.append(d is None or d in shown)
                    shown.add(d)
                if len(shown) > REMEMBERED:
                    shown.clear()
                columns = [batch.column(0)[part], pa.array(sets.sizes, pa.int64()), pa.array(digests, pa.binary()), *map(pa.array, sets.parities())]
                for k in range(ORDERS):
                    lists = [p.view(np.int64)[: 0 if gone else None] for p, gone in zip(sets.prefixes(frequencies, k, numerator, denominator), absent, strict=True)]
                    # the other orders only rule pairs out, for which half of a hash does
                    columns.append(_lists([np.unique(p.astype(np.int32)) for p in lists] if k else lists, absent))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", *SIGNATURE, "prefix", *OTHERS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, cls binary" + "".join(f", {s} long" for s in SIGNATURE) + ", prefix array<long>" + "".join(f", {p} array<int>" for p in OTHERS)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repeated_tokens(rows: DataFrame, temporary: Temporary):
    """Two Bloom filters, sent to all workers: of the tokens that are in several prefixes, and of
    those in more than ``FEW``."""
    counted = rows.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    counted = temporary.stored(counted, "jac-repeated")
    context = rows.sparkSession.sparkContext
    sent = [context.broadcast(Bloom.of(counted.filter(F.col("k") > least).select("token"))) for least in (1, FEW)]
    temporary.drop(counted)
    return sent


def pruned(lists: DataFrame, repeated) -> DataFrame:
    """``lists`` with ``tokens``, those of ``prefix`` that may be in several prefixes, and their
    ``places`` there. Rows without such tokens are left out."""
    others = lists.drop("prefix")
    names = ["tokens", "places", *others.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(0)
            starts, lengths = prefix.offsets.to_numpy()[:-1], np.diff(prefix.offsets.to_numpy())
            token, of = prefix.flatten().to_numpy(), np.repeat(np.arange(len(prefix)), lengths)
            place = np.arange(len(token)) - np.repeat(starts - starts[0], lengths) if len(token) else of
            use = repeated.value.holds(token)
            left = np.bincount(of[use], minlength=len(prefix))
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            both = [pa.ListArray.from_arrays(offsets, pa.array(v[use])) for v in (token, place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*both, *batch.columns[1:]], names).filter(pa.array(left > 0))

    schema = ", ".join(["tokens array<long>, places array<int>", *[f"{f.name} {f.dataType.simpleString()}" for f in others.schema.fields]])
    return lists.select("prefix", *others.columns).mapInArrow(run, schema)


def postings(lists: DataFrame, chosen: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """token, place and the other columns for each of the ``chosen`` tokens. Only these travel."""
    others = lists.drop("tokens", "places")
    names = ["token", "place", *others.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, place = (batch.column(i).flatten() for i in (0, 1))
            of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
            use = np.nonzero(chosen(token.to_numpy()))[0]
            at, row = pa.array(use), pa.array(of[use])
            yield pa.RecordBatch.from_arrays([token.take(at), place.take(at), *[c.take(row) for c in batch.columns[2:]]], names)

    schema = ", ".join(["token long, place int", *[f"{f.name} {f.dataType.simpleString()}" for f in others.schema.fields]])
    return lists.select("tokens", "places", *others.columns).mapInArrow(run, schema)


def apart(n: Column, m: Column, numerator: int, denominator: int) -> Column:
    """How many tokens can be in only one of two similar sets of n and m tokens, as they have at
    least t (n + m) / (1 + t) in common."""
    common = F.floor((numerator * (n + m) + (numerator + denominator - 1)) / F.lit(float(numerator + denominator)))
    return n + m - 2 * common


def alike(a: dict[str, Column], b: dict[str, Column], numerator: int, denominator: int) -> Column:
    """Whether two sets can be similar, by their sizes and the bits in which their parities differ."""
    n, m = a["n"], b["n"]
    differing = sum((F.bit_count(a[s].bitwiseXOR(b[s])) for s in SIGNATURE), F.lit(0))
    return (denominator * F.least(n, m) >= numerator * F.greatest(n, m)) & (differing <= apart(n, m, numerator, denominator))


def first_shared(a: dict[str, Column], b: dict[str, Column], numerator: int, denominator: int) -> Column:
    """Whether a token can be the first that two similar sets share: all before it are in one of
    them only, and so are as many behind it as one set has there more than the other."""
    behind = F.abs((a["n"] - a["place"]) - (b["n"] - b["place"]))
    return a["place"] + b["place"] + behind <= apart(a["n"], b["n"], numerator, denominator)


FIELDS = ("cls", "n", "place", *SIGNATURE)


def starred(lists: DataFrame, crowded, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of each crowded token's classes with a hub of its list, the first by class,
    where alike. Hubs are found by partial aggregates, and the join with them can be split."""
    found = postings(lists, lambda tokens: crowded.value.holds(tokens))
    hubs = found.groupBy("token").agg(F.min(F.struct(*FIELDS)).alias("hub"), F.count("*").alias("k")).filter("k > 1").select("token", "hub")
    own, hub = ({f: F.col(f"{prefix}{f}") for f in FIELDS} for prefix in ("", "hub."))
    # where parities can't tell large sets apart, a pair waits for what may be its first token
    telling = (apart(own["n"], hub["n"], numerator, denominator) < 32 * PARITY) | first_shared(own, hub, numerator, denominator)
    met = found.join(hubs, "token").filter((own["cls"] != hub["cls"]) & alike(own, hub, numerator, denominator) & telling)
    return met.select(F.col("cls").alias("a"), hub["cls"].alias("b"))


def crossing(lists: DataFrame, crowded, roots: DataFrame, temporary: Temporary, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of different components, alike and met at what may be their first shared
    token. Crowded tokens of a single component have none, and don't travel."""
    once = lists.dropDuplicates(["cls"]).join(roots, F.col("cls") == F.col("node"), "left")
    once = temporary.stored(once.select(*lists.columns, F.coalesce("root", "cls").alias("root")), "jac-once")
    ends = postings(once.select("tokens", "places", "root"), lambda tokens: crowded.value.holds(tokens))
    mixed = ends.groupBy("token").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x != _y").select("token")
    mixed = temporary.stored(mixed, "jac-mixed")
    open_ = lists.sparkSession.sparkContext.broadcast(Bloom.of(mixed))
    # what passes the filter of crowded tokens by chance was among ``ends`` as well
    named = postings(once, lambda tokens: ~crowded.value.holds(tokens) | open_.value.holds(tokens))
    named = temporary.stored(named, "jac-named")
    temporary.drop(once, mixed)
    a, b = ({f: F.col(f"{f}_{side}") for f in FIELDS} for side in "lr")
    likely = alike(a, b, numerator, denominator) & first_shared(a, b, numerator, denominator)

    def met(share: DataFrame) -> DataFrame:
        left, right = (share.select("token", *[F.col(f).alias(f"{f}_{side}") for f in (*FIELDS, "root")]) for side in "lr")
        pairs = left.join(right, (left["token"] == right["token"]) & (F.col("root_l") < F.col("root_r")) & likely)
        return pairs.select(F.col("cls_l").alias("a"), F.col("cls_r").alias("b")).distinct()

    rounds = [temporary.stored(met(named.filter(F.pmod("token", F.lit(ROUNDS)) == k)), "jac-met") for k in range(ROUNDS)]
    temporary.drop(named)
    return functools.reduce(DataFrame.unionByName, rounds)


def whole_sets(docs: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """cls and tokens (its whole set, 8 bytes a token) for ``wanted`` (cls and rep, one of its
    doc_ids).

    Only texts that a Bloom filter of the representatives lets through are looked at again.
    """
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted.select(F.xxhash64("rep"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold=LOWER)
        for batch in batches:
            for _, texts in chunks(batch.filter(pa.array(bloom.value.holds(batch.column(1).to_numpy())))):
                sets = Sets(texts, hasher, ngram)
                columns = [pa.array(sets.digests(), pa.binary()), pa.array([s.tobytes() for s in sets.of(sets.tokens)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "tokens"])

    again = docs.select("text", F.xxhash64("doc_id").alias("at")).mapInArrow(run, "cls binary, tokens binary")
    return again.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def filtered(pairs: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) that share enough prefix tokens under the other orders.

    The i-th common token of an order has at most n - o others before it in its set, so it lies
    in a prefix of l tokens if i <= l - (n - o): both prefixes share all up to the smaller of
    these numbers. Half hashes that agree within a prefix are subtracted.
    """
    common = f"(({numerator} * (_na + _nb) + {numerator + denominator - 1}) div {numerator + denominator})"
    length = "({n} - ({numerator} * {n} + {denominator} - 1) div {denominator} + 1)"
    la, lb = (length.format(n=n, numerator=numerator, denominator=denominator) for n in ("_na", "_nb"))
    orders = range(1, ORDERS)
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("n").alias(f"_n{side}"), *[F.col(f"p{k}").alias(f"_p{side}{k}") for k in orders]), side)
    enough = F.lit(True)
    for k in orders:
        least = F.expr(f"least({la} - _na, {lb} - _nb) + {common} - ({la} - size(_pa{k}))")
        enough = enough & (F.size(F.array_intersect(f"_pa{k}", f"_pb{k}")) >= F.greatest(least, F.lit(1)))
    return pairs.filter(enough).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(denominator * shared >= numerator * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("_x"))
    second = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("_y"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "_x", "_y")
    return joined.mapInArrow(run, "a binary, b binary")


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).distinct().unionByName(pairs.select(F.col("b").alias("cls")).distinct()).distinct()


def linked_classes(docs: DataFrame, temporary: Temporary, ngram: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n and cls of each document; node and root of each class that is linked).

    A doc_id of any type that can be compared and hashed does.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequency_table(docs, temporary, ngram))
    rows = temporary.stored(token_sets(docs, ngram, numerator, denominator, table), "jac-docs")
    reps = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    lists = rows.filter("prefix is not null").select("prefix", "cls", "n", *SIGNATURE)
    repeated, crowded = repeated_tokens(rows, temporary)
    lists = temporary.stored(pruned(lists, repeated), "jac-lists")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        pairs = temporary.stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-candidates")
        classes = rows.filter("prefix is not null").select("cls", "n", *OTHERS).join(_members(pairs), "cls", "left_semi").dropDuplicates(["cls"])
        classes = temporary.stored(classes, f"{name}-classes")
        near = temporary.stored(filtered(pairs, classes, numerator, denominator), f"{name}-near")
        temporary.drop(pairs, classes)
        members = temporary.stored(_members(near).join(reps, "cls"), f"{name}-members")
        sets = temporary.stored(whole_sets(docs, members, ngram), f"{name}-sets")
        links = temporary.stored(verified(near, sets, numerator, denominator), name)
        temporary.drop(near, members, sets)
        return links

    links = check(starred(lists, crowded, numerator, denominator), "jac-starred")
    # what is left: candidates from different components
    roots = components(links, temporary.stored)
    more = check(crossing(lists, crowded, roots, temporary, numerator, denominator), "jac-crossing")
    if not more.isEmpty():
        stars = roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(stars.unionByName(more), temporary.stored)
    return rows.select("doc_id", "n", "cls"), roots


def similar_groups(docs: DataFrame, ngram: int = NGRAM, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Temporary(docs.sparkSession, tidy=True) as temporary:
        rows, roots = linked_classes(docs, temporary, ngram, numerator, denominator)
        by_class = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("_first"))
        by_class = by_class.join(roots, by_class["cls"] == roots["node"], "left").select("cls", "_first", F.coalesce("root", "cls").alias("_root"))
        by_class = temporary.stored(by_class, "jac-first")
        least = by_class.groupBy("_root").agg(F.min("_first").alias("_least"))
        named = by_class.join(least, "_root").select(F.col("cls").alias("_cls"), "_least")
        joined = rows.join(named, F.col("cls") == F.col("_cls"), "left")
        component = F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id"))
        return stored(joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "jac-groups")


def text_digest(text: Column) -> Column:
    """128 bits of SHA-256; null as the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def one_of_each_group(docs: DataFrame, ngram: int = NGRAM, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row of ``docs`` for each group, and all rows without words, repeated ones too.

    A row belongs to a group by its text, whatever its doc_id: other rows may share that, and it
    may be null. The row with the smallest doc_id stays, one with null only if the group has no
    other; among rows with that doc_id, the one with the smallest hash. Texts stand by 128 bits of
    SHA-256; the hash of a row only picks among rows of one text. Columns of any type do, maps too.
    """
    by_text, by_row = fresh(docs, "text_key", "row_key")
    # maps can't be hashed as they are
    text, row = text_digest(F.col("text")), F.xxhash64(*[F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])
    keys = docs.select(text.alias("text_key"), row.alias("row_key"), F.col("doc_id").cast("long").alias("id"))
    with Temporary(docs.sparkSession, tidy=True) as temporary:
        rows, roots = linked_classes(docs.select(text.alias("doc_id"), "text"), temporary, ngram, numerator, denominator)
        groups = rows.filter("n > 0").select(F.col("doc_id").alias("text_key"), "cls").distinct()
        groups = groups.join(roots, groups["cls"] == roots["node"], "left").select("text_key", F.coalesce("root", "cls").alias("group"))
        wordless = stored(rows.filter("n = 0").select(F.col("doc_id").alias(by_text)).distinct(), "jac-wordless")
        of_text = keys.groupBy("text_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("least"))
        first = of_text.join(groups, "text_key").groupBy("group").agg(F.min(F.struct("least", "text_key")).alias("m"))
        kept = stored(first.select(F.col("m.text_key").alias(by_text), F.col("m.least.row_key").alias(by_row)), "jac-kept")
    keyed = docs.withColumns({by_text: text, by_row: row})
    one = keyed.join(kept, [by_text, by_row], "left_semi").dropDuplicates([by_text, by_row])
    return one.unionByName(keyed.join(wordless, by_text, "left_semi")).select(*docs.columns)
