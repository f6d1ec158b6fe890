"""Approximate nearest neighbours by inner product: stable projections in a kd-tree.

Vectors get one more coordinate that brings all to the longest one's length; then the largest
inner product is the smallest distance. ``PROJECTED`` Gaussian (2-stable) projections map a
vector to a few dimensions, in which the squared distance divided by the original one is
chi-square distributed. So once the k-th best vector lies at distance d, a vector that beats it
is missed with probability at most 1 - ``SURE`` if the search goes on in the projected space up
to d squared times the chi-square quantile: the stopping test.

The kd-tree's upper part is fitted on a bounded sample (``SAMPLE``) and routes every vector to a
cell; cells have at most some ``CELL`` vectors and are searched by one task each, leaf by leaf
in the order of projected distance, until the test holds. A query first visits its own cell,
and then, with the distance found there, all cells that the test doesn't rule out.

Equal vectors are one entry that holds their k + 1 smallest ids, which is all that any
answer can show of them.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with null vec_id; vectors of different lengths have no inner product, so each
length is searched on its own, one after the other; repeated rows count once; ties go to smaller
ids; a query without other vectors has no rows; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm.scratch import stored

NEIGHBOURS = 20
PROJECTED = 8
SURE = 0.97
SEED = 11
SAMPLE = 20_000
CELL = 2048
LEAF = 64
#: A cell that more queries than this visit is copied, so that several tasks answer them.
QUERIES = 50_000
SALTS = 16


def chi_square_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom, by bisection."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, digest and v (64-bit floats) of the vectors that take part, each once."""
    lean = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    lean = lean.filter(F.col("vec_id").isNotNull() & (F.size("e") > 0)).filter(finite & F.exists("e", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [(np.array(e.as_py(), "<f8") + 0.0).tobytes() for e in batch.column(1)]
            digests = [hashlib.blake2b(v, digest_size=16).digest() for v in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "digest", "v"])

    return stored(lean.mapInArrow(run, "vec_id long, digest binary, v binary"), "ann-rows")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """digest, v, ids: the k + 1 smallest ids of each different vector."""
    salted = Window.partitionBy("digest", F.pmod("vec_id", F.lit(SALTS))).orderBy("vec_id")
    whole = Window.partitionBy("digest").orderBy("vec_id")
    # repeated rows share a rank
    once = rows.withColumn("_r", F.dense_rank().over(salted)).filter(F.col("_r") <= k + 1).dropDuplicates(["digest", "vec_id"])
    least = once.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= k + 1)
    return least.groupBy("digest").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Projection:
    """Augmented vectors to a few dimensions, and there to the cells of a complete kd-tree."""

    def __init__(self, sample: np.ndarray, longest: float, depth: int, projected: int, seed: int):
        self.longest = longest
        self.matrix = np.random.default_rng(seed).standard_normal((sample.shape[1] + 1, projected))
        self.depth = depth
        self.axis = np.zeros(1 << depth, np.int64)
        self.at = np.zeros(1 << depth)
        self._split(self.points(sample), 1)

    def _split(self, p: np.ndarray, node: int) -> None:
        if node >= 1 << self.depth:
            return
        if len(p):
            self.axis[node] = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            self.at[node] = float(np.median(p[:, self.axis[node]]))
        left = p[:, self.axis[node]] < self.at[node]
        self._split(p[left], 2 * node)
        self._split(p[~left], 2 * node + 1)

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)


def matrix_of(column: pa.Array) -> np.ndarray:
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1) if packed else np.zeros((0, 1))


class Cell:
    """The vectors of one cell in the order of a local kd-tree, with a box around each leaf."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], projection: Projection):
        p = projection.points(x)
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(p))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            axis = int(np.argmax(p[own].max(axis=0) - p[own].min(axis=0)))
            half = np.argsort(p[own, axis], kind="stable")
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.ids = [[ids[i] for i in own] for own in leaves]
        self.sizes = [np.array([len(e) for e in held]) for held in self.ids]
        self.x = [x[own] for own in leaves]
        self.low = np.stack([p[own].min(axis=0) for own in leaves])
        self.high = np.stack([p[own].max(axis=0) for own in leaves])

    def search(self, q: np.ndarray, point: np.ndarray, bound: float, k: int, longest: float, reach: float) -> tuple[list[tuple[float, int]], float]:
        """The (k + 1) best (-score, id) not under ``bound``, and the bound that they give."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        distance = np.einsum("ij,ij->i", gap, gap)
        base = float(q @ q) + longest
        best: list[tuple[float, int]] = []
        for leaf in np.argsort(distance, kind="stable").tolist():
            if distance[leaf] > reach * max(base - 2 * bound, 0.0):
                break  # the stopping test
            score = (self.x[leaf] * q).sum(axis=1)
            found = np.nonzero(score >= bound)[0]
            if len(found):
                best += [(-float(score[i]), e) for i in found.tolist() for e in self.ids[leaf][i]]
                best.sort()
                del best[k + 1 :]
                if len(best) == k + 1:
                    bound = max(bound, -best[-1][0])
        return best, bound


def lookup(values: dict[int, int]) -> Column:
    """The value of the row's cell, 1 if it has none."""
    if not values:
        return F.lit(1).cast("long")
    pairs = F.create_map(*[F.lit(x).cast("long") for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.col("cell")), F.lit(1).cast("long"))


def _searched(cells: DataFrame, visits: DataFrame, projection, k: int, reach: float) -> DataFrame:
    """query, bound and the best ids and scores for each visit (query, v, bound, cell, part)."""
    # at most a row for each cell
    crowded = visits.groupBy("cell", "part").count().filter(F.col("count") > QUERIES).groupBy("cell").agg(F.max("count").alias("n")).collect()
    copies = lookup({r["cell"]: -(-r["n"] // QUERIES) for r in crowded})
    cells = cells.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    visits = visits.withColumn("copy", F.pmod(F.xxhash64(F.lit(1), F.col("query")), copies))
    index = cells.select("cell", "part", "copy", F.lit(0).alias("kind"), F.col("digest").alias("query"), "v", F.lit(None).cast("double").alias("bound"), "ids")
    asked = visits.select("cell", "part", "copy", F.lit(1).alias("kind"), "query", "v", "bound", F.lit(None).cast("array<long>").alias("ids"))
    place = ["cell", "part", "copy"]
    together = index.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proj = projection.value
        now, held_v, held_ids, cell = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for c, p, copy, kind, query, v, bound, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, p, copy) != now:
                    now, held_v, held_ids, cell = (c, p, copy), [], [], None
                if kind == 0:
                    held_v.append(v)
                    held_ids.append(ids)
                    continue
                if cell is None and held_v:
                    cell = Cell(np.frombuffer(b"".join(held_v), "<f8").reshape(len(held_v), -1), held_ids, proj)
                    held_v, held_ids = [], []
                if cell is None:
                    continue
                q = np.frombuffer(v, "<f8")
                best, reached = cell.search(q, proj.queries(q[None])[0], -math.inf if bound is None else bound, k, proj.longest, reach)
                out.append((query, reached if reached > -math.inf else None, [e for _, e in best], [-s for s, _ in best]))
            if out:
                types = (pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["query", "bound", "ids", "scores"])

    return together.mapInArrow(run, "query binary, bound double, ids array<long>, scores array<double>")


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, sure: float = SURE, projected: int = PROJECTED, cell: int = CELL, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query.

    ``is_query`` is a condition on vec_id that tells which vectors are queries.
    """
    every = usable(vectors)
    found = every.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in every.select(F.length("v").alias("n")).distinct().orderBy("n").collect():  # a row for each length
        found = found.unionByName(_nearest_of_length(every.filter(F.length("v") == r["n"]), is_query, k, sure, projected, cell, sample, seed))
    return found


def _nearest_of_length(rows: DataFrame, is_query, k: int, sure: float, projected: int, cell: int, sample: int, seed: int) -> DataFrame:
    """``nearest`` for ``rows`` (vec_id, digest, v) of one length."""
    held = stored(entries(rows, k), "ann-entries")
    asking = stored(rows.filter(is_query).select("digest", F.col("vec_id").alias("query_id")).distinct(), "ann-queries")
    n = held.count()

    # at most about ``sample`` vectors
    part = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fit = matrix_of(held.filter(part * n < sample).select("v").toArrow().column("v").combine_chunks())

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.einsum("ij,ij->i", x, x).max(initial=0.0))])], ["longest"])

    longest = held.select("v").mapInArrow(lengths, "longest double").agg(F.max("longest")).first()[0]
    dims = len(held.select("v").first()[0]) // 8
    depth = max(0, min(math.ceil(math.log2(max(1, n / cell))), int(math.log2(max(1, len(fit) / 8)))))
    projection = Projection(fit.reshape(-1, dims), longest, depth, projected, seed)
    sent = rows.sparkSession.sparkContext.broadcast(projection)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proj = sent.value
        for batch in batches:
            x = matrix_of(batch.column(1))
            p = proj.points(x)
            columns = [*batch.columns, pa.array(proj.cells(p)), pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "v", "ids", "cell", "p"])

    routed = stored(held.select("digest", "v", "ids").mapInArrow(route, "digest binary, v binary, ids array<long>, cell long, p array<double>"), "ann-routed")
    boxes = routed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.get("p", i)).alias(f"{tag}{i}") for tag, f in (("lo", F.min), ("hi", F.max)) for i in range(projected)])
    # at most a row for each cell, of which there are fewer than vectors in the sample
    boxes = sorted(boxes.collect(), key=lambda r: r["cell"])
    number = np.array([r["cell"] for r in boxes])
    low = np.array([[r[f"lo{i}"] for i in range(projected)] for r in boxes])
    high = np.array([[r[f"hi{i}"] for i in range(projected)] for r in boxes])
    # a cell that the sample didn't foresee to be so full is split
    parts = {r["cell"]: -(-r["n"] // (2 * cell)) for r in boxes if r["n"] > 2 * cell}
    queries = asking.select("digest").distinct()
    parts_of = lookup(parts)
    cells = routed.withColumn("part", F.pmod(F.xxhash64("digest"), parts_of))
    reach = chi_square_quantile(sure, projected)
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), parts_of - 1)).alias("part")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proj = sent.value
        for batch in batches:
            p = proj.queries(matrix_of(batch.column(1)))
            nearest_cell = number[np.argmin(_box_distance(p, low, high), axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_cell)], ["query", "v", "cell"])

    asked = stored(held.join(queries, "digest", "left_semi").select(F.col("digest").alias("query"), "v").mapInArrow(home, "query binary, v binary, cell long"), "ann-asked")
    first = asked.select("query", "v", F.lit(None).cast("double").alias("bound"), "cell", every_part)
    first = stored(_searched(cells, first, sent, k, reach), "ann-first")

    bounds = first.groupBy("query").agg(F.max("bound").alias("bound"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proj = sent.value
        for batch in batches:
            q = matrix_of(batch.column(1))
            bound = batch.column(3).to_pandas().fillna(-np.inf).to_numpy()
            limit = reach * np.maximum(np.einsum("ij,ij->i", q, q) + proj.longest - 2 * bound, 0)
            near = _box_distance(proj.queries(q), low, high) <= limit[:, None]
            near &= number[None] != batch.column(2).to_numpy()[:, None]
            row, to = np.nonzero(near)
            columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(3).take(pa.array(row)), pa.array(number[to])]
            yield pa.RecordBatch.from_arrays(columns, ["query", "v", "bound", "cell"])

    rest = asked.join(bounds, "query").select("query", "v", "cell", "bound").mapInArrow(others, "query binary, v binary, bound double, cell long")
    rest = rest.select("query", "v", "bound", "cell", every_part)
    second = stored(_searched(cells, rest, sent, k, reach), "ann-second")

    found = first.unionByName(second).select("query", F.explode(F.arrays_zip("ids", "scores")).alias("_f"))
    found = found.select("query", F.col("_f.ids").alias("vec_id"), F.col("_f.scores").alias("score"))
    by_vector = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_r", F.row_number().over(by_vector)).filter(F.col("_r") <= k + 1).drop("_r")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = asking.join(found, F.col("digest") == F.col("query")).filter("vec_id != query_id")
    return answers.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _box_distance(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.empty((len(p), len(low)))
    for i in range(len(p)):
        gap = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
        out[i] = np.einsum("ij,ij->i", gap, gap)
    return out
