"""Exponential means as an associative scan.

The mean moves by y = q y + alpha x with q = 1 - alpha, an affine map for each value. The maps of
a block compose to y = q^n y + b, where b is a sum over the block that windows can take; these
small maps are applied one after the other in the order of blocks, which gives every block the
mean before it; then each row applies its block's map up to itself. A mean that begins with the
first value x is the one that stood at x before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.functions import blocks

#: Rows of a block at most. Powers of 1 / q grow with it: they stay below 10^LARGEST.
ROWS, LARGEST = 2000, 200

#: (new column, column, alpha, least number of values).
Mean = tuple[str, str, float, int]


def span(n: int) -> float:
    return 2 / (n + 1)


def _before(names: list[str], alphas: list[float]):
    """Of sorted blocks (symbol, _block, then n, b and first of each mean): symbol, _block, then the
    mean and the number of values before the block. The only sequential step: one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state = object(), []
        for batch in batches:
            columns = batch.to_pydict()
            out: list[list] = [[] for _ in range(2 * len(alphas))]
            for row, now in enumerate(columns["symbol"]):
                if now != symbol:
                    symbol, state = now, [(None, 0)] * len(alphas)
                for k, alpha in enumerate(alphas):
                    y, count = state[k]
                    n, b, first = (columns[f"_{f}{k}"][row] for f in ("n", "b", "first"))
                    y = first if y is None else y
                    out[2 * k].append(y)
                    out[2 * k + 1].append(count)
                    state[k] = (None if y is None else (1 - alpha) ** n * y + b, count + n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64() if i % 2 else pa.float64()) for i, c in enumerate(out)]], names)

    return run


def block_rows(alphas: Sequence[float], rows: int | None = None) -> int:
    """Rows of a block, few enough that powers stay finite."""
    return min(rows or ROWS, *[max(1, int(LARGEST / -math.log10(1 - a))) for a in alphas])


def with_means(df: DataFrame, means: Sequence[Mean]) -> DataFrame:
    """Exponential means y = (1 - alpha) y + alpha x from the first value on, null until there are
    as many values as asked for; a null leaves the mean as it is. 0 < alpha < 1.

    ``df`` comes from ``blocks.with_halo`` with at most ``block_rows`` rows for each block; the
    halo, which is left out, only serves windows that the columns are made of.
    """
    decay, upto = [1 - m[2] for m in means], Window.partitionBy("symbol", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    own = [c for c in df.columns if c != "_halo"]
    value = [F.when(~F.col("_halo"), F.col(m[1]).cast("double")) for m in means]
    df = df.withColumns({f"_x{k}": x for k, x in enumerate(value)} | {f"_n{k}": F.count(x).over(upto) for k, x in enumerate(value)})
    n, x = ([F.col(f"_{f}{k}") for k in range(len(means))] for f in "nx")
    sums = {f"_b{k}": F.coalesce(F.sum((1 - q) * x[k] * F.pow(F.lit(q), -n[k])).over(upto), F.lit(0.0)) * F.pow(F.lit(q), n[k]) for k, q in enumerate(decay)}
    df = df.withColumns(sums).filter("not _halo")
    maps = []
    for k in range(len(means)):
        first = F.min_by(x[k], F.when(x[k].isNotNull(), F.col("_pos")))
        maps += [F.max(n[k]).alias(f"_n{k}"), F.max_by(f"_b{k}", "_pos").alias(f"_b{k}"), first.alias(f"_first{k}")]
    each = df.groupBy("symbol", "_block").agg(*maps)
    names = ["symbol", "_block", *[f"_{f}{k}" for k in range(len(means)) for f in ("y", "c")]]
    kind = df.schema["symbol"].dataType.simpleString()
    schema = ", ".join([f"symbol {kind}", "_block long", *[f"_y{k} double, _c{k} long" for k in range(len(means))]])
    before = each.repartition("symbol").sortWithinPartitions("symbol", "_block").mapInArrow(_before(names, [m[2] for m in means]), schema)
    df = blocks.joined(df, before, "symbol", "_block")
    out = []
    for k, (q, (name, _, _, least)) in enumerate(zip(decay, means, strict=True)):
        seen = F.col(f"_c{k}") + n[k]
        mean = F.when(seen == 1, F.coalesce(x[k], f"_y{k}")).otherwise(F.pow(F.lit(q), n[k]) * F.col(f"_y{k}") + F.col(f"_b{k}"))
        out.append(F.when(seen >= max(1, least), mean).alias(name))
    return df.select(*own, *out)
