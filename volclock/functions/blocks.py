"""Work on long series in blocks of consecutive rows, so that one symbol is many tasks.

Rows are numbered without sorting a symbol as a whole: they are counted in buckets of time, the
counts are added up over buckets, and rows are numbered inside of each bucket. A block is so many
consecutive numbers. What a row needs of the rows before its block comes in one of two ways:

- windows: a block holds copies of the last rows before it, and of the first ones after it where a
  window looks ahead. This halo is dropped in the end (``in_blocks``);
- running values: one summary of each block is scanned in the order of blocks, and what stands
  before a block is joined to its rows (``carried``).
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and seconds of a bucket: some ten thousand bars of a few minutes.
ROWS, BUCKET = 20_000, 90 * 86_400

Scan = tuple[Column, Callable[[Column], Column]]


def joined(df: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the columns of ``side``, which has one row for each of its keys; nulls are equal."""
    other = side.select(*[F.col(k).alias(f"_{k}_") for k in keys], *[c for c in side.columns if c not in keys])
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys])
    return df.join(other, on).drop(*[f"_{k}_" for k in keys])


def carried(df: DataFrame, block: str, **scans: Scan) -> DataFrame:
    """``df`` with what the blocks before a row's own come to: for each name an aggregate of a block
    and the function that unites it over blocks (null before the first). Only one row for each
    block of a symbol is sorted."""
    order = Window.partitionBy("symbol").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    each = df.groupBy("symbol", block).agg(*[value.alias(name) for name, (value, _) in scans.items()])
    return joined(df, each.select("symbol", block, *[unite(F.col(name)).over(order).alias(name) for name, (_, unite) in scans.items()]), "symbol", block)


def bucket_of(seconds: int | None = None) -> Column:
    """The bucket of a row's time; a null time has one of its own, before all others."""
    return F.floor(F.unix_micros(F.col("time").cast("timestamp")) / F.lit((seconds or BUCKET) * 1_000_000))


def positioned(df: DataFrame, seconds: int | None = None) -> DataFrame:
    """``df`` with ``_pos``, the number of each row of a symbol in time order, from 0. Rows of one
    time have any order among themselves."""
    if "_pos" in df.columns:
        return df
    df = carried(df.withColumn("_bucket", bucket_of(seconds)), "_bucket", _before=(F.count("*"), F.sum))
    inside = F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy("time"))
    return df.withColumn("_pos", F.coalesce("_before", F.lit(0)) + inside - 1).drop("_bucket", "_before")


def numbered(f):
    """For a function that adds columns: rows are numbered once, for all it calls."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        kept = "_pos" in df.columns
        out = f(positioned(df), *args, **named)
        return out if kept else out.drop("_pos")

    return run


def with_halo(df: DataFrame, halo: int, rows: int | None = None, ahead: int = 0) -> DataFrame:
    """``df`` with ``_pos``, ``_block`` and ``_halo``: every row in its own block, and again as halo
    (true) in each block that begins at most ``halo`` rows later or ends at most ``ahead`` rows
    before it."""
    rows = rows or ROWS
    df = positioned(df)
    own, last = F.floor(F.col("_pos") / rows), F.floor((F.col("_pos") + halo) / rows)
    first = F.greatest(F.floor((F.col("_pos") - ahead) / rows), F.lit(0).cast("long"))
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_halo", F.col("_block") != own)


def in_blocks(df: DataFrame, compute: Callable[[DataFrame], DataFrame], halo: int, rows: int | None = None, ahead: int = 0) -> DataFrame:
    """``compute(df)``, block by block. ``compute`` adds columns that depend on a row, the ``halo``
    rows before and the ``ahead`` rows after it, by windows over ``symbol`` and ``time``, and keeps
    all others.

    While it runs, ``symbol`` names the block as well, so that its windows stay within.
    """
    kept = "_pos" in df.columns
    cut = with_halo(df, halo, rows, ahead).withColumn("symbol", F.struct("symbol", "_block"))
    out = compute(cut).filter(~F.col("_halo")).withColumn("symbol", F.col("symbol.symbol"))
    return out.drop("_block", "_halo", *([] if kept else ["_pos"]))


def blocked(halo: Callable[..., int]):
    """For a function that adds columns by trailing windows: runs it in blocks, unless it is called
    from another one. ``halo`` gets the function's arguments, apart from the DataFrame."""

    def wrap(f):
        @functools.wraps(f)
        def run(df: DataFrame, *args, **named) -> DataFrame:
            if "_halo" in df.columns:
                return f(df, *args, **named)
            bound = inspect.signature(f).bind(df, *args, **named)
            bound.apply_defaults()
            return in_blocks(df, lambda cut: f(cut, *args, **named), halo(**{k: v for k, v in list(bound.arguments.items())[1:]}))

        return run

    return wrap
