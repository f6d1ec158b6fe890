"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volclock.llm.scratch import Temporary, stored


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Per node that has an edge: node and root, the smallest node of its component.

    ``edges`` has two columns of one orderable type; null ends and loops are left out. Large
    and small stars alternate: every node links its larger neighbours (then its smaller ones)
    to the smallest node it sees, until nothing changes. Edges stay a table throughout; the
    number of rounds grows with the logarithm of the longest chain.
    """
    a, b = edges.columns
    with Temporary(edges.sparkSession) as temporary:
        now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
        now = temporary.stored(now, "links")
        state = None
        while True:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.filter("u != v").distinct()
            lower = large.groupBy("u").agg(F.min("v").alias("m"))
            joined = large.join(lower, "u")
            small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
            before, now = now, temporary.stored(small.filter("u != v").distinct(), "links")
            temporary.drop(before)
            found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(found) == state:
                break
            state = tuple(found)
        roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        return keep(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
