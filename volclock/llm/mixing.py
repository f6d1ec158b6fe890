"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow whose packets are its documents in a seeded random order, again and
again for as many epochs as its target allows. A packet's virtual finish time is the number
of the source's tokens sent so far, itself included, divided by the source's target. The
packets of all sources are range-sorted by that time and sent until the token budget is
used up. Since the order within a source is fixed by a key of the document and, among repeated
rows, by their number, the outcome for a source is one number of full epochs and the place, a key
and a number, at which the last epoch stops.

Nothing gathers a source in one task: repeated rows are counted before they are shuffled, sums run
over (source, key bucket) and over ticks of virtual time first, and only different documents of one
bucket, or packets of one tick, are ever sorted together.

Defined results: null text has size 0; documents of size 0 are taken 0 times; a null source
is a source of its own, after the others; repeated rows (one source, doc_id and text) share their key
and are packets of their own, so that the last epoch may take some of them and not the others: how
many is fixed, which of them is not (they differ in other columns at most); texts of any
length count whole; an empty table gives an empty result. Columns of the caller keep their values
in ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm.scratch import Temporary, stored
from volclock.llm.text import small, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20
#: Key buckets of each source, and ticks of one unit of virtual time. More of them make
#: smaller sorts; the outcome doesn't depend on them.
BUCKETS = 1024
TICKS = 4096
#: Copies of a row that one row stands for until they are spread, and parts in which rows of one key are numbered.
COPIES, SALTS = 10_000, 256


def document_key(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of an MD5 of the document, which other engines can compute as well."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source with its size and its target.

    Targets share the sum of all sizes by weight; no target exceeds ``max_epochs`` times its
    source, and what is cut goes to the others by weight. This is a water level: sources
    sorted by (limit / weight) fill up one by one, which raises the level of the rest for as
    long as the next one's limit lies below it; the highest level is the one sought.
    The windows run over one row for each source, not over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    filling = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    limit = F.col("source_size").cast("double") * max_epochs
    before = F.coalesce(F.sum("_limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("_total") - before) / F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    return (
        by_source.withColumn("_weight", weight)
        .withColumn("_limit", limit)
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .select("source", "source_size", F.least("_limit", F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_weight")).alias("target"))
    )


def fair_queue(
    sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS, ticks: int = TICKS
) -> DataFrame:
    """Per source: source, source_size, target, full_epochs, last_bucket, last_key, last_size,
    last_number, last_copies.

    ``sizes`` has source, size and key. A document is taken ``full_epochs`` times, and once more if
    its (bucket, key, size) lies before the last one, or is the last one and its number among such
    rows, from 1 to ``last_copies``, is at most ``last_number``.
    """
    with Temporary(sizes.sparkSession) as temporary:
        return stored(_queue(sizes, temporary, weights, max_epochs, buckets, ticks), "mix-queue")


def _queue(sizes: DataFrame, temporary: Temporary, weights, max_epochs: int, buckets: int, ticks: int) -> DataFrame:
    targets = temporary.stored(source_targets(sizes, weights, max_epochs), "mix-targets")
    queued = sizes.filter("size > 0").groupBy("source", "size", "key").agg(F.count("*").alias("copies"))
    queued = queued.withColumn("bucket", F.pmod("key", F.lit(buckets))).withColumn("_all", F.col("size") * F.col("copies"))

    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        queued.groupBy("source", "bucket")
        .agg(F.sum("_all").alias("_sum"))
        .select("source", "bucket", F.coalesce(F.sum("_sum").over(in_source), F.lit(0)).alias("_start"))
    )
    t = targets.filter("target > 0").select(F.col("source").alias("_source"), "source_size", "target")
    s = starts.join(t, F.col("source").eqNullSafe(F.col("_source")))
    s = s.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "_start", "source_size", "target")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    sent = (
        queued.withColumn("_sent", F.sum("_all").over(in_bucket) - F.col("_all"))
        .join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .withColumn("_sent", F.col("_sent") + F.col("_start"))
    )

    # ordered by (bucket, key, size, number) within a source; one packet for each copy and epoch
    epochs = F.least(F.lit(max_epochs), F.ceil(F.col("target") / F.col("source_size"))).cast("int")
    packets = (
        sent.withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs)))
        .withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPIES).cast("long"))))
        .repartition("source", "key", "epoch", "_from")
        .withColumn("number", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES - 1, F.col("copies")))))
        .withColumn("_sent", F.col("_sent") + F.col("number") * F.col("size"))
        .withColumn("finish", ((F.col("epoch") - 1) * F.col("source_size") + F.col("_sent")) / F.col("target"))
        .withColumn("tick", F.floor(F.col("finish") * ticks))
        .select("source", "epoch", "bucket", "key", "size", "number", "copies", "finish", "tick")
    )
    packets = temporary.stored(packets, "mix-packets")

    by_tick = packets.groupBy("tick").agg(F.sum("size").alias("_sum"))
    before_tick = Window.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    opened = by_tick.select(F.col("tick").alias("_tick"), F.coalesce(F.sum("_sum").over(before_tick), F.lit(0)).alias("_before"))
    budget = targets.agg(F.round(F.sum("target")).cast("long").alias("_budget"))
    opened = opened.join(F.broadcast(budget), F.col("_before") < F.col("_budget"))
    in_tick = (
        Window.partitionBy("tick")
        .orderBy("finish", F.col("source").asc_nulls_last(), "bucket", "key", "size", "number", "epoch")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # at most max_epochs * ticks + 1 rows
    taken = (
        packets.repartitionByRange("tick")
        .withColumn("_running", F.sum("size").over(in_tick))
        .join(F.broadcast(opened), F.col("tick") == F.col("_tick"))
        .filter(F.col("_running") + F.col("_before") <= F.col("_budget"))
    )
    last = taken.groupBy("source").agg(F.max(F.struct("epoch", "bucket", "key", "size", "number", "copies")).alias("_last"))
    last = last.select(F.col("source").alias("_source"), "_last")
    return targets.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source",
        "source_size",
        "target",
        F.coalesce(F.col("_last.epoch") - 1, F.lit(0)).alias("full_epochs"),
        *[F.col(f"_last.{c}").alias(f"last_{c}") for c in ("bucket", "key", "size", "number", "copies")],
    )


def with_size(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text"), seed).alias("key")
    )


def with_times(rows: DataFrame, queue: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (with own, size, key) and ``times``, how often each is taken; ``queue`` comes from ``fair_queue``.

    Only rows at the place where a source's last epoch stops between copies need numbers. They are
    stored with a salt, numbered within each (source, salt), and the salts' counts added up.
    """
    joined = rows.join(small(queue), F.col("own").eqNullSafe(F.col("source")), "left")
    place = F.struct(F.pmod("key", F.lit(buckets)).alias("b"), F.col("key").alias("k"), F.col("size").alias("s"))
    last = F.struct(F.col("last_bucket").alias("b"), F.col("last_key").alias("k"), F.col("last_size").alias("s"))
    partly = F.coalesce((place == last) & (F.col("last_number") < F.col("last_copies")), F.lit(False))

    def times(more: Column) -> Column:
        return F.when(F.col("size") > 0, F.col("full_epochs") + F.when(F.col("last_key").isNotNull() & more, 1).otherwise(0)).otherwise(0).cast("long").alias("times")

    names = [*rows.columns, "source_size", "target"]
    if queue.filter("last_number < last_copies").isEmpty():
        return joined.select(*names, times(place <= last))
    edge = joined.filter(partly).select(*names, "full_epochs", "last_key", "last_number", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    edge = stored(edge, "mix-edge")
    counts = edge.groupBy("own", "salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("own").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("own").alias("_own"), F.col("salt").alias("_salt"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("own", "salt").orderBy("key"))
    counted = edge.withColumn("_inside", inside).join(counts, F.col("own").eqNullSafe(F.col("_own")) & (F.col("salt") == F.col("_salt")))
    counted = counted.select(*names, times(F.col("_inside") + F.col("_before") <= F.col("last_number")))
    return joined.filter(~partly).select(*names, times(place <= last)).unionByName(counted)


def mix_sizes(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS, ticks: int = TICKS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs (times taken), taken (words)."""
    sizes = stored(with_size(docs, seed), "mix-sizes")
    queue = fair_queue(sizes, weights, max_epochs, buckets, ticks)
    rows = with_times(sizes.withColumnRenamed("source", "own"), queue, buckets)
    return rows.select("doc_id", F.col("own").alias("source"), "size", "source_size", "target", F.col("times").alias("epochs"), (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS, ticks: int = TICKS) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken, all columns kept."""
    with Temporary(docs.sparkSession) as temporary:
        queue = fair_queue(temporary.stored(with_size(docs, seed), "mix-sizes"), weights, max_epochs, buckets, ticks)
    own = docs.select(
        F.struct("*").alias("row"), F.col("source").alias("own"), word_count(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text"), seed).alias("key")
    )
    times = with_times(own, queue, buckets).filter("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
