"""Quality rules whose cutoffs adapt to each language and source.

A sketch of a metric is a histogram over log-linear bins (as in high dynamic range
histograms): values below 64 have a bin each, larger ones keep their six leading bits, so a
quantile is off by less than 1/32 of its value. Sketches merge by adding counts: those of
(lang, source) sum up to those of a language and of the whole corpus, which stand in where a
group is too small to judge itself by. Bins are integers, so reruns agree.

A document fails a rule if its metric lies beyond the group's quartiles by more than
``FENCE`` times their distance, or a least slack where the group hardly varies.

Everything runs as DataFrame expressions; a text is never shuffled nor stored. The filter
reads texts twice, for the sketches and for the verdict.

Defined results: null or empty text has no words and fails the base rule; texts of any length
are measured whole; null lang and null source are groups of their own; repeated rows are judged
alike and all stay or go; an empty table gives an empty result. Columns of the caller keep their
values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm.scratch import Temporary, stored
from volclock.llm.text import small, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
FENCE = 6
#: Smaller groups are judged by their language, and small languages by the whole corpus.
MIN_GROUP = 100
#: Metrics are whole numbers per thousand; the least distance of the fences from the quartiles.
UPPER_SLACK = {"m_length": 2000, "m_symbols": 100, "m_lines": 500, "m_repeats": 400}
LOWER_SLACK = {"m_length": 1500}


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    keep = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = docs.withColumns({"_w": words(F.col("text")), "_lines": lines})
    w = F.col("_w")
    df = df.withColumn(
        "_h",
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))),
    )
    h = F.col("_h")
    # most texts repeat no window: only the others are sorted
    df = df.withColumn("_some", F.size(F.array_distinct(h)) < F.size(h))
    df = df.withColumn("_s", F.when(F.col("_some"), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    df = df.withColumn(
        "_d",
        F.array_sort(
            F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))),
                lambda x: x["i"],
            )
        ),
    )
    d = F.col("_d")
    covered = F.aggregate(
        F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_some"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def metrics() -> dict[str, Column]:
    return {
        "m_length": _ratio("word_chars", "n_words"),
        "m_symbols": _ratio("n_symbols", "n_words"),
        "m_lines": _ratio("n_dup_lines", "n_lines"),
        "m_repeats": _ratio("n_repeat_words", "n_words"),
    }


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.expr(f"(1000 * {part}) div nullif({whole}, 0)"), F.lit(0))


def bin_of(value: Column) -> Column:
    """Lowest value of the bin: the value itself below 64, else its six leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.element_at(F.array(*[F.lit(1 << k) for k in range(58)]), drop + 1)
    return (value - F.pmod(value, width)).cast("long")


def thresholds(base: DataFrame, temporary: Temporary) -> DataFrame:
    """One row for each (lang, source): lang, source and a lower and upper bound of each metric.

    ``base`` has lang, source, n_words and the base columns. Documents under the base rule
    don't count. The result has a row for each language and source, whatever the corpus size.
    """
    names = list(UPPER_SLACK)
    sketch = (
        base.filter(~base_failed())
        .withColumns(metrics())
        .select("lang", "source", F.posexplode(F.array(*[F.col(m) for m in names])).alias("metric", "value"))
        .groupBy("lang", "source", "metric", bin_of(F.col("value")).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    sketch = temporary.stored(sketch, "rules-sketch")
    groups = temporary.stored(base.groupBy("lang", "source").agg(F.count("*").alias("n_docs")), "rules-groups")

    def quartiles(keys: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*keys, "metric")
        merged = merged.withColumn("_upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("_all", F.sum("n").over(whole))
        return merged.groupBy(*keys, "metric").agg(
            F.max("_all").alias(f"n_{tag}"),
            F.min(F.when(4 * F.col("_upto") >= F.col("_all"), F.col("bin"))).alias(f"lo_{tag}"),
            F.min(F.when(4 * F.col("_upto") >= 3 * F.col("_all"), F.col("bin"))).alias(f"hi_{tag}"),
        )

    def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("metric").alias("_metric"), *[c for c in df.columns if c not in (*keys, "metric")])

    rows = groups.select("lang", "source", F.explode(F.array(*[F.lit(i) for i in range(len(names))])).alias("metric"))
    for keys, tag in ((["lang", "source"], "own"), (["lang"], "lang"), ([], "all")):
        part = keyed(quartiles(keys, tag), keys)
        on = F.col("metric") == F.col("_metric")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(part, on, "left").drop("_metric", *[f"_{k}" for k in keys])

    def best(what: str) -> Column:
        return F.when(F.col("n_own") >= MIN_GROUP, F.col(f"{what}_own")).when(F.col("n_lang") >= MIN_GROUP, F.col(f"{what}_lang")).otherwise(F.col(f"{what}_all"))

    rows = rows.withColumns({"lo": best("lo"), "hi": best("hi")}).withColumn("spread", FENCE * (F.col("hi") - F.col("lo")))
    bounds = []
    for i, m in enumerate(names):
        here = F.col("metric") == i
        bounds.append(F.max(F.when(here, F.col("hi") + F.greatest(F.col("spread"), F.lit(UPPER_SLACK[m])))).alias(f"{m}_max"))
        if m in LOWER_SLACK:
            bounds.append(F.max(F.when(here, F.col("lo") - F.greatest(F.col("spread"), F.lit(LOWER_SLACK[m])))).alias(f"{m}_min"))
    return rows.groupBy("lang", "source").agg(*bounds)


def judge(base: DataFrame, bounds: DataFrame) -> DataFrame:
    """``base`` with base_failed and kept, by a join with the thresholds of its group."""
    cols = base.columns
    b = bounds.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    m = metrics()
    verdict = F.lit(True)
    for name in UPPER_SLACK:
        verdict = verdict & F.coalesce(m[name] <= F.col(f"{name}_max"), F.lit(True))
    for name in LOWER_SLACK:
        verdict = verdict & F.coalesce(m[name] >= F.col(f"{name}_min"), F.lit(True))
    # one expression, which no filter is split off from and evaluated under the join once more
    kept = F.when(base_failed(), F.lit(False)).otherwise(verdict)
    joined = base.join(small(b), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(*cols, base_failed().alias("base_failed"), kept.alias("kept"))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, source, the base columns, base_failed and kept."""
    with Temporary(docs.sparkSession) as temporary:
        base = stored(with_base(docs.select("doc_id", "lang", "source", "text")).drop("text"), "rules-base")
        return judge(base, stored(thresholds(base, temporary), "rules-bounds"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    with Temporary(docs.sparkSession) as temporary:
        figures = temporary.stored(with_base(docs.select("lang", "source", "text")).drop("text"), "rules-base")
        bounds = stored(thresholds(figures, temporary), "rules-bounds")
    base = with_base(docs.select(F.struct("*").alias("row"), "lang", "source", "text")).drop("text")
    return judge(base, bounds).filter("kept").select("row.*")
