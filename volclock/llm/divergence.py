"""How far the sources of a language differ in their words, and by which words.

Every source of a language gives each kept term a smoothed probability in billionths, as does the
language as a whole; f(p, q) = floor((p - q)^2 / (p + q)) is the distance of two such numbers.
Two sources' sum of f over all V terms is never taken term by term: it is

    V f(p0, q0) + sum over terms of the first [f(p, q0) - f(p0, q0)] + the same for the second
    + sum over shared terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)],

where p0, q0 are what either gives to a term it doesn't have. The two one-sided sums depend on how
many terms a source has of each count only; the last sum joins the postings of a term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm.scratch import Temporary, stored

LEAST_DOCS, TOP = 10, 10
#: So many different terms are counted before a task hands its counts on.
HELD = 400_000

#: Bytes of terms (ASCII letters, in lower case, and all of code points from 128 on); others are gaps.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of letters or characters beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents): partial counts of a task."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), count in n.items():
            held = docs[lang, source]
            words = list(count)
            columns = [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(list(count.values()), pa.int64()), pa.array([held[w] for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            found = terms(text.as_py())
            n.setdefault((lang, source), Counter()).update(found)
            docs.setdefault((lang, source), Counter()).update(set(found))
        if sum(map(len, n.values())) > HELD:
            yield from out()
    yield from out()


def f(p: Column, q: Column) -> Column:
    """The distance of two probabilities in billionths, a whole number."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def probability(count: Column, total: Column, kept: Column) -> Column:
    """Billionths of a term found ``count`` times among ``total`` occurrences of ``kept`` terms."""
    return 1 + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)"))


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, n_lang (of the term in its language) and first (true in one row of
    each term of a language) of the terms in at least ``least_docs`` documents of their language.
    One shuffle, by language and term, of counts that tasks have already summed: a term has a row
    for each task and source at most, however many documents hold it."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = given.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    by_source = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    summed = by_source.withColumns({"docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    return summed.filter(F.col("docs") >= least_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "n_lang", "first")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: each other source of the language,
    farthest first; part ``term``: the ``top`` terms that a source has more often than its
    language, by their distance. Ties go by the item's bytes.

    ``docs`` has lang, source and text; nulls count as empty strings, which are a language and
    source like others. Each row is a document, repeated ones too. A source without terms has its
    pairs; a language without kept terms has pairs of value 0. An empty table has no rows. Texts of
    any length and further columns of any name do. All arithmetic is in whole numbers.

    The posting join makes at most one row for each pair of sources and shared term and adds it up
    before it is shuffled; sources, not documents, make it long, and each of its pairs is in the
    result. Terms of part ``term`` are cut to the top before they are shuffled.
    """
    with Temporary(docs.sparkSession) as temporary:
        kept = temporary.stored(postings(docs, least_docs), "postings")
        languages = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("of_lang"))
        sources = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = sources.join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "of_lang")])
        groups = groups.withColumn("p0", F.when(F.col("v") > 0, probability(F.lit(0), F.col("total"), F.col("v"))))
        groups = temporary.stored(groups, "groups")

        mine = groups.select("lang", "source", "total", "v", "p0")
        other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
        none = f(F.col("p0"), F.col("q0"))
        constant = mine.join(other, "lang").filter("source != other").select("lang", "source", "other", F.coalesce(F.col("v") * none, F.lit(0)).alias("value"))

        price = probability(F.col("n"), F.col("total"), F.col("v"))
        histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(mine, ["lang", "source"])
        one_sided = histogram.withColumn("p", price).join(other, "lang").filter("source != other")
        one_sided = one_sided.groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * (f(F.col("p"), F.col("q0")) - none)).alias("value"))
        one_sided = one_sided.unionByName(one_sided.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))

        priced = kept.join(mine, ["lang", "source"]).select("lang", "source", "term", price.alias("p"), "p0")
        shared = priced.join(priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]).filter("source < other")
        p, q, q0, p0 = (F.col(c) for c in ("p", "q", "q0", "p0"))
        both = shared.groupBy("lang", "source", "other").agg(F.sum(f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).alias("value"))
        both = both.unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))

        pairs = constant.unionByName(one_sided).unionByName(both).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
        at = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(at)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

        q = probability(F.col("n_lang"), F.col("of_lang"), F.col("v"))
        told = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), price.alias("p"), q.alias("q")).filter("p > q")
        told = told.withColumn("value", f(F.col("p"), F.col("q"))).withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= top)
        told = told.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        return stored(pairs.unionByName(told), "divergence")
