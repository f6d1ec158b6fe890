"""Lines that many documents share: boilerplate such as menus, banners and disclaimers goes.

Lines are exploded with their positions, normalised and hashed; the documents of each hash are
counted; a line whose hash is in too many goes from all but the last of them; what is left is put
together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volclock.llm.scratch import Temporary, stored
from volclock.llm.text import fresh, small

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 40, 5


def lines_of(text: Column) -> Column:
    """The lines of a text in order; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def digest(text: Column) -> Column:
    """128 bits of SHA-256: no two texts are known that share them, crafted ones included."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def without_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with what is left in ``text``, and n_lines and n_dropped of each row (or, where a
    caller's column has that name, with an underscore before it, as the last two columns).

    A key of at least ``least_chars`` code points in at least ``least_docs`` documents stays only
    in the largest doc_id that holds it, there in all its lines. Rows that share a doc_id count as
    one document, so do those without a doc_id, which come before all others. Repeated rows all
    come back, each treated alike. A null or empty text is one empty line, and null becomes empty.
    Empty tables stay empty. Texts of any length and other columns of any name and type do.

    Counting ships 24 bytes for each distinct line of a document, first dealt by line and
    document, so that a line in every document is no hot key; Spark combines before both
    shuffles. Decisions meet the lines again by broadcast where few keys go, else by a join
    whose side of lines is split where skewed. Texts move once, to their own decisions.
    """
    with Temporary(docs.sparkSession) as temporary:
        row_key = [F.col(doc_id).alias("doc"), digest(F.coalesce(F.col(text), F.lit(""))).alias("text_key")]
        lines = docs.select(*row_key, F.posexplode(lines_of(F.col(text))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
        long = lines.filter(F.char_length("key") >= least_chars).select("doc", "text_key", "pos", digest(F.col("key")).alias("key"))
        held = F.struct("doc")  # counts null as a document, and orders it first
        counted = long.groupBy("key").agg(F.count_distinct(held).alias("n"), F.max(held).alias("last")).filter(F.col("n") >= least_docs)
        common = temporary.stored(counted.select("key", F.col("last.doc").alias("last")), "common-lines")
        hits = long.join(small(common), "key").filter(~F.col("doc").eqNullSafe(F.col("last")))
        gone = stored(hits.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("gone")), "dropped-lines")
    doc, key, mine, n_lines, n_dropped = fresh(docs, "_doc", "_text_key", "_gone", "n_lines", "n_dropped")
    side = gone.select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("gone").alias(mine))
    given = docs.withColumn(n_lines, F.size(lines_of(F.col(text))).cast("long"))
    joined = given.join(side, given[doc_id].eqNullSafe(side[doc]) & (digest(F.coalesce(given[text], F.lit(""))) == side[key]), "left")
    # as fields of one struct, so that the split is made once, not once for each place
    both = F.array(F.struct(lines_of(F.col(f"`{text}`")).alias("lines"), F.coalesce(F.col(mine), F.array().cast("array<int>")).alias("gone")))
    kept = F.transform(both, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"]), lambda i: F.get(x["lines"], i)))
    left = F.array_join(F.get(kept, 0), "\n")
    names = [left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*names, F.col(n_lines), F.when(F.col(mine).isNotNull(), F.size(mine)).otherwise(0).cast("long").alias(n_dropped))
