"""Chat formatting by quotation linking.

Lines that start with ``>`` are quoted, one level for each sign; runs of lines at one level are
a passage. A passage is looked up as a whole, then by its paragraphs, then by its lines:
always as a hash of the normalised text (lower case, single spaces). The same hashes are
taken of what messages say themselves. A quoted unit comes from the earliest message of its
own conversation that says it, or else from the earliest message of all, by (conv_id, turn);
only earlier messages count. Every passage is linked to the origin of the whole, or else to
those of its paragraphs, where a paragraph without an origin counts by its lines. All these
links are kept; among them ``to_conv`` and ``to_turn`` name the origin of the shallowest and
most complete unit.

Conversations that quote others are joined to one thread: threads are the components of all
links between conversations, and the level of a conversation is the longest path of links
that leads from it. In a thread, messages stand in reply order: (level, conv_id, turn) puts
every message after all that it quotes. Quotes, and the lines that introduce them, are left
out.

A unit has one origin however many messages say it, so nothing is paired within a group.

Defined results: null text is empty; a message that only quotes has an empty text; rows with
null conv_id or turn are passed on with a null thread and no links; rows that share conv_id
and turn share their links; paragraphs and lines of fewer than ``LEAST`` words link nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.llm.components import components
from volclock.llm.scratch import stored

LEAST = 3
TURN = "<|{role}|>\n{text}\n<|end|>\n"

_QUOTED = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.DOTALL)
_INTRODUCES = re.compile(r"\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{0,40}:\s*$", re.IGNORECASE)


def split_levels(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes, and the quoted passages: (level, lines)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level = 0
    for line in text.split("\n"):
        match = _QUOTED.fullmatch(line)
        now = match[1].count(">") if match else 0
        if not match:
            own.append(line)
        else:
            if now != level:
                passages.append((now, []))
                if level == 0:
                    while own and not own[-1].strip():
                        own.pop()
                    if own and _INTRODUCES.search(own[-1]):
                        own.pop()
            passages[-1][1].append(match[2])
        level = now
    return ("\n".join(own).strip() if passages else text), passages


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def units(lines: list[str]) -> dict[tuple[int, str], tuple[int, int]]:
    """(Paragraph, -1 for the whole; hash of the normalised unit): (kind: 0 whole, 1 paragraph,
    2 line; number of words). A unit equal to a more complete one it is part of is left out."""
    found: dict[tuple[int, str], tuple[int, int]] = {}
    normal = [line.lower().split() for line in lines]

    def add(words: list[str], kind: int, paragraph: int) -> None:
        if words and (kind == 0 or len(words) >= LEAST):
            unit = digest(" ".join(words))
            if (-1, unit) not in found:
                found.setdefault((paragraph, unit), (kind, len(words)))

    add([w for line in normal for w in line], 0, -1)
    paragraph: list[list[str]] = []
    number = 0
    for line in [*normal, []]:
        if line:
            paragraph.append(line)
        elif paragraph:
            add([w for part in paragraph for w in part], 1, number)
            for part in paragraph:
                add(part, 2, number)
            paragraph, number = [], number + 1
    return found


def parsed_units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level (0: said itself), passage (hash of a quoted passage, so that equal
    ones are the same), paragraph, kind, words, unit (hash) of all messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv_id, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, passages = split_levels(text or "")
                said = {unit: size for (_, unit), size in units(own.split("\n")).items()}
                rows += [(conv_id, turn, 0, None, -1, kind, n, unit) for unit, (kind, n) in said.items()]
                for level, lines in passages:
                    passage = digest(f"{level}\n" + "\n".join(lines))
                    rows += [(conv_id, turn, level, passage, i, kind, n, unit) for (i, unit), (kind, n) in units(lines).items()]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "level", "passage", "paragraph", "kind", "words", "unit"])

    lean = messages.filter("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
    return lean.mapInArrow(run, "conv_id long, turn long, level int, passage string, paragraph int, kind int, words long, unit string")


def passage_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, kind, words, to_conv, to_turn: all origins of all quoted
    passages, by the most complete units that have one."""
    found = parsed_units(messages)
    quoted = stored(found.filter("level > 0").distinct(), "quotes-quoted")
    wanted = quoted.select(F.col("unit").alias("_unit")).distinct()
    said = found.filter("level = 0").groupBy("unit", "conv_id").agg(F.min("turn").alias("turn"))
    said = stored(said.join(wanted, F.col("unit") == F.col("_unit"), "left_semi"), "quotes-said")
    here = said.select(F.col("unit").alias("_u"), F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
    anywhere = said.groupBy("unit").agg(F.min(F.struct("conv_id", "turn")).alias("_first")).withColumnRenamed("unit", "_v")
    linked = (
        quoted.join(here, (F.col("unit") == F.col("_u")) & (F.col("conv_id") == F.col("_c")) & (F.col("_t") < F.col("turn")), "left")
        .join(anywhere, (F.col("unit") == F.col("_v")) & (F.col("_first.conv_id") < F.col("conv_id")), "left")
        .withColumn("to", F.when(F.col("_t").isNotNull(), F.struct(F.col("_c").alias("conv_id"), F.col("_t").alias("turn"))).otherwise(F.col("_first")))
        .filter("to is not null")
    )
    # within one passage of one message
    passage = Window.partitionBy("conv_id", "turn", "passage")
    most = linked.withColumns({"_whole": F.min("kind").over(passage) == 0, "_best": F.min("kind").over(passage.partitionBy("conv_id", "turn", "passage", "paragraph"))})
    kept = most.filter(F.when(F.col("_whole"), F.col("kind") == 0).otherwise(F.col("kind") == F.col("_best")))
    return kept.select("conv_id", "turn", "level", "passage", "kind", "words", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn")).distinct()


def reply_links(links: DataFrame) -> DataFrame:
    """Per message with links: conv_id, turn, to_conv and to_turn (the origin of its shallowest
    and most complete unit), links (all origins, in order) and n_links."""
    to = F.struct("to_conv", "to_turn")
    best = links.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", "kind", (-F.col("words")).alias("words"), to.alias("to"))).alias("_best"), F.array_sort(F.collect_set(to)).alias("links")
    )
    return best.select("conv_id", "turn", F.col("_best.to.to_conv").alias("to_conv"), F.col("_best.to.to_turn").alias("to_turn"), "links", F.size("links").alias("n_links"))


def thread_levels(links: DataFrame) -> DataFrame:
    """conv_id and level of all conversations that link others: the longest path of links.

    Links lead to smaller conv_ids, so paths end. In each round a link to a conversation with
    a single link of its own is led on to where that one leads: chains halve, and conversations
    whose links all lead to ends are done. The number of rounds grows with the most
    conversations of several links on a path, and with the logarithm of the chains between.
    """
    now = links.filter("to_conv != conv_id").select("conv_id", "to_conv").distinct()
    up = now.select(F.col("conv_id").alias("_c")).distinct()
    # to_conv is null for links to an end
    now = now.join(up, F.col("to_conv") == F.col("_c"), "left").groupBy("conv_id", F.col("_c").alias("to_conv")).agg(F.lit(1).cast("long").alias("steps"))
    now = stored(now, "quotes-levels")
    while not now.filter("to_conv is not null").isEmpty():
        single = now.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("to_conv").alias("_to"), F.max("steps").alias("_steps")).filter("n = 1")
        single = single.select(F.col("conv_id").alias("_c"), "_to", "_steps")
        led = now.join(single, F.col("to_conv") == F.col("_c"), "left").select(
            "conv_id", F.when(F.col("_c").isNull(), F.col("to_conv")).otherwise(F.col("_to")).alias("to_conv"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")
        )
        now = stored(led.groupBy("conv_id", "to_conv").agg(F.max("steps").alias("steps")), "quotes-levels")
    return now.select("conv_id", F.col("steps").alias("level"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, root (the smallest conversation of the thread) and steps (its level) of all
    conversations that link others or are linked by them."""
    roots = components(links.filter("to_conv != conv_id").select("conv_id", "to_conv")).select(F.col("node").alias("conv_id"), "root")
    levels = thread_levels(links).select(F.col("conv_id").alias("_c"), "level")
    return roots.join(levels, F.col("conv_id") == F.col("_c"), "left").select("conv_id", "root", F.coalesce("level", F.lit(0)).cast("long").alias("steps"))


def formatted(messages: DataFrame, turn_format: str = TURN) -> DataFrame:
    """Per message: thread_id, level, conv_id, turn, role, text (without quotes), n_quoted,
    deepest (quote level), to_conv, to_turn, n_links, links (all origins) and chat (the message
    in ``turn_format``); sorted by thread and reply order within range partitions."""
    all_links = stored(passage_links(messages), "quotes-links")
    links = reply_links(all_links)
    roots = stored(threads(all_links), "quotes-roots").select(F.col("conv_id").alias("_conv"), "root", "steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, deepest, chats = [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, passages = split_levels(text or "")
                texts.append(own)
                counts.append(sum(len(lines) for _, lines in passages))
                deepest.append(max((level for level, _ in passages), default=0))
                chats.append(turn_format.format(role=role or "user", text=own))
            columns = [*batch.columns[:3], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(deepest, pa.int32()), pa.array(chats, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "text", "n_quoted", "deepest", "chat"])

    lean = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text")
    cleaned = lean.mapInArrow(run, "conv_id long, turn long, role string, text string, n_quoted long, deepest int, chat string")
    on = links.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "to_conv", "to_turn", "n_links", "links")
    joined = cleaned.join(on, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").join(roots, F.col("conv_id") == F.col("_conv"), "left")
    known = F.col("turn").isNotNull()
    out = joined.select(
        F.when(known, F.coalesce("root", "conv_id")).alias("thread_id"),
        F.when(known & F.col("conv_id").isNotNull(), F.coalesce("steps", F.lit(0))).cast("long").alias("level"),
        "conv_id", "turn", "role", "text", "n_quoted", "deepest", "to_conv", "to_turn", F.coalesce("n_links", F.lit(0)).alias("n_links"), "links", "chat",
    )
    order = ["thread_id", "level", "conv_id", "turn"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
