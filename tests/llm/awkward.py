"""Tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, kept string, cls long, _w long"
LONG_WORDS = 30_000


def rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éau", "straße", "naïve"]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [prose(n) for n in (3, 60, 120, 200, 400)]
    near = base[3].split()
    near[100] = "changed"
    passage = prose(60)
    texts: list[str | None] = [
        None, "", "   \n\t ", "one", "one two", "!!! ??? ...", *base, *base[1:3], " ".join(near),
        prose(80) + "\n" + passage, prose(30) + " " + passage + " " + prose(30), passage + " " + passage,
        "again and " * 200, prose(LONG_WORDS), "  x y" * 40, "line\nline\nline\n" * 30,
        "a\x00b \x1f c", "<|endoftext|> and text", base[2].upper(),
    ]
    out = [(i, t, ("en", "de", None)[i % 3], ("s0", "s1", "s2", None)[i % 4], len(t or ""), 7, "k", "x", i, None) for i, t in enumerate(texts)]
    out += [out[7], out[7]]  # repeated rows
    out.append((None, base[3], None, None, None, None, None, None, None, None))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
