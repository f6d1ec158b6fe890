"""Plain versions of what the operators return, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_groups(docs, n, numerator, denominator):
    """docs: [(doc_id, text)]. Sorted (doc_id, n_shingles, component_id)."""
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and denominator * len(a & b) >= numerator * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs))


def substring(docs, window):
    """docs: [(doc_id, text)]. Counter of (doc_id, n_words, n_removed, kept_sha256)."""
    all_words = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = Counter()
    for (d, _), w in zip(docs, all_words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def threads(messages, split, least=3):
    """By (conv_id, turn): (thread, level, all origins); messages are (conv_id, turn, text)."""

    def normal(lines):
        return " ".join(" ".join(lines).lower().split())

    def paragraphs(lines):
        out = [[]]
        for line in lines:
            out = out + [[]] if not line.strip() else [*out[:-1], [*out[-1], line]]
        return [p for p in out if p]

    said = {}
    for conv, turn, text in sorted(messages, key=lambda m: m[:2]):
        lines = split(text)[0].split("\n")
        parts = [normal(p) for p in paragraphs(lines)] + [normal([line]) for line in lines]
        for unit in {normal(lines), *(u for u in parts if len(u.split()) >= least)} - {""}:
            said.setdefault(unit, []).append((conv, turn))

    def origin(unit, conv, turn):
        here = [p for p in said.get(unit, []) if p[0] == conv and p[1] < turn]
        return (here or [p for p in said.get(unit, [])[:1] if p[0] < conv] or [None])[0]

    links = {}
    for conv, turn, text in messages:
        to = links.setdefault((conv, turn), set())
        for _, lines in split(text)[1]:
            whole = origin(normal(lines), conv, turn)
            for p in [] if whole else paragraphs(lines):
                got = origin(normal(p), conv, turn) if len(normal(p).split()) >= least else None
                to |= {got} if got else {origin(normal([x]), conv, turn) for x in p if len(x.split()) >= least}
            to |= {whole}
        to.discard(None)
    above = {}
    for (conv, _), to in links.items():
        above.setdefault(conv, set()).update(c for c, _ in to if c != conv)
    level, root = {}, {c: c for c in above}
    for conv in sorted(above):
        level[conv] = max((level[c] + 1 for c in above[conv]), default=0)
        met = {root[c] for c in above[conv]} | {root[conv]}
        root = {c: min(met) if r in met else r for c, r in root.items()}
    return {(c, t): (root[c], level[c], sorted(to)) for (c, t), to in links.items()}


def common_lines(docs, least_chars, least_docs):
    """docs: [(doc_id, text)]. Counter of (doc_id, n_lines, n_dropped, what is left)."""
    blank = " \t\n\x0b\f\r"
    holders = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(blank).translate(LOWER)
            if len(key) >= least_chars:
                holders.setdefault(key, set()).add(d)
    last = {k: max(h, key=lambda d: (d is not None, d or 0)) for k, h in holders.items() if len(h) >= least_docs}
    out = Counter()
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(x.strip(blank).translate(LOWER), d) == d]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def divergence(docs, least_docs, top):
    """docs: [(lang, source, text)]. Rows of the audit, every term of every pair taken by itself."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, held, whole = {}, {}, {}
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = Counter(term.findall((text or "").translate(LOWER)))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        held.setdefault(lang, Counter()).update(set(found))
        whole.setdefault(lang, Counter()).update(found)
    out = []
    for lang, sources in counts.items():
        kept = [t for t, n in held[lang].items() if n >= least_docs]

        def numbers(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: numbers(c) for s, c in sources.items()}, numbers(whole[lang])
        for s, c in sources.items():
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            told = [(t, f(p[s][t], q[t])) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", told, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return sorted(out)


def vector_codes(rows, parts, entries, rounds, scale):
    """rows: [(vec_id, vector, label)]. Sorted (vec_id, code, error, label_error, sha256)."""
    import math

    ints = []
    for d, v, label in rows:
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < (1 << 24) / scale for x in v):
            ints.append((d, tuple(math.floor(x * scale) for x in v), label))
    out = []
    for size in {len(v) for _, v, _ in ints}:
        own = [r for r in ints if len(r[1]) == size]
        m = size // parts
        cut = [[v[i * m : (i + 1) * m] for i in range(parts)] for _, v, _ in own]
        first = sorted({(d is None, d or 0, v) for d, v, _ in own})[:entries]
        book = [[v[i * m : (i + 1) * m] for _, _, v in first] for i in range(parts)]

        def near(x, i, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book[i]))

        for _ in range(rounds):
            found = [[near(x, i)[1] for i, x in enumerate(v)] for v in cut]
            for i in range(parts):
                for k in range(len(first)):
                    mine = [v[i] for v, f in zip(cut, found, strict=True) if f[i] == k]
                    if mine:
                        book[i][k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        sha = hashlib.sha256(",".join(str(x) for part in book for c in part for x in c).encode()).hexdigest()
        for (d, _, label), v in zip(own, cut, strict=True):
            found = [near(x, i) for i, x in enumerate(v)]
            out.append((d, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label, sha))
    total = Counter()
    for _, _, e, label, _ in out:
        total[label] += e
    return Counter((d, code, e, total[label], sha) for d, code, e, label, sha in out)
