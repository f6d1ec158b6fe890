"""License scans by a positional index of rare words.

The index holds, for each template (the notice of a license, a short phrase, or a reference of
one line, which gives a label but isn't counted), the positions of its rarest words; how rare a word is comes from the numbers of documents that
hold it, counted over the whole corpus. A file's own rare license words are looked up;
postings whose position relative to the file agrees meet at one place (an exact one for a
phrase or reference, within ``SLACK`` words for a notice, which may have words put in or left out). Such a
place is then verified: every word of a phrase in its position; ``SHARE`` of a notice's words
and all its mandatory key phrases.

Defined results: null or empty text has no words and no labels; a notice that stands twice
gives its label once; repeated rows give equal rows; a null doc_id is kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volclock.llm.wordhash import LOWER, NOT_ALNUM, WordHasher, chunks

# Short phrases, and the notices that license texts ask to be put into files
# with the phrases in them that must be there.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee is hereby granted"],
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        ["apache license version 2 0", "in compliance with the license"],
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
        ["endorse or promote products derived from this software"],
    ),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        ["gnu general public license as published by the free software foundation", "version 2 of the license"],
    ),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ["gnu general public license as published by the free software foundation", "version 3 of the license"],
    ),
    "agpl-3": (
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        ["gnu affero general public license"],
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at",
        ["mozilla public license v 2 0"],
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ["free and unencumbered software released into the public domain"],
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ["creative commons attribution 4 0 international license"],
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
        ["creative commons attribution sharealike 4 0 international license"],
    ),
}

# References of one line: they give labels, but don't count among the places of phrases.
REFERENCES = {
    "mit": ["spdx license identifier mit", "licensed under mit"],
    "isc": ["spdx license identifier isc", "under the isc license"],
    "apache-2": ["apache license 2 0", "apache license v2", "spdx license identifier apache 2 0"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd license", "simplified bsd license"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd license", "new bsd license"],
    "gpl-2": [
        "gnu general public license version 2", "gnu general public license v2", "gnu general public license v 2", "version 2 of the gnu general public license",
        "gnu gpl version 2", "gpl version 2", "gpl v2", "gplv2", "gpl 2", "gpl 2 0",
    ],
    "gpl-3": [
        "gnu general public license version 3", "gnu general public license v3", "gnu general public license v 3", "version 3 of the gnu general public license",
        "gnu gpl version 3", "gpl version 3", "gpl v3", "gplv3", "gpl 3", "gpl 3 0",
    ],
    "agpl-3": [
        "gnu affero general public license version 3", "gnu affero general public license v3", "gnu affero general public license v 3",
        "version 3 of the gnu affero general public license", "agpl version 3", "agpl v3", "agplv3", "agpl 3", "agpl 3 0",
    ],
    "mpl-2": [
        "mozilla public license version 2", "mozilla public license v2", "mozilla public license v 2", "mozilla public license 2", "mpl version 2", "mpl v2", "mpl 2 0",
    ],
    "unlicense": ["spdx license identifier unlicense", "under the unlicense"],
    "cc-by": ["cc by 4", "cc by 3", "creative commons attribution 4", "creative commons attribution 3"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["creative commons attribution noncommercial", "creative commons attribution non commercial"],
}

ANCHORS = 8
SLACK = 6
SHARE = 0.8


class Template:
    def __init__(self, label: str, words: list[int], phrases: list[list[int]], exact: bool, base: bool = False):
        self.label, self.words, self.exact, self.base = label, np.array(words), exact, base
        self.phrases = [np.array(p) for p in phrases]
        self.anchors: list[int] = []


class RareWordIndex:
    """Templates as numbers of words in one vocabulary, and the postings of their anchors."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, list[str]]], references: dict[str, list[str]] = {}):
        self.hasher = WordHasher(separators=NOT_ALNUM, fold=LOWER)
        lines = [(label, r) for label, rs in references.items() for r in rs]
        texts = [*phrases.values(), *(t for t, _ in notices.values()), *(p for _, ps in notices.values() for p in ps), *(r for _, r in lines)]
        hashed = [self.hasher([t.encode()]).hashes for t in texts]
        self.vocabulary = np.unique(np.concatenate(hashed))
        numbers = iter(np.searchsorted(self.vocabulary, h).tolist() for h in hashed)
        whole = [Template(label, next(numbers), [], True, True) for label in phrases]
        parts = [Template(label, next(numbers), [], False) for label in notices]
        for template, (_, ps) in zip(parts, notices.values(), strict=True):
            template.phrases = [np.array(next(numbers)) for _ in ps]
        self.templates = whole + parts + [Template(label, next(numbers), [], True) for label, _ in lines]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.is_anchor = np.zeros(len(self.vocabulary), bool)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, -1 if it isn't there."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def build(self, documents: int, frequency: dict[int, int]) -> RareWordIndex:
        """Choose the anchors by idf: the rarest word of a phrase, the rarest ones of a notice.
        Words that no document holds are no anchors: a notice can be found without them, but a
        template that must have one is nowhere."""
        idf = [math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in range(len(self.vocabulary))]
        for t, template in enumerate(self.templates):
            must = template.words.tolist() if template.exact else [w for p in template.phrases for w in p.tolist()]
            if not all(frequency.get(w, 0) for w in must):
                continue
            there = {w for w in template.words.tolist() if frequency.get(w, 0)}
            rarest = sorted(there, key=lambda w: (-idf[w], w))
            template.anchors = rarest[: 1 if template.exact else ANCHORS]
            for w in template.anchors:
                self.is_anchor[w] = True
                places = np.nonzero(template.words == w)[0].tolist()
                self.postings.setdefault(w, []).extend((t, p) for p in (places[:1] if template.exact else places))
        return self

    def places(self, file: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template: (file position - template position, template position) of all shared anchors."""
        found: dict[int, list[tuple[int, int]]] = {}
        for i in np.nonzero((file >= 0) & self.is_anchor[file])[0].tolist():
            for t, p in self.postings[int(file[i])]:
                found.setdefault(t, []).append((i - p, p))
        return found

    def scan(self, file: np.ndarray) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """(phrases found, as label and place; share of words of each label found)."""
        base: list[tuple[str, int]] = []
        labels: dict[str, float] = {}
        for t, places in self.places(file).items():
            template = self.templates[t]
            n = len(template.words)
            if template.exact:
                at = np.array([a for a, _ in places if 0 <= a <= len(file) - n], dtype=np.int64)
                if len(at):
                    whole = (file[at[:, None] + np.arange(n)] == template.words).all(axis=1)
                    if template.base:
                        base += [(template.label, int(a)) for a in at[whole]]
                    if whole.any():
                        labels[template.label] = 1.0
                continue
            share = max((self.verified(template, file, a) for a in self.candidates(template, sorted(places))), default=0.0)
            if share:
                labels[template.label] = max(share, labels.get(template.label, 0.0))
        return base, labels

    @staticmethod
    def candidates(template: Template, places: list[tuple[int, int]]) -> Iterator[int]:
        """Places where half of the anchors agree within the slack."""
        need = (len(template.anchors) + 1) // 2
        held: Counter[int] = Counter()
        low = 0
        last = None
        for a, p in places:
            held[int(template.words[p])] += 1
            while places[low][0] < a - SLACK:
                w = int(template.words[places[low][1]])
                held[w] -= 1
                if not held[w]:
                    del held[w]
                low += 1
            if len(held) >= need and (last is None or places[low][0] > last):
                last = places[low][0]
                yield last

    @staticmethod
    def verified(template: Template, file: np.ndarray, at: int) -> float:
        """Share of the template's words around the place, 0 if too few or a key phrase lacks."""
        n = len(template.words)
        here = file[max(0, at - SLACK) : max(0, at + n + 2 * SLACK)]
        wanted, there = Counter(template.words.tolist()), Counter(here[here >= 0].tolist())
        share = sum(min(k, there[w]) for w, k in wanted.items()) / n
        if share < SHARE:
            return 0.0
        for phrase in template.phrases:
            starts = np.nonzero(here[: max(0, len(here) - len(phrase) + 1)] == phrase[0])[0]
            if not any((here[s : s + len(phrase)] == phrase).all() for s in starts):
                return 0.0
        return share


def word_frequencies(docs: DataFrame, index: RareWordIndex) -> tuple[int, dict[int, int]]:
    """Number of documents, and of those that hold each word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(index.vocabulary) + 1, np.int64)
        for batch in batches:
            for part, texts in chunks(batch):
                words = index.hasher(texts)
                number = index.numbers(words.hashes)
                known = number >= 0
                pairs = np.unique(words.texts()[known] * len(index.vocabulary) + number[known])
                held[:-1] += np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
                held[-1] += part.stop - part.start
        some = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some])], ["word", "n"])

    # at most one row for each word of the vocabulary
    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop(len(index.vocabulary), 0), counts


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, list[str]]] = NOTICES, references: dict[str, list[str]] = REFERENCES) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of phrases), first_word, last_word (the
    smallest and largest of them), base_labels, labels (sorted, comma-joined) and score, the
    largest share of a template's words that was found."""
    index = RareWordIndex(phrases, notices, references)
    index.build(*word_frequencies(docs, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, 1):
                words = index.hasher(texts)
                number = index.numbers(words.hashes)
                first = words.first.tolist()
                anchors = np.concatenate([[0], np.cumsum((number >= 0) & index.is_anchor[number])])
                some = anchors[words.first[1:]] > anchors[words.first[:-1]]
                rows = []
                for t, has in enumerate(some.tolist()):
                    n = first[t + 1] - first[t]
                    base, labels = index.scan(number[first[t] : first[t + 1]]) if has else ([], {})
                    at = [a for _, a in base]
                    rows.append(
                        (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), max(labels.values(), default=0.0))
                    )
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], *columns], NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
