"""Words of many texts at once as 64-bit hashes, in numpy, for use inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: So many bytes of text are looked at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 20

#: Words of more bytes are hashed by BLAKE2b: of long words, a polynomial modulo a power of two
#: takes some for equal that differ in a pattern, whatever its base.
LONG_WORD = 64

#: ASCII white space separates words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: All of ASCII but letters and digits.
NOT_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())
LOWER = bytes(range(256)).lower()
AS_IS = bytes(range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: hashes, where each starts and ends in ``data``, and where the
    words of each text start (``first`` has one entry more than there are texts)."""

    def __init__(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.data, self.hashes, self.starts, self.ends, self.first = data, hashes, starts, ends, first

    def text(self, a: int, b: int) -> bytes:
        """The words from a up to b, joined by one space."""
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split())

    def texts(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, n: int) -> np.ndarray:
        """Hashes of all n consecutive words, over the ends of texts as well."""
        h = self.hashes
        size = len(h) - n + 1
        if size <= 0:
            return np.empty(0, np.uint64)
        out = h[:size].copy()
        for k in range(1, n):
            out *= np.uint64(0x9FB21C651E98DF25)
            out += h[k : k + size]
        return mix64(out)


class WordHasher:
    """Hashes words by a polynomial over their bytes, so that no word is made a Python object but
    those of more than ``LONG_WORD`` bytes.

    ``separators`` are the bytes between words; ``fold`` maps bytes first. Both leave bytes
    of multi-byte characters alone, so UTF-8 is never cut.
    """

    def __init__(self, separators: bytes = SPACES, fold: bytes = AS_IS, seed: int = 1):
        rng = np.random.default_rng(seed)
        value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.fold = fold
        self.value = value[np.frombuffer(fold, np.uint8)]
        self.between = np.zeros(256, bool)
        self.between[np.frombuffer(separators, np.uint8)] = True
        self.value[self.between] = 0
        self.power = self.inverse = np.empty(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            steps = np.full((2, n), [[_BASE], [_BASE_INVERSE]], np.uint64)
            steps[:, 0] = 1
            self.power, self.inverse = np.cumprod(steps, axis=1)
        return self.power[:n], self.inverse

    def __call__(self, texts: list[bytes]) -> Words:
        data = np.frombuffer(b" ".join(texts), np.uint8)
        n = len(data)
        between = self.between[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = between[1:] != between[:-1] if n else False
        if n:
            edge[0] = not between[0]
            edge[n] = not between[n - 1]
        else:
            edge[:] = False
        at = np.nonzero(edge)[0]
        starts, ends = at[0::2], at[1::2]
        hashes = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):  # a stretch of words at a time, whatever the length of a text
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right")))
            low = starts[a]
            power, inverse = self._powers(int(ends[b - 1] - low))
            total = np.zeros(len(power) + 1, np.uint64)
            np.cumsum(self.value[data[low : ends[b - 1]]] * power, out=total[1:])
            s, e = starts[a:b] - low, ends[a:b] - low
            hashes[a:b] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            a = b
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            word = data[starts[i] : ends[i]].tobytes().translate(self.fold)
            hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        first = np.searchsorted(starts, text_starts)
        first[-1] = len(starts)
        return Words(data, hashes, starts, ends, first)


def chunks(batch: pa.RecordBatch, column: int = 0, size: int = CHUNK_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Slices of a batch whose texts have some ``size`` bytes together, null as empty."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield slice(start, i + 1), texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts)), texts[start:]
