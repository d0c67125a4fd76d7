"""Vectorised text kernel shared by the corpus operators.

Everything here works on Arrow string buffers with numpy, a few passes per byte, so that
hashing every word of a corpus costs nanoseconds instead of a Python object per word.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; those separators are ASCII, so
working on UTF-8 bytes gives exactly the words of the regular expression
``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are handled in slices of about this many bytes, so memory is bounded by this and
#: the longest single text.
SLICE_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


_TABLES = {lower: _bytes_table(1)[LOWER] if lower else _bytes_table(1) for lower in (False, True)}
_TABLES2 = {lower: _bytes_table(2)[LOWER] if lower else _bytes_table(2) for lower in (False, True)}
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or its inverse modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        out = np.full(size, _BASE if kind == "base" else _INV, U64)
        out[0] = 1
        np.cumprod(out, out=out)
        if n > 4 * SLICE_BYTES:  # of one huge text: don't keep
            return out[:n]
        _powers[kind] = have = out
    return have[:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield at, to
        at = to


class Words:
    """Words of a slice of texts: ``start``/``end`` byte positions in ``buf``, and
    ``of`` with the range ``of[d]:of[d + 1]`` of words of text ``d``. Null texts have none."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
        self.off = off - (off[0] if len(off) else 0)
        n = len(self.buf)
        inside = ~SPACE[self.buf]
        before = np.empty(n + 1, bool)  # before[i]: position i - 1 belongs to a word of the same text
        before[0], before[1:] = False, inside
        before[self.off[:-1]] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(n + 1, bool)
        after[:-1], after[-1] = inside, False
        after[self.off[1:]] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.of = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.of)

    def _prefix(self, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.buf) + 1, U64)
        out[0] = 0
        np.cumsum(table[self.buf] * _power("base", len(self.buf)), out=out[1:])
        return out

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes."""
        table = (_TABLES2 if second else _TABLES)[lower]
        at = self._prefix(table)
        return mix((at[end] - at[start]) * _power("inverse", len(self.buf) + 1)[start])

    def hashes(self, lower: bool = False, second: bool = False) -> np.ndarray:
        return self.spans(self.start, self.end, lower, second)

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k consecutive words of one text, and the index of each
        window's first word."""
        room = np.repeat(self.of[1:], self.count) - np.arange(len(words))  # words left in the text
        at = np.flatnonzero(room >= k)
        return combine(words, at, k), at

    def doc(self, word: np.ndarray) -> np.ndarray:
        """The text that each word index belongs to."""
        return np.searchsorted(self.of, word, "right") - 1


def combine(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of words[at], ..., words[at + k - 1]."""
    out = np.full(len(at), k, U64)
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += words[at + j]
    return mix(out)


def cover(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in at[i] .. at[i] + k - 1 for some i."""
    step = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + k, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over flags[offsets[d]:offsets[d + 1]]."""
    total = np.zeros(len(flags) + 1, np.int64 if flags.dtype.kind in "bui" else np.float64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text (doc ascending): values sorted within each text, and
    offsets of the texts."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(n_docs + 1))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct k-word shingles, lower-cased A-Z; a text of fewer than
    k words has its whole sequence as its only shingle, and one without words has none."""
    w = Words(texts)
    h = w.hashes(lower=True)
    value, at = w.grams(h, k)
    doc = w.doc(at)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        extra = np.empty(len(short), U64)
        for n in np.unique(w.count[short]):
            of_n = w.count[short] == n
            extra[of_n] = combine(h, w.of[short[of_n]], int(n))
        value, doc = np.concatenate([value, extra]), np.concatenate([doc, short])
    return distinct(doc, value, len(texts))
