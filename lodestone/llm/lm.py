"""Language-model scoring with an Elias-Fano n-gram trie of order 3.

Tokens are the lower-cased words of a text and one end. The model is interpolated with
Dirichlet back-off weights:

    p(w)         = (c(w) + 1) / (N + V + 1)
    p(w | v)     = (c(v w) + k2 p(w)) / (c(v) + k2)
    p(w | u v)   = (c(u v w) + k3 p(w | v)) / (c(u v) + k3)

where a context that training lacks leaves all to the lower order, and one of two words that
occurs fewer than ``min_context`` times is pruned. Every text follows an end. All orders sum
to one.

A trie shard holds whole contexts: its levels are the last word of a context, the word before
that (for two words), and the successors of the context. Levels and pointers between them are
monotone sequences in Elias-Fano form; an n-gram is found by a successor search inside its
context's range on each level. Beside the last level lie the quantised log probabilities
c / (T + k) of the n-grams, beside the one above the quantised back-off weights k / (T + k),
T being the context's count. The levels are flat arrays that are used from a memory map, of
memory alone inside a task, or of a file that was saved.

The corpus is cut into segments. In three exchanges, a segment sends its distinct words, pairs
and triples with their counts in training documents, as sorted runs to hash buckets, and each
bucket answers each of its runs:

* words: exact counts and dense numbers, in which the other runs are written;
* pairs and triples: the bucket sums the runs, builds its shard of the trie, and looks up each
  run's n-grams in it.

A bucket is chosen by the context. How often a context occurs is known to all segments from
the exchange before; one with more than a bucket's fair share is cut by its successors into
as many parts as it has shares, and its count travels along.
"""

from __future__ import annotations

import mmap
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _segments, _spark, _text

_U = np.uint64
#: Fingerprint of the end of a text, which is the context of the first word too.
END = _text.mix(np.array([0xE4D0], _U))[0]
_CODES = 1 << 16


#: Position of the k-th one in a byte.
_SELECT = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _at = [i for i in range(8) if _byte >> i & 1]
    _SELECT[_byte, : len(_at)] = _at


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``: low bits packed, high bits
    in unary; access and search go through a count of ones before each byte of these."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        v = values.astype(_U)
        low_bits = max(0, int(np.floor(np.log2(universe / n)))) if n and universe > n else 0
        low = np.zeros(8, np.uint8)
        if low_bits:
            bits = ((v[:, None] >> np.arange(low_bits, dtype=_U)) & _U(1)).astype(np.uint8).ravel()
            low = np.append(np.packbits(bits, bitorder="little"), low)  # 8 bytes behind, so that a window can be read
        high = (v >> _U(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        self._set(n, low_bits, low, np.packbits(bits, bitorder="little"))

    def _set(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._ones = np.zeros(len(high) + 1, np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(np.bitwise_count(high), out=self._ones[1:])

    @classmethod
    def from_parts(cls, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> "EliasFano":
        out = cls.__new__(cls)
        out._set(n, low_bits, low, high)
        return out

    def get(self, i: np.ndarray | int) -> np.ndarray:
        """Values at places i, by select on the unary part."""
        i = np.asarray(i, np.int64)
        byte = np.searchsorted(self._ones, i, "right") - 1
        out = (byte * 8 + _SELECT[self.high[byte], i - self._ones[byte]] - i).astype(_U) << _U(self.low_bits)
        if self.low_bits:
            bit = i * self.low_bits
            first, window = bit >> 3, np.zeros(i.shape, _U)
            for j in range((self.low_bits + 14) // 8):
                window |= self.low[first + j].astype(_U) << _U(8 * j)
            out |= (window >> (bit & 7).astype(_U)) & _U((1 << self.low_bits) - 1)
        return out

    def successor(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each value the first place in lo..hi that holds at least it; hi if none does."""
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            less = self.get(mid) < value[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


_STEP = 16 / (_CODES - 2)


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes, from 1 up, of probabilities by their logarithm, in steps of 0.06 %; 0 of zero."""
    with np.errstate(divide="ignore"):
        code = np.round(-np.log10(p) / _STEP) + 1
    return np.where(p > 0, np.clip(code, 1, _CODES - 1), 0).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) * _STEP), 0.0)


def _new(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each level, which rows of sorted columns begin another prefix."""
    out, changed = [], np.zeros(len(columns[0]), bool)
    for c in columns:
        changed = changed.copy()
        changed[:1] = True
        changed[1:] |= c[1:] != c[:-1]
        out.append(changed)
    return out


class Trie:
    """A shard over distinct n-grams in columns (last word of the context first, the successor
    last), in lexical order, with the codes of their log probabilities and of the back-off
    weights of their contexts."""

    def __init__(self, columns: list[np.ndarray], codes: np.ndarray, backoff: np.ndarray):
        self.levels, self.pointers = [], []
        new = _new(columns)
        parents = np.zeros(len(columns[0]), np.int64)
        for j, c in enumerate(columns):
            at = np.flatnonzero(new[j])
            # the successors of the k-th prefix are lifted by k times 2**32: one sequence
            lifted = c[at].astype(_U) + (parents[at].astype(_U) << _U(32))
            self.levels.append(EliasFano(lifted, (int(parents[-1]) + 1 if len(c) else 1) << 32))
            if j:
                first = np.flatnonzero(new[j - 1][at])
                self.pointers.append(EliasFano(np.append(first, len(at)), len(at) + 1))
            parents = np.cumsum(new[j]) - 1
        self.codes, self.backoff = codes, backoff

    def find(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams on the last level, and of their contexts on the one above; -1 for
        those not there."""
        n = len(columns[0])
        new = _new(columns)  # what follows with the same prefix is looked for once
        run, parent = np.zeros(n, np.int64), np.zeros(1, np.int64)
        lo, hi = np.zeros(1, np.int64), np.full(1, self.levels[0].n, np.int64)
        context = np.full(n, -1, np.int64)
        for j, c in enumerate(columns):
            at = np.flatnonzero(new[j])
            above = run[at]  # the prefix's place among those of the level above
            alive = np.flatnonzero(parent[above] >= 0)
            above = above[alive]
            want = c[at[alive]].astype(_U) + (parent[above].astype(_U) << _U(32))
            first, last = lo[above], hi[above]
            i = self.levels[j].successor(want, first, last)
            hit = np.flatnonzero(i < last)
            hit = hit[self.levels[j].get(i[hit]) == want[hit]]
            parent = np.full(len(at), -1, np.int64)
            parent[alive[hit]] = i[hit]
            run = np.cumsum(new[j]) - 1
            if j < len(self.pointers):
                there = np.maximum(parent, 0)
                lo, hi = (self.pointers[j].get(np.minimum(there + d, self.pointers[j].n - 1)).astype(np.int64) for d in (0, 1))
            if j == len(columns) - 2:
                context = parent[run]
        return parent[run], context

    def lookup(self, columns: list[np.ndarray]) -> np.ndarray:
        """Codes of n-grams; 0 for those not there."""
        if not len(self.codes) or not len(columns[0]):  # an empty level has no pointers
            return np.zeros(len(columns[0]), np.uint16)
        at, _ = self.find(columns)
        return np.where(at >= 0, self.codes[at], 0).astype(np.uint16)

    def _bytes(self) -> bytes:
        parts = [np.array([len(self.levels)], np.int64)]
        for ef in (*self.levels, *self.pointers):
            parts += [np.array([ef.n, ef.low_bits], np.int64), ef.low, ef.high]
        parts += [self.codes, self.backoff]
        head = np.array([len(parts), *(x.nbytes for x in parts)], np.int64)
        return head.tobytes() + b"".join(x.tobytes() for x in parts)

    def save(self, path: str) -> None:
        Path(path).write_bytes(self._bytes())

    @classmethod
    def _over(cls, m: mmap.mmap) -> "Trie":
        k = int(np.frombuffer(m, np.int64, 1)[0])
        sizes = np.frombuffer(m, np.int64, k, 8)
        at = 8 * (k + 1) + np.append(0, np.cumsum(sizes))
        part = [np.frombuffer(m, np.uint8, int(n), int(a)) for n, a in zip(sizes, at)]
        ef = []
        for i in range(1, k - 2, 3):
            n, low_bits = np.frombuffer(part[i].tobytes(), np.int64)
            ef.append(EliasFano.from_parts(int(n), int(low_bits), part[i + 1], part[i + 2]))
        out = cls.__new__(cls)
        levels = int(np.frombuffer(part[0].tobytes(), np.int64)[0])
        out.levels, out.pointers = ef[:levels], ef[levels:]
        out.codes, out.backoff = (np.frombuffer(x.tobytes(), np.uint16) for x in part[-2:])
        return out

    def mapped(self) -> "Trie":
        """The same trie over an anonymous memory map: one block, and no file on any disk."""
        data = self._bytes()
        m = mmap.mmap(-1, len(data))
        m.write(data)
        return Trie._over(m)

    @classmethod
    def open(cls, path: str) -> "Trie":
        """The trie over a read-only memory map of a file that save() wrote."""
        with open(path, "rb") as f:
            return cls._over(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them. Faster than a sort of
    all values where most are repeated, as words are."""
    code, some = pd.factorize(values)
    order = np.argsort(some)
    rank = np.empty(len(some), np.int64)
    rank[order] = np.arange(len(some))
    return some[order], rank[code]


def _first(place: np.ndarray, n: int) -> np.ndarray:
    """Where each of n values comes first."""
    out = np.empty(n, np.int64)
    out[place[::-1]] = np.arange(len(place))[::-1]
    return out


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(blob: bytes) -> np.ndarray:
    width = blob[0]
    out = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel().astype(_U)


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Sorted distinct n-grams: each level's values once for each prefix, and bits that say
    where prefixes begin on the level below."""
    new = _new(columns)
    parts = []
    for j, c in enumerate(columns):
        at = np.flatnonzero(new[j])
        values = c[at].astype(_U)
        parts.append(_narrow(np.diff(values, prepend=_U(0)) if j == 0 else values))
        if j:
            parts.append(np.packbits(new[j - 1][at]).tobytes())
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, k, 8)
    at = 8 * (k + 1) + np.append(0, np.cumsum(sizes))
    parts = [blob[a:b] for a, b in zip(at[:-1], at[1:])]
    columns = [np.cumsum(_wide(parts[0]), dtype=_U)]
    for values, bits in zip(parts[1::2], parts[2::2]):
        values = _wide(values)
        parent = np.cumsum(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(values))) - 1
        columns = [c[parent] for c in columns] + [values]
    return columns


def _pack_counts(c: np.ndarray) -> bytes:
    """One byte a count; larger ones follow as (index, count)."""
    large = np.flatnonzero(c > 254)
    return len(large).to_bytes(8, "little") + np.where(c > 254, 255, c).astype(np.uint8).tobytes() + np.stack([large, c[large]]).astype(np.int64).tobytes()


def _unpack_counts(blob: bytes, n: int) -> np.ndarray:
    large = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    if large:
        at, value = np.frombuffer(blob, np.int64, 2 * large, 8 + n).reshape(2, -1)
        out[at] = value
    return out


#: Sorted n-grams of a segment for a bucket, their training counts, and (context, count) of
#: contexts that are cut into parts.
RUN = "kind int, bucket int, seg int, keys binary, counts binary, cut binary"
_RUN = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("seg", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("cut", pa.binary())])
ANSWER = "seg int, kind int, bucket int, values binary, numbers binary, n long, v long"


@dataclass(frozen=True)
class Shape:
    """What all steps have to agree on."""

    buckets: int
    k2: float
    k3: float
    min_context: int
    tokens: int = 0
    vocabulary: int = 0

    def parts(self, total: np.ndarray) -> np.ndarray:
        """Into how many parts a context of this count is cut."""
        return np.maximum(1, np.ceil(2 * total * self.buckets / max(self.tokens, 1))).astype(np.int64)

    def bucket(self, context: np.ndarray, word: np.ndarray, total: np.ndarray) -> np.ndarray:
        part = word.astype(np.int64) % self.parts(total)
        return (_text.mix(context * _U(0x9FB21C651E98DF25) + part.astype(_U)) >> _U(33)).astype(np.int64) % self.buckets


class Segment:
    """A segment's tokens, and their n-grams as far as answers are there."""

    def __init__(self, table: pa.Table, shape: Shape):
        self.shape, self.seg = shape, table.column("seg")[0].as_py() if table.num_rows else 0
        words, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for chunk in table.column("text").chunks:
            for a, b in _text.slices(chunk):
                w = _text.Words(chunk.slice(a, b - a))
                words.append(np.insert(w.hashes(lower=True), w.of[1:], END))
                counts.append(w.count + 1)
        self.count = np.concatenate(counts)
        self.training = np.array(table.column("train").to_pylist(), bool)
        self.offsets = np.append(0, np.cumsum(self.count))
        self.train = np.repeat(self.training, self.count)
        self.words, self.place = _distinct(np.concatenate(words))

    def word_run(self) -> list[dict]:
        cuts = _segments.bucket_cuts(self.words, self.shape.buckets)
        n = np.bincount(self.place[self.train], minlength=len(self.words))
        return [
            {"kind": 1, "bucket": int(b), "seg": self.seg, "keys": _segments.pack_keys(self.words[cuts[b] : cuts[b + 1]]), "counts": _pack_counts(n[cuts[b] : cuts[b + 1]]), "cut": b""}
            for b in np.flatnonzero(np.diff(cuts))
        ]

    def take(self, answers: list[tuple[int, int, bytes, bytes]]) -> None:
        """Takes (kind, bucket, values, numbers) in, as far as there are any."""
        cuts = _segments.bucket_cuts(self.words, self.shape.buckets)
        c, number = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), _U)
        for _, b, values, numbers in (x for x in answers if x[0] == 1):
            part = slice(cuts[b], cuts[b + 1])
            c[part] = _unpack_counts(values, int(cuts[b + 1] - cuts[b]))
            number[part] = np.cumsum(_wide(numbers), dtype=_U) * _U(self.shape.buckets) + _U(b)
        c, number = c[self.place], number[self.place].astype(np.uint32)
        self.c = c
        del self.place, self.words
        self.first = self.offsets[:-1]
        end = c[-1] if len(c) else 0
        before = np.empty_like(number)  # each text follows an end
        before[1:], before[:1] = number[:-1], number[-1:]
        self.total = np.empty_like(c)
        self.total[1:], self.total[:1] = c[:-1], end
        pairs = np.flatnonzero((c > 0) & (self.total > 0))
        self.pairs = self._level(2, pairs, [before, number], before[pairs].astype(_U), self.total[pairs])
        if not any(x[0] == 2 for x in answers):
            return
        self.two = self._codes(self.pairs, answers, 2)
        seen = np.round(dequantise(self.two) * (self.total + self.shape.k2)).astype(np.int64)
        self.context = np.zeros_like(seen)
        self.context[1:] = seen[:-1]
        self.context[self.first] = 0
        self.context[self.context < self.shape.min_context] = 0
        earlier = np.zeros_like(before)
        earlier[1:] = before[:-1]
        triples = np.flatnonzero((self.two > 0) & (self.context > 0))
        both = _text.mix((before[triples].astype(_U) << _U(32)) | earlier[triples])
        self.triples = self._level(3, triples, [before, earlier, number], both, self.context[triples])
        self.three = self._codes(self.triples, answers, 3)

    def _level(self, kind: int, at: np.ndarray, columns: list[np.ndarray], context: np.ndarray, total: np.ndarray) -> tuple:
        """Distinct n-grams of the tokens ``at`` in the order of buckets, and what they come from."""
        rank = np.zeros(len(at), np.int64)
        if kind == 3:
            _, rank = np.unique((columns[0][at].astype(_U) << _U(32)) | columns[1][at], return_inverse=True)
        else:
            rank = columns[0][at].astype(np.int64)
        key, place = np.unique((rank.astype(_U) << _U(32)) | columns[-1][at], return_inverse=True)
        one = _first(place, len(key))
        bucket = self.shape.bucket(context[one], columns[-1][at[one]], total[one])
        order = np.argsort(bucket.astype(np.uint16 if self.shape.buckets <= 1 << 16 else np.int64), kind="stable")
        return kind, at, one, place, order, np.searchsorted(bucket[order], np.arange(self.shape.buckets + 1)), columns, total

    def run(self, level: tuple) -> list[dict]:
        kind, at, one, place, order, cuts, columns, total = level
        n = np.bincount(place[self.train[at]], minlength=len(one))
        out = []
        for b in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[b] : cuts[b + 1]]
            cols = [c[at[one[mine]]] for c in columns]
            parts = np.flatnonzero(self.shape.parts(total[one[mine]]) > 1)
            cut = np.stack([*(c[parts].astype(np.int64) for c in cols[:-1]), total[one[mine[parts]]]])
            cut = np.unique(cut, axis=1).tobytes() if len(parts) else b""
            out.append({"kind": kind, "bucket": int(b), "seg": self.seg, "keys": pack_columns(cols), "counts": _pack_counts(n[mine]), "cut": cut})
        return out

    def _codes(self, level: tuple, answers: list[tuple[int, int, bytes, bytes]], kind: int) -> np.ndarray:
        """The code of each token's n-gram; 0 where there is none."""
        _, at, one, place, order, cuts, _, _ = level
        value = np.zeros(len(one), np.uint16)
        for _, b, values, _ in (x for x in answers if x[0] == kind):
            value[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(values, np.uint16)
        out = np.zeros(len(self.c), np.uint16)
        out[at] = value[place]
        return out

    def probabilities(self) -> tuple[np.ndarray, np.ndarray]:
        """p(w), and p of every token under the whole model."""
        s = self.shape
        low = (self.c + 1) / (s.tokens + s.vocabulary + 1)
        p = low
        for kind, codes, total, k in ((2, "two", self.total, s.k2), (3, "three", None, s.k3)):
            if hasattr(self, codes):
                total = self.context if kind == 3 else total
                p = np.where(total > 0, dequantise(getattr(self, codes)) + k / (total + k) * p, p)
        return low, p


def _answers(table: pa.Table) -> list[tuple[int, int, bytes, bytes]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "values", "numbers"))))


def _send_words(shape: Shape):
    return lambda table: pa.Table.from_pylist(Segment(table, shape).word_run(), _RUN)


def _send(kind: int, shape: Shape):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], _RUN)
        segment = Segment(table, shape)
        segment.take(_answers(answers))
        level = segment.pairs if kind == 2 else getattr(segment, "triples", None)
        return pa.Table.from_pylist(segment.run(level) if level else [], _RUN)

    return send


def _answer_words(table: pa.Table) -> pa.Table:
    keys = [_segments.unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unpack_counts(x, len(k)) for x, k in zip(table.column("counts").to_pylist(), keys)])
    word, place = _distinct(np.concatenate(keys))
    total = np.bincount(place, counts, minlength=len(word)).astype(np.int64)
    at = np.append(0, np.cumsum([len(k) for k in keys]))
    out = []
    for i, (seg, bucket) in enumerate(zip(table.column("seg").to_pylist(), table.column("bucket").to_pylist())):
        mine = place[at[i] : at[i + 1]]  # sorted, as the run is
        out.append({"seg": seg, "kind": 1, "bucket": bucket, "values": _pack_counts(total[mine]), "numbers": _narrow(np.diff(mine, prepend=0)), "n": int(total.sum()), "v": int((total > 0).sum())})
    return pa.Table.from_pylist(out, _ANSWER)


_ANSWER = pa.schema([("seg", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("values", pa.binary()), ("numbers", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def build_shard(columns: list[np.ndarray], counts: np.ndarray, k: float, cut: list[np.ndarray]) -> Trie:
    """The trie of distinct, sorted n-grams with their counts; ``cut`` gives (context, count)
    of contexts that have successors in other shards too."""
    some = np.flatnonzero(counts)
    columns, counts = [c[some] for c in columns], counts[some]
    if not len(some):
        return Trie([np.zeros(0, _U)] * len(columns), np.zeros(0, np.uint16), np.zeros(0, np.uint16))
    begins = _new(columns)[-2]
    context = np.cumsum(begins) - 1
    total = np.bincount(context, counts)
    known = {tuple(x[:-1]): x[-1] for part in cut for x in part.T.tolist()}
    if known:
        for i, row in enumerate(zip(*(c[np.flatnonzero(begins)].tolist() for c in columns[:-1]))):
            total[i] = known.get(row, total[i])
    return Trie(columns, quantise(counts / (total[context] + k)), quantise(k / (total + k)))


def _answer(shape: Shape):
    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        runs = [unpack_columns(x) for x in table.column("keys").to_pylist()]
        lengths = [len(r[0]) for r in runs]
        columns = [np.concatenate(c) for c in zip(*runs)]
        counts = np.concatenate([_unpack_counts(x, n) for x, n in zip(table.column("counts").to_pylist(), lengths)])
        cut = [np.frombuffer(x, np.int64).reshape(kind, -1) for x in table.column("cut").to_pylist() if x]
        rank = columns[0]
        if kind == 3:
            _, rank = np.unique((columns[0] << _U(32)) | columns[1], return_inverse=True)
        key, place = np.unique((rank.astype(_U) << _U(32)) | columns[-1], return_inverse=True)
        one = _first(place, len(key))
        distinct = [c[one] for c in columns]
        total = np.bincount(place, counts, minlength=len(one)).astype(np.int64)
        trie = build_shard(distinct, total, shape.k2 if kind == 2 else shape.k3, cut).mapped()
        values = trie.lookup(distinct)[place]
        at = np.append(0, np.cumsum(lengths))
        rows = [
            {"seg": seg, "kind": kind, "bucket": bucket, "values": values[a:b].tobytes(), "numbers": b"", "n": 0, "v": 0}
            for seg, bucket, a, b in zip(table.column("seg").to_pylist(), table.column("bucket").to_pylist(), at[:-1], at[1:])
        ]
        return pa.Table.from_pylist(rows, _ANSWER)

    return answer


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shape: Shape):
    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        s = Segment(table, shape)
        s.take(_answers(answers))
        low, p = s.probabilities()
        return pa.table({
            "doc_id": table.column("doc_id"),
            "held_out": pa.array(~s.training),
            "n_tokens": pa.array(s.count.astype(np.int64)),
            "n_known": pa.array(_text.per_text(s.c > 0, s.offsets)),
            "train_tokens": pa.array(np.full(len(s.count), shape.tokens, np.int64)),
            "base_score": pa.array(_text.per_text(np.log10(low), s.offsets)),
            "score": pa.array(_text.per_text(np.log10(p), s.offsets)),
        })

    return score


def score_texts(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", k2: float = 4.0, k3: float = 4.0, min_context: int = 4) -> DataFrame:
    """SCORES for every document, under the model of those for which ``train`` is true.

    ``k2`` and ``k3`` are the weights of the lower orders; a context of two words needs
    ``min_context`` occurrences to have successors of its own.

    A null text is empty: one token, the end. A null ``train`` counts as false. Documents
    without training data score by the uniform lower order. Repeated rows count as often as
    they occur; a null doc_id stays null. Empty tables give an empty result; other columns
    are ignored. Texts are taken whole; one text must fit in memory.
    """
    spark = docs.sparkSession
    _spark.ship(spark)
    scratch = _spark.Scratch(spark)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = _segments.segment_count(docs, text)
    shape = Shape(n, k2, k3, min_context)
    seg = plain.withColumn("seg", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int")).repartition(n, "seg")

    def asked(runs: DataFrame, answer) -> DataFrame:
        return runs.repartition(n, "bucket").groupBy("bucket").applyInArrow(answer, ANSWER)

    answers = scratch.put(asked(seg.groupBy("seg").applyInArrow(_send_words(shape), RUN), _answer_words), "words")
    # a bucket says its sums in each of its answers
    row = answers.groupBy("bucket").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.sum("n"), F.sum("v")).first()
    shape = Shape(n, k2, k3, min_context, int(row[0] or 0), int(row[1] or 0))
    if shape.vocabulary >= 1 << 30:
        raise ValueError("word numbers of 32 bits hold at most 2**30 training words")
    for kind in (2, 3):
        runs = seg.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(_send(kind, shape), RUN)
        answers = answers.union(scratch.put(asked(runs, _answer(shape)), f"grams-{kind}"))
    return seg.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(_score(shape), SCORES)
