"""Sequence packing: minimum bin slack over remaining lengths, with exact subset sums.

Each task packs the documents of its own partition, so nothing is shuffled. Token ids come
from a public byte-level BPE vocabulary. A document of more tokens than a window first
fills whole windows; what remains of it waits in a bounded pool. From the pool a bitset
subset-sum dynamic programme chooses, for one window after another, the multiset of
remaining lengths that comes closest to the capacity, always containing the longest; the
chosen multiset is found by backtracking through the bitsets, as a count for each distinct
length. A window that the pool cannot fill is topped up with a cut of the document that
leaves the least behind, so that only the last window of a partition is short; it is split
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Remainders that wait in a task at once, and their tokens; more start the packing.
POOL_DOCS, POOL_TOKENS = 512, 2_000_000
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts under a byte-level BPE vocabulary.

    The vocabulary is read from the file of the ``tokenizers`` library, and the merges are
    run by ``tiktoken``, whose ids are the same and several times faster to get (the tests
    hold one against the other). Its regular expressions give up on runs of a million white
    spaces; such a text is encoded by ``tokenizers`` itself."""

    def __init__(self, path: str):
        import tiktoken

        self._path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._core = tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self._special = set(special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.frombuffer(self._core.encode_to_tiktoken_buffer(text, self._special), np.uint32)
        except ValueError:  # the expression's stack is bounded
            if self._slow is None:
                import tokenizers

                self._slow = tokenizers.Tokenizer.from_file(self._path)
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Slack:
    """A multiset of lengths, each at most ``capacity``, from which fill() takes one window."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: dict[int, int] = defaultdict(int)

    def fill(self) -> dict[int, int]:
        """Counts of the lengths of the fullest window that holds the longest length."""
        first = max(self.count)
        room = self.capacity - first
        mask = (1 << (room + 1)) - 1
        reach, steps, before = 1, [], []
        for length in sorted((x for x in self.count if x <= room), reverse=True):
            left = self.count[length] - (length == first)
            k = 1
            while left > 0 and k * length <= room:  # binary splitting of the count
                k_now = min(k, left)
                before.append(reach)
                steps.append((length, k_now))
                reach |= (reach << (length * k_now)) & mask
                left -= k_now
                k *= 2
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        taken: dict[int, int] = defaultdict(int)
        taken[first] = 1
        for (length, k), was in zip(reversed(steps), reversed(before)):
            if not was >> at & 1:
                taken[length] += k
                at -= length * k
        for length, k in taken.items():
            self.count[length] -= k
            if not self.count[length]:
                del self.count[length]
        return dict(taken)


class Packer:
    """Packs a stream of (doc, ids) into pieces; sequence ids start at ``base``."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.sequence = capacity, base
        self.slack, self.pool = Slack(capacity), defaultdict(list)
        self.docs = self.tokens = 0

    def piece(self, item: tuple, start: int, length: int, offset: int) -> tuple:
        doc, ids, at, total = item
        part = ids[start - at : start - at + length]
        return (doc, start, length, zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, offset)

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        start, total = 0, len(ids)
        while total - start >= self.capacity:
            yield self.piece((doc, ids, 0, total), start, self.capacity, 0)
            self.sequence += 1
            start += self.capacity
        if start < total:
            self.wait((doc, ids[start:].copy() if start else ids, start, total))
        while self.docs >= POOL_DOCS or self.tokens >= POOL_TOKENS:
            yield from self.window()

    def wait(self, item: tuple) -> None:
        length = item[3] - item[2]
        self.slack.count[length] += 1
        self.pool[length].append(item)
        self.docs += 1
        self.tokens += length

    def take(self, length: int) -> tuple:
        item = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.docs -= 1
        self.tokens -= length
        return item

    def window(self) -> Iterator[tuple]:
        """One full window, or what is left if that is less."""
        offset = 0
        for length, k in sorted(self.slack.fill().items(), reverse=True):
            for _ in range(k):
                yield self.piece(item := self.take(length), item[2], length, offset)
                offset += length
        room = self.capacity - offset
        if room and self.slack.count:  # cut the longest to close the gap
            length = max(self.slack.count)
            self.slack.count[length] -= 1
            if not self.slack.count[length]:
                del self.slack.count[length]
            doc, ids, at, total = item = self.take(length)
            yield self.piece(item, at, room, offset)
            self.wait((doc, ids[room:], at + room, total))
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        while self.tokens >= self.capacity:
            yield from self.window()
        sizes = [1 << b for b in reversed(range(self.capacity.bit_length())) if self.tokens >> b & 1]
        items = sorted(chain.from_iterable(self.pool.values()), key=lambda x: -(x[3] - x[2]))
        offset = 0
        for item in items:
            at = item[2]
            while at < item[3]:
                n = min(sizes[0] - offset, item[3] - at)
                yield self.piece(item, at, n, offset)
                at, offset = at + n, offset + n
                if offset == sizes[0]:
                    sizes.pop(0)
                    self.sequence += 1
                    offset = 0
        self.pool.clear()
        self.docs = self.tokens = 0


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces (PIECES) of all documents packed into sequences of ``capacity`` tokens.

    A document is its token ids and then ``end_id``; a null text is empty, so it is that one
    id. A null doc_id stays null. Repeated rows are packed as often as they occur. An empty
    table has no pieces. Sequence ids are unique, with the task's partition in the upper 31
    bits; they are the same when a task is run again. ``tokenizer`` is a path that every
    executor has (the file belongs to an installed library).
    """
    _spark.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []

        def out(force: bool) -> Iterator[pa.RecordBatch]:
            if rows and (force or len(rows) >= 8192):
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                rows.clear()
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc, t in zip(ids, texts):
                rows.extend(packer.add(doc, np.append(encoder.encode(t.as_py() or ""), np.uint32(end_id))))
                yield from out(False)
        rows.extend(packer.finish())
        yield from out(True)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)
