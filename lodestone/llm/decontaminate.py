"""Benchmark decontamination: containment of short test items in long documents.

Similarity of an item to a whole document is near zero, however plainly the document quotes
it, so documents are not sketched; what is asked is how much of the *item* they contain.
Items are partitioned by the size of their shingle set, in classes of at most a quarter's
growth. Every item of a class gives the class's number of bottom-k MinHash values, chosen
so large that a document that contains 80 % of the item's shingles must contain one of
them: of n shingles fewer than n - ceil(0.8 n) + 1 may be missing. Probing all shingles of
a document against these values therefore finds every such document, and each candidate is
then verified by exact containment, on the words themselves.

The items are a stated query set, taken in blocks of bounded size; each block is broadcast
and all documents stream past it, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(_text.LOWER)
#: Items in a block: with some hundred words each, a block takes tens of MB.
BLOCK_ITEMS = 20_000


def word_shingles(text: str | None, k: int) -> set[bytes]:
    """Distinct k-word shingles, lower-cased A-Z; the whole sequence if it is shorter."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def size_class(n: int) -> int:
    """Largest size of the class of n: classes end at powers of 1.25, rounded down."""
    upper = 1
    while upper < n:
        upper = max(upper + 1, int(upper * 1.25))
    return upper


def sketch_size(upper: int, percent: int) -> int:
    """Values that an item of up to ``upper`` shingles must give."""
    return upper - math.ceil(upper * percent / 100) + 1


class ItemIndex:
    """Bottom-k values of items, by shingle length, and the items for verification."""

    def __init__(self, items: list[tuple[int, str | None]], k: int, percent: int):
        self.k, self.percent = k, percent
        self.items = [(i, s, len(next(iter(s)).split(b" "))) for i, t in items if (s := word_shingles(t, k))]
        posts: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for place, (_, shingles, length) in enumerate(self.items):
            w = _text.Words(pa.array([x.decode() for x in shingles]))
            values, _ = w.grams(w.hashes(), length)
            posts[length].append((np.sort(values)[: sketch_size(size_class(len(shingles)), percent)], place))
        self.posts = {}
        for length, found in posts.items():
            value = np.concatenate([v for v, _ in found])
            place = np.repeat([p for _, p in found], [len(v) for v, _ in found])
            order = np.argsort(value, kind="stable")
            self.posts[length] = value[order], place[order]

    def candidates(self, texts: pa.Array) -> list[tuple[int, int]]:
        """(text, item) with a common value."""
        w = _text.Words(texts)
        h = w.hashes(lower=True)
        out: set[tuple[int, int]] = set()
        for length, (value, place) in self.posts.items():
            gram, at = w.grams(h, length)
            lo = np.searchsorted(value, gram)
            hit = np.flatnonzero(value[np.minimum(lo, len(value) - 1)] == gram)
            if len(hit):
                pairs = np.unique(np.stack([w.doc(at[hit]), lo[hit]]), axis=1)
                for doc, first in pairs.T:
                    last = np.searchsorted(value, value[first], "right")
                    out.update((int(doc), int(p)) for p in place[first:last])
        return sorted(out)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item place, shingles of the item, of these in the text), verified."""
        out, have, cached = [], {}, None
        for doc, place in self.candidates(texts):
            _, shingles, length = self.items[place]
            if doc != cached:
                cached, have = doc, {}
            if length not in have:
                words = _WORD.findall(texts[doc].as_py().encode().translate(_LOWER))
                have[length] = {b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)}
            shared = len(shingles & have[length])
            if 100 * shared >= self.percent * len(shingles):
                out.append((doc, place, len(shingles), shared))
        return out


def _blocks(items: DataFrame, item_text: str, item_id: str, shingle: int, percent: int) -> Iterator[ItemIndex]:
    plain = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    n = max(1, math.ceil(plain.count() / BLOCK_ITEMS))
    for b in range(n):
        part = plain.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else plain
        yield ItemIndex([tuple(r) for r in part.collect()], shingle, percent)


HITS = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """HITS: every (document, item) where the document contains at least ``percent`` % of the
    item's distinct shingles of ``shingle`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased).

    An item of fewer words is one shingle, its whole sequence. Items and documents that are
    null or have no words match nothing. Rows repeated in either table give repeated hits;
    null ids stay null. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    _spark.ship(spark)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = spark.createDataFrame([], HITS)
    for index in _blocks(items, item_text, item_id, shingle, percent):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for a, b in _text.slices(batch.column(1)):
                    part = batch.slice(a, b - a)
                    found = index.matches(part.column(1))
                    if found:
                        doc, place, size, both = (np.array(x) for x in zip(*found))
                        item = pa.array([index.items[p][0] for p in place], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), item, pa.array(size), pa.array(both), pa.array(both / size)], [x.split()[0] for x in HITS.split(", ")])

        found = plain.mapInArrow(run, HITS)
        out = found if out.isLocal() else out.union(found)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows, with all their columns, that contaminated() does not report."""
    spark = docs.sparkSession
    _spark.ship(spark)
    names = docs.columns
    for index in _blocks(items, item_text, item_id, shingle, percent):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(names.index(text))
                keep = np.ones(batch.num_rows, bool)
                for a, b in _text.slices(texts):
                    keep[[a + x[0] for x in index.matches(texts.slice(a, b - a))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
