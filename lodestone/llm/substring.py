"""Substring deduplication with a log-structured fingerprint index.

Documents are cut into segments of ascending doc_id. A segment writes the fingerprints of
all its windows as one sorted immutable run, cut into hash buckets. A bucket merge-joins its
runs in the order of the segments, behind the runs that the index holds of earlier batches,
and answers each run with one bit for each fingerprint: an earlier run has it. A hit is
verified by a second value of 16 bits, from hashes of the words' bytes under another table,
so a window is accepted on 80 bits of two independent hashes. With the bits, a segment decides its
windows in memory, together with repeats inside the segment. ``FingerprintIndex`` keeps the
runs of a batch, merged, as the index's next level, and compacts levels as they pile up.
``remove_in_batches`` passes a table through an index in two batches.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _segments, _spark, _text

#: Share of the rows, those of the smallest ids, that are the history of the rest.
HISTORY = 0.1
RUN = "bucket int, seg int, keys binary, checks binary"


def _windows(texts: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Keys, checks and texts of all windows, and first word of each in its segment."""
    texts = pa.chunked_array([texts]) if isinstance(texts, pa.Array) else texts
    out, done, words = [], 0, 0
    for chunk in texts.chunks:
        for a, b in _text.slices(chunk):
            w = _text.Words(chunk.slice(a, b - a))
            h = w.hashes()
            key, at = w.grams(h, width)
            check = (_text.combine(w.hashes(second=True), at, width) >> np.uint64(48)).astype(np.uint16)
            out.append((key, check, w.doc(at) + done, at + words))
            done, words = done + b - a, words + len(h)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _run(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check) sorted by key, and the place of every window among them."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    same = k[1:] == k[:-1]
    new[1:] = ~same
    if (same & (c[1:] != c[:-1])).any():  # one key, two windows
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], c[new], place


def _runs(width: int, buckets: int):
    def make(table: pa.Table) -> pa.Table:
        key, check, _, _ = _windows(table.column("text"), width)
        key, check, _ = _run(key, check)
        cuts = _segments.bucket_cuts(key, buckets)
        full = np.flatnonzero(np.diff(cuts))
        seg = table.column("seg")[0].as_py()
        return pa.table({
            "bucket": pa.array(full.astype(np.int32)),
            "seg": pa.array(np.full(len(full), seg, np.int32)),
            "keys": pa.array([_segments.pack_keys(key[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
            "checks": pa.array([check[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
        })

    return make


def _load(table: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Runs of a bucket in the order of their segments: segments, lengths, keys, checks."""
    table = table.sort_by("seg")
    keys = [_segments.unpack_keys(x) for x in table.column("keys").to_pylist()]
    checks = [np.frombuffer(x, np.uint16) for x in table.column("checks").to_pylist()]
    return table.column("seg").to_pylist(), [len(x) for x in keys], np.concatenate(keys), np.concatenate(checks)


def _merge(table: pa.Table) -> pa.Table:
    segs, lengths, key, check = _load(table)
    _, _, place = _run(key, check)
    # a fingerprint's first entry in the order of segments is its lowest index
    first = np.full(place.max() + 1 if len(place) else 0, len(key))
    first[place[::-1]] = np.arange(len(key))[::-1]
    seen = first[place] < np.arange(len(key))
    out, at = [], 0
    for seg, n in zip(segs, lengths):
        bits = seen[at : at + n]
        at += n
        if seg >= 0 and bits.any():
            out.append((seg, np.packbits(bits).tobytes()))
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"seg": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "bits": pa.array([x[1] for x in out], pa.binary())})


def _compact(table: pa.Table) -> pa.Table:
    """All runs of a bucket as one."""
    _, _, key, check = _load(table)
    key, check, _ = _run(key, check)
    return pa.table({"bucket": table.column("bucket").combine_chunks()[:1], "seg": pa.array([-1], pa.int32()), "keys": pa.array([_segments.pack_keys(key)], pa.binary()), "checks": pa.array([check.tobytes()], pa.binary())})


def _decide(width: int, buckets: int, digest: bool):
    def decide(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = table.column("doc_id")
        n = table.num_rows
        rank = ids.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy() if n else np.zeros(0, np.int64)
        key, check, doc, word = _windows(table.column("text"), width)
        key, check, place = _run(key, check)
        earlier = np.zeros(len(key), bool)
        cuts = _segments.bucket_cuts(key, buckets)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            size = cuts[b + 1] - cuts[b]
            earlier[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, place, rank[doc])
        gone = earlier[place] | (rank[doc] > least[place])
        n_words, n_removed, kept = [], [], []
        at, done = word[gone], 0
        for chunk in table.column("text").chunks:
            for a, b in _text.slices(chunk):
                w = _text.Words(chunk.slice(a, b - a))
                m = len(w.start)
                lo, hi = np.searchsorted(at, [done, done + m])
                covered = _text.cover(at[lo:hi] - done, width, m)
                done += m
                n_words.append(w.count)
                n_removed.append(_text.per_text(covered, w.of))
                kept += _joined(w, covered) if digest else _remaining(w, covered, chunk.slice(a, b - a))
        column = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.string())
        total = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (n_words, n_removed)]
        more = {c: table.column(c) for c in table.column_names if c == "kept_row"}
        return pa.table({"doc_id": ids, "n_words": pa.array(total[0]), "n_removed": pa.array(total[1]), "kept_sha256" if digest else "kept_text": column, **more})

    return decide


def _joined(w: _text.Words, covered: np.ndarray) -> list[memoryview]:
    """Each text's words that are left, joined by one space."""
    left = np.flatnonzero(~covered)
    mask = np.zeros(len(w.buf) + 1, np.int8)
    mask[w.start[left]] += 1
    mask[w.end[left]] -= 1
    keep = np.cumsum(mask[:-1], dtype=np.int8) > 0
    doc = w.doc(left)
    later = np.append(False, doc[1:] == doc[:-1])[: len(left)]
    keep[w.start[left[later]] - 1] = True
    out = memoryview(np.where(_text.SPACE[w.buf], 32, w.buf).astype(np.uint8)[keep].tobytes())
    ends = np.append(0, np.cumsum(keep))[w.off]
    return [out[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _remaining(w: _text.Words, covered: np.ndarray, texts: pa.Array) -> list[str | None]:
    """Each text without the removed words and the white space that follows them."""
    out = texts.to_pylist()
    hit = np.unique(w.doc(np.flatnonzero(covered)))
    for d in hit:
        a, b = w.of[d], w.of[d + 1]
        ends = np.append(w.start[a + 1 : b], w.off[d + 1])
        left = np.flatnonzero(~covered[a:b])
        parts = [w.buf[w.start[a + i] : ends[i]].tobytes() for i in left]
        out[d] = b"".join(parts).decode("utf-8").rstrip()
    return out


def _prepared(docs: DataFrame, text: str, doc_id: str, keep: tuple[str, ...]) -> DataFrame:
    more = [F.struct(*keep).alias("kept_row")] if keep else []
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def remove_repeats(docs: DataFrame, width: int = 13, text: str = "text", doc_id: str = "doc_id", digest: bool = False, index: "FingerprintIndex | None" = None, keep: tuple[str, ...] = (), segments: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every document: each word is removed that
    is covered by a window of ``width`` words whose word sequence also starts in a document
    with a smaller doc_id, or anywhere in the index's earlier batches.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are; windows are judged on the input.
    kept_text is the text without removed words and the white space behind them, unchanged
    if nothing is removed; with ``digest`` it is instead kept_sha256, of the kept words
    joined by one space. A null text has no words (kept_text null, kept_sha256 of nothing).
    Rows of one doc_id never remove words of each other; a null doc_id counts as larger than
    any other. Texts shorter than a window lose nothing. An empty table gives an empty
    result. Columns named in ``keep`` are returned in a struct kept_row; others are ignored.
    """
    spark = docs.sparkSession
    _spark.ship(spark)
    plain = _prepared(docs, text, doc_id, keep)
    n = segments or _segments.segment_count(docs, text)
    buckets = index.buckets if index else n
    # a text shuffle, used by both steps
    seg = plain.withColumn("seg", _segments.by_range(plain, "doc_id", n)).repartition(n, "seg")
    runs = seg.groupBy("seg").applyInArrow(_runs(width, buckets), RUN)
    if index:
        runs = index.begin(runs, width)
    answers = runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merge, "seg int, bucket int, bits binary")
    last = "kept_sha256 string" if digest else "kept_text string"
    out = T.StructType([*T._parse_datatype_string(f"doc_id long, n_words long, n_removed long, {last}").fields, *(f for f in plain.schema if f.name == "kept_row")])
    return seg.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(_decide(width, buckets, digest), out)


class FingerprintIndex:
    """The windows of all earlier batches, in immutable sorted runs under ``path``.

    ``remove_repeats(batch, index=index)`` judges a batch against them, and ``commit()``
    makes the batch's own runs part of the index, merged into one run for each bucket. As
    soon as there are more than ``most_runs`` levels, they are compacted into one. A batch that
    was not committed is ignored, so one that fails can simply be run again.

    The index is what its newest manifest file says: the levels, the number of buckets and the
    width of windows. Opening a folder that has one goes on from there, in any process; other
    settings than the manifest's are refused. A manifest is written under another name and then
    renamed, which of two writers only one can do. Nothing is deleted while results of earlier
    batches may still have to read it; ``vacuum()`` deletes what the manifest doesn't name.
    """

    def __init__(self, spark, path: str, buckets: int | None = None, most_runs: int = 4):
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs
        self.buckets, self.width = buckets or 64, None
        self.levels: list[str] = []
        self._new: DataFrame | None = None
        self._batch = ""
        self._serial = 0
        self._fs, self._root = self._file_system(self.path)
        found = max((int(name[9:]) for name in self._names() if name.startswith("manifest-")), default=0)
        if found:
            stream = self._fs.open(self._at(f"manifest-{found}"))
            try:
                kept = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            if buckets not in (None, kept["buckets"]):
                raise ValueError(f"the index under {path} has {kept['buckets']} buckets")
            self._serial, self.levels, self.buckets, self.width = found, kept["levels"], kept["buckets"], kept["width"]

    def _file_system(self, path: str):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._root)] if self._fs.exists(self._root) else []

    def _read(self, level: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.path}/{level}")

    def begin(self, runs: DataFrame, width: int) -> DataFrame:
        """The batch's runs behind the index's. If the batch is to be committed, that must
        happen before the next one begins."""
        if self.width not in (None, width):
            raise ValueError(f"the index under {self.path} holds windows of {self.width} words")
        self.width, self._new, self._batch = width, runs, ""
        out = runs
        for level in self.levels:
            out = out.union(self._read(level))
        return out

    def _merge_to(self, runs: DataFrame, name: str) -> str:
        runs.groupBy("bucket").applyInArrow(_compact, RUN).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def commit(self) -> None:
        if self._new is None:
            raise ValueError("there is no batch to commit")
        serial = self._serial + 1
        mine = uuid.uuid4().hex[:8]  # folders of a batch that failed are nobody's
        levels = [*self.levels, self._merge_to(self._new, f"level-{serial}-{mine}")]
        if len(levels) > self.most_runs:
            everything = self._read(levels[0])
            for level in levels[1:]:
                everything = everything.union(self._read(level))
            levels = [self._merge_to(everything, f"compacted-{serial}-{mine}")]
        stream = self._fs.create(self._at(f"new-{mine}"))
        try:
            stream.write(bytearray(json.dumps({"levels": levels, "buckets": self.buckets, "width": self.width}).encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(f"manifest-{serial}")) or not self._fs.rename(self._at(f"new-{mine}"), self._at(f"manifest-{serial}")):
            raise RuntimeError(f"another writer has committed to the index under {self.path}")
        self._serial, self.levels, self._new = serial, levels, None

    def vacuum(self) -> None:
        """Deletes what the newest manifest doesn't name. Results that were not read yet, of
        batches before it, can't be read afterwards."""
        for name in self._names():
            if name not in (*self.levels, f"manifest-{self._serial}"):
                self._fs.delete(self._at(name), True)


def remove_in_batches(docs: DataFrame, width: int = 13, text: str = "text", doc_id: str = "doc_id", digest: bool = False, history: float = HISTORY) -> DataFrame:
    """remove_repeats() of the whole table, passed through a fresh index in two batches: the
    rows of about the ``history`` smallest ids, whose runs become the index's first level, and
    the rest. The rows are the same as those of one batch."""
    scratch = _spark.Scratch(docs.sparkSession)
    key = F.col(doc_id).cast("long")
    bound = docs.select(key.alias("id")).approxQuantile("id", [history], 0.01)
    n = _segments.segment_count(docs, text)
    index = FingerprintIndex(docs.sparkSession, f"{scratch.root}/index", buckets=n)
    early = F.coalesce(key <= int(bound[0]), F.lit(False)) if bound else F.lit(False)
    few = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n * history))
    first = remove_repeats(docs.where(early), width, text, doc_id, digest, index, segments=few)
    index.commit()
    return first.union(remove_repeats(docs.where(~early), width, text, doc_id, digest, index, segments=n))
