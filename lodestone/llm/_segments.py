"""Segments of documents, and sorted runs of fingerprints exchanged between them.

A segment is a bounded set of whole documents (some megabytes of text). What it asks of the
rest of the corpus goes out as one sorted run of distinct fingerprints, cut into hash
buckets; the answer to a run is an array aligned with it, so that no fingerprint travels
twice and no document's words ever become rows. A fingerprint that a third of all documents
contain costs each segment one entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Stored (compressed) bytes of the documents in a segment.
SEGMENT_BYTES = 8e6


def segment_count(docs: DataFrame, text: str) -> int:
    return _spark.parts_for(_spark.stored_bytes(docs, text), SEGMENT_BYTES, docs.sparkSession)


def by_hash(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def by_range(docs: DataFrame, key: str, n: int) -> Column:
    """Segment numbers that ascend with the key; null keys come last. The bounds come from a
    sample of about 32 keys for each segment, as any range partitioning does; they decide
    how even segments are, not what they contain together."""
    total = docs.select(key).where(F.col(key).isNotNull()).count()
    share = min(1.0, 32 * n / max(total, 1))
    keys = docs.select(key).where(F.col(key).isNotNull())
    keys = np.sort((keys.sample(share, 7) if share < 1 else keys).toArrow().column(0).to_numpy())
    bounds = np.unique(keys[np.linspace(0, len(keys) - 1, n + 1).astype(int)[1:-1]]) if len(keys) else keys

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.full(len(ids), len(bounds) + 1, np.int32)
        out[known] = np.searchsorted(bounds, ids[known].astype("int64"), "right")
        return pd.Series(out)

    return place(F.col(key))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of six bytes, or eight where one is larger."""
    d = np.diff(keys, prepend=np.uint64(0))
    first, d = d[:1], d[1:]
    small = not len(d) or int(d.max()) < 1 << 48
    body = d.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if small else d.tobytes()
    return (b"\6" if small else b"\10") + first.tobytes() + body


def unpack_keys(blob: bytes) -> np.ndarray:
    width = blob[0]
    first, body = np.frombuffer(blob, np.uint64, 1, 1) if len(blob) > 1 else np.zeros(0, np.uint64), np.frombuffer(blob, np.uint8, offset=min(9, len(blob)))
    if not len(first):
        return first
    d = np.zeros((len(body) // width + 1, 8), np.uint8)
    d[1:, :width] = body.reshape(-1, width)
    out = d.view(np.uint64).ravel()
    out[0] = first[0]
    return np.cumsum(out, dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal ranges of the key space begins in sorted keys."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))
