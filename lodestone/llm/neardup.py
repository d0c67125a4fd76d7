"""MinHash near-duplicate detection with odd sketches and exact links.

1. One pass hashes every text's shingle set and gives its size, a 128-bit hash of the set,
   MinHash bands and an odd sketch: the (sample index, minimum) pairs folded into a parity
   bitmap. Equal sets form one class from here on, whose representative goes on alone.
2. In each band bucket every member is paired with the bucket's smallest, and a pair stays
   if the XOR population count of its sketches allows a high similarity. Members that fail
   against the smallest are paired with the smallest of themselves. The components of these
   candidate pairs are clusters. Where a bucket has members of several, all pairs of different
   clusters that the sizes allow meet in blocks, and clusters with a near pair become one. So
   every near pair of a bucket is in one of the clusters to verify. Sets so small that only an
   equal set can reach the similarity are done with step 1, and stay out of the bands: many of
   them may share one frequent shingle, and so a bucket.
3. The whole texts of a cluster meet once, in blocks of bounded size, and all links of
   different components are confirmed on the full sets: similar texts collapse quickly into
   the largest component, and only members outside it are compared with everything. No link
   between two texts of a cluster is lost, and no pairs are written out.
4. The components of the links, with the classes of equal sets, are the groups.

At similarity 0.8, 33 bands of 6 rows miss a pair with probability 5e-5, and the sketch
bound lies six standard deviations away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

BANDS, ROWS = 33, 6
SKETCH_BITS = 1024
#: XOR population count up to which a pair may be similar; see sketch_bound().
_U = np.uint64
_SEEDS = _text.mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
#: Shingles of the texts in one block of a cluster.
BLOCK_SHINGLES = 3_000_000
#: Members of a bucket in one block, where its clusters are compared.
BLOCK_MEMBERS = 8192


def sketch_bound(similarity: float, sigmas: float = 6.0) -> int:
    """The population count that XORed sketches of sets of this similarity do not exceed,
    but with a chance of a one in a billion."""
    k = BANDS * ROWS
    differ = min(k, k * (1 - similarity) + sigmas * (k * similarity * (1 - similarity)) ** 0.5)
    mean = SKETCH_BITS / 2 * (1 - np.exp(-2 * 2 * differ / SKETCH_BITS))
    return int(mean + sigmas * (SKETCH_BITS / 4 * (1 - np.exp(-4 * 2 * differ / SKETCH_BITS))) ** 0.5)


def minhash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima (text, sample) of the sets values[offsets[d]:offsets[d + 1]], none empty."""
    out = np.empty((len(offsets) - 1, BANDS * ROWS), np.uint64)
    buf = np.empty_like(values)
    for i, seed in enumerate(_SEEDS):
        np.bitwise_xor(values, _text.mix(seed[None])[0], out=buf)
        buf *= seed
        np.minimum.reduceat(buf, offsets[:-1], out=out[:, i])
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps (text, SKETCH_BITS / 8 bytes) of the samples."""
    place = _text.mix(mins ^ _SEEDS) % _U(SKETCH_BITS)
    flat = (place + np.arange(len(mins), dtype=_U)[:, None] * _U(SKETCH_BITS)).ravel().astype(np.int64)
    bits = np.bincount(flat, minlength=len(mins) * SKETCH_BITS).reshape(len(mins), SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), axis=1)


SIGNATURE = "row_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """SIGNATURE of every (row_id, text); empty sets have null hashes, bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.slices(batch.column(1)):
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                values, offsets = _text.shingle_sets(texts, shingle)
                n = np.diff(offsets)
                full = np.flatnonzero(n > 0)
                of = np.append(offsets[:-1][full], len(values))
                set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                bands, sketch = [None] * len(n), [None] * len(n)
                if len(full):
                    set_a[full] = _text.mix(np.add.reduceat(_text.mix(values), of[:-1]))
                    set_b[full] = _text.mix(np.add.reduceat(_text.mix(values ^ _U(0x5851F42D4C957F2D)), of[:-1]))
                    mins = minhash(values, of)
                    keys = _text.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(full), 0)
                    for r in range(ROWS):
                        keys = _text.mix(keys + mins[:, r::ROWS])
                    odd = odd_sketches(mins)
                    for i, d in enumerate(full):
                        bands[d], sketch[d] = keys[i].view(np.int64), odd[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n.astype(np.int64)), pa.array(set_a.view(np.int64), mask=n == 0), pa.array(set_b.view(np.int64), mask=n == 0), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["row_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return docs.mapInArrow(run, SIGNATURE)


def _close(pairs: DataFrame, sketches: DataFrame, bound: int) -> DataFrame:
    """Pairs (a, b, key) with column ``near``: their sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, SKETCH_BITS // 64) for c in ("sa", "sb"))
            near = np.bitwise_count(x ^ y).sum(axis=1) <= bound
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "near"])

    a, b = (sketches.select(F.col("row_id").alias(n), F.col("sketch").alias(f"s{n}")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, near boolean")


def _stars(members: DataFrame) -> DataFrame:
    """(key, a, b): every member b of a bucket with the bucket's smallest member a."""
    centre = members.groupBy("key").agg(F.min("row_id").alias("a"), F.max("row_id").alias("most")).where("most > a").select("key", "a")
    return members.join(centre, "key").where("row_id > a").select("key", "a", F.col("row_id").alias("b"))


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                self.up = up
                return up
            up = nxt


def links(values: np.ndarray, offsets: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets whose similarity is at least percent / 100, directly or over
    others: a spanning forest of the link graph. With ``side`` only sets of different sides
    are compared.

    Sets are probed one after another against all sets of other components. Once most are in
    one component, it is enough to probe the others."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    forest, out = _Forest(n), []

    def probe(x: int, roots: np.ndarray) -> None:
        lo, hi = size[x] * percent / 100, size[x] * 100 / percent
        other = (roots != roots[x]) & (size >= lo - 1e-9) & (size <= hi + 1e-9)
        if side is not None:
            other &= side != side[x]
        cand = np.flatnonzero(other)
        if not len(cand):
            return
        mine = values[offsets[x] : offsets[x + 1]]
        if len(cand) < n // 8:
            at = np.concatenate([np.arange(offsets[c], offsets[c + 1]) for c in cand])
            flat, own = values[at], np.repeat(np.arange(len(cand)), size[cand])
        else:
            flat, own, cand = values, owner, np.arange(n)
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.bincount(own[mine[place] == flat], minlength=len(cand))
        ok = other[cand] & (100 * both >= percent * (size[x] + size[cand] - both))
        for y in cand[ok]:
            r, s = forest.find(x), forest.find(y)
            if r != s:
                forest.up[max(r, s)] = min(r, s)
                out.append((x, int(y)))

    done = np.zeros(n, bool)
    for x in range(min(n, 16)):  # a few stars form the largest component
        probe(x, forest.roots())
        done[x] = True
    roots = forest.roots()
    largest = np.bincount(roots, minlength=n).argmax()
    for x in np.flatnonzero((roots != largest) & ~done):
        roots = forest.roots()
        if roots[x] == roots[largest] and len(np.unique(roots)) == 1:
            break
        probe(int(x), roots)
    return out


def joins(size: np.ndarray, sketch: np.ndarray, label: np.ndarray, probe: np.ndarray, target: np.ndarray, percent: int, bound: int) -> list[tuple[int, int]]:
    """Pairs of labels that join all members of different labels whose sizes and sketches allow
    a link, directly or over others. Every probe is compared with every target."""
    label, out = label.copy(), []
    for x in np.flatnonzero(probe):
        lo, hi = size[x] * percent / 100, size[x] * 100 / percent
        cand = np.flatnonzero(target & (label != label[x]) & (size >= lo - 1e-9) & (size <= hi + 1e-9))
        near = cand[np.bitwise_count(sketch[cand] ^ sketch[x]).sum(axis=1) <= bound]
        for other in np.unique(label[near]):
            out.append((int(label[x]), int(other)))
            label[label == other] = label[x]
    return out


def _meet(stars: DataFrame, failed: DataFrame, cluster: DataFrame, reps: DataFrame, percent: int, bound: int, parts: int) -> DataFrame:
    """Pairs (a, b) of clusters with a near pair in a bucket. A row without a cluster is one.

    Only buckets of at least three members, one of which failed against the first centre, have
    pairs that no centre has judged. The rows of a bucket's largest cluster, which are many if
    the bucket is hot, meet only the others, and these meet each other as well."""
    hot = stars.join(failed.select("key").distinct(), "key", "left_semi")
    members = hot.select("key", F.col("b").alias("row_id")).union(hot.select("key", F.col("a").alias("row_id"))).distinct()
    placed = members.join(cluster, "row_id", "left").select("key", "row_id", F.coalesce("cluster", "row_id").alias("cluster"))
    shares = placed.groupBy("key", "cluster").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.sum("n").alias("m"), F.count("*").alias("c"), F.max(F.struct("n", "cluster")).alias("top")).where("c > 1 and m > 2")
    mixed = mixed.select("key", F.col("top.cluster").alias("largest"), *(F.ceil(n / BLOCK_MEMBERS).cast("int").alias(c) for n, c in ((F.col("top.n"), "mains"), (F.col("m") - F.col("top.n"), "rests"))))
    rest = F.col("cluster") != F.col("largest")
    dealt = placed.join(mixed, "key").withColumn("rest", rest).withColumn("block", F.pmod(F.xxhash64("row_id"), F.when(rest, F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # a block of the largest cluster has the number -1 - block
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("rest"), -F.col("mains")).otherwise(F.lit(0)), F.col("rests") - 1)))
    inner = F.col("other") >= 0
    i = F.when(~F.col("rest"), F.col("other")).when(inner, F.least("block", "other")).otherwise(F.col("block"))
    j = F.when(~F.col("rest"), -1 - F.col("block")).when(inner, F.greatest("block", "other")).otherwise(F.col("other"))
    cells = dealt.select("key", i.alias("i"), j.alias("j"), (F.col("rest") & (F.col("block") == i)).alias("probe"), "row_id", "cluster")
    rows = cells.join(reps.select("row_id", "n_shingles", "sketch"), "row_id").select("key", "i", "j", "probe", "cluster", "n_shingles", "sketch")

    def check(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        probe = t.column("probe").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(t), SKETCH_BITS // 64)
        target = np.ones(len(t), bool) if t.column("i")[0] == t.column("j")[0] else ~probe
        found = joins(t.column("n_shingles").to_numpy(), sketch, t.column("cluster").to_numpy(), probe, target, percent, bound)
        if found:
            x = np.array(found)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    keyed = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return keyed.mapInArrow(lambda batches: _by_key(batches, ("key", "i", "j"), check), "a long, b long").distinct()


def _by_key(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], check: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``check`` gives for the rows of each key, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in names])
        cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = tuple(key[:, a])
            if held and now != last:
                yield from check(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield from check(held)


def _merged(cluster: DataFrame, pairs: DataFrame, scratch: _spark.Scratch) -> DataFrame:
    """(row_id, cluster) after the clusters of the pairs (a, b) have become one."""
    joined = _spark.components(pairs, scratch, "joined")
    alone = joined.join(cluster, joined.node == cluster.row_id, "left_anti").select(F.col("node").alias("row_id"), F.col("node").alias("cluster"))
    out = cluster.select("row_id", "cluster").union(alone)
    return out.join(joined, out.cluster == joined.node, "left").select("row_id", F.coalesce("component", "cluster").alias("cluster"))


def _verify(texts: DataFrame, shingle: int, percent: int, parts: int) -> DataFrame:
    """Confirmed links (a, b) of rows (cluster, i, j, block, row_id, text): a task handles
    one (cluster, i, j) after another, the block i against the block j, or one within itself."""

    def check(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        sets = [(v, np.diff(o)) for c in t.column("text").chunks for a, b in _text.slices(c) for v, o in [_text.shingle_sets(c.slice(a, b - a), shingle)]]
        values = np.concatenate([v for v, _ in sets])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in sets]))])
        ids, block = t.column("row_id").to_numpy(), t.column("block").to_numpy()
        side = block if t.column("i")[0].as_py() != t.column("j")[0].as_py() else None
        found = links(values, offsets, percent, side)
        if found:
            x = np.array(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[:, 0]]), pa.array(ids[x[:, 1]])], ["a", "b"])

    keyed = texts.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return keyed.mapInArrow(lambda batches: _by_key(batches, ("cluster", "i", "j"), check), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer than
    ``shingle`` words has its whole sequence as its only shingle. Documents are linked if
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id
    reachable, and kept says that the document is that one.

    Null, empty and blank texts have n_shingles 0 and are linked with nothing. Rows with the
    same doc_id are one node each under that id: equal or not, their links count for it. A
    row with a null doc_id gets a null component_id, kept true, and takes no part. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    _spark.ship(spark)
    scratch = _spark.Scratch(spark)
    plain = docs.select(F.col(doc_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))
    sig = scratch.put(signatures(plain, shingle), "signatures")
    some = sig.where("row_id is not null and n_shingles > 0")

    classes = scratch.put(some.groupBy("set_a", "set_b").agg(F.min("row_id").alias("rep")), "classes")
    reps = some.join(classes, [some.set_a == classes.set_a, some.set_b == classes.set_b, some.row_id == classes.rep]).select(some["*"])
    reps = scratch.put(reps.dropDuplicates(["row_id", "set_a", "set_b"]), "reps")
    reps = reps.where(F.col("n_shingles") * 100 >= F.lit(percent) * (F.col("n_shingles") + 1))
    sketches = reps.select("row_id", "sketch")
    bound = sketch_bound(percent / 100)
    members = reps.select("row_id", F.explode("bands").alias("key"))

    first = scratch.put(_stars(members), "stars")
    judged = scratch.put(_close(first.select("a", "b").distinct(), sketches, bound), "judged")
    failed = first.join(judged.where("not near").select("a", "b"), ["a", "b"], "left_semi").select("key", F.col("b").alias("row_id"))
    second = _close(_stars(failed.distinct()).select("a", "b").distinct(), sketches, bound)
    near = judged.union(second).where("near").select("a", "b")
    cluster = scratch.put(_spark.components(near, scratch, "cluster").withColumnRenamed("node", "row_id").withColumnRenamed("component", "cluster"), "clusters")
    parts = _spark.parts_for(_spark.stored_bytes(docs, text), 12e6, spark)
    pairs = scratch.put(_meet(first, failed, cluster, reps, percent, bound, parts), "pairs")
    if not pairs.isEmpty():
        cluster = scratch.put(_merged(cluster, pairs, scratch), "merged")

    sized = cluster.join(reps.groupBy("row_id").agg(F.sum("n_shingles").alias("n_shingles")), "row_id")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = cluster.join(blocks, "cluster").withColumn("block", F.pmod(F.hash("row_id"), "blocks"))
    grid = placed.select("row_id", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grid = grid.select("row_id", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    chosen = plain.join(grid, "row_id").select("cluster", "i", "j", "block", "row_id", "text")
    edges = _verify(chosen, shingle, percent, parts)
    linked = edges.union(_several(some, classes))
    group = scratch.put(_spark.components(linked, scratch, "links"), "groups")
    by_row = sig.select("row_id", "n_shingles", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"], "left")
    out = by_row.join(group, by_row.rep == group.node, "left")
    component = F.coalesce("component", "rep", "row_id")
    return out.select(F.col("row_id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("row_id"), F.lit(True)).alias("kept"))


def _several(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of rows that share a doc_id but not a set."""
    ids = some.groupBy("row_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).where("lo <> hi").select("row_id")
    return some.join(ids, "row_id").join(classes, ["set_a", "set_b"]).select(F.col("rep").alias("a"), F.col("row_id").alias("b")).where("a <> b")
