import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import _text, neardup
from lodestone.llm.neardup import near_duplicates


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def check(frame, k=2, percent=80):
    want = brute([(r.doc_id, r.text) for r in frame.collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, k, percent).collect()}
    assert got == want
    return got


def test_whole_table(docs):
    got = check(docs)
    assert len({c for _, c in got.values()}) < len(got)
    check(docs, 5)


def test_families(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for family in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([9, 40, 300]))]
        for _ in range(rng.choice([1, 3, 40])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 6))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                base = words  # drift
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_blocks(spark, monkeypatch):
    """Clusters that don't fit into one block."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 400)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:50] + [f"u{i}_{j}" for j in range(i % 9)])) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(odd, empty):
    rows = near_duplicates(odd, 2, 80).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].kept and by[2].component_id == 2
    assert by[8].component_id == 1 and not by[8].kept and by[5].n_shingles == 1
    assert by[7].component_id == 6 and by[None].component_id is None and by[None].kept
    assert near_duplicates(empty).collect() == []


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    for share, near in ((0.95, True), (0.8, True), (0.2, False)):
        b = a.copy()
        b[: int(len(b) * (1 - share) / (1 + share) * 1)] = rng.integers(0, 2**63, int(len(b) * (1 - share) / (1 + share)), dtype=np.uint64)
        sketch = [neardup.odd_sketches(neardup.minhash(np.sort(x), np.array([0, len(x)]))) for x in (a, b)]
        count = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert (count <= neardup.sketch_bound(0.8)) == near


@pytest.mark.parametrize("n", [1, 2, 7])
def test_links_span_all_pairs(n):
    values = np.concatenate([np.sort(np.r_[np.arange(100), 1000 + i]).astype(np.uint64) for i in range(n)])
    found = neardup.links(values, np.arange(n + 1) * 101, 80)
    assert len(found) == n - 1


@pytest.mark.parametrize("members", [neardup.BLOCK_MEMBERS, 3])
def test_pair_behind_far_centres(spark, monkeypatch, members):
    """Both of a pair are far from the two first members of every bucket that they share."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", members)
    passage = " ".join(f"p{i}" for i in range(20))
    pair = [(1000 + i, f"{passage} a{i} b{i}") for i in range(2)]
    pool = [f"w{i}" for i in range(9000)]
    mine, each = (neardup.minhash(*_text.shingle_sets(pa.array(t), 1)) for t in ([t for _, t in pair], pool))
    bands = np.arange(neardup.BANDS * neardup.ROWS).reshape(neardup.BANDS, neardup.ROWS)
    shared = [b for b in bands if (mine[0, b] == mine[1, b]).all()]
    free, hubs = np.ones(len(pool), bool), []
    for b in shared:
        while sum((neardup.minhash(*_text.shingle_sets(pa.array([t]), 1))[0, b] == mine[0, b]).all() for t in hubs) < 2:
            tail = np.flatnonzero(free & (each[:, b] > mine[0, b]).all(axis=1))[:60]
            free[tail] = False
            hub = " ".join([passage, *(pool[i] for i in tail)])
            sketch = neardup.odd_sketches(neardup.minhash(*_text.shingle_sets(pa.array([hub, *(t for _, t in pair)]), 1)))
            if (np.bitwise_count(sketch[1:] ^ sketch[0]).sum(axis=1) > neardup.sketch_bound(0.8)).all():
                hubs.append(hub)
    assert shared
    check(spark.createDataFrame([*enumerate(hubs), *pair], "doc_id long, text string"), 1)
