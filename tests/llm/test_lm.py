import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm, queries
from lodestone.llm.lm import score_texts


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [0]


def counted(rows, train):
    one, two, three = Counter(), Counter(), Counter()
    for d, t in rows:
        if train(d):
            ts = tokens(t)
            one.update(ts)
            two.update(zip([0, *ts], ts))
            three.update(zip([0, *ts], ts, ts[1:]))
    return one, two, three


def probability(one, two, three, u, v, w, k2=4.0, k3=4.0, least=4):
    """p(w | u v) by dictionaries; u is None for the first token of a text."""
    p = (one[w] + 1) / (sum(one.values()) + len(one) + 1)
    if one[v]:
        p = (two[v, w] + k2 * p) / (one[v] + k2)
    if u is not None and two[u, v] >= least:
        p = (three[u, v, w] + k3 * p) / (two[u, v] + k3)
    return p


def brute(rows, train):
    """(n_tokens, n_known, train tokens, base, score) of every row, by dictionaries."""
    one, two, three = counted(rows, train)
    n, v = sum(one.values()), len(one)
    low = {w: (c + 1) / (n + v + 1) for w, c in one.items()}
    out = []
    for d, t in rows:
        ts = tokens(t)
        base = score = 0.0
        for a, b, w in zip([None, 0, *ts], [0, *ts], ts):
            p = low.get(w, 1 / (n + v + 1))
            base += math.log10(p)
            if one[b]:
                p = (two[b, w] + 4 * p) / (one[b] + 4)
            if a is not None and two[a, b] >= 4:
                p = (three[a, b, w] + 4 * p) / (two[a, b] + 4)
            score += math.log10(p)
        out.append((d, len(ts), sum(one[x] > 0 for x in ts), n, base, score))
    return out


def check(frame, got, train):
    want = sorted(brute([(r.doc_id, r.text) for r in frame.collect()], train), key=lambda x: (x[0] is None, x[0] or 0))
    mine = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(mine) == len(want)
    for r, w in zip(mine, want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=2e-3)


def test_whole_table(spark, docs, sf_dir):
    import zlib

    check(docs, queries.op10_lm_scoring(spark, sf_dir), lambda d: zlib.crc32(str(d).encode()) % 7 != 2)


def test_odd_rows(odd, empty):
    check(odd, score_texts(odd, F.col("doc_id") != 7), lambda d: d is not None and d != 7)
    assert score_texts(empty, F.lit(True)).collect() == []
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in score_texts(odd, F.lit(False)).collect())


def test_probabilities_sum_to_one(spark):
    """Over all known words, the end, and the unknown word, after every context."""
    rows = [(1, "a b a c"), (2, "b a"), (3, "c c b")]
    words = ["a", "b", "c", "new"]
    probes = [(100 + i, f"{w} {x}") for i, (w, x) in enumerate((w, x) for w in words for x in words)] + [(200 + i, w) for i, w in enumerate(words)] + [(300, "")]
    frame = spark.createDataFrame(rows + probes, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(frame, F.col("doc_id") < 100).collect()}
    text = dict(probes)
    by_text = {text[d]: s for d, s in got.items() if d in text}
    # p(text) over all one-word texts and the empty one, given what may follow the first word
    for w in words:
        last = {x: 10 ** (by_text[f"{w} {x}"]) for x in words}
        assert 0 < sum(last.values()) < 1
    assert sum(10**s for t, s in by_text.items()) < 1


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 100, 5000):
        for universe in (1, 7, 1 << 20, 1 << 52):
            v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
            ef = lm.EliasFano(v, universe)
            assert np.array_equal(ef.get(np.arange(n)), v)
            q = rng.integers(0, universe + 1, 50, dtype=np.uint64)
            assert np.array_equal(ef.successor(q, np.zeros(50), np.full(50, n)), np.searchsorted(v, q))


def distinct(columns):
    return [np.array(c, np.uint64) for c in zip(*sorted(set(zip(*(c.tolist() for c in columns)))))]


@pytest.mark.parametrize("order", [2, 3])
def test_trie_finds_all_and_nothing_else(tmp_path, order):
    rng = np.random.default_rng(order)
    columns = distinct([rng.integers(0, 60, 4000, dtype=np.uint64) for _ in range(order - 1)] + [rng.integers(0, 1 << 32, 4000, dtype=np.uint64) >> rng.integers(0, 30, 4000, dtype=np.uint64)])
    counts = rng.integers(1, 50, len(columns[0]))
    trie = lm.build_shard(columns, counts, 4.0, [])
    trie.save(str(tmp_path / "trie"))
    contexts = Counter()
    for *c, n in zip(*(x.tolist() for x in columns[:-1]), counts.tolist()):
        contexts[tuple(c)] += n
    assert trie.levels[order - 2].n == len(contexts) == len(trie.backoff)  # real contexts, each once
    assert trie.levels[0].n == len(set(columns[0].tolist())) and trie.levels[-1].n == len(counts)
    probes = [np.concatenate([c, c + np.uint64(i == order - 1), rng.integers(0, 70, 500, dtype=np.uint64)]) for i, c in enumerate(columns)]
    known = {g: n / (contexts[g[:-1]] + 4) for *g, n in zip(*(x.tolist() for x in columns), counts.tolist()) for g in [tuple(g)]}
    want = [known.get(g, 0) for g in zip(*(p.tolist() for p in probes))]
    for t in (trie, trie.mapped(), lm.Trie.open(str(tmp_path / "trie"))):
        assert lm.dequantise(t.lookup(probes)) == pytest.approx(want, rel=1e-3)
        _, context = t.find(columns)
        weights = [4 / (contexts[g] + 4) for g in zip(*(c.tolist() for c in columns[:-1]))]
        assert lm.dequantise(t.backoff[context]) == pytest.approx(weights, rel=1e-3)
    empty = lm.build_shard([c[:0] for c in columns], counts[:0], 4.0, []).mapped()
    assert empty.lookup(columns).tolist() == [0] * len(counts)
    assert all(np.array_equal(a, b) for a, b in zip(lm.unpack_columns(lm.pack_columns(columns)), columns))


def test_contexts_that_are_cut():
    """Parts of a context give the probabilities of the whole, if its count travels along."""
    columns = distinct([np.repeat(np.arange(3, dtype=np.uint64), 50), np.arange(150, dtype=np.uint64) % np.uint64(50)])
    counts = np.arange(1, 151)
    whole = lm.dequantise(lm.build_shard(columns, counts, 4.0, []).lookup(columns))
    total = np.array([[0, 1, 2], [counts[:50].sum(), counts[50:100].sum(), counts[100:].sum()]])
    for part in (0, 1):
        mine = np.flatnonzero(columns[1] % np.uint64(2) == part)
        cols = [c[mine] for c in columns]
        assert np.array_equal(lm.dequantise(lm.build_shard(cols, counts[mine], 4.0, [total]).lookup(cols)), whole[mine])


def test_hot_contexts(spark):
    """One word is a third of all tokens, in many segments and buckets."""
    rows = [(i, " ".join(f"the w{(i * j) % 97}" for j in range(30)) + " the the the") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(frame, score_texts(frame, F.col("doc_id") % 5 != 0), lambda d: d % 5 != 0)


def test_model_sums_to_one():
    rows = [(i, t) for i, t in enumerate(["a b a c a b", "b a b a", "c c b a b a b", "", "a b c a b a"])]
    counts = counted(rows, lambda d: True)
    words = [*counts[0], "new"]
    for u in (None, *counts[0]):
        for v in counts[0]:
            if (v != 0 or u is None) and u != 0 or (u == 0 and v != 0):
                assert sum(probability(*counts, u, v, w) for w in words) == pytest.approx(1)


def test_quantised_probabilities():
    p = 10.0 ** -np.linspace(0, 15, 5000)
    assert lm.dequantise(lm.quantise(p)) == pytest.approx(p, rel=4e-4)
    assert lm.quantise(np.zeros(2)).tolist() == [0, 0]
