import hashlib
import random
import re

import pytest

from lodestone.llm.substring import FingerprintIndex, remove_in_batches, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    first = {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d, ws in words.items():
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(frame, width=13):
    want = brute([(r.doc_id, r.text) for r in frame.collect()], width)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(frame, width, digest=True).collect()}
    assert got == want
    return got


def test_whole_table(docs):
    assert sum(x[1] for x in check(docs).values()) > 0


def test_random(spark):
    rng = random.Random(2)
    passages = [[f"p{i}_{j}" for j in range(rng.randrange(5, 60))] for i in range(10)]
    rows = []
    for d in range(80):
        ws = []
        for _ in range(rng.randrange(0, 6)):
            ws += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(20))] + rng.choice(passages)
        rows.append((d * 3, rng.choice([" ", "\n", " \t "]).join(ws)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_odd_rows(odd, empty):
    rows = remove_repeats(odd, 13, keep=("source", "score")).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].kept_text is None and by[3].kept_text == "" and by[4].n_words == 0 and by[4].kept_text == " \t\n\r "
    assert by[1].n_removed == 0 and by[8].n_removed == by[8].n_words == 15 and by[8].kept_text == "" and by[8].kept_row.source == "c"
    assert by[6].n_removed == 0 and by[7].n_removed >= 119_990 and by[None].n_removed == 0
    assert remove_repeats(empty, digest=True).collect() == []
    assert hashlib.sha256(b"").hexdigest() == {r.doc_id: r for r in remove_repeats(odd, digest=True).collect()}[2].kept_sha256


def test_kept_text_keeps_its_layout(spark):
    p = " ".join(f"p{i}" for i in range(13))
    frame = spark.createDataFrame([(1, p), (2, f"a\n\nb  {p}\nc\td")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in remove_repeats(frame).collect()}[2] == "a\n\nb  c\td"


def test_incremental_batches_equal_one(spark, docs, tmp_path):
    index = FingerprintIndex(spark, f"file://{tmp_path}", buckets=8, most_runs=2)
    got = {}
    for lo in range(0, 200, 50):
        batch = docs.where(f"doc_id >= {lo} and doc_id < {lo + 50}")
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(batch, digest=True, index=index).collect()}
        index.commit()
    assert len(index.levels) <= 2
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_reopened_index_goes_on(spark, docs, tmp_path):
    """A later process opens the folder, and knows all batches that were committed."""
    path, got = f"file://{tmp_path}/index", {}
    for lo in range(0, 200, 50):
        index = FingerprintIndex(spark, path, buckets=8, most_runs=2)
        batch = docs.where(f"doc_id >= {lo} and doc_id < {lo + 50}")
        lost = remove_repeats(batch, digest=True, index=index)  # a batch that fails before its commit
        assert lost.count() == batch.count()
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(batch, digest=True, index=index).collect()}
        index.commit()
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 13)
    late = remove_repeats(docs.where("doc_id >= 150").selectExpr("doc_id + 1000 AS doc_id", "text"), digest=True, index=FingerprintIndex(spark, path))
    again = FingerprintIndex(spark, path)
    assert (again.buckets, again.width) == (8, 13) and again.levels == index.levels
    assert all(r.n_removed == r.n_words for r in late.collect() if r.n_words >= 13)
    again.vacuum()
    assert FingerprintIndex(spark, path).levels == index.levels and len(again._names()) == len(index.levels) + 1
    with pytest.raises(ValueError):
        FingerprintIndex(spark, path, buckets=9)
    with pytest.raises(ValueError):
        remove_repeats(docs, 5, index=FingerprintIndex(spark, path))
    with pytest.raises(ValueError):
        FingerprintIndex(spark, path).commit()


def test_unread_results_outlive_compaction(spark, docs, tmp_path):
    index = FingerprintIndex(spark, f"file://{tmp_path}", buckets=4, most_runs=1)
    results = []
    for lo in range(0, 200, 50):
        results.append(remove_repeats(docs.where(f"doc_id >= {lo} and doc_id < {lo + 50}"), digest=True, index=index))
        index.commit()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for x in results for r in x.collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_two_batches_equal_one(docs, odd, empty):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 13)
    for share in (0.1, 0.6, 1.0):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_in_batches(docs, digest=True, history=share).collect()} == want
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.kept_sha256)
    assert sorted(remove_in_batches(odd, digest=True, history=0.5).collect(), key=key) == sorted(remove_repeats(odd, digest=True).collect(), key=key)
    assert remove_in_batches(empty, digest=True).collect() == []
