import re

from lodestone.llm.decontaminate import contaminated, remove_contaminated, size_class, sketch_size, word_shingles


def shingles(t, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(docs, items, percent=80):
    out = set()
    for i, t in items:
        mine = shingles(t, 5)
        for d, text in docs:
            n = len(next(iter(mine))) if mine else 5
            if mine and 100 * len(mine & {tuple(x) for x in shingles(text, n) if len(x) == n}) >= percent * len(mine):
                out.add((d, i))
    return out


def pairs(frame):
    return {(r.doc_id, r.item_id) for r in frame.collect()}


def test_whole_table(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert pairs(contaminated(docs, items)) == want and want
    left = remove_contaminated(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_partial_and_short(spark):
    item = " ".join(f"i{j}" for j in range(54))  # 50 shingles
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y"), (2, " ".join(item.split()[:44])), (3, " ".join(item.split()[:43])), (4, "a b c"), (5, "z A B c z"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "a b c"), (3, None), (4, " ")], "item_id long, text string")
    assert pairs(contaminated(docs, items)) == {(1, 1), (2, 1), (4, 2), (5, 2)}


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (None, "one"), (2, ""), (3, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id or 0) for r in contaminated(odd, items).collect()) == [(1, 1), (5, 0), (8, 1), (8, 1)]
    assert contaminated(empty, items).collect() == [] and contaminated(odd, items.limit(0)).collect() == []
    assert remove_contaminated(odd, items).count() == odd.count() - 4
    assert remove_contaminated(odd, items.limit(0)).count() == odd.count()


def test_sketches_cannot_miss():
    """A document may lack n - ceil(0.8 n) shingles; one more value must be among the rest."""
    for n in range(1, 400):
        upper = size_class(n)
        assert n <= upper <= max(n + 1, 1.25 * n + 1)
        assert min(sketch_size(upper, 80), n) > n - -(-n * 80 // 100)
    assert word_shingles("A b", 5) == {b"a b"}
