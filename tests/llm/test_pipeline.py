import re

import corpus_pipeline
import pytest
from lodestone.llm import _spark
from lodestone.llm.neardup import near_duplicates
from pyspark.sql import functions as F
from test_neardup import brute as near_groups
from test_quality import brute as quality_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, docs, sf_dir, tmp_path):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, docs, sf_dir, tmp_path):
    good, unique, cut, clean, packed = run(spark, docs, sf_dir, tmp_path)
    for frame in (good, unique, cut, clean):
        assert frame.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert not any(quality_counts(t)[5] for t in kept.values()) and len(kept) > 0.8 * len(texts)
    groups = near_groups(list(kept.items()), 5, 80)
    assert {r.doc_id for r in unique.collect()} == {c for _, c in groups.values()}
    before = {r.doc_id: WORD.findall(r.text) for r in unique.collect()}
    first, n = {}, corpus_pipeline.REPEATED_WORDS
    for d in sorted(before):
        for i in range(len(before[d]) - n + 1):
            first.setdefault(tuple(before[d][i : i + n]), d)
    for r in cut.collect():
        ws = before[r.doc_id]
        gone = {j for i in range(len(ws) - n + 1) if first[tuple(ws[i : i + n])] < r.doc_id for j in range(i, i + n)}
        assert WORD.findall(r.text) == [w for j, w in enumerate(ws) if j not in gone] and r.n_chars == len(r.text)
    assert {r.doc_id for r in clean.collect()} <= {r.doc_id for r in cut.collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_run_equals_stages(spark, docs, sf_dir, tmp_path):
    stages = run(spark, docs, sf_dir, tmp_path)[-1]
    whole = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, stages.groupBy("doc_id").agg({"length": "sum"}).collect()))


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows(spark, sf_dir, tmp_path, odd, empty, which):
    frame = {"odd": odd, "empty": empty}[which].drop("score").selectExpr("doc_id", "text", "lang", "source", "n_chars")
    good, unique, cut, clean, packed = run(spark, frame, sf_dir, tmp_path)
    assert all(x.columns == frame.columns for x in (good, unique, cut, clean))
    assert packed.count() >= (0 if which == "empty" else 1)


def test_a_run_leaves_the_tables_of_others(spark, docs):
    before = near_duplicates(docs, shingle=2, percent=80)  # not read yet
    with _spark.owned("another run"):
        mine = _spark.Scratch(spark)
        mine.put(docs.limit(1), "x")
        _spark.clean(docs)
        assert mine not in _spark._scratch
    assert before.count() == docs.count()


def test_sizes_of_joins_are_measured(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert _spark.stored_bytes(docs.join(labels, "doc_id")) <= texts
