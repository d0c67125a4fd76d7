import math
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.llm import queries

CONTRACT = {
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


def test_all_registered():
    names = set(entry.queries())
    assert {*queries.QUERIES, "pipeline"} <= names and set(entry.oracle_sql()) <= names
    assert {int(x[2:].split("_")[0]) for x in queries.QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    assert frame.columns[: len(CONTRACT[name])] == CONTRACT[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = c.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine = sorted(tuple(r[x] for x in want.columns) for r in got.collect())
    theirs = sorted(want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(math.isclose(x, y) if isinstance(x, float) else x == y for x, y in zip(a, b))


@pytest.mark.parametrize("name, n, rest", [("op2_language_id", 3, 1), ("op5_toxicity", 4, 2), ("op10_lm_scoring", 7, 2)])
def test_held_out_rows(spark, sf_dir, name, n, rest):
    for r in queries.QUERIES[name](spark, sf_dir).select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op5_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    bad = got[got.toxic == 1]
    assert (got.predicted == got.toxic).mean() > 0.95 and bad.predicted.mean() > 0.8
