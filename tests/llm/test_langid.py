import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import langid, queries


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got.held_out]
    assert 0.2 < len(held) / len(got) < 0.5
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(odd, empty):
    got = {r.doc_id: r for r in langid.identify_languages(odd, F.lit(True)).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[2].score == 0
    assert got[1].lang_pred == got[8].lang_pred == got[6].lang_pred == "en" and got[9].lang_pred == "ja"
    assert langid.identify_languages(empty, F.lit(True)).collect() == []
    assert {r.lang_pred for r in langid.identify_languages(odd, F.lit(False)).collect()} == {"und"}
    digits = odd.withColumn("text", F.lit("12 34 !"))
    assert {r.lang_pred for r in langid.identify(digits, langid.train(odd)).collect()} == {"und"}


def test_ngrams_are_those_of_each_text():
    texts = ["Ab c", "", None, "É日", "b", "1a"]
    both, off = langid.ngrams(pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = langid.ngrams(pa.array([t], pa.string()))
        assert np.array_equal(both[off[i] : off[i + 1]], alone)
    assert np.array_equal(langid.ngrams(pa.array(["AB cd"]))[0], langid.ngrams(pa.array(["ab CD"]))[0])


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 10 + int(rng.integers(50))]), np.array([0.8, 0.6]), y) for y in rng.integers(0, 3, 600)]
    w = langid.ftrl(rows, 3)
    assert w[:3, :3].argmax(axis=1).tolist() == [0, 1, 2] and (w[100:] == 0).all()


def test_temperature_softens_errors():
    z = np.array([[4.0, 0.0]] * 100)
    y = np.array([0] * 75 + [1] * 25)
    p = 1 / (1 + np.exp(-4 / langid.temperature(z, y)))
    assert abs(p - 0.75) < 0.02
