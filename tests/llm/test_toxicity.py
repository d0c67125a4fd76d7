import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity as T


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abdeiklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[10] = rng.choice(["Scoundrel!", "villain,"])
            words[20] = "gromp" + rng.choice(["en", "isch", "ung", "t"])
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return T.train(labelled)


def scores(model, *texts):
    own = model.prepare()
    return T.probability(T.cells(*T.hits(pa.array(texts, pa.string()), own)), own.weights)


def test_lexicon(model):
    assert {"scoundrel", "villain"} <= set(model.words) | {x for x in model.stems} or any(x.startswith("gromp") for x in model.stems)
    plain, direct, stem, misspelt, swapped, quoted, reported = scores(
        model, "some other text", "you villain here", "so grompische words", "you vilain here", "you scoundrle", 'he wrote "villain" here', "they said villain once"
    )
    assert direct > 0.3 and stem > 0.3 and plain < 0.3
    assert misspelt > plain and swapped > plain and quoted < direct and reported < direct


def test_held_out(labelled):
    docs = labelled.drop("toxic").withColumn("held_out", F.col("doc_id") % 4 == 2)
    got = T.score_toxicity(docs, labelled.drop("text"), ~F.col("held_out"), keep=("doc_id", "held_out")).join(labelled, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.98


def brute_distance(a, b):
    d = {(-1, -1): 0}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if i < 0 or j < 0:
                d[i, j] = max(i, j) + 1
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_distances():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    trie = T.Trie(terms)
    for most in (1, 2):
        for _ in range(300):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
            assert {t for t, _ in trie.near(w, most)} == {t for t in terms if brute_distance(w, t) <= most}, (w, most)


def test_halves_lose_no_misspelling():
    rng = random.Random(2)
    m = T.Model(["scoundrel", "villain", "clown"], []).prepare()
    for term in m.words:
        for _ in range(200):
            i, c = rng.randrange(len(term)), rng.choice("abcxyz")
            w = rng.choice([term[:i] + term[i + 1 :], term[:i] + c + term[i:], term[:i] + c + term[i + 1 :], term[:i] + term[i + 1 : i + 2] + term[i] + term[i + 2 :]])
            t = T.Tokens(pa.array([w]))
            assert len(t.start) == 1
            kinds = T.hits(pa.array([w]), m)[2]
            assert len(kinds) == 1, (term, w)


def test_odd_rows(odd, empty, model):
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[2] == {r.doc_id: r.score for r in got}[3]
    assert T.score(empty, model).collect() == []
    none = odd.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert T.score_toxicity(odd, none, F.lit(True)).count() == odd.count()


def test_tokens_are_those_of_each_text():
    texts = ["Ab1 c-d", "", None, "É日", '"x"', "e"]
    t = T.Tokens(pa.array(texts))
    words = [[t.word(i) for i in range(t.of[d], t.of[d + 1])] for d in range(len(texts))]
    assert words == [["ab1", "c", "d"], [], [], ["é日"], ["x"], ["e"]]
    assert t.spans(t.start[:1], t.end[:1])[0] == T.hash_of("ab1")


def test_misspelt_stems_and_short_and_weak_entries():
    m = T.Model(["scum", "idiot", "git"], ["gromp", "blath"], weak={"idiot", "blath"}, known={"scam", "gromm*"}).prepare()
    kinds = {w: list(T.hits(pa.array([w]), m)[2]) for w in "grompen gropmen grampisch grmpung grommet skum scmu scumm scam slam crum idoit blatherer balther git gti giit gut ordinary".split()}
    assert kinds["grompen"] == [0] and all(kinds[w] == [2] for w in ("gropmen", "grampisch", "grmpung", "skum", "scmu", "scumm", "gti", "giit"))
    assert kinds["idoit"] == kinds["blatherer"] == kinds["balther"] == [3] and kinds["git"] == [0]
    assert not any(kinds[w] for w in ("grommet", "scam", "slam", "crum", "gut", "ordinary"))


def test_halves_lose_no_misspelt_stem():
    rng = random.Random(3)
    m = T.Model([], ["scoundr", "gromp", "bleat"]).prepare()
    for term in m.stems:
        for _ in range(200):
            i, c = rng.randrange(len(term)), rng.choice("abcxyz")
            w = rng.choice([term[:i] + term[i + 1 :], term[:i] + c + term[i:], term[:i] + c + term[i + 1 :], term[:i] + term[i + 1 : i + 2] + term[i] + term[i + 2 :]]) + rng.choice(["", "en", "ing"])
            assert len(T.hits(pa.array([w]), m)[2]) == 1, (term, w)
