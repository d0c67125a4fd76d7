"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts are lower-cased and split into words of letters; their 1- to 3-grams, with word
boundaries, are hashed to a fixed number of dimensions. Document frequencies are counted in
Spark over all training documents. The classifier is fitted on a bounded sample of them
(``max_train_docs``, and a hundred of each rare language) with follow-the-regularised-leader
(FTRL-Proximal) under an elastic net, which leaves most weights zero. A part of the sample
is kept out of the fit and sets the temperature of the probabilities. The model has
``DIMENSIONS * (languages + 1)`` numbers however large the corpus is, and is broadcast; all
texts are then scored whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

DIMENSIONS = 1 << 16
UNKNOWN = "und"
#: Rows of a rare language in the sample; with at most 200 languages, 20,000 rows more.
LEAST = 100
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _letters[0]


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased letters and word boundaries, and the texts' offsets.
    A text without letters has none."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])).to_pybytes() if texts.buffers()[2] is not None else b""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    at = np.append(0, np.cumsum(lead))[off - off[0]]  # code points before each text
    letter = _letter_table()[points]
    follows = np.zeros(len(points), bool)  # a boundary is kept where it ends a word
    follows[1:] = letter[:-1]
    follows[at[:-1][at[:-1] < len(points)]] = False
    keep = letter | follows
    c = np.where(letter, points, 0)[keep]
    offsets = np.append(0, np.cumsum(keep))[at]
    first = offsets[:-1][np.diff(offsets) > 0]
    c1, c2 = np.zeros_like(c), np.zeros_like(c)
    c1[1:], c2[2:] = c[:-1], c[:-2]
    c1[first] = c2[first] = 0
    second = first[first + 1 < np.append(first[1:], len(c))] + 1 if len(first) else first
    c2[second] = 0
    a, b, d = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = c * a
    two = (one ^ (c1 * b)) * d + np.uint32(1)
    three = (two ^ (c2 * a)) * b + np.uint32(2)
    out = np.empty((len(c), 3), np.uint32)
    for j, h in enumerate((one, two, three)):
        out[:, j] = (h ^ (h >> np.uint32(15))) * d >> np.uint32(16)
    return out.ravel(), offsets * 3


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted dimensions and counts of each text."""
    code, off = ngrams(texts)
    for d in range(len(texts)):
        mine = code[off[d] : off[d + 1]]
        if len(mine) < 6000:
            yield np.unique(mine, return_counts=True)
        else:
            n = np.bincount(mine, minlength=DIMENSIONS)
            at = np.flatnonzero(n)
            yield at, n[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """TF-IDF of unit length, with logarithmic term frequencies."""
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] / self.temperature


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (dimension, class) after FTRL-Proximal over rows of (dimensions, values, class)."""
    z = np.zeros((DIMENSIONS, classes))
    s = np.zeros((DIMENSIONS, classes))

    def weights(zi: np.ndarray, si: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(si)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            zi, si = z[at], s[at]
            w = weights(zi, si)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(si + g * g) - np.sqrt(si)) / alpha * w
            s[at] = si + g * g
    return weights(z, s)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section on its logarithm.
    A class counts as true with one unseen error in mind, (n + 1) / (n + 2), so that a
    sample without errors doesn't make certainties."""
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(k - 1, 1))
    target[np.arange(n), y] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        v = logits / np.exp(t)
        v = v - v.max(axis=1, keepdims=True)
        return float((np.log(np.exp(v).sum(axis=1)) - (target * v).sum(axis=1)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each dimension occurs, over all rows, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for a, b in _text.slices(batch.column(0)):
                for at, _ in features(batch.column(0).slice(a, b - a)):
                    total[at] += 1
                    rows += 1
        at = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.append(total[at[:-1]], rows))], ["dimension", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(count, "dimension int, n long").groupBy("dimension").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["dimension"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(DIMENSIONS, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def _sample(docs: DataFrame, text: str, language: str, doc_id: str, most: int, max_languages: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of about ``most`` rows in random order, drawn alike from all languages, but
    for rare ones, of which about LEAST rows are taken if there are so many."""
    sizes = docs.groupBy(language).agg(F.count("*").alias("n")).orderBy(F.desc("n"), language).limit(max_languages).collect()
    if not sizes:
        return []
    share = min(1.0, most / sum(n for _, n in sizes))
    order = F.pmod(F.xxhash64(text, doc_id, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for name, n in sizes:
        chosen = F.when(F.col(language) == name, order < max(share, LEAST / n)).otherwise(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.slices(batch.column(1)):
                got = list(features(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x.astype("<u2").tobytes() for x, _ in got], pa.binary()), pa.array([np.minimum(n, 65535).astype("<u2").tobytes() for _, n in got], pa.binary())],
                    ["language", "place", "at", "n"],
                )

    rows = docs.where(chosen).select(F.col(language).cast("string").alias("language"), F.col(text).cast("string").alias("text"), order.alias("place"))
    table = rows.mapInArrow(run, "language string, place double, at binary, n binary").toArrow().sort_by([("place", "ascending"), ("at", "ascending"), ("n", "ascending"), ("language", "ascending")])
    return [(name, np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<u2")) for name, at, n in zip(*(table.column(c).to_pylist() for c in ("language", "at", "n")))]


def train(docs: DataFrame, text: str = "text", language: str = "lang", doc_id: str = "doc_id", max_train_docs: int = 6000, max_languages: int = 200) -> Model | None:
    """A model of the ``max_languages`` most frequent languages of the rows; None if no row
    has a language and a letter. Rows with a null text or language teach nothing."""
    _spark.ship(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    seen, total = document_frequencies(rows, text)
    sample = [x for x in _sample(rows, text, language, doc_id, max_train_docs, max_languages) if len(x[1])]
    if not sample:
        return None
    names = sorted({x[0] for x in sample})
    model = Model(names, np.log((1 + total) / (1 + seen)) + 1, np.zeros((DIMENSIONS, len(names)), np.float32))
    data = [(at, model.vector(at, n), names.index(name)) for name, at, n in sample]
    held = data[:: 5] if len(data) >= 50 else []
    model.weights = ftrl([x for i, x in enumerate(data) if i % 5] if held else data, len(names)).astype(np.float32)
    if held:
        model.temperature = temperature(np.array([x @ model.weights[at] for at, x, _ in held]), np.array([y for _, _, y in held]))
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with lang_pred and score, the calibrated probability of lang_pred.

    A null text, one without a letter, and every text under no model has lang_pred ``und``
    and score 0. Equal probabilities fall to the language that sorts first. Other columns are
    ignored; repeated rows get equal results; an empty table gives an empty result."""
    _spark.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b in _text.slices(batch.column("_t")):
                part = batch.slice(a, b - a)
                name, score = [UNKNOWN] * len(part), np.zeros(len(part))
                for i, (at, n) in enumerate(features(part.column("_t")) if model else ()):
                    if len(at):
                        p = softmax(model.logits(at, n))
                        name[i], score[i] = model.languages[int(p.argmax())], min(float(p.max()), 1.0)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(name, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, _spark.fields(kept, keep, "lang_pred string, score double"))


def identify_languages(docs: DataFrame, train_on: Column, text: str = "text", language: str = "lang", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), max_train_docs: int = 6000) -> DataFrame:
    """identify() of all rows under a model of those for which ``train_on`` is true."""
    return identify(docs, train(docs.where(train_on), text, language, doc_id, max_train_docs), text, keep)
