"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows of the hits.

The lexicon is learned. Its candidates come from a bounded sample of the labels, of which
near copies count once: Spark counts in how many toxic and in how many other documents each
word and each word beginning of 4 to 8 characters occurs, and in rounds, the terms that best
explain the toxic documents not explained yet become entries: whole words, or beginnings that
stand for all their inflections (stems). At most ``max_terms`` entries are kept, which bounds
the model. Then one pass over all documents counts every entry again, over all labels, and
gathers the words near entries that clean documents use. Entries whose evidence does not hold
over all labels go.

Every word of a text is looked up exactly. A word that is no entry, but shares a string with
one deleted character with an entry, is run as a Levenshtein automaton through the tries of
whole words and of stems, which are met by a word's beginning; misspellings that the training
documents show to be words, or beginnings of words, in their own right are no hits. Entries of
fewer than five characters must keep their first letter, and those of three allow only a
doubled letter or a swap. A misspelt weak entry counts as a weak hit. A hit inside quotation
marks, or next to words of report, counts as quoted. Hits are weighed by how many others
stand in the window around them, and a logistic regression over the few cells that these
numbers fall into, fitted on all training documents, makes the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

STEMS = range(4, 9)
#: Words on either side that count as a hit's context.
WINDOW = 10
#: Words of report, close before a hit: the sentence speaks about the word.
REPORT = ("quote", "quoted", "quotes", "quoting", "said", "says", "called", "term", "word", "cited", "cite", "alleged", "allegedly")
_QUOTES = '"“”„«»‘’‹›'
_kinds: list[np.ndarray] = []
_U = np.uint64


def _kind_table() -> np.ndarray:
    """0 separator, 1 letter or digit, 2 quotation mark, for every code point."""
    if not _kinds:
        out = np.array([chr(i).isalnum() for i in range(0x110000)], np.uint8)
        out[[ord(c) for c in _QUOTES]] = 2
        _kinds.append(out)
    return _kinds[0]


class Tokens:
    """Lower-cased words (letters and digits) of a slice of texts, as code points."""

    def __init__(self, texts: pa.Array):
        texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])).to_pybytes() if texts.buffers()[2] is not None else b""
        self.points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        self.off = np.append(0, np.cumsum(lead))[off - off[0]]
        n = len(self.points)
        self.kind = _kind_table()[self.points]
        inside = self.kind == 1
        before = np.append(False, inside)
        before[self.off[:-1]] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.append(inside, False)
        after[self.off[1:]] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1 if n else self.start
        self.size = self.end - self.start
        self.of = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.of))
        # rolling sums of code points times powers, so that any span's hash is one difference
        self._sum = np.zeros(n + 1, _U)
        np.cumsum(_text.mix(self.points.astype(_U) + _U(1)) * _text._power("base", n), out=self._sum[1:])
        self._inverse = _text._power("inverse", n + 2)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _text.mix((self._sum[end] - self._sum[start]) * self._inverse[start])

    def without(self, start: np.ndarray, end: np.ndarray, i: int) -> np.ndarray:
        """Hashes of spans less their character i."""
        at = start + i
        return _text.mix((self._sum[at] - self._sum[start]) * self._inverse[start] + (self._sum[end] - self._sum[at + 1]) * self._inverse[start + 1])

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le")


def hash_of(term: str) -> int:
    t = Tokens(pa.array([term]))
    return int(t.spans(np.array([0]), np.array([len(t.points)]))[0])


def _keys(terms: Iterable[str]) -> np.ndarray:
    return np.sort(np.array([hash_of(x) for x in terms], _U))


class Trie:
    """Terms by character; ``near`` intersects it with a word's Levenshtein automaton."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term

    def near(self, word: str, most: int = 1) -> list[tuple[str, int]]:
        """Terms within ``most`` insertions, deletions, substitutions or swaps of neighbours.

        The automaton's state after a path of the trie is the row of distances between the
        path and the word's beginnings; a branch is left as soon as no entry can get back
        within the limit."""
        out = []

        def walk(node: dict, above: str, row: list[int], before: list[int] | None) -> None:
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        out.append((child, row[-1]))
                    continue
                now = self._step(word, c, above, row, before)
                if min(now) <= most or min(row) <= most:
                    walk(child, c, now, row)

        walk(self.root, "", list(range(len(word) + 1)), None)
        return sorted(out, key=lambda x: (x[1], x[0]))

    def near_beginnings(self, word: str, most: int = 1) -> list[tuple[str, int]]:
        """Terms within ``most`` edits of a beginning of the word, each with the length of the
        nearest such beginning, the longest of several. A row of the automaton holds the
        distances to all beginnings at once."""
        out = []

        def walk(node: dict, above: str, row: list[int], before: list[int] | None) -> None:
            for c, child in node.items():
                if c == "":
                    best = min(row[1:], default=most + 1)
                    if best <= most:
                        out.append((child, max(j for j, d in enumerate(row) if d == best and j)))
                    continue
                now = self._step(word, c, above, row, before)
                if min(now) <= most or min(row) <= most:
                    walk(child, c, now, row)

        walk(self.root, "", list(range(len(word) + 1)), None)
        return sorted(out)

    @staticmethod
    def _step(word: str, c: str, above: str, row: list[int], before: list[int] | None) -> list[int]:
        """The automaton's next state."""
        now = [row[0] + 1]
        for j, w in enumerate(word, 1):
            d = min(now[-1] + 1, row[j] + 1, row[j - 1] + (w != c))
            if before is not None and j > 1 and w == above and word[j - 2] == c:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        return now


def plausible(term: str, got: str) -> bool:
    """Whether what is one edit from an entry may be its misspelling: short entries have too
    many ordinary neighbours."""
    if len(term) >= 5:
        return True
    if got[:1] != term[0]:
        return False
    return len(term) == 4 or sorted(got) == sorted(term) or got in {term[: i + 1] + term[i:] for i in range(len(term))}


#: Numbers of clear, quoted, misspelt and weak hits, and of hits in the fullest window, each
#: on a scale of 0 to CELLS - 1.
FEATURES, CELLS = 5, 6


@dataclass
class Model:
    """Entries (whole words, stems), which of them are weak (clean documents have them now and
    then), known words near entries, and known beginnings (with ``*``) near stems, that are no
    misspellings, and the weights of a bias and the features."""

    words: list[str]
    stems: list[str]
    weak: set[str] = field(default_factory=set)
    known: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 7.0, 2.0, 6.0, 2.0, 0.5]))
    evidence: float = 20.0

    @staticmethod
    def key(term: str, whole: bool) -> int:
        return int(np.array([hash_of(term)], _U).view(np.int64)[0]) ^ (0 if whole else len(term))

    def entries_of(self, t: "Tokens", i: int) -> list[int]:
        """Keys of the entries that a word is or begins with."""
        word = t.word(i)
        return [k for x, k in self.entry_keys.get(word, ())] + [k for n in self.stem_keys for x, k in self.entry_keys.get((word[:n], n), ())]

    def prepare(self) -> "Model":
        self.word_keys = _keys(self.words)
        self.stem_keys = {n: _keys(x for x in self.stems if len(x) == n) for n in {len(x) for x in self.stems}}
        self.weak_keys = _keys(self.weak)
        self.trie, self.stem_trie = Trie(self.words), Trie(self.stems)
        self.longest = max((len(x) for x in self.stems), default=0) + 1
        self.near_words, self.near_stems = Deletions(self.words), Deletions(self.stems)
        self.entry_keys = {x: [(x, self.key(x, True))] for x in self.words} | {(x, len(x)): [(x, self.key(x, False))] for x in self.stems}
        self.report = _keys(REPORT)
        self.cache: dict[str, int] = {}
        return self

    def near(self, word: str) -> list[tuple[str, str]]:
        """(entry, what of the word is near it): the word, or a beginning and ``*``."""
        whole = [(term, word) for term, _ in self.trie.near(word) if plausible(term, word)]
        begin = self.stem_trie.near_beginnings(word[: self.longest]) if self.stems else []
        return whole + [(term, f"{word[:n]}*") for term, n in begin if plausible(term, word[:n])]

    def misspelt(self, word: str) -> int:
        """2 if the word is a misspelt entry, 3 if a weak one, 0 if neither."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = [term for term, what in self.near(word) if what not in self.known]
            got = self.cache[word] = 0 if not found else 3 if self.weak.issuperset(found) else 2
        return got


def _in(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


class Keys:
    """A set of hashes, behind a table of bits that answers most of the misses."""

    def __init__(self, keys: set[int]):
        self.keys = np.sort(np.array(sorted(keys), _U))
        self.some = np.zeros(1 << 16, bool)
        self.some[self.keys & _U(0xFFFF)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.some[values & _U(0xFFFF)]
        at = np.flatnonzero(out)
        out[at] = _in(self.keys, values[at])
        return out


class Deletions:
    """Finds spans one edit away from terms: the span or the term, less one character, equals
    the other, or both do less one character each (substitutions and swaps)."""

    def __init__(self, terms: list[str]):
        whole: dict[int, set[int]] = {}
        less: dict[int, set[int]] = {}
        for x in terms:
            whole.setdefault(len(x), set()).add(hash_of(x))
            less.setdefault(len(x), set()).update(hash_of(x[:i] + x[i + 1 :]) for i in range(len(x)))
        none: set[int] = set()
        sizes = {n + d for n in whole for d in (-1, 0, 1)} - {0}
        #: For each length of a span: what it may be itself, and less one character.
        self.of = {m: (Keys(less.get(m + 1, none)), Keys(less.get(m, none) | whole.get(m - 1, none))) for m in sorted(sizes)}

    def near(self, t: Tokens, at: np.ndarray, begin: bool) -> np.ndarray:
        """Which of the words ``at``, or a beginning of which of them, are near a term."""
        out = np.zeros(len(at), bool)
        for m, (itself, shorter) in self.of.items():
            some = np.flatnonzero((t.size[at] >= m if begin else t.size[at] == m) & ~out)
            if not len(some):
                continue
            start = t.start[at[some]]
            found = itself.has(t.spans(start, start + m))
            for i in range(m):
                found |= shorter.has(t.without(start, start + m, i))
            out[some[found]] = True
        return out


def hits(texts: pa.Array, model: Model, fuzzy: bool = True) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Word indices of hits; the kind of each (0 clear, 2 misspelt, 3 weak); and whether it is
    quoted: inside quotation marks of one line, or up to four words behind a word of report."""
    t = Tokens(texts)
    own = t.spans(t.start, t.end)
    exact, weak = _in(model.word_keys, own), _in(model.weak_keys, own)
    for n, keys in model.stem_keys.items():
        at = np.flatnonzero(t.size >= n)
        begin = t.spans(t.start[at], t.start[at] + n)
        found = _in(keys, begin)
        weak[at[found & ~exact[at]]] = _in(model.weak_keys, begin[found & ~exact[at]])
        exact[at] |= found
    wrong = np.zeros(len(own), np.int64)
    if fuzzy and (model.words or model.stems):
        rest = np.flatnonzero(~exact)
        _, one, which = np.unique(own[rest], return_index=True, return_inverse=True)
        one = rest[one]  # each word once
        near = np.flatnonzero(model.near_words.near(t, one, False) | model.near_stems.near(t, one, True))
        verdict = np.zeros(len(one), np.int64)
        verdict[near] = [model.misspelt(t.word(i)) for i in one[near]]
        wrong[rest] = verdict[which]
    at = np.flatnonzero(exact | (wrong > 0))
    kind = np.where(wrong[at] > 0, wrong[at], np.where(weak[at], 3, 0))
    if not len(at):
        return t, at, kind, np.zeros(0, bool)
    marks, lines = np.flatnonzero(t.kind == 2), np.flatnonzero(t.points == 10)
    begin = t.off[t.doc[at]]
    stop = t.off[t.doc[at] + 1]
    if len(lines):
        line = np.searchsorted(lines, t.start[at])
        begin = np.maximum(begin, np.where(line > 0, lines[line - 1] + 1, 0))
        stop = np.minimum(stop, np.where(line < len(lines), lines[np.minimum(line, len(lines) - 1)], stop))
    before = np.searchsorted(marks, t.start[at])
    opened = before - np.searchsorted(marks, begin)
    closes = np.searchsorted(marks, stop) > before
    reported = np.append(0, np.cumsum(_in(model.report, own)))
    said = reported[at] > reported[np.maximum(at - 4, t.of[t.doc[at]])]
    return t, at, kind, ((opened % 2 == 1) & closes) | said


def cells(t: Tokens, at: np.ndarray, kind: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    """(text, FEATURES): numbers of hits, as steps of a logarithmic scale."""
    n = len(t.off) - 1
    out = np.zeros((n, FEATURES), np.int64)
    if len(at):
        np.add.at(out, (t.doc[at], np.where(quoted, 1, kind)), 1)
        free = at[~quoted & (kind != 3)]
        doc = t.doc[free]
        lo = np.searchsorted(free, np.maximum(free - WINDOW, t.of[doc]))
        hi = np.searchsorted(free, np.minimum(free + WINDOW, t.of[doc + 1] - 1), "right")
        np.maximum.at(out[:, 4], doc, hi - lo)
    return np.minimum(np.ceil(np.log2(out + 1)).astype(np.int64), CELLS - 1)


def probability(cell: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(cell)), cell]) @ weights, -30, 30)))


def count_terms(rows: DataFrame) -> DataFrame:
    """(key, n): in how many of the rows (text) each word and word beginning occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(n[part])], ["key", "n"])

        for batch in batches:
            for a, b in _text.slices(batch.column(0)):
                t = Tokens(batch.column(0).slice(a, b - a))
                keys, docs = [t.spans(t.start, t.end)], [t.doc]
                for n in STEMS:
                    at = np.flatnonzero(t.size > n)
                    keys.append(t.spans(t.start[at], t.start[at] + n) + _U(n))  # a beginning is not the whole word
                    docs.append(t.doc[at])
                value, _ = _text.distinct(np.concatenate(docs), np.concatenate(keys), b - a)
                held.append(value)
                size += len(value)
                if size > 3_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return rows.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def spell(rows: DataFrame, keys: np.ndarray) -> dict[int, tuple[str, bool]]:
    """The term of each key, and whether it is a whole word, read back from the rows that
    were counted. ``keys`` are few, and so is the result."""
    wanted = np.sort(keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found: list[tuple[int, str, bool]] = []
            for a, b in _text.slices(batch.column(0)):
                t = Tokens(batch.column(0).slice(a, b - a))
                for n in (0, *STEMS):
                    at = np.flatnonzero(t.size > n)
                    key = t.spans(t.start[at], t.start[at] + n) + _U(n) if n else t.spans(t.start, t.end)
                    for i in np.flatnonzero(_in(wanted, key)):
                        if int(key[i]) not in seen:
                            seen.add(int(key[i]))
                            word = t.word(at[i])
                            found.append((int(key[i].view(np.int64)), word[:n] if n else word, not n))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.bool_())], ["key", "term", "whole"])

    found = rows.select("text").mapInArrow(find, "key long, term string, whole boolean")
    return {r["key"]: (r["term"], r["whole"]) for r in found.groupBy("key").agg(F.min("term").alias("term"), F.max("whole").alias("whole")).collect()}


def _least_shingles(texts: pa.Array, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """The smallest hash of each text's five-word shingles under each seed; 0 without any."""
    w = _text.Words(texts)
    value, at = w.grams(w.hashes(lower=True), 5)
    doc = w.doc(at)
    begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
    out = []
    for seed in seeds:
        least = np.zeros(len(texts), _U)
        if len(doc):
            least[doc[begins]] = np.minimum.reduceat(_text.mix(value + _U(seed)), begins)
        out.append(least.view(np.int64))
    return out


def _one_of_copies(rows: DataFrame, scratch: _spark.Scratch) -> DataFrame:
    """The rows (row, text, label) less all but one of those that share label and the smallest
    hash of their five-word shingles, under one seed after another: near copies are one
    witness for a term, not many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                least = _least_shingles(part.column(1), (0, 1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, least)], ["row", "label", "c0", "c1", "c2"])

    chosen = rows.select("row", "text", "label").mapInArrow(run, "row long, label int, c0 long, c1 long, c2 long")
    for c in ("c0", "c1", "c2"):
        chosen = chosen.groupBy("label", c).agg(F.min(F.struct("row", "c0", "c1", "c2")).alias("x")).select("label", "x.*")
    chosen = scratch.put(chosen.select("row"), "chosen")
    return rows.join(F.broadcast(chosen) if chosen.count() <= 1_000_000 else chosen, "row", "left_semi")


def choose(found: list[tuple[str, bool, int, float]], strong: float = np.inf) -> tuple[list[str], list[str]]:
    """(words, stems) out of (term, whole word, toxic documents, weight of evidence): those
    with at least half of the best one's evidence, or a quarter where that is still
    ``strong``. Of terms that begin alike one is taken: the whole word that makes up nearly
    all of the family, or else its longest common beginning."""
    words, stems = [], []
    best = max((x[3] for x in found), default=0)
    for term, _, n, evidence in sorted(found, key=lambda x: (-x[3], x[0], x[1])):
        if evidence < best / 2 and evidence < max(best / 4, strong) or any(term.startswith(x[:4]) and (x.startswith(term) or term.startswith(x)) for x in words + stems):
            continue
        family = [x for x in found if x[0].startswith(term) or term.startswith(x[0])]
        whole = [x for x in family if x[1] and x[2] >= 0.9 * n]
        if whole:
            words.append(max(whole, key=lambda x: (x[2], len(x[0]), x[0]))[0])
        else:
            stems.append(max((x for x in family if not x[1] and x[2] >= 0.95 * n), key=lambda x: (len(x[0]), x[2], x[0]), default=(term,))[0])
    return words, stems


def _evidence(n: Column, other: Column, bad: int, good: int) -> Column:
    """The likelihood ratio statistic of "toxic documents have the term more often"."""
    m, base = n + other, bad / (bad + good)
    if not good:
        return 2 * n
    return 2 * (n * F.log(n / (m * base)) + F.when(other > 0, other * F.log(other / (m * (1 - base)))).otherwise(0))


def learn_lexicon(rows: DataFrame, scratch: _spark.Scratch, max_terms: int = 2000, least: int = 5) -> Model:
    """A model with words, stems and weak entries from rows (row, text, label).

    A round takes the terms with most evidence (over three times the logarithm of the number
    of terms) from the toxic documents that no entry explains so far; words that only keep an
    entry company have none left in the next round. An entry occurs in at least ``least`` of
    these, and 20 times as often as in clean ones; it is weak if clean documents have it more
    than a 200th as often. It ends when no term qualifies, or with the best of the round that
    fills ``max_terms``."""
    rows = scratch.put(_one_of_copies(rows, scratch), "witnesses")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    model = Model([], [])
    if not bad:
        return model
    other = scratch.put(count_terms(rows.where("label = 0")).withColumnRenamed("n", "other"), "other")
    evidence = model.evidence = 3 * float(np.log(max(other.count(), 1000)))
    while len(model.words) + len(model.stems) < max_terms:

        def unexplained(batches: Iterator[pa.RecordBatch], model=Model(list(model.words), list(model.stems))) -> Iterator[pa.RecordBatch]:
            own = model.prepare()
            for batch in batches:
                for a, b in _text.slices(batch.column(0)):
                    part = batch.slice(a, b - a)
                    t, at, _, _ = hits(part.column(0), own, fuzzy=False)
                    yield part.filter(pa.array(np.bincount(t.doc[at], minlength=b - a) == 0))

        toxic = rows.where("label = 1").select("text").mapInArrow(unexplained, "text string")
        terms = count_terms(toxic).where(F.col("n") >= least).join(other, "key", "left").withColumn("other", F.coalesce("other", F.lit(0)))
        terms = terms.where((F.col("n") / bad) > 20 * (F.col("other") / max(good, 1)))
        ratio = _evidence(F.col("n"), F.col("other"), bad, good)
        best = terms.withColumn("evidence", ratio).where(F.col("evidence") >= evidence).orderBy(F.desc("evidence"), "key").limit(max_terms).collect()
        if not best:
            break
        spelt = spell(toxic, np.array([r["key"] for r in best], np.int64).view(_U))
        found = [(*spelt[r["key"]], r["n"], r["evidence"]) for r in best if r["key"] in spelt and len(spelt[r["key"]][0]) >= 3]
        words, stems = ([x for x in new if x not in old] for new, old in zip(choose(found, 4 * evidence), (model.words, model.stems)))
        room = max_terms - len(model.words) - len(model.stems)
        words, stems = words[:room], stems[: max(room - len(words), 0)]
        if not words and not stems:
            break
        often = {(spelt[r["key"]]): r["n"] * good <= 200 * r["other"] * bad for r in best if r["key"] in spelt}
        model.words, model.stems = model.words + words, model.stems + stems
        model.weak |= {x for x in words if often[x, True]} | {x for x in stems if often[x, False]}
    return model


def survey(rows: DataFrame, model: Model) -> DataFrame:
    """For each row, its first column with ``copy`` (alike for copies), ``entries`` (keys of the
    entries that it has) and ``near`` (words near an entry, and beginnings near a stem)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.prepare()
        for batch in batches:
            for a, b in _text.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = part.column(1)
                t, at, kind, _ = hits(texts, own)
                near, entries = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                for d, word in sorted({(int(t.doc[i]), t.word(i)) for i in at[kind >= 2]}):
                    near[d] += [what for _, what in own.near(word)]
                for i in at[kind != 2]:
                    for key in own.entries_of(t, i):
                        if key not in entries[t.doc[i]]:
                            entries[t.doc[i]].append(key)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_least_shingles(texts, (0,))[0]), pa.array(entries, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.string()))], ["id", "copy", "entries", "near"]
                )

    return rows.mapInArrow(run, "id long, copy long, entries array<long>, near array<string>")


def refine(found: DataFrame, model: Model) -> Model:
    """The model after all labels: from survey()'s rows with a ``label``. Entries whose
    evidence falls short over all documents go, weak ones are told anew, and words near an
    entry that clean documents use are known. What is collected is bounded by the number of
    entries; one of n characters has at most some hundred n neighbours."""
    sizes = {r[0]: r[1] for r in found.groupBy("label").agg(F.countDistinct("copy")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    each = found.select("label", "copy", F.explode("entries").alias("entry")).distinct()
    n, other = (F.coalesce(F.sum(F.when(F.col("label") == x, 1)), F.lit(0)) for x in (1, 0))
    rows = each.groupBy("entry").agg(n.alias("n"), other.alias("other"))
    counts = {r["entry"]: (r["n"], r["other"], r["e"]) for r in rows.withColumn("e", _evidence(F.col("n"), F.col("other"), bad, good)).collect()} if bad else {}
    # what the sample's entries need here too; the better one keeps each of its documents
    fine = {k for k, (n, o, e) in counts.items() if n and n * good > 20 * o * bad / 2 and (e or 0) >= model.evidence / 2}
    often = {k for k, (n, o, _) in counts.items() if n * good <= 200 * o * bad}
    keys = {x: model.key(x, True) for x in model.words}, {x: model.key(x, False) for x in model.stems}
    model.words, model.stems = ([x for x in of if k[x] in fine] for of, k in zip((model.words, model.stems), keys))
    model.weak = {x for of, k in zip((model.words, model.stems), keys) for x in of if k[x] in often}
    model.known = {r[0] for r in found.where("label = 0").select(F.explode("near").alias("what")).distinct().collect()}
    return model


def fit(cells: np.ndarray, bad: np.ndarray, good: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression over cells with their numbers of toxic and other documents, by
    Newton steps; ``prior`` is where weights stay that nothing speaks against. Hits never
    lower the score."""
    x = np.column_stack([np.ones(len(cells)), cells])
    w, n = prior.copy(), bad + good
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (bad - n * p) - strength * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def assess(docs: DataFrame, model: Model, text: str, keep: tuple[str, ...], **more: Column) -> tuple[DataFrame, list[str], list[str]]:
    """A frame of the kept columns, those of ``more``, the document's cell and its counts of
    hits; with the names of the kept columns, and of the columns that hold them."""
    _spark.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, names, _ = _spark.carried(docs, keep, RESULTS, **more, text=F.col(text).cast("string"))
    fixed = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.prepare()
        for batch in batches:
            texts = batch.column(len(fixed))
            for a, b in _text.slices(texts):
                part = batch.slice(a, b - a)
                t, at, kind, quoted = found = hits(texts.slice(a, b - a), own)
                n = [np.bincount(t.doc[at[x]], minlength=b - a) for x in (kind >= 0, quoted, kind == 2)]
                cell = cells(*found) @ CELLS ** np.arange(FEATURES)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fixed)], pa.array(cell), *(pa.array(x.astype(np.int64)) for x in n)], [*fixed, "cell", "n_hits", "n_quoted", "n_misspelt"])

    out = rows.mapInArrow(run, _spark.fields(rows, tuple(fixed), "cell long, n_hits long, n_quoted long, n_misspelt long"))
    return out, names, fixed[: len(names)]


RESULTS = "score double, predicted int, n_hits long, n_quoted long, n_misspelt long"


def _scored(assessed: DataFrame, names: list[str], columns: list[str], weights: np.ndarray, threshold: float) -> DataFrame:
    """Scores of cells, by SQL functions."""
    z = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        z = z + F.lit(float(w)) * F.pmod(F.floor(F.col("cell") / CELLS**i), F.lit(CELLS))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    kept = [F.col(c).alias(n) for c, n in zip(columns, names)]
    return assessed.select(*kept, score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_hits", "n_quoted", "n_misspelt")


def weigh(rows: DataFrame, prior: np.ndarray) -> np.ndarray:
    """Weights fitted on rows with a cell and a label 0 or 1; what is collected is bounded by
    the number of cells."""
    found = rows.groupBy("cell").agg(F.sum(1 - F.col("label")).cast("long").alias("good"), F.sum("label").cast("long").alias("bad")).orderBy("cell").toArrow()
    cell, good, bad = (found.column(i).to_numpy() for i in range(3))
    return fit(cell[:, None] // CELLS ** np.arange(FEATURES) % CELLS, bad, good, prior) if len(cell) else prior


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", max_terms: int = 2000) -> Model:
    """A model from rows with a text and a label 0 or 1, all of which are used."""
    _spark.ship(labelled.sparkSession)
    scratch = _spark.Scratch(labelled.sparkSession)
    rows = scratch.put(labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"), F.monotonically_increasing_id().alias("row")).where("text is not null and label in (0, 1)"), "labelled")
    model = learn_lexicon(rows, scratch, max_terms)
    marks = rows.select(F.col("row").alias("id"), "label")
    model = refine(scratch.put(survey(rows.select("row", "text"), model).join(marks, "id"), "survey"), model)
    assessed, _, _ = assess(rows, model, "text", (), label=F.col("label"))
    model.weights = weigh(assessed.withColumnRenamed(_spark.made("label"), "label"), model.weights)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """Kept columns with score (0 to 1), predicted (1 if score >= threshold) and the numbers
    n_hits, n_quoted and n_misspelt, for every row.

    A null, empty or blank text has no hits and the score of such texts. Texts are taken
    whole. Repeated rows get equal results; other columns are ignored, and so are kept ones
    named like a result; an empty table gives an empty result."""
    return _scored(*assess(docs, model, text, keep), model.weights, threshold)


def sampled(known: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows, all if there are no more, chosen by a hash of their id."""
    share = most / max(known.count(), 1)
    return known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else known


def score_toxicity(docs: DataFrame, labels: DataFrame, train_on: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3, max_terms: int = 2000, max_labels: int = 50_000) -> DataFrame:
    """score() of all documents, under a model of labelled ones for which ``train_on`` (of the
    document's columns) is true. The lexicon's candidates come from about ``max_labels``
    labelled ids, chosen by a hash, which bounds the sample and lets its ids be broadcast;
    everything that is counted of them, and the weights, from all labelled documents, by joins
    of document numbers without texts. A label row without a document, or with a null id or
    label, teaches nothing; of several labels of an id the largest counts."""
    spark = docs.sparkSession
    _spark.ship(spark)
    scratch = _spark.Scratch(spark)
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    ids = F.broadcast(sampled(known, max_labels))
    rows = docs.where(train_on).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    sample = scratch.put(rows.join(ids, "id").select("text", "label", F.monotonically_increasing_id().alias("row")), "sample")
    model = learn_lexicon(sample, scratch, max_terms)
    found = scratch.put(survey(rows, model), "survey")
    model = refine(scratch.put(found.join(known, "id"), "labelled"), model)
    train_id = F.when(train_on & F.col(text).isNotNull(), F.col(doc_id).cast("long"))
    assessed, names, columns = assess(docs, model, text, keep, id=train_id)
    assessed = scratch.put(assessed, "assessed")
    cell = assessed.select(F.col(_spark.made("id")).alias("id"), "cell").where("id is not null").join(known, "id")
    return _scored(assessed, names, columns, weigh(cell, model.weights), threshold)
