"""License scanning: TF-IDF cosine to templates, then inheritance from directories.

A text is cut into paragraphs, lines and sentences, and itself as a whole. Every piece is
compared with all templates by the cosine of sparse TF-IDF vectors, in which words that no
template has weigh as much as the rarest word of the templates, so that prose around a notice
lowers its score. Templates are the full texts in ``license_texts``, each of their paragraphs,
well-known headers, and a table of licenses' names in a few phrases.

A text that is as a whole near a full license text has that license alone. Otherwise a
paragraph that several licenses share counts for the one of which most is in the text (words,
weighed by how near their pieces are), and of equals for the one whose own full text is covered best: a text with the two clauses that both
BSD licenses have is not the one of three.

Two tests pass over pieces that can't be near a template, both by the Cauchy-Schwarz inequality.
A piece without any of the templates' ``keys`` stays below the threshold: of each template these
words hold more than 1 - threshold**2 of the squared length, and the rest of it gives less than
the threshold with any piece. So does a piece of whose own squared length less than threshold**2
lies in words of templates.

A file without a license of its own takes that of the license file in the nearest directory
above it. Directories, not files, are expanded into their ancestors and joined with the
directories that hold a license file; both joins are salted where a directory is hot.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: SPDX identifiers and names that notices call the licenses by.
LICENSES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2", "GNU GPL 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3", "GNU GPL 3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL v3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0", "CC0 public domain dedication"],
    **{
        f"CC-{kind.replace(' ', '-')}-{v}": [f"CC {kind} {v}", f"Creative Commons {names} {v}", f"Creative Commons {names} {v} International"]
        for kind, names in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for v in ("3.0", "4.0")
    },
}
PHRASES = ("{}", "licensed under the {}", "licensed under {}", "released under the {}", "this work is licensed under the {}", "this work is licensed under {}", "distributed under the terms of the {}", "available under the {}", "you may use this file under the terms of the {}")
#: Opening sentences and headers of well-known licenses, and notices without one.
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Proprietary": ["All rights reserved", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited"],
}
#: Ordinary words that become keys last.
COMMON = frozenset("that this with from have which such other they their there will been were when what about into some than then these those your would".split())
#: Holds beside a license's own words in many notices, and counts only where no license is named.
WEAK = "Proprietary"
#: Words of a paragraph of a full text that makes a template, at least.
PARAGRAPH_WORDS = 12
#: Cosine of a whole text with a full license text that makes it one.
WHOLE = 0.85
_WORDS = re.compile(r"[a-z]+\d*|\d+(?:\.\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", re.I)
LICENSE_NAMES = r"(?i)^(?:un)?licen[cs]e(?:[.-].*)?$|^copying(?:[.-].*)?$|^licenses?\.(?:txt|md|rst)$"


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def full_texts() -> dict[str, str]:
    """The license texts that come with this package, by identifier."""
    folder = resources.files(__package__) / "license_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def paragraphs(text: str) -> list[str]:
    return [x for x in re.split(r"\n[ \t\r]*\n", text) if x.strip()]


class Templates:
    """TF-IDF vectors of all templates, as an inverted index from words."""

    def __init__(self, licenses: dict[str, list[str]] = LICENSES, texts: dict[str, list[str]] = TEXTS, full: dict[str, str] | None = None, threshold: float = 0.75):
        full = full_texts() if full is None else full
        self.threshold = threshold
        docs = [(key, words(p.format(name))) for key, names in licenses.items() for name in names for p in PHRASES] + [(key, words(t)) for key, some in texts.items() for t in some]
        docs += [(key, ws) for key, t in full.items() for x in paragraphs(t) if len(ws := words(x)) >= PARAGRAPH_WORDS]
        # the head of a text, its title and what follows to the first long paragraph, names it
        docs += [(key, words(" ".join(paragraphs(t)[:n]))) for key, t in full.items() for n in (1, 2, 3)]
        self.whole = {len(docs) + i for i in range(len(full))}
        docs += [(key, words(t)) for key, t in full.items()]
        df = Counter(w for _, ws in docs for w in set(ws))
        self.unknown = math.log(1 + len(docs)) + 1
        self.idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
        self.licenses = [key for key, _ in docs]
        self.length = {key: len(words(t)) for key, t in full.items()}
        self.spdx = {key.lower(): key for key in (*licenses, *texts, *full)}
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        keys: set[str] = set()
        for i, (_, ws) in enumerate(docs):
            v = self.vector(ws)
            for w, x in v.items():
                self.index[w].append((i, x))
            have = sum(x * x for w, x in v.items() if w in keys)
            for w, x in sorted(v.items(), key=lambda e: (e[0] in COMMON, -len(e[0]), -e[1], e[0])):  # long words are rare in other texts
                if have > 1 - threshold**2 + 1e-9:
                    break
                if w not in keys:
                    keys.add(w)
                    have += x * x
        self.keys = frozenset(keys)

    def vector(self, ws: list[str]) -> dict[str, float]:
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.unknown) for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def bound(self, ws: list[str]) -> float:
        """What no cosine with a template exceeds: the length of the part of the vector that
        lies in words of templates."""
        known = unknown = 0.0
        for w, n in Counter(ws).items():
            x = 1 + math.log(n)
            if w in self.idf:
                known += (x * self.idf[w]) ** 2
            else:
                unknown += x * x
        return math.sqrt(known / (known + unknown * self.unknown**2)) if known else 0.0

    def cosines(self, ws: list[str]) -> dict[int, float]:
        """The cosine with each template that shares a word."""
        got: dict[int, float] = defaultdict(float)
        for w, x in self.vector(ws).items():
            for i, y in self.index.get(w, ()):
                got[i] += x * y
        return got

    def best(self, text: str) -> dict[str, float]:
        """The highest cosine of each license that shares a word with the text."""
        out: dict[str, float] = {}
        for i, c in self.cosines(words(text)).items():
            out[self.licenses[i]] = max(out.get(self.licenses[i], 0.0), min(c, 1.0))
        return out

    def look(self, piece: str) -> tuple[frozenset[str], float]:
        """The licenses of the templates that are nearest to a piece, if near enough."""
        spdx = _SPDX.search(piece)
        if spdx:
            name = spdx[1].lower().removesuffix("-only").removesuffix("-or-later")
            if name in self.spdx:
                return frozenset([self.spdx[name]]), 1.0
        ws = words(piece)
        if self.keys.isdisjoint(ws) or self.bound(ws) < self.threshold:
            return frozenset(), 0.0
        found = self.best(piece)
        top = max(found.values(), default=0.0)
        if top < self.threshold:
            return frozenset(), 0.0
        return frozenset(k for k, c in found.items() if c > top - 1e-6), top

    def scan(self, text: str, threshold: float | None = None) -> tuple[list[tuple[str, float]], int, int]:
        """(license, score) found, best first, the number of notices and of words in them."""
        all_words = words(text)
        if not all_words or self.keys.isdisjoint(all_words) and not _SPDX.search(text):
            return [], 0, 0
        whole = {i: c for i, c in self.cosines(all_words).items() if i in self.whole and c >= WHOLE} if self.bound(all_words) >= WHOLE else {}
        if whole:
            i = min(whole, key=lambda i: (-whole[i], self.licenses[i]))
            return [(self.licenses[i], min(whole[i], 1.0))], 1, len(all_words)
        seen: dict[str, tuple[frozenset[str], float]] = {}

        def look(piece: str) -> tuple[frozenset[str], float]:
            if piece not in seen:
                seen[piece] = self.look(piece)
            return seen[piece]

        pieces: list[tuple[frozenset[str], float, int]] = []  # that matched, none inside another
        notices = 0
        for paragraph in paragraphs(text):
            if self.keys.isdisjoint(words(paragraph)) and not _SPDX.search(paragraph):
                continue
            lines = paragraph.split("\n")
            inner: list[tuple[frozenset[str], float, int]] = []
            for line in lines:
                if self.keys.isdisjoint(words(line)) and not _SPDX.search(line):
                    continue
                of_line = [(*got, len(words(x))) for x in dict.fromkeys(_SENTENCE.split(line)) if (got := look(x))[0]]
                got = look(line)
                if got[0] and len(words(line)) >= sum(x[2] for x in of_line):
                    of_line = [(*got, len(words(line)))]
                inner += of_line
            joined = look(" ".join(paragraph.split())) if len(lines) > 1 else (frozenset(), 0.0)
            if joined[0] and len(words(paragraph)) >= sum(x[2] for x in inner):
                inner = [(*joined, len(words(paragraph)))]
            notices += len(inner)
            pieces += inner
        named = [x for x in pieces if x[0] != {WEAK}]
        mass: dict[str, float] = defaultdict(float)  # words, by how far above the threshold their piece is
        for names, score, n in named or pieces:
            for k in names:
                mass[k] += n * ((score - self.threshold) / (1 - self.threshold)) ** 2
        rank = lambda k: (-mass[k], -mass[k] / self.length.get(k, math.inf), k)
        found: dict[str, float] = {}
        for names, score, _ in named or pieces:
            k = min(names, key=rank)
            found[k] = max(found.get(k, 0.0), score)
        return sorted(found.items(), key=lambda x: rank(x[0])), notices, sum(x[2] for x in pieces)


SCAN = "license string, score double, licenses array<string>, n_notices int, mostly_license boolean"


def detect(files: DataFrame, text: str = "text", keep: tuple[str, ...] = ("path",), threshold: float = 0.75) -> DataFrame:
    """Kept columns with SCAN for every row, from its whole text.

    license is the license that holds most of the text's words and score its cosine; without one,
    null and 0. Ties fall to the identifier that sorts first. mostly_license: notices make up
    nine tenths of the words. Null and empty texts have none. Repeated rows get equal results;
    other columns are ignored, and so are kept ones named like a result; an empty table gives
    an empty result."""
    _spark.ship(files.sparkSession)
    rows, names, out = _spark.carried(files, keep, SCAN, text=F.col(text).cast("string"))
    last = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(threshold=threshold)
        some_key = r"(?i)\b(?:" + "|".join(re.escape(k) for k in sorted(templates.keys)) + r")|spdx-license-identifier"
        for batch in batches:
            texts = batch.column(last)
            some = pc.fill_null(pc.match_substring_regex(texts, some_key), False).to_numpy(zero_copy_only=False)
            license, score, all_of, n, mostly = [None] * len(texts), np.zeros(len(texts)), [[]] * len(texts), np.zeros(len(texts), np.int32), np.zeros(len(texts), bool)
            for i in np.flatnonzero(some):
                t = texts[int(i)].as_py()
                found, n[i], held = templates.scan(t)
                if found:
                    license[i], score[i], all_of[i] = found[0][0], found[0][1], sorted(x[0] for x in found)
                    mostly[i] = 10 * held >= 9 * len(words(t))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(license, pa.string()), pa.array(score), pa.array(all_of, pa.list_(pa.string())), pa.array(n), pa.array(mostly)], out.names)

    return rows.mapInArrow(run, out)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty for a path without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame, path: str = "path", license_file: Column | None = None) -> DataFrame:
    """Adds license_file, effective_license and inherited_from (a directory) to detect()'s rows.

    A license file is a row with a license for which ``license_file`` is true; by default one
    with a name such as LICENSE or COPYING. A row without a license gets that of the nearest directory above its
    path that holds a license file; of several there, the best score counts, then the
    identifier that sorts first. A null path inherits nothing."""
    if license_file is None:
        license_file = F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(LICENSE_NAMES), F.lit(False))
    rows = scanned.withColumn("license_file", F.col("license").isNotNull() & license_file).withColumn("_dir", directory(F.col(path)))
    sources = rows.where("license_file and _dir is not null").groupBy(F.col("_dir").alias("_above")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l")))["l"].alias("_found"))
    dirs = rows.where("license is null and _dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts)))).alias("_depth"))
    above = above.select("_dir", "_depth", F.array_join(F.slice(parts, 1, F.col("_depth")), "/").alias("_above"))
    salts = 16  # the topmost directory is above all others
    above = above.withColumn("_salt", F.pmod(F.xxhash64("_dir"), F.lit(salts)).cast("int"))
    spread = sources.select(F.col("_above").alias("_a"), "_found", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    nearest = above.join(spread, (above["_above"] == spread["_a"]) & (above["_salt"] == spread["_s"])).groupBy("_dir").agg(F.max(F.struct("_depth", "_found", "_above")).alias("x"))
    nearest = nearest.select(F.col("_dir").alias("_d"), F.col("x._found").alias("_license"), F.col("x._above").alias("_from"))
    # a directory with many files: its one row goes to as many salts as its rows are dealt over
    width = 64
    nearest = nearest.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_s"))
    dealt = rows.withColumn("_salt", F.when(F.col("license").isNull(), F.pmod(F.xxhash64(path), F.lit(width))).cast("int"))
    out = dealt.join(nearest, (dealt["_dir"] == nearest["_d"]) & (dealt["_salt"] == nearest["_s"]), "left")
    return out.select(*scanned.columns, "license_file", F.coalesce("license", "_license").alias("effective_license"), F.when(F.col("license").isNull(), F.col("_from")).alias("inherited_from"))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ("path",), threshold: float = 0.75, license_file: Column | None = None) -> DataFrame:
    """detect() and then inherit(): one row for every row of ``files``."""
    scratch = _spark.Scratch(files.sparkSession)
    scanned = scratch.put(detect(files, text, keep, threshold), "scanned")
    return inherit(scanned, path, license_file)
