import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.licenses import Templates, full_texts, paragraphs, scan_licenses, words


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("prose before.\nReleased under the MIT License.\nand behind", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}", "GPL-2.0"),
        ("Copyright 2020 X. All rights reserved.", "Proprietary"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the \"Software\"), to deal in the Software without restriction", "MIT"),
        ("Copyright 2020 X. All rights reserved.\n\nReleased under the MIT License.", "MIT"),
        ("the driver lost his license in the rain", None),
        ("MIT and Apache are names", None),
        ("", None),
    ],
)
def test_detection(text, want):
    found, notices, _ = Templates().scan(text, 0.75)
    assert (found[0][0] if found else None) == want and (notices > 0) == (want is not None)


def brute(files):
    """effective license by walking up the directories."""
    t = Templates()
    own = {p: (x[0] if (x := t.scan(text or "", 0.75)[0]) else None) for p, text in files if p is not None}
    held = {p.rpartition("/")[0]: x[0] for p, x in own.items() if x and p.rpartition("/")[2] in ("LICENSE", "COPYING")}
    out = {}
    for p, x in own.items():
        d = p.rpartition("/")[0]
        while not x and d not in held and d:
            d = d.rpartition("/")[0]
        out[p] = x[0] if x else held.get(d)
    return out


def test_inheritance(spark):
    files = [("LICENSE", "Released under the MIT License."), ("a/COPYING", "GNU General Public License, version 3"), ("q.py", "# Licensed under the Apache License, Version 2.0\nfoo bar baz code"), ("k/z.py", None), ("ab/y.py", "")]
    files += [(f"a/{'b/' * i}f{i}.py", "# code") for i in range(6)] + [("c/d/LICENSE", "BSD 3-Clause License"), ("c/d/e/x", "x"), ("c/x", "x")]
    frame = spark.createDataFrame(files, "path string, text string")
    got = {r.path: r for r in scan_licenses(frame).collect()}
    assert {p: r.effective_license for p, r in got.items()} == brute(files)
    assert got["a/b/b/f2.py"].inherited_from == "a" and got["k/z.py"].inherited_from == "" and got["q.py"].inherited_from is None


def test_no_license_file_no_inheritance(spark):
    frame = spark.createDataFrame([("a/x", "Released under the MIT License."), ("a/y", "y")], "path string, text string")
    assert {r.path: r.effective_license for r in scan_licenses(frame).collect()} == {"a/x": "MIT", "a/y": None}


def test_whole_table(spark, docs, sf_dir):
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, sf_dir).collect()}
    t = Templates()
    assert len(got) == docs.count()
    for r in docs.collect():
        found = t.scan(r.text, 0.75)[0]
        assert got[r.doc_id].license == (found[0][0] if found else None)


def test_odd_rows(odd, empty):
    files = odd.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).withColumn("license", F.lit("clash"))
    got = scan_licenses(files.withColumn("path", F.when(F.col("doc_id") != 5, F.col("path"))), keep=("doc_id", "path")).collect()
    assert len(got) == odd.count() and all(r.license is None and r.effective_license is None for r in got)
    assert scan_licenses(files.limit(0)).collect() == []


@pytest.fixture(scope="module")
def templates():
    return Templates()


@pytest.mark.parametrize("key", sorted(full_texts()))
def test_full_texts(templates, key):
    """As they are; with names filled in; without title and notice; on one line; after prose."""
    text = full_texts()[key]
    named = text.replace("<year>", "2021").replace("<copyright holders>", "Jane Doe").replace("<copyright holder>", "Jane Doe")
    body = "\n\n".join(paragraphs(text)[2:])
    for t in (text, named, " ".join(named.split()), named.upper()):
        found, notices, held = templates.scan(t)
        assert [x[0] for x in found] == [key] and held == len(words(t)) and notices == 1
    assert [x[0] for x in templates.scan(body)[0]] == [key]
    prose = "some prose about nothing in particular.\n\n" * 40
    assert templates.scan(prose + text)[0][0][0] == key or key == "BSD-2-Clause"  # its clauses are the other's too


@pytest.mark.parametrize("name, key", [("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0")])
def test_texts_and_heads_of_the_system(templates, name, key):
    path = pathlib.Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("no such file here")
    text = path.read_text()
    assert [x[0] for x in templates.scan(text)[0]] == [key]
    assert templates.scan("\n".join(text.split("\n")[:14]))[0][0][0] in (key, "BSD-2-Clause")


def test_tests_lose_nothing(templates):
    """Pieces without a key, or over the bound, against all cosines."""
    rng = random.Random(1)
    vocabulary = sorted(templates.idf) + ["foo", "bar", "baz"] * 300
    pieces = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    for t in full_texts().values():
        some = words(t)
        for _ in range(40):
            at, n = rng.randrange(len(some)), rng.randrange(3, 60)
            pieces.append(" ".join(rng.choice(["foo", w]) if rng.random() < 0.2 else w for w in some[at : at + n]))
    for piece in pieces:
        ws = words(piece)
        top = max(templates.cosines(ws).values(), default=0)
        assert top <= templates.bound(ws) + 1e-9
        assert not templates.keys.isdisjoint(ws) or top < templates.threshold
