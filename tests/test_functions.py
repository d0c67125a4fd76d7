import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import call, equal
from lodestone.streaming import feed

DATES = ["2024-01-31 13:05:09", "2024-02-29 00:00:00", "2023-12-31 23:59:59", "2024-09-01", "1969-07-20 20:17:40", "no date", None]
CALLS = [
    ("date", ["+1 day"]),
    ("date", ["+1 month"]),
    ("datetime", ["start of month", "+1 month", "-1 day"]),
    ("datetime", ["-3 hours", "+30 minutes", "+90 seconds"]),
    ("date", ["-1 year"]),
    ("date", ["weekday 0"]),
    ("date", ["start of year", "weekday 3"]),
    ("time", []),
    ("unixepoch", ["start of day"]),
]


@pytest.fixture(scope="module")
def dates(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DATES)], "i int, d string")


def expected(sql, *more):
    con = sqlite3.connect(":memory:")
    return [con.execute(sql, (*more[:1], d, *more[1:])).fetchone()[0] for d in DATES]


@pytest.mark.parametrize("name, modifiers", CALLS)
def test_dates(dates, name, modifiers):
    got = [r[0] for r in dates.orderBy("i").select(call(name, F.col("d"), *modifiers)).collect()]
    con = sqlite3.connect(":memory:")
    marks = ", ".join("?" * (1 + len(modifiers)))
    assert got == [con.execute(f"SELECT {name.upper()}({marks})", (d, *modifiers)).fetchone()[0] for d in DATES]


def test_strftime(dates):
    pattern = "%Y-%m-%d|%H:%M:%S|%j|%w|%W|%s|%f|100%%"
    got = [r[0] for r in dates.orderBy("i").select(call("strftime", pattern, F.col("d"), "+1 day")).collect()]
    assert got == expected("SELECT STRFTIME(?, ?, ?)", pattern, "+1 day")
    day = [r[0] for r in dates.orderBy("i").select(call("julianday", F.col("d"))).collect()]
    con = sqlite3.connect(":memory:")
    assert day == [x if x is None else pytest.approx(x, abs=1e-6) for (x,) in (con.execute("SELECT JULIANDAY(?)", (d,)).fetchone() for d in DATES)]


def test_now_and_unknown_modifiers(dates):
    assert len(dates.select(call("date", "now")).first()[0]) == 10
    with pytest.raises(ValueError):
        call("date", F.col("d"), "next week")
    with pytest.raises(ValueError):
        call("strftime", "%Q", F.col("d"))


def test_texts_and_numbers_compare(spark, tmp_path):
    df = spark.createDataFrame([("5", 5), ("5.0", 7), ("x", 8), (None, None)], "a string, n long")
    assert [r.n for r in df.where(equal(F.col("a"), 5)).collect()] == [5, 7]
    assert df.where(equal(F.col("n"), "x")).count() == 0
    assert [r.a for r in df.where(equal(F.col("n"), "7")).collect()] == ["5.0"]
    assert df.where(equal(F.col("a"), None)).count() == 0
    df.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(equal(F.col("n"), 7))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n,7)" in plan


def test_many_changes_are_handed_over_in_ranges(spark, monkeypatch, tmp_path):
    from lodestone import Database, TableSpec, schema as s

    monkeypatch.setattr(feed, "MOST_EVENTS", 4)
    db = Database(spark, [TableSpec("t", {"x": s.integer()})], path=f"file://{tmp_path}/db")
    seen = []
    db.t.on("insert", lambda e: seen.append(e.x))
    db.t.insert_from(spark.range(11).select(F.col("id").alias("x")).coalesce(1))
    db.t.insert({"x": 11})
    db.poll()
    assert seen == list(range(12)) and db.store.state.changes == []
