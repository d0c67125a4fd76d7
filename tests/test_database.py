import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lodestone import ConcurrentCommit, ConstraintError, Database, NoRowFound, TableSpec, ValidationError
from lodestone import schema as s
from lodestone.sources import database


def users(**more):
    fields = {"name": s.string(), "email": s.string().email(), "score": s.number().default(0), "bio": s.string().optional()}
    return TableSpec("users", fields, **more)


SCORES = [("Alice", 100, None), ("Bob", 50, None), ("Carol", 100, None), ("Dave", 25, "x"), ("Eve", 75, "y")]


@pytest.fixture
def db(spark):
    posts = TableSpec("posts", {"title": s.string(), "user_id": s.integer().optional()})
    d = Database(spark, [users(), posts], relations={"posts": {"user_id": "users"}})
    d.users.insert_many([{"name": n, "email": f"{n.lower()}@x.org", "score": v, **({"bio": b} if b else {})} for n, v, b in SCORES])
    return d


def test_reads(db):
    q = db.users.select()
    assert q.count() == 5 and q.sum("score") == 350 and q.avg("score") == 70 and q.min("score") == 25 and q.max("score") == 100
    assert q.where({"score": {"$gte": 75}}).sum("score") == 275
    assert q.where({"score": -1}).sum("score") == 0 and q.where({"score": -1}).avg("score") == 0 and q.where({"score": -1}).min("score") is None
    assert q.where({"bio": {"$isNull": True}}).count() == 3
    assert sorted(db.users.select("score").distinct().pluck("score")) == [25, 50, 75, 100]
    assert db.users.select("score").distinct().count() == 4
    assert [r["score"] for r in db.users.select("score").group_by("score").having({"COUNT(*)": {"$gt": 1}}).all()] == [100]
    assert [len(db.users.select().order_by("id").paginate(p, 2)["data"]) for p in (1, 2, 3)] == [2, 2, 1]
    page = db.users.select().paginate(1, 2)
    assert page["total"] == 5 and page["pages"] == 3
    assert db.users.select().where({"score": -1}).paginate()["pages"] == 0
    assert {(r["score"], r["count"]) for r in db.users.select().group_by("score").count_grouped()} == {(100, 2), (50, 1), (25, 1), (75, 1)}
    with pytest.raises(ValueError):
        db.users.select().count_grouped()
    assert db.users.select().order_by("name", "desc").limit(2).offset(1).pluck("name") == ["Dave", "Carol"]
    assert db.users.select("name").order_by("score").first().name == "Dave"
    with pytest.raises(NoRowFound):
        db.users.select().where({"name": "Nobody"}).first_or_fail()
    assert not db.users.select().where({"name": "Nobody"}).exists() and db.users.select().exists()
    assert "LocalTableScan" in db.users.select().explain() or "Scan parquet" in db.users.select().explain()


def test_null_keeps_sql_meaning(db):
    assert db.users.select().where({"bio": None}).count() == 0
    assert db.users.select().where({"bio": {"$ne": "x"}}).count() == 1
    assert db.users.select().where({"bio": {"$notIn": ["x"]}}).count() == 1
    nulls = db.users.select("bio")
    assert db.users.select().where_not_in("name", nulls).count() == 0
    assert db.users.select().where_in("bio", nulls).count() == 2


def test_entities_and_relations(db):
    alice = db.users.get_one({"name": "Alice"})
    post = db.posts.insert({"title": "Hello", "user_id": alice.id})
    assert post.user().name == "Alice" and [p.title for p in alice.posts()] == ["Hello"]
    assert db.posts.select().where({"user": alice}).count() == 1
    alice.score = 7
    assert db.users.get(alice.id).score == 7 and alice.score == 7
    with pytest.raises(AttributeError):
        alice.nothing
    rows = db.users.select().with_("posts").order_by("id").all()
    assert [len(r.posts) for r in rows] == [1, 0, 0, 0, 0]
    row = db.posts.select().with_("user").first()
    assert row.to_dict()["user"]["name"] == "Alice"
    joined = db.posts.select("title").join(db.users, ["name"]).where({"users.score": 7}).all()
    assert [r.asDict() for r in joined] == [{"title": "Hello", "users_name": "Alice"}]
    assert db.users.select("name").join("posts", "id", ["title"], "user_id").all()[0]["posts_title"] == "Hello"
    with pytest.raises(ConstraintError):
        db.posts.insert({"title": "Orphan", "user_id": 99})
    db.users.delete(alice.id)
    assert db.posts.get(post.id).user_id is None


def test_mutations(db):
    assert db.users.update({"score": 1}).where({"score": 100}).exec() == 2
    with pytest.raises(ValueError):
        db.users.update({"score": 1}).exec()
    assert db.users.select().where({"score": 1}).increment("score", 9) == 2
    assert db.users.select().where({"score": 10}).decrement("score") == 2
    assert db.users.select().where({"score": 9}).count() == 2
    assert db.users.select().where_in("name", db.users.select("name").where({"score": 9})).update_all({"bio": "z"}) == 2
    assert db.users.select().where({"bio": "z"}).count() == 2
    assert db.users.delete().where({"name": {"$like": "%E%"}}).exec() == 3  # Alice, Dave, Eve
    assert db.users.select().order_by("name").pluck("name") == ["Bob", "Carol"]
    assert db.users.select().where({"name": "nobody"}).delete_all() == 0
    found = db.users.find_or_create({"name": "Zed"}, {"email": "z@x.org"})
    assert found["created"] and found["entity"].id == 6  # keys are never used again
    assert not db.users.find_or_create({"name": "Zed"})["created"]
    assert db.users.upsert({"name": "Zed"}, {"score": 5}).score == 5
    assert db.users.upsert({"name": "Yve"}, {"email": "y@x.org"}).id == 7
    assert [e.score for e in db.users.upsert_many([{"id": 6, "score": 1}, {"id": 7, "score": 2}])] == [1, 2]
    assert db.users.update(999, {"score": 1}) is None
    assert db.exec("UPDATE users SET score = score + ?, bio = 'q, r' WHERE name = ?", 10, "Zed") == 1
    assert db.users.get(6).bio == "q, r" and db.users.get(6).score == 11
    assert db.exec("INSERT INTO users (name, email) VALUES (?, ?), ('M', 'm@x.org')", "L", "l@x.org") == 2
    assert db.exec("DELETE FROM users WHERE name IN ('L', 'M')") == 2
    with pytest.raises(ValueError):
        db.exec("DROP TABLE users")
    before = db.users.count()
    db.users.compact()
    assert db.users.count() == before and len(db.state.tables["users"].segments) == 1
    assert db.store.vacuum() > 0 and db.users.count() == before


def test_validation(db):
    for bad in ({"name": "A"}, {"name": 1, "email": "a@b.c"}, {"name": "A", "email": "ab"}, {"name": "A", "email": "a@b.c", "other": 1}):
        with pytest.raises(ValidationError):
            db.users.insert(bad)
    assert db.users.count() == 5
    assert db.users.insert_many([]) == []


def test_bulk(spark, db):
    rows = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("name"), F.concat("id", F.lit("@x.org")).alias("email"))
    assert db.users.insert_from(rows.repartition(3)) == 1000
    assert db.users.count() == 1005 and db.users.select("id").distinct().count() == 1005 and db.users.select().max("id") == 1005
    assert db.users.select().where({"name": "u7"}).first().score == 0
    with pytest.raises(ValidationError):
        db.users.insert_from(rows.withColumn("email", F.lit("bad")))
    merged = spark.createDataFrame([("u1", "1@x.org", 5.0), ("v", "v@x.org", 6.0)], "name string, email string, score double")
    assert db.users.upsert_from(merged, "name") == (1, 1)
    assert db.users.select().where({"score": {"$in": [5, 6]}}).count() == 2


def test_transactions(db):
    def fail():
        db.users.insert({"name": "T", "email": "t@x.org"})
        db.users.select().update_all({"score": 0})
        assert db.users.count() == 6 and db.users.select().sum("score") == 0
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        db.transaction(fail)
    assert db.users.count() == 5 and db.users.select().sum("score") == 350
    assert db.transaction(lambda: db.users.insert({"name": "T", "email": "t@x.org"}).name) == "T"
    assert db.users.count() == 6


def test_two_writers(spark, db):
    other = Database(spark, db.specs.values(), path=db.path)
    db.users.insert({"name": "T", "email": "t@x.org"})
    with pytest.raises(ConcurrentCommit):
        other.users.insert({"name": "U", "email": "u@x.org"})
    assert Database(spark, db.specs.values(), path=db.path).users.count() == 6


def test_soft_deletes_timestamps_hooks(spark):
    calls = []
    hooks = {
        "users": {
            "before_insert": lambda d: {**d, "name": d["name"].strip()},
            "after_insert": lambda e: calls.append(("in", e.name)),
            "before_update": lambda d, key: calls.append(("up", key)),
            "before_delete": lambda key: key != 2,
            "after_delete": lambda key: calls.append(("del", key)),
        }
    }
    db = Database(spark, [users(timestamps=True, soft_deletes=True, unique=(("email",),))], hooks=hooks)
    a = db.users.insert({"name": " A ", "email": "a@x.org"})
    b = db.users.insert({"name": "B", "email": "b@x.org"})
    assert a.name == "A" and a.createdAt == a.updatedAt and isinstance(a.createdAt, dt.datetime)
    with pytest.raises(ConstraintError):
        db.users.insert({"name": "C", "email": "a@x.org"})
    with pytest.raises(ConstraintError):
        db.users.select().update_all({"email": "same@x.org"})
    created = a.createdAt
    a.update({"score": 3})
    assert a.updatedAt > created and db.users.get(a.id).createdAt == created
    assert db.users.delete(a.id) and not db.users.delete(b.id)
    assert db.users.select().pluck("name") == ["B"] and db.users.select().with_trashed().count() == 2
    assert db.users.select().where(lambda c, f, op: op.eq(f.lower(c.name), "a")).count() == 0
    assert db.users.select().only_trashed().pluck("name") == ["A"] and db.users.get(a.id) is not None
    db.users.restore(a.id)
    assert db.users.count() == 2
    assert b.delete(force=True) is False  # the hook refuses
    assert db.users.delete(a.id, force=True) and db.users.select().with_trashed().count() == 1
    assert calls == [("in", "A"), ("in", "B"), ("up", 1), ("del", 1), ("del", 1)]


def test_checks_send_new_rows_to_the_table(spark, monkeypatch):
    """Not the table to the rows, whatever its size."""
    posts = TableSpec("posts", {"title": s.string(), "user_id": s.integer()})
    db = Database(spark, [users(unique=(("email",),)), posts], relations={"posts": {"user_id": "users"}})
    db.users.insert_from(spark.range(2000).selectExpr("concat('u', id) AS name", "concat(id, '@x.org') AS email"))
    frame, sent = type(spark.range(1)), []
    collect, mode = frame.collect, spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")

    def watched(df):
        found = collect(df)
        sent.extend(float(x) for x in re.findall(r"BroadcastQueryStage .*rowCount=([\d.E+]+)", df._jdf.queryExecution().explainString(mode)))
        return found

    monkeypatch.setattr(frame, "collect", watched)
    db.users.insert({"name": "N", "email": "n@x.org"})
    db.posts.insert({"title": "t", "user_id": 7})
    with pytest.raises(ConstraintError, match="'7@x.org'"):
        db.users.insert({"name": "N", "email": "7@x.org"})
    with pytest.raises(ConstraintError, match="9999 is in no row of users"):
        db.posts.insert({"title": "t", "user_id": 9999})
    with pytest.raises(ConstraintError, match="'7@x.org'"):
        db.users.insert_from(spark.sql("SELECT 'N' AS name, '7@x.org' AS email"))
    with pytest.raises(ConstraintError, match="'7@x.org'"):
        db.users.update(1, {"email": "7@x.org"})
    assert sent and max(sent) <= 2


@pytest.mark.parametrize("few", [0, 100_000])
def test_checks_of_few_and_many_rows(spark, monkeypatch, few):
    monkeypatch.setattr(database, "FEW", few)
    spec = TableSpec("parts", {"a": s.string(), "b": s.string().optional(), "whole": s.integer().optional()}, unique=(("a", "b"),))
    db = Database(spark, [spec], relations={"parts": {"whole": "parts"}})
    db.parts.insert_many([{"a": "x", "b": "1"}, {"a": "x"}, {"a": "x"}, {"a": "y", "b": "1", "whole": 5}, {"a": "z", "b": "1", "whole": 1}])
    for rows, says in (
        ([{"a": "n", "b": "1"}, {"a": "x", "b": "1"}], "'x', '1'"),
        ([{"a": "n", "b": "1"}, {"a": "n", "b": "1"}], "'n', '1'"),
        ([{"a": "n", "b": "1", "whole": 1}, {"a": "n", "b": "2", "whole": 99}], "whole 99 is in no row of parts"),
    ):
        with pytest.raises(ConstraintError, match=says):
            db.parts.insert_many(rows)
        with pytest.raises(ConstraintError, match=says):
            db.parts.insert_from(spark.createDataFrame([(r["a"], r["b"], r.get("whole")) for r in rows], "a string, b string, whole long"))
    with pytest.raises(ConstraintError, match="id must be unique"):
        db.parts.insert_from(spark.sql("SELECT 2L AS id, 'n' AS a"))
    with pytest.raises(ConstraintError, match="whole 99 is in no row of parts"):
        db.parts.select().where({"a": "y"}).update_all({"whole": 99})
    with pytest.raises(ConstraintError, match="'x', '1'"):
        db.parts.select().where({"a": "x"}).update_all({"b": "1"})
    db.parts.insert_from(spark.sql("SELECT 'x' AS a, CAST(NULL AS STRING) AS b, 4L AS whole"))
    assert db.parts.count() == 6 and db.parts.select().where({"a": "y"}).pluck("whole") == [5]


def test_cascade(spark):
    specs = [TableSpec("authors", {"name": s.string()}), TableSpec("books", {"title": s.string(), "author_id": s.integer()})]
    db = Database(spark, specs, relations={"books": {"author_id": "authors"}}, cascade={"authors": ["books"]})
    db.authors.insert_many([{"name": "A"}, {"name": "B"}])
    db.books.insert_many([{"title": "x", "author_id": 1}, {"title": "y", "author_id": 1}, {"title": "z", "author_id": 2}])
    assert db.authors.delete(1)
    assert db.books.select().pluck("title") == ["z"]


def test_types_round_trip(spark):
    spec = TableSpec(
        "items",
        {
            "kind": s.enum("a", "b").default("a"),
            "alive": s.boolean().default(True),
            "at": s.date().optional(),
            "blob": s.binary().optional(),
            "tags": s.array(s.string()).default(list),
            "settings": s.obj(theme=s.string(), n=s.integer().optional()).optional(),
            "meta": s.record().default(dict),
            "pair": s.tuple_of(s.string(), s.number()).optional(),
            "either": s.union(s.string(), s.number()).optional(),
            "names": s.record(s.integer()).optional(),
        },
        computed={"loud": lambda c: F.upper(c.kind)},
    )
    db = Database(spark, [spec])
    at = dt.datetime(2020, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
    e = db.items.insert({"at": at, "blob": b"\0\1", "tags": ["x", "y"], "settings": {"theme": "dark"}, "meta": {"a": [1, {"b": None}]}, "pair": ("p", 1.5), "either": 2.5, "names": {"k": 1}})
    row = db.items.get(e.id)
    assert row.tags == ["x", "y"] and row.settings == {"theme": "dark", "n": None} and row.meta == {"a": [1, {"b": None}]} and bytes(row.blob) == b"\0\1"
    assert row.pair == ("p", 1.5) and row.either == 2.5 and row.kind == "a" and row.alive is True and row.names == {"k": 1} and row.loud == "A" == e.loud
    db.items.update(e.id, {"meta": {"z": 1}, "tags": []})
    assert db.items.get(e.id).meta == {"z": 1} and db.items.get(e.id).tags == []
    assert db.items.select().where({"loud": "A"}).count() == 1 and db.items.select("loud").order_by("loud").pluck("loud") == ["A"]
    with pytest.raises(ValidationError):
        db.items.insert({"kind": "c"})
    with pytest.raises(ValidationError):
        db.items.insert({"settings": {"theme": 1}})
    dumped = db.dump()
    again = Database(spark, [spec])
    again.load(dumped)
    assert again.items.select().first().meta == {"z": 1}


def test_dump_load_migrate_diff(spark, db):
    data = db.dump()
    assert len(data["users"]) == 5 and data["users"][0]["name"] == "Alice"
    other = Database(spark, [users()])
    other.load({**data, "unknown": [{}]})
    assert other.users.count() == 5
    other.seed({"users": [{"name": "S", "email": "s@x.org"}]})
    assert other.users.count() == 6
    other.load({"users": data["users"][:2]})
    assert other.users.count() == 2 and other.users.select().min("id") == 7
    path = other.path + "/export"
    db.dump_to(path)
    other.load_from(path)
    assert other.users.count() == 5
    assert other.diff() == {}
    wider = users()
    wider.fields["age"] = s.integer().optional()
    migrated = Database(spark, [wider], path=other.path)
    assert migrated.users.select().where({"age": {"$isNull": True}}).count() == 5
    migrated.users.insert({"name": "W", "email": "w@x.org", "age": 3})
    assert migrated.users.select().sum("age") == 3
    narrow = Database(spark, [users()], path=other.path)
    assert narrow.diff() == {"users": {"added": [], "removed": ["age"], "type_changed": []}}
    assert narrow.tables() == ["users"] and [c["name"] for c in narrow.columns("users")] == ["id", "name", "email", "score", "bio"]
    narrow.close()
    with pytest.raises(RuntimeError):
        narrow.users.count()


def test_listeners(db):
    seen = []
    off = db.users.on("insert", lambda e: seen.append(("insert", e.name)))
    db.users.on("update", lambda e: seen.append(("update", e.score)))
    db.users.on("delete", lambda e: seen.append(("delete", e)))
    db.users.on("insert", lambda e: 1 / 0)  # a failing listener disturbs no other
    f = db.users.insert({"name": "F", "email": "f@x.org"})
    db.users.select().where({"name": "Bob"}).increment("score", 1)
    db.users.delete(1)
    assert db.poll() == 3
    assert seen == [("insert", "F"), ("update", 51), ("delete", {"id": 1})]
    off()
    db.users.insert({"name": "G", "email": "g@x.org"})
    f.score = 9
    db.poll()
    assert seen[3:] == [("update", 9)]
    db._feed.trim()
    assert db.store.files.names("_changes") == [] or all(x.startswith((".", "_")) for x in db.store.files.names("_changes"))
    with pytest.raises(ValueError):
        db.users.on("other", print)
    db.close()


def test_background_listener(db):
    import time

    seen = []
    db.users.on("insert", lambda e: seen.append(e.name))
    db._feed.start()
    db.users.insert({"name": "F", "email": "f@x.org"})
    for _ in range(100):
        if seen:
            break
        time.sleep(0.2)
    db.close()
    assert seen == ["F"]


def test_indexes_sort_and_filter(spark):
    db = Database(spark, [TableSpec("points", {"email": s.string(), "n": s.integer()}, indexes=(("email",), ("n",)))])
    db.points.insert_from(spark.range(2000).selectExpr("concat('e', (id * 7919) % 2000) email", "id n"))
    assert db.points.select().where({"email": "e77"}).count() == 1
    emails = [r.email for r in db.frame("points").coalesce(1).select("email").collect()]
    assert emails == sorted(emails) or db.frame("points").rdd.getNumPartitions() > 1
    db.points.update({"n": 1}).where({"email": "e5"}).exec()
    db.points.compact()
    assert db.points.count() == 2000


def test_null_aware_not_in(spark, db):
    empty = db.users.select("bio").where({"name": "Nobody"})
    assert db.users.select().where_not_in("bio", empty).count() == 5
    assert db.users.select().where_not_in("bio", spark.createDataFrame([("x",)], "b string")).count() == 1
    assert db.users.select().where_not_in("name", spark.createDataFrame([("Bob",), (None,)], "b string")).count() == 0
    assert "BroadcastNestedLoopJoin" not in db.users.select().where_not_in("name", db.users.select("email")).explain()


def test_not_reactive(spark):
    db = Database(spark, [users()], reactive=False)
    db.users.insert({"name": "F", "email": "f@x.org"})
    with pytest.raises(RuntimeError):
        db.users.on("insert", print)


def test_multi(db):
    db.posts.insert_many([{"title": "p", "user_id": 1}, {"title": "q", "user_id": 1}, {"title": "r", "user_id": 2}])

    def joined(c):
        u, p = c.users, c.posts
        return {"select": {"who": u.name, "what": p.title, "one": 1}, "join": [p.user_id, u.id], "where": {u.score: {"$gte": 50}, p.title: ["p", "r"]}, "order_by": {p.title: "desc"}}

    assert [tuple(r) for r in db.query(joined).collect()] == [("Bob", "r", 1), ("Alice", "p", 1)]

    def grouped(c):
        u, p = c.users, c.posts
        return {"select": {"who": u.name, "n": F.count("*")}, "join": [u.id, p.user_id], "group_by": [u.name], "order_by": [(u.name, "asc")], "limit": 5}

    assert [tuple(r) for r in db.query(grouped).collect()] == [("Alice", 2), ("Bob", 1)]

    def self_join(c):
        a, b = c.users, c.users
        return {"select": {"a": a.name, "b": b.name}, "join": [a.score, b.score], "where": {a.name: "Alice", b.name: {"$ne": "Alice"}}}

    assert [tuple(r) for r in db.query(self_join).collect()] == [("Alice", "Carol")]
    assert [r[0] for r in db.raw("SELECT name FROM users WHERE score > ? ORDER BY name", 60).collect()] == ["Alice", "Carol", "Eve"]
