"""Queries that change managed copies of the benchmark tables and return what they hold then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as s
from ..sources.database import ConstraintError, Database
from ..sources.schema import TableSpec
from .tables import read, rounded, shop

PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
S = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
_S = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def plan(sql: str | None):
    def register(fn):
        PLANS[fn.__name__] = (fn, sql)
        return fn

    return register


@plan("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def insert_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    return db.sales.df().agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@plan("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS id, n_name AS name, 'member' AS role FROM nation")
def insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, [TableSpec("people", {"name": s.string(), "role": s.string().default("member")})])
    db.people.insert_many([{"name": r[0]} for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()])
    return db.people.df()


@plan("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.sales.update({"o_orderstatus": "P"}).where({"o_totalprice": {"$gt": 300000}}).exec()
    return db.sales.select(*S).df()


@plan("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice FROM orders")
def increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.sales.select().where_in("o_custkey", db.customers.select("c_custkey").where({"c_mktsegment": "BUILDING"})).increment("o_totalprice", 100)
    return db.sales.select("o_orderkey", "o_totalprice").df()


@plan("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice - 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def decrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.sales.select().where({"o_orderstatus": "F"}).decrement("o_totalprice")
    return db.sales.select("o_orderkey", "o_totalprice").df()


@plan(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders "
    "UNION ALL SELECT o_orderkey + 10000000, o_totalprice * 2 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0"
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the merged rows are there, the other half are new."""
    db = shop(spark, sf_dir)
    some = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    new = some.where("o_orderkey % 2 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    db.sales.upsert_from(some.unionByName(new), "o_orderkey")
    return db.sales.select("o_orderkey", "o_totalprice").df()


@plan("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'new'")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, [TableSpec("lands", {"n_name": s.string(), "code": s.integer()})])
    db.lands.insert_from(read(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("code")))
    db.lands.upsert({"code": 3}, {"n_name": "changed"})
    db.lands.upsert({"code": 100}, {"n_name": "new"})
    return db.lands.df().select(F.col("code").cast("int").alias("n_nationkey"), "n_name")


@plan(f"{_S} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.sales.delete().where({"o_orderstatus": "F", "o_totalprice": {"$lt": 200000}}).exec()
    return db.sales.select(*S).df()


@plan(f"{_S} WHERE NOT o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_all_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.sales.select().where_in("o_custkey", db.customers.select("c_custkey").where({"c_acctbal": {"$lt": 0}})).delete_all()
    return db.sales.select(*S).df()


@plan(f"{_S} WHERE o_orderstatus <> 'O'")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir, soft=True)
    db.sales.delete().where({"o_orderstatus": "O"}).exec()
    return db.sales.select(*S).df()


@plan(f"{_S} WHERE o_orderstatus = 'O'")
def only_trashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir, soft=True)
    db.sales.delete().where({"o_orderstatus": "O"}).exec()
    return db.sales.select(*S).only_trashed().df()


@plan("SELECT count(*) AS live, (SELECT count(*) FROM orders) AS everything FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O')")
def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir, soft=True)
    first = db.sales.select().where({"o_orderstatus": "O"}).min("o_orderkey")
    db.sales.delete().where({"o_orderstatus": "O"}).exec()
    db.sales.restore(first)
    return spark.createDataFrame([(db.sales.count(), db.sales.select().with_trashed().count())], "live long, everything long")


@plan(f"{_S} WHERE o_custkey <> 7")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir, cascade=True)
    db.customers.delete(7)
    return db.sales.select(*S).df()


@plan("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN o_custkey END AS o_custkey FROM orders")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.customers.delete().where({"c_mktsegment": "BUILDING"}).exec()
    return db.sales.select("o_orderkey", "o_custkey").df()


@plan("SELECT true AS dangling, true AS twice, count(*) AS n FROM customer")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir, unique=True)

    def refused(fn: Callable) -> bool:
        try:
            fn()
        except ConstraintError:
            return True
        return False

    dangling = refused(lambda: db.sales.insert({"o_custkey": 1 << 40, "o_orderstatus": "F", "o_totalprice": 1, "o_orderpriority": "x"}))
    twice = refused(lambda: db.customers.insert({"c_name": db.customers.select().first().c_name, "c_mktsegment": "x", "c_acctbal": 0}))
    return spark.createDataFrame([(dangling, twice, db.customers.count())], "dangling boolean, twice boolean, n long")


@plan("SELECT n_nationkey, n_name, CAST(NULL AS BIGINT) AS rank FROM nation")
def migrate_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"n_name": s.string()}
    db = Database(spark, [TableSpec("lands", fields, key="n_nationkey")])
    db.lands.insert_from(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    wider = Database(spark, [TableSpec("lands", {**fields, "rank": s.integer().optional()}, key="n_nationkey")], path=db.path)
    return wider.lands.df().withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@plan("SELECT n_name, n_regionkey FROM nation UNION ALL SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
def dump_load_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, [TableSpec("lands", {"n_name": s.string(), "n_regionkey": s.integer()})])
    db.lands.insert_from(read(spark, sf_dir, "nation").select("n_name", "n_regionkey"))
    data = db.dump()
    db.load(data)
    db.seed({"lands": [r for r in data["lands"] if r["n_regionkey"] == 0]})
    return db.lands.df().select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@plan("SELECT 'lands' AS tbl, 'rank' AS removed")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = TableSpec("lands", {"n_name": s.string(), "rank": s.integer().optional()})
    db = Database(spark, [one])
    narrow = Database(spark, [TableSpec("lands", {"n_name": s.string()})], path=db.path)
    return spark.createDataFrame([(t, c) for t, d in narrow.diff().items() for c in d["removed"]], "tbl string, removed string")


@plan("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P'")
def transaction_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.transaction(lambda: db.sales.delete().where({"o_orderstatus": "P"}).exec())

    def fails() -> None:
        db.sales.select().update_all({"o_totalprice": 0})
        db.sales.select().delete_all()
        raise RuntimeError("roll back")

    try:
        db.transaction(fails)
    except RuntimeError:
        pass
    return rounded(db.sales.df().agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total")


@plan("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_totalprice < 10000)")
def exec_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = shop(spark, sf_dir)
    db.exec("UPDATE sales SET o_orderstatus = ? WHERE o_totalprice > ?", "O", 250000)
    db.exec("DELETE FROM sales WHERE o_totalprice < ?", 10000)
    return db.sales.select("o_orderkey", "o_orderstatus").df()


@plan(
    "SELECT 'insert' AS op, count(*) AS n FROM nation UNION ALL SELECT 'update', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'delete', count(*) FROM nation WHERE n_regionkey = 2"
)
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, [TableSpec("lands", {"n_name": s.string(), "n_regionkey": s.integer()})])
    seen: list[tuple[str, int]] = []
    for op in ("insert", "update", "delete"):
        db.lands.on(op, lambda e, op=op: seen.append((op, 1)))
    db.lands.insert_from(read(spark, sf_dir, "nation").select("n_name", "n_regionkey"))
    db.poll()
    db.lands.select().where({"n_regionkey": 1}).update_all({"n_name": "x"})
    db.lands.select().where({"n_regionkey": 2}).delete_all()
    db.poll()
    db.close()
    return spark.createDataFrame(seen, "op string, one int").groupBy("op").agg(F.count("*").alias("n"))
