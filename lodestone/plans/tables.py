"""The benchmark tables as an attached database, and managed copies of some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as s
from ..sources.database import Database
from ..sources.schema import TableSpec

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "events": "event_id",
}
RELATIONS = [
    ("nation", "n_regionkey", "region"),
    ("customer", "c_nationkey", "nation"),
    ("supplier", "s_nationkey", "nation"),
    ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"),
    ("lineitem", "l_partkey", "part"),
    ("lineitem", "l_suppkey", "supplier"),
]


def attached(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    for name, key in KEYS.items():
        db.attach(name, f"{sf_dir}/{name}.parquet", key)
    for child, fk, parent in RELATIONS:
        db.relate(child, fk, parent)
    return db


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shop(spark: SparkSession, sf_dir: str, soft: bool = False, cascade: bool = False, unique: bool = False) -> Database:
    """Managed copies of customer and orders, with the benchmark's keys."""
    specs = [
        TableSpec("customers", {"c_name": s.string(), "c_mktsegment": s.string(), "c_acctbal": s.number()}, key="c_custkey", unique=(("c_name",),) if unique else ()),
        TableSpec("sales", {"o_custkey": s.integer().optional(), "o_orderstatus": s.enum("F", "O", "P"), "o_totalprice": s.number(), "o_orderpriority": s.string()}, key="o_orderkey", soft_deletes=soft),
    ]
    db = Database(spark, specs, relations={"sales": {"o_custkey": "customers"}}, cascade={"customers": ["sales"]} if cascade else None)
    db.customers.insert_from(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))
    db.sales.insert_from(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    return db


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """Sums of doubles depend on their order in the last places."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
