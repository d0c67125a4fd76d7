"""Queries that read: filters, projections, joins, aggregates, sorting, raw SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import call
from .tables import attached, rounded

PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
O = ("o_orderkey", "o_custkey", "o_totalprice")  # noqa: E741
_O = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def plan(sql: str | None, name: str | None = None):
    def register(fn):
        PLANS[name or fn.__name__] = (lambda spark, sf_dir: fn(attached(spark, sf_dir)), sql)
        return fn

    return register


def _filters() -> None:
    """Object conditions on orders and lineitem, one query for each operator."""
    cases = {
        "filter_eq": ({"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
        "filter_eq_null": ({"o_orderstatus": None}, "o_orderstatus = NULL"),
        "filter_ne": ({"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'"),
        "filter_gt": ({"o_totalprice": {"$gt": 400000}}, "o_totalprice > 400000"),
        "filter_gte": ({"o_totalprice": {"$gte": 400000}}, "o_totalprice >= 400000"),
        "filter_lt": ({"o_totalprice": {"$lt": 20000}}, "o_totalprice < 20000"),
        "filter_lte": ({"o_totalprice": {"$lte": 20000}}, "o_totalprice <= 20000"),
        "filter_in": ({"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')"),
        "filter_in_empty": ({"o_orderpriority": {"$in": []}}, "1 = 0"),
        "filter_not_in": ({"o_orderpriority": {"$notIn": ["1-URGENT", "5-LOW"]}}, "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
        "filter_not_in_empty": ({"o_orderpriority": {"$notIn": []}}, "1 = 1"),
        "filter_between": ({"o_totalprice": {"$between": [100000, 120000]}}, "o_totalprice BETWEEN 100000 AND 120000"),
        "filter_multi_op": ({"o_totalprice": {"$gt": 100000, "$lt": 120000, "$ne": 110000}, "o_orderstatus": "O"}, "o_totalprice > 100000 AND o_totalprice < 120000 AND o_totalprice <> 110000 AND o_orderstatus = 'O'"),
        "filter_or": ({"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 450000}}]}, "o_orderstatus = 'P' OR o_totalprice > 450000"),
        "filter_or_and_mix": (
            {"o_custkey": {"$lt": 500}, "$or": [{"o_orderstatus": "P", "o_totalprice": {"$lt": 100000}}, {"o_orderpriority": {"$like": "%urgent"}}, {"o_totalprice": {"$between": [1000, 50000]}}]},
            "o_custkey < 500 AND ((o_orderstatus = 'P' AND o_totalprice < 100000) OR o_orderpriority ILIKE '%urgent' OR o_totalprice BETWEEN 1000 AND 50000)",
        ),
    }
    for name, (where, sql) in cases.items():
        plan(f"{_O} WHERE {sql}", name)(lambda db, w=where: db.orders.select(*O).where(w).df())


_filters()


@plan("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' AND p_brand ILIKE 'brand#1_'")
def filter_like(db):
    return db.part.select("p_partkey", "p_name").where({"p_name": {"$like": "%RED%"}, "p_brand": {"$like": "brand#1_"}}).df()


def _with_nulls(db):
    """The test tables have no nulls: orders without their priority where it is low."""
    db.attach("orders_n", db.frame("orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))), "o_orderkey")
    return db.orders_n


@plan(f"{_O} WHERE nullif(o_orderpriority, '5-LOW') IS NULL")
def filter_is_null(db):
    return _with_nulls(db).select(*O).where({"o_orderpriority": {"$isNull": True}}).df()


@plan(f"{_O} WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL")
def filter_is_not_null(db):
    return _with_nulls(db).select(*O).where({"o_orderpriority": {"$isNotNull": True}}).df()


@plan(f"{_O} WHERE nullif(o_orderpriority, '5-LOW') <> '1-URGENT'")
def filter_ne_null(db):
    return _with_nulls(db).select(*O).where({"o_orderpriority": {"$ne": "1-URGENT"}}).df()


@plan(f"{_O} WHERE nullif(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH')")
def filter_not_in_null(db):
    return _with_nulls(db).select(*O).where({"o_orderpriority": {"$notIn": ["1-URGENT", "2-HIGH"]}}).df()


@plan(f"{_O} WHERE (o_totalprice > 300000 AND o_orderstatus = 'O') AND o_custkey < 700")
def filter_raw(db):
    return db.orders.select(*O).where_raw("o_totalprice > ? AND o_orderstatus = ?", 300000, "O").where({"o_custkey": {"$lt": 700}}).df()


@plan("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building' AND substr(c_name, 1, 8) = 'Customer' AND length(concat(c_name, c_mktsegment)) > 20")
def filter_ast_function(db):
    return db.customer.select("c_custkey", "c_name").where(lambda c, f, op: op.and_(op.eq(f.lower(c.c_mktsegment), "building"), op.eq(f.substr(c.c_name, 1, 8), "Customer"), op.gt(f.length(f.concat(c.c_name, c.c_mktsegment)), 20))).df()


@plan("SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal > 0) OR c_mktsegment ILIKE 'mach%'")
def filter_ast_not(db):
    return db.customer.select("c_custkey", "c_name").where(lambda c, f, op: op.or_(op.not_(op.gt(c.c_acctbal, 0)), op.like(c.c_mktsegment, "mach%"))).df()


@plan("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IS NOT NULL AND c_acctbal >= 100 AND c_acctbal <= 5000 AND c_nationkey <> 3 AND c_nationkey < 20")
def filter_ast_in(db):
    q = db.customer.select("c_custkey", "c_name").where(lambda c, f, op: op.and_(op.in_(c.c_mktsegment, ["BUILDING", "MACHINERY"]), op.is_not_null(c.c_custkey)))
    return q.where(lambda c, f, op: op.and_(op.gte(c.c_acctbal, 100), op.lte(c.c_acctbal, 5000), op.ne(c.c_nationkey, 3), op.lt(c.c_nationkey, 20))).df()


@plan("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
def filter_ast_and_object(db):
    return db.customer.select("c_custkey").where({"c_mktsegment": "BUILDING"}).where(lambda c, f, op: op.lt(c.c_acctbal, 0)).df()


@plan("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING')")
def where_in_list(db):
    return db.customer.select("c_custkey", "c_name").where_in("c_mktsegment", ["BUILDING"]).df()


@plan("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment NOT IN ('BUILDING')")
def where_not_in_list(db):
    return db.customer.select("c_custkey", "c_name").where_not_in("c_mktsegment", ["BUILDING"]).df()


@plan("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def where_in_subquery(db):
    return db.customer.select("c_custkey", "c_name").where_in("c_custkey", db.orders.select("o_custkey").where({"o_totalprice": {"$gt": 450000}})).df()


@plan("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def where_not_in_subquery(db):
    return db.customer.select("c_custkey", "c_name").where_not_in("c_custkey", db.orders.select("o_custkey").where({"o_totalprice": {"$gt": 200000}})).df()


@plan("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_totalprice > 1)")
def where_not_in_subquery_null(db):
    values = db.orders.select("o_custkey").where({"o_totalprice": {"$gt": 1}}).df().select(F.nullif("o_custkey", F.lit(1)))
    return db.customer.select("c_custkey").where_not_in("c_custkey", values).df()


@plan("SELECT * FROM nation")
def select_all(db):
    return db.nation.select().df()


@plan("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def project(db):
    return db.orders.select("o_orderkey", "o_orderstatus").select("o_totalprice").df()


@plan("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(db):
    return db.orders.select("o_orderstatus", "o_orderpriority").distinct().df()


@plan("SELECT n_name FROM nation WHERE n_regionkey = 1")
def pluck(db):
    names = db.nation.select().where({"n_regionkey": 1}).pluck("n_name")
    return db.spark.createDataFrame([(n,) for n in names], "n_name string")


@plan("SELECT c_custkey, upper(c_name) || '/' || c_mktsegment AS label FROM customer")
def computed(db):
    return db.customer.df().select("c_custkey", call("concat", call("upper", F.col("c_name")), "/", F.col("c_mktsegment")).alias("label"))


@plan("SELECT o_orderkey, c_name AS customer_c_name, c_mktsegment AS customer_c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def join_relation(db):
    return db.orders.select("o_orderkey").join(db.customer, ["c_name", "c_mktsegment"]).where({"o_totalprice": {"$gt": 300000}}).df()


@plan("SELECT c_name, o_orderkey AS orders_o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0")
def join_relation_reverse(db):
    return db.customer.select("c_name").join(db.orders, ["o_orderkey"]).where({"c_acctbal": {"$lt": 0}}).df()


@plan("SELECT l_orderkey, l_linenumber, l_quantity, p_brand AS part_p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50")
def join_manual(db):
    return db.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").join("part", "l_partkey", ["p_brand"], "p_partkey").where({"l_quantity": 50}).df()


@plan("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def join_qualified_filter(db):
    return db.orders.select("o_orderkey").join(db.customer, ["c_custkey"]).where({"customer.c_mktsegment": "BUILDING", "orders.o_orderstatus": "F"}).df().select("o_orderkey")


@plan("SELECT l_orderkey, l_linenumber, o_orderstatus AS orders_o_orderstatus, p_type AS part_p_type, s_name AS supplier_s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_extendedprice > 90000")
def join_star(db):
    q = db.lineitem.select("l_orderkey", "l_linenumber").join(db.orders, ["o_orderstatus"]).join(db.part, ["p_type"]).join(db.supplier, ["s_name"])
    return q.where({"l_extendedprice": {"$gt": 90000}}).df()


@plan("SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_all_columns(db):
    return db.nation.select().join(db.region).df()


@plan("SELECT c.c_name AS customer, n.n_name AS nation, r.r_name AS region, 1 AS one FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 5000 AND r.r_name IN ('ASIA', 'EUROPE')")
def multi_join(db):
    def q(t):
        c, n, r = t.customer, t.nation, t.region
        return {"select": {"customer": c.c_name, "nation": n.n_name, "region": r.r_name, "one": 1}, "join": [[c.c_nationkey, n.n_nationkey], [r.r_regionkey, n.n_regionkey]], "where": {c.c_acctbal: {"$gt": 5000}, r.r_name: ["ASIA", "EUROPE"]}}

    return db.query(q)


@plan("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 3 AND b.n_nationkey <> 3")
def multi_self_join(db):
    def q(t):
        a, b = t.nation, t.nation
        return {"select": {"a": a.n_name, "b": b.n_name}, "join": [a.n_regionkey, b.n_regionkey], "where": {a.n_nationkey: 3, b.n_nationkey: {"$ne": 3}}}

    return db.query(q)


@plan("SELECT c_custkey FROM customer c JOIN nation n ON c_nationkey = n_nationkey WHERE c_nationkey = n_regionkey")
def multi_column_equality(db):
    def q(t):
        c, n = t.customer, t.nation
        return {"select": {"c_custkey": c.c_custkey}, "join": [c.c_nationkey, n.n_nationkey], "where": {c.c_nationkey: n.n_regionkey}}

    return db.query(q)


@plan("SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY region DESC LIMIT 3")
def multi_group(db):
    def q(t):
        c, n, r = t.customer, t.nation, t.region
        return {"select": {"region": r.r_name, "n": F.count("*"), "balance": F.round(F.sum(c.c_acctbal.column), 2)}, "join": [[c.c_nationkey, n.n_nationkey], [n.n_regionkey, r.r_regionkey]], "group_by": [r.r_name], "order_by": {r.r_name: "desc"}, "limit": 3}

    return db.query(q)


@plan("SELECT n_name AS name FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 5 OFFSET 3")
def multi_order_limit(db):
    def q(t):
        n = t.nation
        return {"select": {"name": n.n_name}, "order_by": [(n.n_regionkey, "desc"), n.n_nationkey], "limit": 5, "offset": 3}

    return db.query(q)


@plan("SELECT n_nationkey, n_name, count(c_custkey) AS n, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS kids FROM nation LEFT JOIN (SELECT * FROM customer) ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def eager_has_many(db):
    db.attach("client", db.customer.df(), "c_custkey").relate("client", "c_nationkey", "nation")
    df = db.nation.select("n_nationkey", "n_name").with_("client").df()
    return df.select("n_nationkey", "n_name", F.size("client").cast("long").alias("n"), F.array_join(F.transform("client", lambda x: x["c_custkey"].cast("string")), ",").alias("kids"))


@plan("SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def eager_belongs_to(db):
    df = db.orders.select("o_orderkey", "o_custkey").where({"o_totalprice": {"$gt": 400000}}).with_("customer").df()
    return df.select("o_orderkey", F.col("customer.c_name").alias("name"))


@plan("SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'")
def agg_count(db):
    return db.lineitem.select().where({"l_returnflag": "R"}).order_by("l_orderkey").offset(5).aggregate("count")


@plan("SELECT count(*) AS count FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def agg_count_distinct(db):
    return db.orders.select("o_orderstatus", "o_orderpriority").distinct().aggregate("count")


@plan("SELECT round(sum(l_extendedprice), 2) AS sum FROM lineitem WHERE l_discount > 0.05")
def agg_sum(db):
    return rounded(db.lineitem.select().where({"l_discount": {"$gt": 0.05}}).aggregate("sum", "l_extendedprice"), "sum")


@plan("SELECT round(avg(l_quantity), 6) AS avg FROM lineitem")
def agg_avg(db):
    return rounded(db.lineitem.select().aggregate("avg", "l_quantity"), "avg", digits=6)


@plan("SELECT min(o_orderpriority) AS min FROM orders")
def agg_min(db):
    return db.orders.select().aggregate("min", "o_orderpriority")


@plan("SELECT max(l_extendedprice) AS max FROM lineitem")
def agg_max(db):
    return db.lineitem.select().aggregate("max", "l_extendedprice")


@plan("SELECT coalesce(sum(l_quantity), 0) AS sum FROM lineitem WHERE l_quantity < 0")
def agg_sum_empty(db):
    return db.lineitem.select().where({"l_quantity": {"$lt": 0}}).aggregate("sum", "l_quantity")


@plan("SELECT coalesce(avg(l_quantity), 0) AS avg FROM lineitem WHERE l_quantity < 0")
def agg_avg_empty(db):
    return db.lineitem.select().where({"l_quantity": {"$lt": 0}}).aggregate("avg", "l_quantity")


@plan("SELECT min(l_quantity) AS min FROM lineitem WHERE l_quantity < 0")
def agg_min_empty(db):
    return db.lineitem.select().where({"l_quantity": {"$lt": 0}}).aggregate("min", "l_quantity")


@plan("SELECT sum(DISTINCT l_quantity) AS sum FROM lineitem")
def agg_sum_distinct(db):
    return db.lineitem.select().distinct().aggregate("sum", "l_quantity")


@plan("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS sum FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_grouped_sum(db):
    return rounded(db.lineitem.select().group_by("l_returnflag", "l_linestatus").aggregate("sum", "l_extendedprice"), "sum")


@plan("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderstatus, o_orderpriority")
def count_grouped(db):
    return db.orders.select().group_by("o_orderstatus").group_by("o_orderpriority").grouped_counts()


@plan("SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) BETWEEN 100000 AND 9000000")
def group_having(db):
    return db.orders.select().group_by("o_custkey").having({"COUNT(*)": {"$gt": 15}, "SUM(o_totalprice)": {"$between": [100000, 9000000]}}).grouped_counts()


@plan("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100) AS some, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS none")
def exists(db):
    some, none = (db.orders.select().where({"o_totalprice": w}).offset(1).exists() for w in ({"$gt": 100}, {"$lt": 0}))
    return db.spark.createDataFrame([(some, none)], "some boolean, none boolean")


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_limit_offset(db):
    return db.orders.select("o_orderkey", "o_totalprice").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(20).offset(10).df()


@plan("SELECT o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_by_hidden(db):
    return db.orders.select("o_orderstatus").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(20).df()


@plan("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_only(db):
    return db.nation.select("n_nationkey", "n_name").order_by("n_nationkey").offset(20).df()


@plan("SELECT c_custkey, (SELECT count(*) FROM customer) AS total, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM customer) AS pages FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40)")
def paginate(db):
    p = db.customer.select("c_custkey").order_by("c_acctbal").order_by("c_custkey").raw().paginate(3, 20)
    return db.spark.createDataFrame([(r["c_custkey"], p["total"], p["pages"]) for r in p["data"]], "c_custkey long, total long, pages long")


@plan("SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10")
def top_k(db):
    q = db.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").order_by("l_extendedprice", "desc")
    return q.order_by("l_orderkey").order_by("l_linenumber").order_by("l_partkey").order_by("l_suppkey").limit(10).df()


@plan("SELECT * FROM orders WHERE o_orderkey = 77", "point_lookup")
def _point_lookup(db):
    return db.orders.select().where({"o_orderkey": 77}).limit(1).df()


@plan("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props(db):
    k = call("json_extract", F.col("props"), "$.k").cast("long")
    return db.events.df().groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@plan(
    "SELECT c_custkey, substr(c_name, 1, 4) AS a, CASE WHEN c_acctbal IS NULL OR c_nationkey IS NULL THEN NULL ELSE greatest(c_acctbal, c_nationkey) END AS b, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, "
    "instr(c_name, '#') AS d, replace(c_name, 'Customer', 'C') AS e, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS f, abs(c_acctbal) AS g, trim('  ' || c_mktsegment || ' ') AS h FROM customer"
)
def scalar_functions(db):
    c = F.col
    return db.customer.df().select(
        "c_custkey",
        call("substr", c("c_name"), 0, 5).alias("a"),
        call("max", c("c_acctbal"), c("c_nationkey").cast("double")).alias("b"),
        call("ifnull", call("nullif", c("c_mktsegment"), "BUILDING"), "none").alias("c"),
        call("instr", c("c_name"), "#").cast("long").alias("d"),
        call("replace", c("c_name"), "Customer", "C").alias("e"),
        call("iif", c("c_acctbal") < 0, "debt", "credit").alias("f"),
        call("abs", c("c_acctbal")).alias("g"),
        call("trim", call("concat", "  ", c("c_mktsegment"), " ")).alias("h"),
    )


@plan("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders QUALIFY rn <= 2")
def raw_window(db):
    return db.raw("SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= ?", 2)


@plan("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 3")
def raw_set_ops(db):
    return db.raw("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > ? INTERSECT SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = ?", 0, 3)


@plan("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY c_custkey")
def raw_outer_join(db):
    return db.raw("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > ?) ON c_custkey = o_custkey GROUP BY c_custkey", 400000)


@plan("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n, n_name FROM t JOIN nation ON n = n_nationkey")
def raw_recursive(db):
    return db.raw("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < ?) SELECT n, n_name FROM t JOIN nation ON n = n_nationkey", 5)


@plan(
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 50000 GROUP BY c_mktsegment HAVING count(*) > 5 ORDER BY revenue DESC, c_mktsegment LIMIT 4",
    "flagship",
)
def _flagship(db):
    def q(t):
        o, c = t.orders, t.customer
        return {"select": {"c_mktsegment": c.c_mktsegment, "n": F.count("*"), "revenue": F.round(F.sum(o.o_totalprice.column), 2)}, "join": [o.o_custkey, c.c_custkey], "where": {o.o_orderstatus: "F", o.o_totalprice: {"$gt": 50000}}, "group_by": [c.c_mktsegment]}

    return db.query(q).where("n > 5").orderBy(F.desc("revenue"), "c_mktsegment").limit(4)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship(attached(spark, sf_dir))

