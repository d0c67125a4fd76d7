"""The fluent query: an immutable description that becomes one DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DELETED
from . import predicates as P

if TYPE_CHECKING:
    from ..sources.database import Database


class NoRowFound(LookupError):
    """first_or_fail() on a query without rows."""


@dataclass(frozen=True)
class Join:
    table: str
    left: str
    right: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Query:
    """``db.orders.select("o_orderkey").where({...}).order_by(...)``.

    Every method returns a new query, so that a query can be reused and branched. ``df()``
    builds the DataFrame: join, filter, group, having, project, distinct, sort, offset and
    limit; nothing runs before a terminal such as ``all()``."""

    db: "Database"
    table: str
    columns: tuple[str, ...] = ()
    joins: tuple[Join, ...] = ()
    wheres: tuple[Any, ...] = ()
    raws: tuple[tuple[str, tuple], ...] = ()
    memberships: tuple[tuple[str, Any, bool], ...] = ()
    keys: tuple[str, ...] = ()
    havings: tuple[tuple[str, Any], ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    max_rows: int | None = None
    skip: int | None = None
    is_distinct: bool = False
    trash: str = "without"
    includes: tuple[str, ...] = ()
    is_raw: bool = False

    # building

    def select(self, *columns: str) -> "Query":
        return replace(self, columns=self.columns + columns)

    def where(self, condition: dict[str, Any] | Callable) -> "Query":
        """A dictionary of conditions, or a callback (c, f, op) that returns one. All
        conditions of a query hold together."""
        return replace(self, wheres=(*self.wheres, condition))

    def where_raw(self, sql: str, *params: Any) -> "Query":
        return replace(self, raws=(*self.raws, (sql, params)))

    def where_in(self, column: str, values: "list | Query | DataFrame") -> "Query":
        return replace(self, memberships=(*self.memberships, (column, values, False)))

    def where_not_in(self, column: str, values: "list | Query | DataFrame") -> "Query":
        return replace(self, memberships=(*self.memberships, (column, values, True)))

    def join(self, other: Any, foreign_key: str | list | tuple | None = None, columns: list[str] | tuple | str | None = None, key: str | None = None) -> "Query":
        """Inner equi-join with another table: ``join(db.customer)`` or
        ``join(db.customer, ["c_name"])`` along the declared relation, or
        ``join("customer", "o_custkey", ["c_name"], "c_custkey")`` with explicit keys (a
        string as third argument is the key). Named columns come out as table_column;
        without any, all the other table's columns do."""
        name = other if isinstance(other, str) else other.name
        if isinstance(foreign_key, (list, tuple)):
            foreign_key, columns = None, foreign_key
        if isinstance(columns, str):
            columns, key = None, columns
        left, right = (foreign_key, key or self.db.key_of(name)) if foreign_key else self.db.relation_keys(self.table, name)
        return replace(self, joins=(*self.joins, Join(name, left, right, tuple(columns or ()))))

    def order_by(self, column: str, direction: str = "asc") -> "Query":
        if direction.lower() not in ("asc", "desc"):
            raise ValueError("direction is asc or desc")
        return replace(self, orders=(*self.orders, (column, direction.lower() == "desc")))

    def limit(self, n: int) -> "Query":
        return replace(self, max_rows=n)

    def offset(self, n: int) -> "Query":
        return replace(self, skip=n)

    def distinct(self) -> "Query":
        return replace(self, is_distinct=True)

    def group_by(self, *columns: str) -> "Query":
        return replace(self, keys=self.keys + columns)

    def having(self, conditions: dict[str, Any]) -> "Query":
        """Conditions on aggregate expressions: ``{"COUNT(*)": {"$gt": 1}}``."""
        return replace(self, havings=(*self.havings, *conditions.items()))

    def with_(self, *relations: str) -> "Query":
        """Loads related rows: an array of structs of the children, or a struct of the parent."""
        return replace(self, includes=self.includes + relations)

    def with_trashed(self) -> "Query":
        return replace(self, trash="with")

    def only_trashed(self) -> "Query":
        return replace(self, trash="only")

    def raw(self) -> "Query":
        """Rows instead of entities."""
        return replace(self, is_raw=True)

    def clone(self) -> "Query":
        return self

    # compilation

    def _resolve(self, name: str) -> Column:
        """A column by name: qualified, or of this table, or of a joined one. A computed
        field is its expression, so that it can be filtered and sorted by."""
        if computed := self.db.computed(self.table).get(name):
            return computed(P.Columns(self._resolve))
        if "." in name:
            table, column = name.split(".", 1)
            if table in (self.table, *(j.table for j in self.joins)):
                return F.col(f"`{table}`.`{column}`")
            return F.col(f"`{self.table}`.`{table}`.{column}")
        for table in (self.table, *(j.table for j in self.joins)):
            if name in self.db.columns_of(table):
                return F.col(f"`{table}`.`{name}`")
        raise ValueError(f"{self.table} has no column {name}")

    def condition(self, resolve: Callable[[str], Column] | None = None) -> Column | None:
        """All conditions but memberships in subqueries."""
        resolve = resolve or self._resolve
        out: Column | None = None
        if self.trash != "with" and self.db.is_soft(self.table):
            deleted = resolve(DELETED)
            out = deleted.isNull() if self.trash == "without" else deleted.isNotNull()
        for w in self.wheres:
            compiled = P.compile_callback(w, resolve) if callable(w) else P.compile_where(w, resolve, lambda n, e: self.db.entity_condition(self.table, n, e))
            out = P.both(out, compiled)
        for sql, params in self.raws:
            out = P.both(out, F.expr(f"({P.bind(sql, params)})"))
        for column, values, negate in self.memberships:
            if not isinstance(values, (Query, DataFrame)):
                inside = resolve(column).isin(list(values))
                if not negate or len(list(values)):
                    out = P.both(out, ~inside if negate else inside)
        return out

    def filtered(self, base: DataFrame) -> DataFrame:
        """``base`` (of this table, or joined) with all conditions applied."""
        condition = self.condition()
        out = base if condition is None else base.filter(condition)
        for column, values, negate in self.memberships:
            if isinstance(values, (Query, DataFrame)):
                out = P.in_query(out, self._resolve(column), values.df() if isinstance(values, Query) else values, negate)
        return out

    def _source(self) -> DataFrame:
        out = self.db.frame(self.table).alias(self.table)
        for j in self.joins:
            other = self.db.frame(j.table).alias(j.table)
            out = out.join(other, F.col(f"`{self.table}`.`{j.left}`") == F.col(f"`{j.table}`.`{j.right}`"), "inner")
        return self.filtered(out)

    def _projection(self) -> list[Column]:
        own = self.columns or tuple(self.db.columns_of(self.table))
        out = []
        taken = {c.split(".")[-1] for c in own}
        for c in own:
            out.append(self._resolve(c).alias(c.split(".")[-1]))
        for j in self.joins:
            for c in j.columns or self.db.columns_of(j.table):
                name = f"{j.table}_{c}" if j.columns or c in taken else c
                taken.add(name)
                out.append(F.col(f"`{j.table}`.`{c}`").alias(name))
        return out

    def df(self) -> DataFrame:
        out = self._source()
        if self.keys or self.havings:
            out = self._grouped(out, [])
            return self._finish(out.select(*self.columns) if self.columns else out)
        names = [c.split(".")[-1] for c in self.columns] or list(self.db.columns_of(self.table))
        early = [o for o in self.orders if o[0] not in names and not any(o[0] == f"{j.table}_{c}" for j in self.joins for c in j.columns)]
        if early and self.is_distinct:
            raise ValueError(f"a distinct query can't be ordered by {early[0][0]}, which it doesn't select")
        if early:  # the sort keys are gone after the projection
            out = out.orderBy(*(self._resolve(c).desc() if d else self._resolve(c).asc() for c, d in self.orders))
        out = out.select(*self._projection())
        for name in self.includes:
            out = self.db.include(out, self.table, name)
        return self._finish(out, not early)

    def _grouped(self, base: DataFrame, aggregates: list[Column]) -> DataFrame:
        """One row for each group, with the keys, what else is selected (any value of the
        group), and the aggregates."""
        others = [F.any_value(self._resolve(c)).alias(c) for c in self.columns if c not in self.keys]
        tests = [F.expr(e).alias(f"_having{i}") for i, (e, _) in enumerate(self.havings)]
        todo = [*others, *aggregates, *tests] or [F.lit(1).alias("_one")]
        out = base.groupBy(*(self._resolve(k).alias(k) for k in self.keys)).agg(*todo)
        for i, (_, value) in enumerate(self.havings):
            condition = P.one(F.col(f"_having{i}"), value)
            out = out if condition is None else out.filter(condition)
        return out.drop("_one", *(f"_having{i}" for i in range(len(self.havings))))

    def _finish(self, out: DataFrame, order: bool = True) -> DataFrame:
        if self.is_distinct:
            out = out.distinct()
        if order and self.orders:
            out = out.orderBy(*(F.col(f"`{c.split('.')[-1]}`").desc() if d else F.col(f"`{c.split('.')[-1]}`").asc() for c, d in self.orders))
        if self.skip:
            out = out.offset(self.skip)
        return out if self.max_rows is None else out.limit(self.max_rows)

    # aggregates: order, limit and offset play no part, distinct does

    def aggregate(self, kind: str, column: str | None = None) -> DataFrame:
        """A DataFrame with ``kind`` (count, sum, avg, min, max) as its column: of one row,
        or with group_by one for each group. An empty sum or average is 0."""
        functions = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "avg": lambda c: F.coalesce(F.avg(c), F.lit(0.0)), "min": F.min, "max": F.max}
        base = self._source()
        if kind == "count":
            if self.is_distinct and not self.keys:
                return base.select(*self._projection()).distinct().agg(F.count("*").alias("count"))
            value = F.count("*")
        else:
            c = self._resolve(column)
            if self.is_distinct and kind in ("sum", "avg"):
                inner = F.sum_distinct(c) if kind == "sum" else F.try_divide(F.sum_distinct(c), F.count_distinct(c))
                value = F.coalesce(inner, F.lit(0))
            else:
                value = functions[kind](c)
        if self.keys or self.havings:
            return self._grouped(base, [value.alias(kind)]).select(*self.keys, kind)
        return base.agg(value.alias(kind))

    def _scalar(self, kind: str, column: str | None = None) -> Any:
        rows = self.aggregate(kind, column).collect()
        return [r.asDict() for r in rows] if self.keys else rows[0][kind]

    def count(self) -> Any:
        return self._scalar("count")

    def sum(self, column: str) -> Any:
        return self._scalar("sum", column)

    def avg(self, column: str) -> Any:
        return self._scalar("avg", column)

    def min(self, column: str) -> Any:
        return self._scalar("min", column)

    def max(self, column: str) -> Any:
        return self._scalar("max", column)

    def grouped_counts(self) -> DataFrame:
        if not self.keys:
            raise ValueError("count_grouped needs group_by")
        return self.aggregate("count")

    def count_grouped(self) -> list[dict]:
        return [r.asDict() for r in self.grouped_counts().collect()]

    # terminals

    def _rows(self, df: DataFrame) -> list:
        plain = self.is_raw or self.joins or self.keys
        return self.db.rows(df, None if plain else self.table)

    def all(self) -> list:
        """All rows, on the driver; ``df()`` is the way to large results."""
        return self._rows(self.df())

    def first(self) -> Any:
        rows = self._rows(self.limit(1).df())
        return rows[0] if rows else None

    get = first

    def first_or_fail(self) -> Any:
        row = self.first()
        if row is None:
            raise NoRowFound("No matching row found")
        return row

    def exists(self) -> bool:
        return not self.df().limit(1).isEmpty()

    def pluck(self, column: str) -> list:
        only = replace(self, columns=(column,), joins=tuple(replace(j, columns=()) for j in self.joins))
        return [r[column.split(".")[-1]] for r in only.df().select(column.split(".")[-1]).collect()]

    def paginate(self, page: int = 1, per_page: int = 20) -> dict[str, Any]:
        total = replace(self, orders=(), max_rows=None, skip=None).df().count() if self.keys else self.count()
        data = self.offset((page - 1) * per_page).limit(per_page).all()
        return {"data": data, "total": total, "page": page, "per_page": per_page, "pages": math.ceil(total / per_page)}

    def explain(self) -> str:
        """The optimised and the physical plan; nothing is executed."""
        return self.df()._jdf.queryExecution().toString()

    to_sql = explain

    def __await__(self):
        yield from ()
        return self.all()

    # mutations

    def _only_filters(self) -> None:
        if self.joins or self.keys:
            raise ValueError("a join or group can't be changed")

    def update_all(self, data: dict[str, Any]) -> int:
        """Sets columns (values, or Columns) of all rows that match, whatever the limit;
        returns how many. Hooks and timestamps are left alone."""
        self._only_filters()
        return self.db.update_where(self.table, self, data)

    def increment(self, column: str, by: float = 1) -> int:
        self._only_filters()
        return self.db.update_where(self.table, self, {column: F.col(column) + by})

    def decrement(self, column: str, by: float = 1) -> int:
        return self.increment(column, -by)

    def delete_all(self, force: bool = False) -> int:
        """Deletes all rows that match; in a table with soft deletes, marks them unless
        ``force``."""
        self._only_filters()
        return self.db.delete_where(self.table, self, force)


@dataclass(frozen=True)
class Change:
    """``db.t.update(data).where(...).exec()`` and ``db.t.delete().where(...).exec()``."""

    query: Query
    data: dict[str, Any] | None = None
    given: bool = field(default=False)

    def where(self, condition: dict[str, Any] | Callable) -> "Change":
        return replace(self, query=self.query.where(condition), given=True)

    def exec(self) -> int:
        if not self.given:
            raise ValueError("a condition is required")
        return self.query.delete_all() if self.data is None else self.query.update_all(self.data)

