"""Queries over several tables: ``db.query(lambda c: {...})``.

Every access to a table in the callback is a new alias of it, so a self join is two accesses.
The first table accessed is the one that the joins start from.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates as P

if TYPE_CHECKING:
    from ..sources.database import Database


class Ref:
    """A column of an alias. It can be a key of the where and order dictionaries."""

    def __init__(self, alias: str, name: str):
        self.alias, self.name = alias, name

    @property
    def column(self) -> Column:
        return F.col(f"`{self.alias}`.`{self.name}`")


class TableRef:
    def __init__(self, alias: str, table: str, columns: list[str]):
        self._alias, self._table, self._columns = alias, table, columns

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._columns:
            raise ValueError(f"{self._table} has no column {name}")
        return Ref(self._alias, name)


class Context:
    def __init__(self, db: "Database"):
        self._db, self._refs = db, []

    def __getattr__(self, table: str) -> TableRef:
        if table.startswith("__"):
            raise AttributeError(table)
        ref = TableRef(f"t{len(self._refs) + 1}", table, list(self._db.columns_of(table)))
        self._refs.append(ref)
        return ref


def _value(v: Any) -> Any:
    return v.column if isinstance(v, Ref) else v


def compile_multi(db: "Database", fn: Any) -> DataFrame:
    """The DataFrame of a description with the keys select, join, where, group_by, order_by,
    limit and offset.

    ``select`` maps output names to columns, literals or Column expressions; ``join`` is a pair
    of columns or a list of pairs, each of which brings in the side that isn't there yet;
    ``where`` maps columns (or names of the first table) to a value, a list, another column or
    operators; ``order_by`` is a column, a dictionary or a list of (column, direction)."""
    context = Context(db)
    spec = fn(context)
    if not context._refs:
        raise ValueError("the query names no table")
    tables = {r._alias: r for r in context._refs}
    first = context._refs[0]
    there = {first._alias}
    out = db.frame(first._table).alias(first._alias)
    pairs = spec.get("join", [])
    pairs = [pairs] if pairs and isinstance(pairs[0], Ref) else list(pairs)
    while pairs:
        for i, (a, b) in enumerate(pairs):
            if a.alias in there or b.alias in there:
                break
        else:
            raise ValueError("a join reaches no table of the query")
        a, b = pairs.pop(i)
        new = b.alias if a.alias in there else a.alias
        if new in there:
            out = out.filter(a.column == b.column)
            continue
        # all pairs that link the new table with what is there make one condition
        condition = a.column == b.column
        for x, y in [p for p in pairs if {p[0].alias, p[1].alias} <= there | {new} and new in (p[0].alias, p[1].alias)]:
            condition = condition & (x.column == y.column)
            pairs.remove((x, y))
        out = out.join(db.frame(tables[new]._table).alias(new), condition, "inner")
        there.add(new)
    unused = {r._alias for r in context._refs} - there
    named = [v for part in ("select", "where") for kv in (spec.get(part) or {}).items() for v in kv if isinstance(v, Ref)]
    if any(v.alias in unused for v in named):
        raise ValueError("a table is used, but not joined")

    def resolve(key: Any) -> Column:
        return key.column if isinstance(key, Ref) else F.col(f"`{first._alias}`.`{key}`")

    for key, value in (spec.get("where") or {}).items():
        if key == "$or":
            condition = _any(value, resolve)
        elif isinstance(value, Ref):
            condition = resolve(key) == value.column
        elif isinstance(value, (list, tuple)):
            condition = resolve(key).isin(list(value))
        else:
            condition = P.one(resolve(key), {k: _value(v) for k, v in value.items()} if isinstance(value, dict) else value)
        out = out if condition is None else out.filter(condition)

    select = {n: v for n, v in (spec.get("select") or {}).items()}
    columns = [(F.lit(v) if not isinstance(v, (Ref, Column)) else _value(v)).alias(n) for n, v in select.items()] or [F.col(f"`{first._alias}`.*")]
    if keys := spec.get("group_by"):
        keys = [keys] if isinstance(keys, Ref) else list(keys)
        named = {(k.alias, k.name) for k in keys}
        plain = {n for n, v in select.items() if isinstance(v, Ref) and (v.alias, v.name) in named}
        out = out.groupBy(*(k.column.alias(f"_key{i}") for i, k in enumerate(keys)))
        others = [c for (n, v), c in zip(select.items(), columns) if n not in plain and isinstance(v, Column)]
        if bad := [n for n, v in select.items() if n not in plain and not isinstance(v, Column)]:
            raise ValueError(f"{bad[0]} is neither a key nor an aggregate")
        out = out.agg(*others) if others else out.agg(F.lit(1).alias("_one"))
        place = {(k.alias, k.name): f"_key{i}" for i, k in enumerate(keys)}
        out = out.select(*(F.col(place[v.alias, v.name]).alias(n) if n in plain else F.col(n) for n, v in select.items()), *place.values())
        out = _ordered(out, spec, lambda k: F.col(place[k.alias, k.name]) if isinstance(k, Ref) else F.col(k)).select(*select)
    else:
        out = _ordered(out, spec, resolve).select(*columns)
    if spec.get("offset"):
        out = out.offset(spec["offset"])
    return out if spec.get("limit") is None else out.limit(spec["limit"])


def _any(branches: list[dict], resolve: Any) -> Column:
    out = None
    for b in branches:
        branch = None
        for k, v in b.items():
            branch = P.both(branch, P.one(resolve(k), _value(v)))
        out = branch if out is None else out | branch
    return out


def _ordered(df: DataFrame, spec: dict, resolve: Any) -> DataFrame:
    order = spec.get("order_by")
    if not order:
        return df
    order = list(order.items()) if isinstance(order, dict) else [(order, "asc")] if isinstance(order, (Ref, str)) else [x if isinstance(x, tuple) else (x, "asc") for x in order]
    return df.orderBy(*(resolve(k).desc() if str(d).lower() == "desc" else resolve(k).asc() for k, d in order))
