"""Conditions, compiled to Column expressions by one compiler for all callers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Functions, equal, lit

Resolve = Callable[[str], Column]


class _Entity:
    """Base of rows with methods; stands for its key in conditions."""


def like(c: Column, pattern: str) -> Column:
    """Case-insensitive, without an escape character."""
    return c.ilike(pattern.replace("\\", "\\\\"))


def _pair(v: Any) -> tuple[Any, Any]:
    if not isinstance(v, (list, tuple)) or len(v) != 2:
        raise ValueError("$between takes a pair")
    return v[0], v[1]


def _listed(v: Any, op: str) -> list:
    if isinstance(v, (str, bytes, dict)) or not isinstance(v, Iterable):
        raise ValueError(f"{op} takes a list")
    return list(v)


OPERATORS: dict[str, Callable[[Column, Any], Column | None]] = {
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$ne": lambda c, v: c != v,
    "$in": lambda c, v: c.isin(_listed(v, "$in")),
    "$notIn": lambda c, v: ~c.isin(x) if (x := _listed(v, "$notIn")) else None,
    "$like": like,
    "$between": lambda c, v: c.between(*_pair(v)),
    "$isNull": lambda c, v: c.isNull(),
    "$isNotNull": lambda c, v: c.isNotNull(),
}


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def one(c: Column, value: Any) -> Column | None:
    """The condition of one field: a value to equal, or operators that all hold."""
    if isinstance(value, dict):
        out = None
        for op, operand in value.items():
            if op not in OPERATORS:
                raise ValueError(f"unknown operator {op}; nested objects can't be compared")
            out = both(out, OPERATORS[op](c, operand))
        return out
    return equal(c, value)  # = NULL is never true


def compile_where(where: dict[str, Any], resolve: Resolve, entity: Callable[[str, Any], tuple[str, Any]] | None = None) -> Column | None:
    """All fields' conditions and, under ``$or``, the alternatives; a branch's conditions hold
    together. None means no condition. ``entity`` turns a field that is compared with an
    entity into its key column and value."""
    out: Column | None = None
    for name, value in where.items():
        if name == "$or":
            branches = [compile_where(b, resolve, entity) for b in value]
            if branches and all(b is not None for b in branches):
                any_of = branches[0]
                for b in branches[1:]:
                    any_of = any_of | b
                out = both(out, any_of)
            continue
        if isinstance(value, _Entity):
            if entity is None:
                raise ValueError(f"{name}: an entity can't be compared here")
            name, value = entity(name, value)
        out = both(out, one(resolve(name), value))
    return out


class Columns:
    """``c.name``: the column of that name."""

    def __init__(self, resolve: Resolve):
        self._resolve = resolve

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._resolve(name)

    __getitem__ = __getattr__


class Operators:
    """The ``op`` argument of callback conditions; names that are Python keywords end in _."""

    @staticmethod
    def eq(a: Any, b: Any) -> Column:
        return equal(lit(a), b)

    @staticmethod
    def ne(a: Any, b: Any) -> Column:
        return lit(a) != lit(b)

    @staticmethod
    def gt(a: Any, b: Any) -> Column:
        return lit(a) > lit(b)

    @staticmethod
    def gte(a: Any, b: Any) -> Column:
        return lit(a) >= lit(b)

    @staticmethod
    def lt(a: Any, b: Any) -> Column:
        return lit(a) < lit(b)

    @staticmethod
    def lte(a: Any, b: Any) -> Column:
        return lit(a) <= lit(b)

    @staticmethod
    def and_(a: Column, *more: Column) -> Column:
        for b in more:
            a = a & b
        return a

    @staticmethod
    def or_(a: Column, *more: Column) -> Column:
        for b in more:
            a = a | b
        return a

    @staticmethod
    def not_(a: Column) -> Column:
        return ~a

    @staticmethod
    def in_(a: Any, values: Iterable) -> Column:
        return lit(a).isin(list(values))

    @staticmethod
    def like(a: Any, pattern: str) -> Column:
        return like(lit(a), pattern)

    @staticmethod
    def is_null(a: Any) -> Column:
        return lit(a).isNull()

    @staticmethod
    def is_not_null(a: Any) -> Column:
        return lit(a).isNotNull()


def compile_callback(fn: Callable, resolve: Resolve) -> Column:
    """``fn(c, f, op)``: columns, functions, operators."""
    return fn(Columns(resolve), Functions(), Operators())


def bind(sql: str, params: Iterable[Any]) -> str:
    """SQL text with each ``?`` outside of quotes replaced by a literal."""
    values, out, quote = list(params), [], ""
    for ch in sql:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch == "?":
            if not values:
                raise ValueError("too few parameters")
            out.append(literal(values.pop(0)))
            continue
        out.append(ch)
    if values:
        raise ValueError("too many parameters")
    return "".join(out)


def literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else str(v)
    if isinstance(v, float):
        return f"double('{v!r}')"
    if hasattr(v, "isoformat"):
        return f"timestamp'{v.isoformat(sep=' ')}'" if hasattr(v, "hour") else f"date'{v.isoformat()}'"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def in_query(df: DataFrame, key: Column, values: DataFrame, negate: bool) -> DataFrame:
    """Rows whose key is (not) among the one column of ``values``, as SQL has it: IN is a
    semi join; NOT IN gives nothing if there is a null among the values, and never a row
    whose own key is null unless there are no values.

    Spark plans NOT IN with a broadcast of all values, however many. Here it is an anti join,
    which can shuffle, with two scalar subqueries for what nulls do."""
    if not negate:
        return df.filter(key.isin(values))
    values = values.toDF("_value")
    some = values.agg(F.count("*").alias("n")).scalar()
    nulls = values.agg(F.count_if(F.col("_value").isNull()).alias("n")).scalar()
    known = values.where(F.col("_value").isNotNull())
    return df.filter((some == 0) | ((nulls == 0) & key.isNotNull())).join(known, key == F.col("_value"), "left_anti")
