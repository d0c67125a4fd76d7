"""Declared table schemas: field types, their Spark types, defaults and validation."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MISSING = object()
_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
CREATED, UPDATED, DELETED = "createdAt", "updatedAt", "deletedAt"


class ValidationError(ValueError):
    """A row does not fit its declared schema."""


@dataclass(frozen=True)
class Field:
    """One declared column. Fields are immutable; ``optional()``, ``default()``, ``min()``,
    ``max()`` and ``email()`` return changed copies."""

    kind: str
    spark: T.DataType
    is_optional: bool = False
    default_value: Any = _MISSING
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    choices: tuple | None = None
    inner: Any = None

    def optional(self) -> "Field":
        return replace(self, is_optional=True)

    def default(self, value: Any) -> "Field":
        """``value`` or, if it is callable, what it returns, where a row has none."""
        return replace(self, default_value=value)

    def min(self, n: float) -> "Field":
        """Least number, or least length of a string or array."""
        return replace(self, low=n)

    def max(self, n: float) -> "Field":
        return replace(self, high=n)

    def email(self) -> "Field":
        return replace(self, pattern=_EMAIL)

    def int(self) -> "Field":
        if self.kind != "number":
            raise TypeError("int() is for numbers")
        return replace(self, kind="integer", spark=T.LongType())

    @property
    def is_json(self) -> bool:
        """Kept as a variant, because its shape isn't fixed."""
        return isinstance(self.spark, T.VariantType)

    def check(self, name: str, v: Any) -> Any:
        """The value to store; raises ValidationError."""

        def bad(why: str) -> ValidationError:
            return ValidationError(f"{name}: {why}")

        if v is None:
            if self.is_optional:
                return None
            raise bad("a value is required")
        k = self.kind
        if k in ("string", "enum") and not isinstance(v, str):
            raise bad("expected a string")
        if k in ("number", "integer"):
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise bad("expected a number")
            if k == "integer" and v != int(v):
                raise bad("expected an integer")
            v = int(v) if k == "integer" else float(v)
        if k == "boolean" and not isinstance(v, bool):
            raise bad("expected true or false")
        if k == "date":
            if isinstance(v, str):
                v = dt.datetime.fromisoformat(v)
            if not isinstance(v, dt.datetime):
                raise bad("expected a date")
            v = v.astimezone(dt.timezone.utc) if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        if k == "binary" and not isinstance(v, (bytes, bytearray)):
            raise bad("expected bytes")
        if k == "array":
            if not isinstance(v, (list, tuple)):
                raise bad("expected a list")
            v = [self.inner.check(f"{name}[{i}]", x) for i, x in enumerate(v)]
        if k == "object":
            if not isinstance(v, dict):
                raise bad("expected an object")
            v = {n: f.check(f"{name}.{n}", f.fill(v.get(n))) for n, f in self.inner.items()}
        if k == "tuple":
            if not isinstance(v, (list, tuple)) or len(v) != len(self.inner):
                raise bad(f"expected {len(self.inner)} values")
            v = {f"_{i}": f.check(f"{name}[{i}]", x) for i, (f, x) in enumerate(zip(self.inner, v))}
        if k == "record" and self.inner is not None:
            if not isinstance(v, dict):
                raise bad("expected an object")
            v = {str(n): self.inner.check(f"{name}.{n}", x) for n, x in v.items()}
        if k == "union" and self.inner:
            for f in self.inner:
                try:
                    v = f.check(name, v)
                    break
                except ValidationError:
                    continue
            else:
                raise bad("fits none of the alternatives")
        size = len(v) if isinstance(v, (str, list, bytes)) else v
        if self.low is not None and size < self.low or self.high is not None and size > self.high:
            raise bad(f"out of range ({self.low} to {self.high})")
        if self.pattern and not re.match(self.pattern, v):
            raise bad("malformed")
        if self.choices and v not in self.choices:
            raise bad(f"expected one of {', '.join(map(str, self.choices))}")
        return v

    def fill(self, v: Any) -> Any:
        if v is None and self.default_value is not _MISSING:
            return self.default_value() if callable(self.default_value) else self.default_value
        return v

    def store(self, v: Any) -> Any:
        """The form that a local DataFrame takes."""
        return json.dumps(v, default=str) if self.is_json and v is not None else v

    def broken(self, c: Column) -> Column:
        """True where a column's value violates the declaration: the check of bulk inserts."""
        out = F.lit(False) if self.is_optional else c.isNull()
        size = F.length(c) if self.kind in ("string", "enum") else F.size(c) if self.kind == "array" else c
        if self.low is not None:
            out = out | (size < self.low)
        if self.high is not None:
            out = out | (size > self.high)
        if self.pattern:
            out = out | ~c.rlike(self.pattern)
        if self.choices:
            out = out | ~c.isin(*self.choices)
        return F.coalesce(out, F.lit(False))


def string() -> Field:
    return Field("string", T.StringType())


def number() -> Field:
    return Field("number", T.DoubleType())


def integer() -> Field:
    return number().int()


def boolean() -> Field:
    return Field("boolean", T.BooleanType())


def date() -> Field:
    return Field("date", T.TimestampType())


def binary() -> Field:
    return Field("binary", T.BinaryType())


def enum(*choices: str) -> Field:
    return Field("enum", T.StringType(), choices=choices)


def array(inner: Field) -> Field:
    return Field("array", T.ArrayType(inner.spark), inner=inner)


def obj(**fields: Field) -> Field:
    return Field("object", T.StructType([T.StructField(n, f.spark) for n, f in fields.items()]), inner=fields)


def tuple_of(*fields: Field) -> Field:
    return Field("tuple", T.StructType([T.StructField(f"_{i}", f.spark) for i, f in enumerate(fields)]), inner=fields)


def record(inner: Field | None = None) -> Field:
    """String keys with values of one type, or of any type (a variant)."""
    return Field("record", T.MapType(T.StringType(), inner.spark) if inner else T.VariantType(), inner=inner)


def union(*alternatives: Field) -> Field:
    return Field("union", T.VariantType(), inner=alternatives)


@dataclass(frozen=True)
class TableSpec:
    """A table: declared fields and features. ``computed`` maps a name to a function of a
    column accessor (``lambda c: F.upper(c.name)``) that gives a Column."""

    name: str
    fields: dict[str, Field]
    timestamps: bool = False
    soft_deletes: bool = False
    unique: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    computed: dict[str, Callable] = field(default_factory=dict)
    key: str = "id"

    @property
    def system(self) -> list[str]:
        return [CREATED, UPDATED] * self.timestamps + [DELETED] * self.soft_deletes

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.fields, *self.system]

    @property
    def schema(self) -> T.StructType:
        out = [T.StructField(self.key, T.LongType())]
        out += [T.StructField(n, f.spark) for n, f in self.fields.items()]
        return T.StructType(out + [T.StructField(n, T.TimestampType()) for n in self.system])

    @property
    def local_schema(self) -> T.StructType:
        """The schema with variants as JSON text, for rows that come from the driver."""
        return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VariantType) else f.dataType) for f in self.schema])

    def validate(self, data: dict[str, Any]) -> dict[str, Any]:
        """A whole row, defaults filled in. Unknown keys raise: columns are declared."""
        unknown = set(data) - set(self.columns)
        if unknown:
            raise ValidationError(f"{self.name}: unknown {', '.join(sorted(unknown))}")
        return {n: f.check(f"{self.name}.{n}", f.fill(data.get(n))) for n, f in self.fields.items()}

    def validate_partial(self, data: dict[str, Any]) -> dict[str, Any]:
        """The declared keys among the given ones; others are left out."""
        return {n: self.fields[n].check(f"{self.name}.{n}", v) for n, v in data.items() if n in self.fields}

    def restore(self, row: dict[str, Any]) -> dict[str, Any]:
        """A collected row with variants (as JSON text), tuples and structs as Python values."""
        out = {}
        for n, v in row.items():
            f = self.fields.get(n)
            if f is not None and v is not None:
                v = json.loads(v) if f.is_json else plain(v)
                if f.kind == "tuple":
                    v = tuple(v.values())
            out[n] = v
        return out


def plain(v: Any) -> Any:
    """Rows inside a value as dictionaries."""
    if isinstance(v, T.Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v
