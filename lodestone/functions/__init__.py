"""Scalar functions by their embedded-SQL names, with that dialect's results."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE_NAMES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "string": "text", "binary": "blob", "void": "null"}
#: Letters of strftime that are one of Spark's date patterns.
_DATE_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def lit(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _all_known(columns: tuple[Column, ...], value: Column) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(known, value)


def _min(*a: Column) -> Column:
    return F.min(a[0]) if len(a) == 1 else _all_known(a, F.least(*a))


def _max(*a: Column) -> Column:
    return F.max(a[0]) if len(a) == 1 else _all_known(a, F.greatest(*a))


def _substr(s: Column, start: Column, n: Column | None = None) -> Column:
    """Position 0 lies before the first character, so that ('hello', 0, 2) is 'h'."""
    if n is None:
        return F.call_function("substr", s, F.when(start == 0, 1).otherwise(start))
    return F.call_function("substr", s, F.when(start == 0, 1).otherwise(start), F.when(start == 0, F.greatest(n - 1, F.lit(0))).otherwise(n))


def _moment(at: Any = "now", *modifiers: str) -> Column:
    """A timestamp of the session's time zone, moved by modifiers from left to right; null
    where a text is no date. A month that lacks the day runs over into the next one."""
    t = F.current_timestamp() if isinstance(at, str) and at.lower() == "now" else lit(at).try_cast("timestamp")
    for m in modifiers:
        if not isinstance(m, str):
            raise ValueError("a date modifier is a text")
        word = m.strip().lower()
        if moved := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day)s?", word):
            t = F.timestamp_add("MICROSECOND", F.lit(round(float(moved[1]) * _SECONDS[moved[2]] * 1e6)), t)
        elif moved := re.fullmatch(r"([+-]?\d+)\s+(month|year)s?", word):
            month = F.date_trunc("month", t)
            t = F.timestamp_add(moved[2].upper(), F.lit(int(moved[1])), month) + (t - month)
        elif moved := re.fullmatch(r"start of (day|month|year)", word):
            t = F.date_trunc(moved[1], t)
        elif moved := re.fullmatch(r"weekday ([0-6])", word):
            t = F.timestamp_add("DAY", F.pmod(F.lit(int(moved[1]) + 1) - F.dayofweek(t), F.lit(7)), t)
        else:
            raise ValueError(f"unknown date modifier {m!r}")
    return t


def _julian(t: Column) -> Column:
    return F.unix_micros(t) / F.lit(86400e6) + F.lit(2440587.5)


def _strftime(pattern: str, at: Any = "now", *modifiers: str) -> Column:
    if not isinstance(pattern, str):
        raise ValueError("strftime takes its pattern as a text")
    t = _moment(at, *modifiers)
    own = {
        "w": (F.dayofweek(t) - 1).cast("string"),
        "W": F.lpad(F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("string"), 2, "0"),
        "s": F.unix_seconds(t).cast("string"),
        "J": _julian(t).cast("string"),
        "%": F.lit("%"),
    }
    parts = [F.when(t.isNotNull(), "")]
    for letter, plain in re.findall(r"%(.?)|([^%]+)", pattern):
        if plain:
            parts.append(F.lit(plain))
        elif letter in _DATE_LETTERS:
            parts.append(F.date_format(t, _DATE_LETTERS[letter]))
        elif letter in own:
            parts.append(own[letter])
        else:
            raise ValueError(f"unknown letter %{letter} of strftime")
    return F.concat(*parts)


def _typeof(c: Column) -> Column:
    name = F.when(c.isNull(), "null")
    for spark, own in _TYPE_NAMES.items():
        name = name.when(F.typeof(c) == spark, own)
    return name.otherwise("text")


SPECIAL = {
    "min": _min,
    "max": _max,
    "substr": _substr,
    "substring": _substr,
    "ifnull": F.coalesce,
    "iif": lambda c, a, b: F.when(c, a).otherwise(b),
    "total": lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)),
    "group_concat": lambda c, sep=None: F.listagg(c.cast("string"), sep if sep is not None else F.lit(",")),
    "json_extract": lambda c, path: F.call_function("get_json_object", c, path),
    "typeof": _typeof,
    "div": lambda a, b: F.try_divide(a, b).cast("long"),
    "unicode": lambda c: F.ascii(c),
    "char": lambda *c: F.concat(*(F.char(x) for x in c)),
    "random": lambda: (F.rand() * (1 << 62)).cast("long"),
}


#: Functions of a date and modifiers, which are read here and not by Spark.
DATES = {
    "strftime": _strftime,
    "date": lambda *a: F.date_format(_moment(*a), "yyyy-MM-dd"),
    "time": lambda *a: F.date_format(_moment(*a), "HH:mm:ss"),
    "datetime": lambda *a: F.date_format(_moment(*a), "yyyy-MM-dd HH:mm:ss"),
    "julianday": lambda *a: _julian(_moment(*a)),
    "unixepoch": lambda *a: F.unix_seconds(_moment(*a)),
}


def call(name: str, *args: Any) -> Column:
    """A function by name: an entry of DATES or SPECIAL, or else Spark's function of that name."""
    if own := DATES.get(name.lower()):
        return own(*args)
    own = SPECIAL.get(name.lower())
    columns = [lit(a) for a in args]
    return own(*columns) if own else F.call_function(name.lower(), *columns)


def equal(c: Column, value: Any) -> Column:
    """``c = value``; a number and a text are equal where the text is that number, and a text
    that is none equals no number. Which case holds is known when the plan is optimised, so
    that the comparison is still pushed down to scans."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.when(F.typeof(c) == "string", c.try_cast("double") == F.lit(value)).otherwise(c == F.lit(value))
    if isinstance(value, str):
        number = F.typeof(c).rlike("^((tiny|small|big)?int|float|double|decimal.*)$")
        return F.when(number, c == F.lit(value).try_cast("double")).otherwise(c == F.lit(value))
    return c == lit(value)


class Functions:
    """``f.lower(c.name)``: any attribute is a function."""

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *args: call(name.rstrip("_"), *args)
