"""The database: managed tables with schemas, relations, mutations and change listeners, and
external Parquet tables to query along with them."""

from __future__ import annotations

import atexit
import datetime as dt
import json
import logging
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import predicates as P
from ..operators.multi import compile_multi
from ..operators.query import Change, Query
from .entity import Entity
from .schema import CREATED, DELETED, UPDATED, TableSpec, ValidationError, plain
from .storage import Files, State, Store, TableState

log = logging.getLogger("lodestone")

#: Up to so many new rows are sent to the tables that they are checked against.
FEW = 100_000


class ConstraintError(ValueError):
    """A foreign key or unique constraint would be broken."""


class Table:
    """``db.users``: the operations on one table."""

    def __init__(self, db: "Database", name: str):
        self._db, self.name = db, name

    def select(self, *columns: str) -> Query:
        return Query(self._db, self.name, columns=columns)

    def df(self) -> DataFrame:
        return self.select().df()

    def count(self) -> int:
        return self.select().count()

    def get(self, key: Any) -> Entity | None:
        """The row with a key, deleted softly or not."""
        return self.select().where({self._db.key_of(self.name): key}).with_trashed().first()

    get_by_id = get

    def get_one(self, where: dict | Callable) -> Entity | None:
        return self.select().where(where).with_trashed().first()

    def find_many(self, where: dict | Callable) -> list[Entity]:
        return self.select().where(where).with_trashed().all()

    def insert(self, data: dict[str, Any]) -> Entity:
        return self._db.insert(self.name, [data])[0]

    def insert_many(self, rows: Iterable[dict[str, Any]]) -> list[Entity]:
        return self._db.insert(self.name, list(rows))

    def insert_from(self, df: DataFrame) -> int:
        """Inserts a DataFrame's rows, distributed; returns how many."""
        return self._db.insert_from(self.name, df)

    def update(self, key_or_data: Any, data: dict[str, Any] | None = None) -> Any:
        """``update(key, data)`` changes one row; ``update(data).where(...).exec()`` many."""
        if data is None:
            return Change(self.select().with_trashed(), key_or_data)
        return self._db.update(self.name, key_or_data, data)

    def upsert(self, conditions: dict[str, Any], data: dict[str, Any]) -> Entity:
        return self._db.upsert(self.name, conditions, data)

    def upsert_many(self, rows: list[dict[str, Any]], conditions: dict[str, Any] | None = None) -> list[Entity]:
        with self._db.transaction_scope():
            return [self._db.upsert(self.name, conditions or {}, r) for r in rows]

    def upsert_from(self, df: DataFrame, on: list[str] | str) -> tuple[int, int]:
        """Merges a DataFrame on key columns; returns the rows updated and inserted."""
        return self._db.upsert_from(self.name, df, [on] if isinstance(on, str) else list(on))

    def find_or_create(self, conditions: dict[str, Any], defaults: dict[str, Any] | None = None) -> dict[str, Any]:
        found = self.get_one(conditions)
        return {"entity": found or self.insert({**conditions, **(defaults or {})}), "created": found is None}

    def delete(self, key: Any = None, force: bool = False) -> Any:
        """``delete(key)`` deletes one row; ``delete().where(...).exec()`` many."""
        return Change(self.select()) if key is None else self._db.delete(self.name, key, force)

    def restore(self, key: Any) -> None:
        self._db.restore(self.name, key)

    def compact(self) -> None:
        self._db.compact(self.name)

    def on(self, event: str, callback: Callable) -> Callable[[], None]:
        return self._db.on(self.name, event, callback)


class Database:
    """A folder of managed tables, together with attached external ones.

    ``relations`` is ``{child: {foreign_key: parent}}``, ``cascade`` ``{parent: [children]}``,
    ``hooks`` ``{table: {"before_insert": f, ...}}``. Without a path, a new folder in
    spark.checkpoint.dir serves until the program ends. The session is the caller's and stays open."""

    def __init__(self, spark: SparkSession, specs: Iterable[TableSpec] = (), path: str | None = None, relations: dict[str, dict[str, str]] | None = None, cascade: dict[str, list[str]] | None = None, hooks: dict[str, dict[str, Callable]] | None = None, reactive: bool = True, debug: bool = False):
        self.spark = spark
        self.specs = {s.name: s for s in specs}
        self.external: dict[str, tuple[str | DataFrame, str]] = {}
        self.relations: list[tuple[str, str, str]] = []  # (child, foreign key, parent)
        self.cascade, self.hooks, self.reactive, self.debug = cascade or {}, hooks or {}, reactive, debug
        self.closed = False
        self._pending: State | None = None
        self._after: list[Callable[[], None]] = []
        self._feed = None
        self.store = None
        if self.specs:
            self.path = path or _scratch_folder(spark)
            self.store = Store(spark, self.path)
            self._create_missing()
        for child, keys in (relations or {}).items():
            for fk, parent in keys.items():
                self.relate(child, fk, parent)

    # schema

    def _create_missing(self) -> None:
        """Adds declared tables, and declared columns to stored schemas (a column's older
        rows read null)."""
        state, changed = self.store.state.copy(), False
        for name, spec in self.specs.items():
            have = state.tables.setdefault(name, TableState())
            stored = T.StructType.fromJson(json.loads(have.schema)) if have.schema else T.StructType()
            new = [f for f in spec.schema if f.name not in stored.names]
            if new:
                have.schema = T.StructType([*stored.fields, *new]).json()
                changed = True
        if changed:
            self.store.commit(state)

    def attach(self, name: str, data: str | DataFrame, key: str = "id") -> "Database":
        """Makes a Parquet path or a DataFrame readable as a table; it can't be changed. A path
        is not looked at before the table is used."""
        self.external[name] = (data, key)
        return self

    def _attached(self, name: str) -> DataFrame:
        data, key = self.external[name]
        if isinstance(data, str):
            data = self.spark.read.parquet(data)
            self.external[name] = (data, key)
        return data

    def relate(self, child: str, foreign_key: str, parent: str) -> "Database":
        for t in (child, parent):
            if t not in self.specs and t not in self.external:
                raise ValueError(f"a relation names the unknown table {t}")
        self.relations.append((child, foreign_key, parent))
        return self

    def __getattr__(self, name: str) -> Table:
        if not name.startswith("_") and (name in self.__dict__.get("specs", ()) or name in self.__dict__.get("external", ())):
            return Table(self, name)
        raise AttributeError(f"there is no table {name}")

    def table(self, name: str) -> Table:
        return getattr(self, name)

    def tables(self) -> list[str]:
        return [*self.specs, *self.external]

    def columns(self, table: str) -> list[dict[str, Any]]:
        key = self.key_of(table)
        schema = self.specs[table].schema if table in self.specs else self._attached(table).schema
        required = {n for n, f in self.specs[table].fields.items() if not f.is_optional} if table in self.specs else set()
        return [{"name": f.name, "type": f.dataType.simpleString(), "not_null": f.name == key or f.name in required, "key": f.name == key} for f in schema]

    def diff(self) -> dict[str, dict[str, Any]]:
        """Declared against stored columns, of tables where they differ: added, removed, and
        changed types. System columns are left out."""
        out = {}
        for name, spec in self.specs.items():
            stored = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(json.loads(self.state.tables[name].schema))}
            declared = {n: f.spark.simpleString() for n, f in spec.fields.items()}
            hidden = {spec.key, CREATED, UPDATED, DELETED}
            found = {
                "added": [n for n in declared if n not in stored],
                "removed": [n for n in stored if n not in declared and n not in hidden],
                "type_changed": [{"column": n, "stored": stored[n], "declared": t} for n, t in declared.items() if n in stored and stored[n] != t],
            }
            if any(found.values()):
                out[name] = found
        return out

    def key_of(self, table: str) -> str:
        return self.specs[table].key if table in self.specs else self.external[table][1]

    def columns_of(self, table: str) -> list[str]:
        if table in self.specs:
            return [*self.specs[table].columns, *self.specs[table].computed]
        return self._attached(table).columns

    def computed(self, table: str) -> dict[str, Callable]:
        return self.specs[table].computed if table in self.specs else {}

    def is_soft(self, table: str) -> bool:
        return table in self.specs and self.specs[table].soft_deletes

    def is_storable(self, table: str, name: str) -> bool:
        return table in self.specs and name in self.specs[table].fields

    # relations

    def relation_keys(self, table: str, other: str) -> tuple[str, str]:
        """The equal columns of two related tables: table's own, then the other's."""
        for child, fk, parent in self.relations:
            if (child, parent) == (table, other):
                return fk, self.key_of(parent)
        for child, fk, parent in self.relations:
            if (parent, child) == (table, other):
                return self.key_of(parent), fk
        raise ValueError(f"{table} and {other} are not related; give the keys")

    @staticmethod
    def _nav(fk: str) -> str:
        return re.sub(r"(_id|_?[Kk]ey)$", "", fk)

    def _relation(self, table: str, name: str) -> tuple[str, str, str]:
        """("parent" or "children", foreign key, other table) of a navigation name."""
        for child, fk, parent in self.relations:
            if child == table and name in (self._nav(fk), parent):
                return "parent", fk, parent
        for child, fk, parent in self.relations:
            if parent == table and name == child:
                return "children", fk, child
        raise ValueError(f"{table} has no relation {name}")

    def navigate(self, entity: Entity, name: str) -> Callable[[], Any]:
        try:
            kind, fk, other = self._relation(entity._table, name)
        except ValueError as e:
            raise AttributeError(str(e)) from None
        query = Query(self, other)
        if kind == "parent":
            value = entity[fk]
            return lambda: None if value is None else query.where({self.key_of(other): value}).first()
        return lambda: query.where({fk: entity.key}).all()

    def entity_condition(self, table: str, name: str, entity: Entity) -> tuple[str, Any]:
        for child, fk, parent in self.relations:
            if child == table and parent == entity._table and name in (fk, self._nav(fk), parent):
                return fk, entity.key
        raise ValueError(f"{table} has no relation {name} to {entity._table}")

    def include(self, df: DataFrame, table: str, name: str) -> DataFrame:
        """Adds the related rows as a column: a struct of the parent, or the sorted array of
        structs of the children (empty if there are none)."""
        kind, fk, other = self._relation(table, name)
        rows = Query(self, other).df()
        if kind == "parent":
            if fk not in df.columns:
                raise ValueError(f"select {fk} to include {name}")
            related = rows.select(F.col(self.key_of(other)).alias("_key"), F.struct(*rows.columns).alias(name))
            return df.join(related, df[fk] == F.col("_key"), "left").drop("_key")
        key = self.key_of(table)
        if key not in df.columns:
            raise ValueError(f"select {key} to include {name}")
        order = self.key_of(other)
        first = [order, *(c for c in rows.columns if c != order)] if order in rows.columns else rows.columns
        kids = rows.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
        return df.join(kids, df[key] == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.array().cast(kids.schema[name].dataType)))

    # reading

    @property
    def state(self) -> State:
        return self._pending or self.store.state

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the database is closed")

    def frame(self, table: str) -> DataFrame:
        """All rows of a table."""
        self._open()
        if table in self.specs:
            return self.store.read(self.state.tables[table].segments, self.specs[table].schema)
        if table in self.external:
            return self._attached(table)
        raise ValueError(f"there is no table {table}")

    def rows(self, df: DataFrame, table: str | None) -> list:
        """Collected rows; of a table, entities with computed fields."""
        began = time.perf_counter()
        variants = {f.name for f in df.schema if isinstance(f.dataType, T.VariantType)}
        found = df.select(*(F.to_json(c).alias(c) if c in variants else F.col(f"`{c}`") for c in df.columns)).collect()
        if self.debug:
            log.info("%s: %d rows in %.1f ms", table or "query", len(found), 1000 * (time.perf_counter() - began))
        if table is None:
            return found
        spec = self.specs.get(table)
        plain_rows = [{k: plain(v) for k, v in r.asDict().items()} for r in found]
        return [Entity(self, table, spec.restore(r) if spec else r) for r in plain_rows]

    def query(self, fn: Callable) -> DataFrame:
        """A query over several tables; see compile_multi."""
        return compile_multi(self, fn)

    def raw(self, sql: str, *params: Any) -> DataFrame:
        """Any Spark SQL over the tables, with positional ``?`` parameters."""
        self._open()
        for name in self.tables():
            if re.search(rf"\b{re.escape(name)}\b", sql):
                self.frame(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=list(params)) if params else self.spark.sql(sql)

    def exec(self, sql: str, *params: Any) -> int:
        """One UPDATE, DELETE or INSERT statement; returns the rows affected."""
        text = P.bind(sql.strip().rstrip(";"), params)
        if m := re.fullmatch(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", text):
            values = {k: F.expr(e) for k, e in (x.split("=", 1) for x in _split(m[2]))}
            query = Query(self, m[1]).with_trashed()
            return self.update_where(m[1], query.where_raw(m[3]) if m[3] else query, {k.strip(): v for k, v in values.items()})
        if m := re.fullmatch(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", text):
            query = Query(self, m[1]).with_trashed()
            return self.delete_where(m[1], query.where_raw(m[2]) if m[2] else query, force=True)
        if m := re.fullmatch(r"(?is)INSERT\s+INTO\s+(\w+)\s*\(([^)]*)\)\s*(VALUES\s.*|SELECT\s.*)", text):
            names = [x.strip() for x in m[2].split(",")]
            rows = self.raw(m[3]) if m[3][:6].upper() == "SELECT" else self.spark.sql(f"SELECT * FROM {m[3]}")
            return self.insert_from(m[1], rows.toDF(*names))
        raise ValueError("only UPDATE, DELETE and INSERT can be executed")

    # transactions

    @contextmanager
    def transaction_scope(self):
        """Mutations inside are committed together at the end, or not at all."""
        if self._pending is not None:  # nested: part of the outer one
            yield self
            return
        self._open()
        self._pending, self._after = self.store.state.copy(), []
        try:
            yield self
            after, state = self._after, self._pending
            self._pending, self._after = None, []
            self.store.commit(state)
        except BaseException:
            self._pending, self._after = None, []
            raise
        for f in after:
            f()

    def transaction(self, fn: Callable[[], Any]) -> Any:
        with self.transaction_scope():
            return fn()

    def _hook(self, table: str, name: str) -> Callable | None:
        return self.hooks.get(table, {}).get(name)

    def _spec(self, table: str) -> TableSpec:
        if table not in self.specs:
            raise ValueError(f"{table} can't be changed: it is no managed table")
        return self.specs[table]

    def _changes(self, table: str, op: str, ids: DataFrame) -> None:
        if self.reactive:
            key = self.key_of(table)
            self.store.log_changes(self._pending, ids.select(F.lit(table).alias("tbl"), F.lit(op).alias("op"), F.col(key).alias("row_id")))

    # constraints

    def _local(self, spec: TableSpec, rows: list[dict[str, Any]]) -> DataFrame:
        """A DataFrame of driver rows in the stored form; few of them in one partition."""
        stored = [tuple(spec.fields[c].store(r.get(c)) if c in spec.fields else r.get(c) for c in spec.columns) for r in rows]
        local = self.spark.createDataFrame(stored, spec.local_schema)
        return self._typed(spec, local.coalesce(1) if len(rows) <= FEW else local)

    @staticmethod
    def _typed(spec: TableSpec, df: DataFrame) -> DataFrame:
        out = []
        for f in spec.schema:
            if f.name not in df.columns:
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif isinstance(f.dataType, T.VariantType):
                c = F.col(f.name)
                out.append((c if isinstance(df.schema[f.name].dataType, T.VariantType) else F.parse_json(c)).alias(f.name))
            else:
                out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        return df.select(*out)

    @staticmethod
    def _shared(names: Iterable[str], new: DataFrame, n: int, old: DataFrame) -> DataFrame:
        """The values of ``names`` that the ``n`` rows of ``new`` and ``old`` have in common. Few
        new rows are sent to the old ones, which may be any number and stay where they are."""
        new, old = new.select(*names).alias("n"), old.select(*names).alias("o")
        same = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in names]
        return old.join(F.broadcast(new), same, "left_semi") if n <= FEW else new.join(old, same, "left_semi")

    def _check(self, spec: TableSpec, new: DataFrame, n: int, old: DataFrame, columns: Iterable[str] | None = None) -> None:
        """Raises if the ``n`` rows of ``new`` break a unique or foreign key, among themselves or
        with ``old``. Nulls are distinct and refer to nothing."""
        touched = set(columns) if columns is not None else None
        for names in spec.unique:
            if touched is not None and not touched & set(names):
                continue
            known = new.where(_all_known(names))
            twice = known.groupBy(*names).count().where("count > 1").drop("count")
            if found := twice.unionByName(self._shared(names, known, n, old)).limit(1).collect():
                raise ConstraintError(f"{spec.name}: {', '.join(names)} must be unique; {tuple(found[0])} is not")
        for child, fk, parent in self.relations:
            if child != spec.name or touched is not None and fk not in touched:
                continue
            parents = self.frame(parent).select(F.col(self.key_of(parent)).alias("_parent"))
            if parent == child:
                parents = parents.union(new.select(self.key_of(parent)))
            asked = new.where(F.col(fk).isNotNull()).select(fk)
            if n <= FEW:
                there = parents.join(F.broadcast(asked), F.col("_parent") == F.col(fk), "left_semi").select(F.col("_parent").cast(asked.schema[fk].dataType), F.lit(True))
                orphan = asked.withColumn("_there", F.lit(False)).union(there).groupBy(fk).agg(F.bool_or("_there").alias("_there")).where("not _there")
            else:
                orphan = asked.join(parents, F.col(fk) == F.col("_parent"), "left_anti")
            if found := orphan.limit(1).collect():
                raise ConstraintError(f"{spec.name}: {fk} {found[0][0]} is in no row of {parent}")

    # insert

    def insert(self, table: str, rows: list[dict[str, Any]]) -> list[Entity]:
        spec = self._spec(table)
        if not rows:
            return []
        before, after = self._hook(table, "before_insert"), self._hook(table, "after_insert")
        now = dt.datetime.now(dt.timezone.utc)
        with self.transaction_scope():
            mine = self._pending.tables[table]
            ready = []
            for data in rows:
                data = (before(dict(data)) or data) if before else data
                row = spec.validate(data)
                key = data.get(spec.key)
                row[spec.key] = mine.next_id if key is None else int(key)
                mine.next_id = max(mine.next_id, row[spec.key] + 1)
                if spec.timestamps:
                    row |= {CREATED: now, UPDATED: now}
                ready.append(row)
            new = self._local(spec, ready)
            if any(data.get(spec.key) is not None for data in rows):
                keys = [r[spec.key] for r in ready]
                if len(set(keys)) < len(keys) or self.frame(table).where(F.col(spec.key).isin(keys)).limit(1).count():
                    raise ConstraintError(f"{table}: {spec.key} must be unique")
            self._check(spec, new, len(ready), self.frame(table))
            mine.segments = [*mine.segments, self.store.write(new, table, spec.indexes)]
            if self.reactive:
                self.store.log_rows(self._pending, [(table, "insert", r[spec.key]) for r in ready])
            entities = [Entity(self, table, {c: self._seen(spec, c, r.get(c)) for c in spec.columns} | self._lazy(table, r)) for r in ready]
            if after:
                self._after += [lambda e=e: after(e) for e in entities]
        return entities

    @staticmethod
    def _seen(spec: TableSpec, name: str, v: Any) -> Any:
        """A stored value as reading it gives it."""
        if isinstance(v, dt.datetime) and v.tzinfo:
            return v.astimezone().replace(tzinfo=None)
        return tuple(v.values()) if name in spec.fields and spec.fields[name].kind == "tuple" and v is not None else v

    def _lazy(self, table: str, row: dict[str, Any]) -> dict[str, Any]:
        """Computed fields of a new row."""
        if not self.specs[table].computed:
            return {}
        found = self._local(self.specs[table], [row]).select(*(f(P.Columns(F.col)).alias(n) for n, f in self.specs[table].computed.items())).first()
        return found.asDict()

    def insert_from(self, table: str, df: DataFrame) -> int:
        """Rows of a DataFrame: defaults filled in, checked by expressions, numbered where
        they have no key. Nothing but counts reaches the driver; hooks are not called."""
        spec = self._spec(table)
        unknown = set(df.columns) - set(spec.columns)
        if unknown:
            raise ValidationError(f"{table}: unknown {', '.join(sorted(unknown))}")
        with self.transaction_scope():
            mine = self._pending.tables[table]
            rows = self._typed(spec, df)
            fills = {}
            for n, f in spec.fields.items():
                value = f.fill(None)
                if value is not None and not f.is_json:
                    fills[n] = F.coalesce(n, F.lit(value).cast(f.spark) if not isinstance(value, (list, dict)) else F.from_json(F.lit(json.dumps(value)), f.spark))
            if spec.timestamps:
                now = F.lit(dt.datetime.now(dt.timezone.utc))
                fills |= {CREATED: F.coalesce(CREATED, now), UPDATED: F.coalesce(UPDATED, now)}
            rows = rows.withColumns(fills) if fills else rows
            rows, n = self.store.number(rows, mine.next_id, "_number", table)
            if not n:
                return 0
            rows = rows.withColumn(spec.key, F.coalesce(spec.key, "_number")).drop("_number")
            broken = F.lit(False)
            for name, f in spec.fields.items():
                broken = broken | f.broken(F.col(name))
            if bad := rows.where(broken).limit(1).collect():
                raise ValidationError(f"{table}: a row does not fit the schema: {bad[0].asDict()}")
            old = self.frame(table)
            keys = rows.groupBy(spec.key).count().where("count > 1").select(spec.key) if spec.key in df.columns else None
            if keys is not None and not keys.unionByName(self._shared([spec.key], rows, n, old)).isEmpty():
                raise ConstraintError(f"{table}: {spec.key} must be unique")
            self._check(spec, rows, n, old)
            segment = self.store.write(rows.select(*spec.columns), table, spec.indexes)
            mine.segments = [*mine.segments, segment]
            written = self.store.read([segment], spec.schema)
            mine.next_id = max(mine.next_id, int(written.agg(F.max(spec.key)).first()[0]) + 1)
            self._changes(table, "insert", written)
            return n

    # update and delete

    def _hits(self, table: str, query: Query) -> DataFrame:
        """The keys of the rows that a query's conditions choose, as (_hit)."""
        key = self.key_of(table)
        base = self.frame(table).alias(table)
        return query.filtered(base).select(F.col(f"`{table}`.`{key}`").alias("_hit"))

    def _rewrite(self, table: str, query: Query, change: Callable[[DataFrame], DataFrame] | None, op: str, columns: Iterable[str] | None = None) -> int:
        """Replaces the segments that hold rows chosen by ``query``, with these rows changed,
        or gone if there is no change. Returns how many."""
        spec = self._spec(table)
        with self.transaction_scope():
            mine = self._pending.tables[table]
            if not mine.segments:
                return 0
            placed = self.store.read(mine.segments, spec.schema, with_segment=True)
            subquery = any(isinstance(v, (Query, DataFrame)) for _, v, _ in query.memberships)
            if subquery:  # chosen by a join: keys first, then a semi join
                hits = self._hits(table, query)
                chosen = placed.join(hits, placed[spec.key] == hits["_hit"], "left_semi")
            else:
                condition = query.condition(lambda n: F.col(f"`{n}`"))
                chosen = placed if condition is None else placed.filter(condition)
            per_segment = {r[0]: r[1] for r in chosen.groupBy("_segment").count().collect()}
            total = sum(per_segment.values())
            if not total:
                return 0
            hit = [mine.segments[i] for i in per_segment]
            whole = self.store.read(hit, spec.schema)
            if subquery:
                marked = whole.join(hits.withColumn("_is", F.lit(True)), whole[spec.key] == F.col("_hit"), "left").withColumn("_is", F.coalesce("_is", F.lit(False))).drop("_hit")
            else:
                marked = whole.withColumn("_is", F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True))
            new = change(marked) if change else marked.where("not _is")
            segment = self.store.write(new.select(*spec.columns, "_is"), table, spec.indexes)
            after = self.spark.read.schema(T.StructType([*spec.schema, T.StructField("_is", T.BooleanType())])).parquet(f"{self.store.root}/{segment}")
            if change and columns:
                rest = [s for s in mine.segments if s not in hit]
                old = self.store.read(rest, spec.schema).select(*spec.columns).unionByName(after.where("not _is").select(*spec.columns))
                self._check(spec, after.where("_is").select(*spec.columns), total, old, columns)
            ids = after.where("_is") if change else marked.where("_is")
            self._changes(table, op, ids)
            mine.segments = [*(s for s in mine.segments if s not in hit), segment]
            return total

    def update_where(self, table: str, query: Query, data: dict[str, Any]) -> int:
        spec = self._spec(table)
        values = {}
        for n, v in data.items():
            if n not in spec.columns:
                raise ValidationError(f"{table} has no column {n}")
            if not isinstance(v, Column):
                f = spec.fields.get(n)
                v = f.check(f"{table}.{n}", v) if f and v is not None else v
                v = _literal(f, v) if f else F.lit(v)
            values[n] = v.cast(spec.schema[n].dataType) if not isinstance(spec.schema[n].dataType, T.VariantType) else v
        if not values:
            return 0
        return self._rewrite(table, query, lambda df: df.withColumns({n: F.when(F.col("_is"), v).otherwise(F.col(n)) for n, v in values.items()}), "update", values)

    def update(self, table: str, key: Any, data: dict[str, Any]) -> Entity | None:
        """One row by key; null if there is none. Calls the hooks and sets updatedAt."""
        spec = self._spec(table)
        if before := self._hook(table, "before_update"):
            data = before(dict(data), key) or data
        values = spec.validate_partial(data)
        accessor = Table(self, table)
        if values or spec.timestamps:
            if spec.timestamps:
                values[UPDATED] = dt.datetime.now(dt.timezone.utc)
            self.update_where(table, Query(self, table).with_trashed().where({spec.key: key}), values)
        found = accessor.get(key)
        if found is not None and (after := self._hook(table, "after_update")):
            after(found)
        return found

    def upsert(self, table: str, conditions: dict[str, Any], data: dict[str, Any]) -> Entity:
        spec = self._spec(table)
        key = data.get(spec.key)
        match = {spec.key: key} if key is not None else conditions
        found = Table(self, table).get_one(match) if match else None
        rest = {k: v for k, v in data.items() if k != spec.key}
        if found is not None:
            return self.update(table, found.key, rest)
        return self.insert(table, [{**conditions, **rest}])[0]

    def upsert_from(self, table: str, df: DataFrame, on: list[str]) -> tuple[int, int]:
        """Rows of ``df`` update those that agree on ``on``, and are inserted otherwise: one
        join, without rows on the driver. Among rows of ``df`` that agree, one must remain."""
        spec = self._spec(table)
        with self.transaction_scope():
            scratch = self.store.write(df, "_staging")
            given = self.spark.read.parquet(f"{self.store.root}/{scratch}")
            if not given.groupBy(*on).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{table}: rows to merge agree on {', '.join(on)}")
            mine = self._pending.tables[table]
            new = given.join(self.frame(table).select(*on), on, "left_anti").select(*given.columns)
            inserted = self.insert_from(table, new.drop(spec.key) if spec.key in new.columns and spec.key not in on else new)
            sets = [c for c in given.columns if c not in on and c in spec.columns and c != spec.key]
            updated = 0
            if sets and mine.segments:
                placed = self.store.read(mine.segments, spec.schema, with_segment=True)
                renamed = given.select(*on, *(F.col(c).alias(f"_new_{c}") for c in sets), F.lit(True).alias("_is"))
                differs = F.lit(False)
                for c in sets:
                    differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}").cast(spec.schema[c].dataType))
                touched = {r[0]: r[1] for r in placed.join(renamed, on).where(differs).groupBy("_segment").count().collect()}
                updated = sum(touched.values())
                if updated:
                    hit = [mine.segments[i] for i in touched]
                    joined = self.store.read(hit, spec.schema).join(renamed, on, "left").withColumn("_is", F.coalesce(F.col("_is") & differs, F.lit(False)))
                    changed = joined.withColumns({c: F.when(F.col("_is"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(spec.schema[c].dataType) for c in sets})
                    segment = self.store.write(changed.select(*spec.columns, "_is"), table, spec.indexes)
                    after = self.spark.read.schema(T.StructType([*spec.schema, T.StructField("_is", T.BooleanType())])).parquet(f"{self.store.root}/{segment}")
                    old = self.store.read([s for s in mine.segments if s not in hit], spec.schema).unionByName(after.where("not _is").drop("_is"))
                    self._check(spec, after.where("_is").drop("_is"), updated, old, sets)
                    self._changes(table, "update", after.where("_is"))
                    mine.segments = [*(s for s in mine.segments if s not in hit), segment]
            return updated, inserted

    def delete_where(self, table: str, query: Query, force: bool = False) -> int:
        spec = self._spec(table)
        if spec.soft_deletes and not force:
            now = F.lit(dt.datetime.now(dt.timezone.utc))
            return self._rewrite(table, query, lambda df: df.withColumn(DELETED, F.when(F.col("_is"), now).otherwise(F.col(DELETED))), "update")
        with self.transaction_scope():
            children = [(c, fk) for c, fk, p in self.relations if p == table and c in self.specs]
            gone = None
            if children:
                name = self.store.write(self._hits(table, query), "_staging")
                gone = self.spark.read.schema("_hit long").parquet(f"{self.store.root}/{name}")
            n = self._rewrite(table, query, None, "delete")
            for child, fk in children if n else ():
                self.update_where(child, Query(self, child).with_trashed().where_in(fk, gone), {fk: F.lit(None)})
            return n

    def delete(self, table: str, key: Any, force: bool = False) -> bool:
        """One row by key: hooks, then cascades, then the row, softly where the table has
        soft deletes. False if a hook refused or there is no such row."""
        spec = self._spec(table)
        before, after = self._hook(table, "before_delete"), self._hook(table, "after_delete")
        if before and before(key) is False:
            return False
        with self.transaction_scope():
            for child in self.cascade.get(table, ()):
                fk = next((fk for c, fk, p in self.relations if (c, p) == (child, table)), None)
                if fk:
                    self.delete_where(child, Query(self, child).where({fk: key}), force)
            n = self.delete_where(table, Query(self, table).with_trashed().where({spec.key: key}), force)
            if n and after:
                self._after.append(lambda: after(key))
        return bool(n)

    def restore(self, table: str, key: Any) -> None:
        spec = self._spec(table)
        if not spec.soft_deletes:
            raise ValueError(f"{table} has no soft deletes")
        self.update_where(table, Query(self, table).with_trashed().where({spec.key: key}), {DELETED: None})

    def compact(self, table: str) -> None:
        """Writes all segments of a table as one, in files near Spark's partition size."""
        spec = self._spec(table)
        with self.transaction_scope():
            mine = self._pending.tables[table]
            if len(mine.segments) > 1:
                mine.segments = [self.store.write(self.frame(table).hint("rebalance", *(spec.indexes[0] if spec.indexes else ())), table, spec.indexes)]

    # import and export

    def dump(self) -> dict[str, list[dict[str, Any]]]:
        """All rows of all managed tables, deleted ones too, as JSON-like values."""
        return {t: [json.loads(x) for x in self.frame(t).orderBy(self.key_of(t)).toJSON().collect()] for t in self.specs}

    def dump_to(self, path: str) -> None:
        """The same as JSON lines, a folder for each table."""
        for t in self.specs:
            self.frame(t).write.mode("overwrite").json(f"{path}/{t}")

    def load(self, data: dict[str, list[dict[str, Any]]], append: bool = False) -> None:
        """Rows of a dump, in one transaction, without validation; unknown tables are skipped,
        and keys given anew. Without ``append`` the tables are emptied first."""
        with self.transaction_scope():
            for name, rows in data.items():
                if name not in self.specs:
                    continue
                spec, mine = self.specs[name], self._pending.tables[name]
                if not append:
                    mine.segments = []
                if not rows:
                    continue
                fields = [f for f in spec.schema if f.name != spec.key]
                lines = self.spark.createDataFrame([(i, json.dumps(r, default=str)) for i, r in enumerate(rows)], "_i long, _line string").coalesce(1)
                parsed = lines.select("_i", F.from_json("_line", T.StructType(fields)).alias("r")).select((F.col("_i") + mine.next_id).alias(spec.key), "r.*")
                mine.segments = [*mine.segments, self.store.write(parsed.select(*spec.columns), name)]
                if self.reactive:
                    self.store.log_rows(self._pending, [(name, "insert", mine.next_id + i) for i in range(len(rows))])
                mine.next_id += len(rows)

    def load_from(self, path: str, append: bool = False) -> None:
        """The folders of dump_to(), distributed."""
        with self.transaction_scope():
            for name, spec in self.specs.items():
                if not append:
                    self._pending.tables[name].segments = []
                rows = self.spark.read.schema(T.StructType([f for f in spec.schema if f.name != spec.key])).json(f"{path}/{name}")
                self.insert_from(name, rows)

    def seed(self, fixtures: dict[str, list[dict[str, Any]]]) -> None:
        self.load(fixtures, append=True)

    # changes

    def on(self, table: str, event: str, callback: Callable) -> Callable[[], None]:
        """Calls back for each later insert, update or delete; returns what ends that."""
        if not self.reactive:
            raise RuntimeError("the database is not reactive")
        if event not in ("insert", "update", "delete"):
            raise ValueError("events are insert, update and delete")
        self._spec(table)
        from ..streaming.feed import ChangeFeed

        if self._feed is None:
            self._feed = ChangeFeed(self)
        return self._feed.subscribe(table, event, callback)

    def poll(self) -> int:
        """Dispatches all committed changes to the listeners now; returns how many."""
        return self._feed.drain() if self._feed else 0

    def changes_stream(self) -> DataFrame:
        """The change log as a streaming DataFrame, for listeners of any scale."""
        from ..streaming.feed import stream

        return stream(self)

    def close(self) -> None:
        """Ends listeners; later use raises. The session stays open."""
        if self._feed:
            self._feed.stop()
        self.closed = True


def _scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, gone when the program ends: in
    spark.checkpoint.dir, or where that isn't set and the master is local, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or give the database a path")
    path = f"{shared}/lodestone-db-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='lodestone-db-')}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        Files(spark, path).delete("")
    elif path.startswith(("/", "file:")):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _all_known(names: Iterable[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def _literal(f: Any, v: Any) -> Column:
    if f.is_json:
        return F.parse_json(F.lit(f.store(v))) if v is not None else F.lit(None).cast("variant")
    if isinstance(v, (dict, list)):
        return F.from_json(F.lit(json.dumps(v, default=str)), f.spark)
    return F.lit(v)


def _split(text: str) -> list[str]:
    """At commas outside of parentheses and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]
