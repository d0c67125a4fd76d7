"""Rows with methods: navigation, update, delete and write-through attributes."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from ..operators.predicates import _Entity

if TYPE_CHECKING:
    from .database import Database


class Entity(_Entity):
    """A row of a table. Columns are attributes; setting a declared one updates the table.
    A relation is a method: ``book.author()``, ``author.books()``."""

    def __init__(self, db: "Database", table: str, values: dict[str, Any]):
        object.__setattr__(self, "_db", db)
        object.__setattr__(self, "_table", table)
        object.__setattr__(self, "_values", values)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        values = object.__getattribute__(self, "_values")
        if name in values:
            return values[name]
        return self._db.navigate(self, name)

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __setattr__(self, name: str, value: Any) -> None:
        if not self._db.is_storable(self._table, name):
            raise AttributeError(f"{self._table} has no column {name} to set")
        if self._values.get(name) != value:
            self.update({name: value})

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, Entity) and (self._table, self._values) == (other._table, other._values)

    __hash__ = None

    def __repr__(self) -> str:
        return f"{self._table}({', '.join(f'{k}={v!r}' for k, v in self._values.items())})"

    @property
    def key(self) -> Any:
        return self._values[self._db.key_of(self._table)]

    def to_dict(self) -> dict[str, Any]:
        return dict(self._values)

    def update(self, data: dict[str, Any]) -> "Entity":
        new = self._db.update(self._table, self.key, data)
        if new is not None:
            self._values.update(new._values)
        return self

    def delete(self, force: bool = False) -> bool:
        return self._db.delete(self._table, self.key, force)
