"""lodestone: typed tables, fluent queries and change feeds on Spark DataFrames."""

from .operators.query import NoRowFound, Query
from .sources import schema
from .sources.database import ConstraintError, Database, Table
from .sources.entity import Entity
from .sources.schema import TableSpec, ValidationError
from .sources.storage import ConcurrentCommit

__all__ = ["ConcurrentCommit", "ConstraintError", "Database", "Entity", "NoRowFound", "Query", "Table", "TableSpec", "ValidationError", "schema"]
