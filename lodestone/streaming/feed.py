"""Change listeners on Structured Streaming.

Commits publish their changes as Parquet folders in the order of change numbers. A file
stream picks them up and hands each batch to the listeners on the driver, ordered by number.
A row is read when its change is dispatched, so a listener sees its latest state; a change
whose row is gone by then is dropped, and a delete carries the key alone.
"""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import CHANGES

if TYPE_CHECKING:
    from ..sources.database import Database

log = logging.getLogger("lodestone")

#: Changes that the driver holds at a time; larger batches are handed over in such ranges.
MOST_EVENTS = 10_000


def stream(db: "Database") -> DataFrame:
    """All published changes: change_id, tbl, op, row_id."""
    return db.spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{db.store.root}/_changes")


class ChangeFeed:
    """Listeners of one database. Only changes committed after the first subscription are
    dispatched. ``drain()`` handles what is there now; ``start()`` keeps a query running."""

    def __init__(self, db: "Database"):
        self.db = db
        self.listeners: dict[tuple[str, str], list[Callable]] = {}
        self.seen = db.store.state.next_change - 1
        self._checkpoint = f"{db.store.root}/_staging/feed-{uuid.uuid4().hex}"
        self._query: StreamingQuery | None = None
        self._lock = threading.Lock()
        self._count = 0

    def subscribe(self, table: str, event: str, callback: Callable) -> Callable[[], None]:
        if not any(self.listeners.values()):  # nothing was dispatched meanwhile: start here
            self.seen = max(self.seen, self.db.store.state.next_change - 1)
        mine = self.listeners.setdefault((table, event), [])
        mine.append(callback)

        def off() -> None:
            if callback in mine:
                mine.remove(callback)
            if not any(self.listeners.values()):
                self.stop()

        return off

    def _dispatch(self, batch: DataFrame, _: int) -> None:
        wanted = {k for k, v in self.listeners.items() if v}
        pairs = F.lit(False)
        for table, op in wanted:
            pairs = pairs | ((F.col("tbl") == table) & (F.col("op") == op))
        fresh = batch.filter(F.col("change_id") > self.seen)
        mine = F.when(pairs, F.col("change_id"))
        top, first, last = fresh.agg(F.max("change_id"), F.min(mine), F.max(mine)).first()
        if top is None:
            return
        with self._lock:
            for begin in range(first, last + 1, MOST_EVENTS) if first is not None else ():
                part = fresh.filter(pairs & F.col("change_id").between(begin, min(last, begin + MOST_EVENTS - 1)))
                self._hand_over(part, {t for t, _ in wanted})
            self.seen = max(self.seen, top)

    def _hand_over(self, part: DataFrame, tables: set[str]) -> None:
        """Calls the listeners of at most MOST_EVENTS changes."""
        events: list[tuple[int, str, str, object]] = []
        for table in tables:
            key = self.db.key_of(table)
            own = part.filter(F.col("tbl") == table)
            for r in own.filter("op = 'delete'").select("change_id", "row_id").collect():
                events.append((r[0], table, "delete", {key: r[1]}))
            alive = own.filter("op <> 'delete'")
            if not alive.isEmpty():
                rows = self.db.frame(table)
                entities = {e.key: e for e in self.db.rows(rows.join(alive, rows[key] == F.col("row_id"), "left_semi"), table)}
                for r in alive.select("change_id", "op", "row_id").collect():
                    if r[2] in entities:
                        events.append((r[0], table, r[1], entities[r[2]]))
        for _, table, op, payload in sorted(events, key=lambda x: x[0]):
            for callback in list(self.listeners.get((table, op), ())):
                try:
                    callback(payload)
                except Exception:  # one listener's failure is not another's
                    log.exception("a listener of %s %s failed", table, op)
        self._count += len(events)

    def _writer(self):
        return stream(self.db).writeStream.foreachBatch(self._dispatch).option("checkpointLocation", self._checkpoint)

    def drain(self) -> int:
        """Dispatches everything published so far."""
        if self._query is not None and self._query.isActive:
            self._query.processAllAvailable()
        elif any(self.listeners.values()) and self.db.store.state.next_change - 1 > self.seen:
            self._count = 0
            query = self._writer().trigger(availableNow=True).start()
            query.awaitTermination()
        else:
            self._count = 0
        return self._count

    def start(self, interval: str = "100 milliseconds") -> None:
        """Dispatches in the background until stop()."""
        if self._query is None or not self._query.isActive:
            self._query = self._writer().trigger(processingTime=interval).start()

    def stop(self) -> None:
        if self._query is not None and self._query.isActive:
            self._query.stop()
        self._query = None

    def trim(self) -> None:
        """Deletes the changes that have been dispatched."""
        self.db.store.trim_changes(self.seen + 1)
