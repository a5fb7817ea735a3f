"""A table kept in key order, with new rows in a delta until the next compaction.

The main part is range-partitioned and sorted by the key, so that the scan skips row groups outside a search; the delta is
small and read beside it. A compaction is due when the delta reaches a limit that grows with the logarithm of the main part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import RID, SEQ, Store

FIRST_LIMIT = 3


class SequentialTable:
    """`table` of `store` by `key`. Equal keys are allowed. The limit and the extent of the main part are kept with the table,
    so that they hold when it is opened again."""

    def __init__(self, store: Store, table: str, key: str, limit: int | None = None):
        self.store, self.table, self.key = store, table, key
        notes = store.manifest(table).notes
        self.limit = limit if limit is not None else notes.get("limit", FIRST_LIMIT)
        self.main_seq = notes.get("main_seq", 0)  # changes up to this one are in the main part
        self.main_rows = notes.get("main_rows", 0)

    def delta(self) -> DataFrame:
        """Live rows that came after the last compaction."""
        return self.store.stored(self.table, after=self.main_seq)

    def insert(self, rows: DataFrame) -> int:
        """Adds rows to the delta, after folding it in if it is full. Returns how many."""
        if self.delta().count() >= self.limit:
            self.reconstruct()
        return self.store.append(self.table, rows)

    def reconstruct(self) -> None:
        """Folds delta and main part into one in key order, and sets the next limit."""
        with self.store.lock(self.table):
            m = self.store.manifest(self.table)
            self.main_seq, self.main_rows = m.seq + 1, m.rows
            self.limit = max(1, int(math.log2(self.main_rows + self.limit)))
            self.store.compact(self.table, self.key, {"limit": self.limit, "main_seq": self.main_seq, "main_rows": self.main_rows})

    def search(self, value) -> DataFrame:
        """The first row with the key in order of insertion, or none."""
        return self._plain(self.store.stored(self.table).where(F.col(self.key) == value).orderBy(RID).limit(1))

    def range_search(self, low, high) -> DataFrame:
        """Rows with low <= key <= high, by key."""
        return self._plain(self.store.stored(self.table).where(F.col(self.key).between(low, high)).orderBy(self.key, RID))

    def remove(self, value) -> bool:
        """Deletes one row with the key, the first; whether there was one."""
        first = self.store.stored(self.table).where(F.col(self.key) == value).agg(F.min(RID)).first()[0]
        return first is not None and self.store.delete(self.table, F.col(RID) == first) == 1

    def remove_all(self, value) -> bool:
        """Deletes all rows with the key; whether there were any."""
        return self.store.delete(self.table, F.col(self.key) == value) > 0

    def truncate(self) -> None:
        with self.store.lock(self.table):
            self.store.truncate(self.table)
            self.main_seq, self.main_rows = self.store.manifest(self.table).seq, 0
            self.store.note(self.table, main_seq=self.main_seq, main_rows=0)

    def size(self) -> int:
        return self.store.count(self.table)

    @staticmethod
    def _plain(rows: DataFrame) -> DataFrame:
        return rows.drop(RID, SEQ)
