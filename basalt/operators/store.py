"""Tables in versions: parquet parts, delete lists, and small numbered manifests.

`<root>/<table>/_versions/0000000001.json`, and so on, list the parts in force; the highest number holds. A change writes its
files, then creates the next manifest under a name that only one writer can get: a crash or a failed job leaves files that no
manifest names, and a writer that comes second is told so and changes nothing. Within a process, changes of a table wait for
each other. An insert adds a part, a delete adds a list of row ids, an update adds both; nothing in force is ever rewritten,
so readers of an older manifest are not disturbed. `compact` folds everything into one part, `vacuum` clears away the rest.

Each row has `_rid`, which grows in the order of insertion, and `_seq`, the number of the change that wrote it. A row is
deleted by a list entry of the same `_rid` and a later `_seq`. Parts of inserts are folders `insert-*`, others `part-*`;
a folder has a hidden name until it is written whole.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions.codec import ColumnType, parse_type
from basalt.plans.lexer import SqlError
from basalt.sources import files

RID, SEQ, VERSIONS = "_rid", "_seq", "_versions"
#: Entries of delete lists that are broadcast at most (16 bytes each); lists that are folded into one when there are more.
MOST_BROADCAST, MOST_LISTS = 1_000_000, 16
_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)


@dataclass
class Manifest:
    columns: list[list[str]]  # name, type
    seq: int = 0
    next_rid: int = 0
    parts: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)  # column -> kind, path, seq, options
    gone: int = 0  # entries of the delete lists
    rows: int = 0  # live rows
    notes: dict = field(default_factory=dict)  # what others keep with the table
    version: int = 0

    @property
    def types(self) -> list[tuple[str, ColumnType]]:
        return [(n, parse_type(t)) for n, t in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, k.spark) for n, k in self.types])

    @property
    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(RID, T.LongType()), T.StructField(SEQ, T.LongType())])


def changes(method: Callable) -> Callable:
    """A method (self, table, ...) that changes a table: one at a time in this process."""

    @wraps(method)
    def alone(self, table: str, *args, **kwargs):
        with self.lock(table):
            return method(self, table, *args, **kwargs)

    return alone


class Store:
    """The tables below a folder. Names are case-insensitive."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- catalog

    def folder(self, table: str) -> str:
        return f"{self.root}/{table.lower()}"

    @contextmanager
    def lock(self, table: str):
        with _LOCKS[self.folder(table)]:
            yield

    def versions(self, table: str) -> list[str]:
        return [v for v in files.children(self.spark, f"{self.folder(table)}/{VERSIONS}") if v.endswith(".json")]

    def tables(self) -> list[str]:
        return [t for t in files.children(self.spark, self.root) if self.has(t)]

    def has(self, table: str) -> bool:
        return bool(self.versions(table))

    def manifest(self, table: str) -> Manifest:
        found = self.versions(table)
        if not found:
            raise SqlError(f"no such table: {table}")
        return Manifest(**json.loads(files.read_text(self.spark, f"{self.folder(table)}/{VERSIONS}/{found[-1]}")))

    def save(self, table: str, manifest: Manifest) -> None:
        """Makes `manifest` the one in force, if none came after the one it was made from."""
        manifest.version += 1
        path = f"{self.folder(table)}/{VERSIONS}/{manifest.version:010}.json"
        if not files.create_text(self.spark, path, json.dumps(asdict(manifest), indent=1)):
            raise SqlError(f"table {table} was changed by another writer")

    def create(self, table: str, columns: list[tuple[str, ColumnType]]) -> Manifest:
        with self.lock(table):
            if self.has(table):
                raise SqlError(f"table exists: {table}")
            manifest = Manifest([[n.lower(), str(k)] for n, k in columns])
            self.save(table, manifest)
            return manifest

    def drop(self, table: str) -> None:
        files.remove(self.spark, self.folder(table))

    def new_path(self, table: str, what: str) -> str:
        return f"{self.folder(table)}/{what}-{uuid.uuid4().hex[:12]}"

    def write(self, rows: DataFrame, path: str) -> None:
        """Writes a folder that has its name once it is whole."""
        folder, name = path.rsplit("/", 1)
        rows.write.parquet(f"{folder}/_new-{name}")
        files.rename(self.spark, f"{folder}/_new-{name}", path)

    # -- reading

    def stored(self, table: str, manifest: Manifest | None = None, after: int | None = None) -> DataFrame:
        """Live rows with `_rid` and `_seq`; those of changes later than `after` only, if given."""
        m = manifest or self.manifest(table)
        if not m.parts:
            return self.spark.createDataFrame([], m.stored)
        rows = self.spark.read.schema(m.stored).parquet(*m.parts)
        return self.live(rows if after is None else rows.where(F.col(SEQ) > after), m)

    def live(self, rows: DataFrame, manifest: Manifest) -> DataFrame:
        """`rows` without those that the delete lists name."""
        if not manifest.deletes:
            return rows
        gone = self.spark.read.schema("_rid long, _seq long").parquet(*manifest.deletes)
        gone = gone.select(F.col(RID).alias("gone_rid"), F.col(SEQ).alias("gone_seq"))
        gone = F.broadcast(gone) if manifest.gone <= MOST_BROADCAST else gone
        return rows.join(gone, (rows[RID] == gone["gone_rid"]) & (rows[SEQ] < gone["gone_seq"]), "left_anti")

    def rows(self, table: str) -> DataFrame:
        """The live rows, columns of the table only."""
        m = self.manifest(table)
        return self.stored(table, m).select(*m.schema.names)

    def count(self, table: str) -> int:
        return self.stored(table).count()

    # -- changes

    @changes
    def append(self, table: str, rows: DataFrame) -> int:
        """Adds rows in their order; columns go by place. Returns how many.

        Row ids are the base plus Spark's partition-wise increasing ids: unique and in order, with gaps, and no second
        pass over the data.
        """
        m = self.manifest(table)
        path, names = self.new_path(table, "insert"), m.schema.names
        typed = [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, m.schema.fields, strict=True)]
        numbered = rows.select(*typed, (F.monotonically_increasing_id() + m.next_rid).alias(RID), F.lit(m.seq + 1).cast("long").alias(SEQ))
        self.write(numbered.select(*names, RID, SEQ), path)
        written = self.spark.read.parquet(path).agg(F.count("*").alias("n"), F.max(RID).alias("top")).first()
        if written["n"]:
            m.parts.append(path)
            m.seq, m.next_rid, m.rows = m.seq + 1, written["top"] + 1, m.rows + written["n"]
            self._save_or_clear(table, m, path)
        return written["n"]

    def _save_or_clear(self, table: str, manifest: Manifest, *paths: str) -> None:
        try:
            self.save(table, manifest)
        except SqlError:
            for path in paths:
                files.remove(self.spark, path)
            raise

    @changes
    def delete(self, table: str, condition: Column) -> int:
        """Deletes live rows for which `condition` is true; all or none of them. Returns how many."""
        m = self.manifest(table)
        path = self.new_path(table, "gone")
        hit = self.stored(table, m).where(F.coalesce(condition, F.lit(False)))
        self.write(hit.select(RID, F.lit(m.seq + 1).cast("long").alias(SEQ)), path)
        n = self.spark.read.parquet(path).count()
        if n:
            m.deletes.append(path)
            m.seq, m.gone, m.rows = m.seq + 1, m.gone + n, m.rows - n
            if len(m.deletes) > MOST_LISTS:
                folded = self.new_path(table, "gone")
                self.write(self.spark.read.parquet(*m.deletes).coalesce(1 + m.gone // MOST_BROADCAST), folded)
                m.deletes = [folded]
            self._save_or_clear(table, m, path)
        return n

    @changes
    def update(self, table: str, rid: int, values: dict[str, Column]) -> int:
        """Sets columns of the row `rid`, which keeps its place in the order."""
        m = self.manifest(table)
        old = self.stored(table, m).where(F.col(RID) == rid)
        new = old.withColumns({c: v.cast(m.schema[c].dataType) for c, v in values.items()}).withColumn(SEQ, F.lit(m.seq + 1).cast("long"))
        part, gone = self.new_path(table, "part"), self.new_path(table, "gone")
        self.write(new.select(*m.schema.names, RID, SEQ), part)
        n = self.spark.read.parquet(part).count()
        if n:
            self.write(old.select(RID, F.lit(m.seq + 1).cast("long").alias(SEQ)), gone)
            m.parts.append(part)
            m.deletes.append(gone)
            m.seq, m.gone = m.seq + 1, m.gone + n
            self._save_or_clear(table, m, part, gone)
        return n

    def fetch(self, table: str, rid: int) -> DataFrame:
        """The live row at an address; the filter reaches the parquet scan."""
        m = self.manifest(table)
        return self.stored(table, m).where(F.col(RID) == rid).select(*m.schema.names)

    @changes
    def truncate(self, table: str) -> None:
        """Takes all rows out; declared indexes stay, empty."""
        m = self.manifest(table)
        m.parts, m.deletes, m.gone, m.rows, m.seq = [], [], 0, 0, m.seq + 1
        self._empty_indexes(m)
        self.save(table, m)

    @changes
    def compact(self, table: str, key: str | None = None, notes: dict | None = None) -> None:
        """Folds all parts and delete lists into one part, sorted by `key` if given. Old files stay until `vacuum`. Indexes stay
        declared, but empty: the engine fills them when they are next used or rows come."""
        m = self.manifest(table)
        path = self.new_path(table, "part")
        rows = self.stored(table, m).withColumn(SEQ, F.lit(m.seq + 1).cast("long"))
        self.write(rows.repartitionByRange(key).sortWithinPartitions(key) if key else rows, path)
        m.parts, m.deletes, m.gone, m.seq = [path], [], 0, m.seq + 1
        self._empty_indexes(m)
        m.notes |= notes or {}
        self._save_or_clear(table, m, path)

    @staticmethod
    def _empty_indexes(manifest: Manifest) -> None:
        for entry in manifest.indexes.values():
            entry |= {"empty": True, "path": "", "seq": manifest.seq}

    @changes
    def note(self, table: str, **values) -> None:
        """Keeps small values with the table."""
        m = self.manifest(table)
        m.notes |= values
        self.save(table, m)

    @changes
    def vacuum(self, table: str) -> list[str]:
        """Removes files that the manifest in force does not name, and older manifests. No other writer may be at work."""
        m = self.manifest(table)
        named = {p.rsplit("/", 1)[1] for p in [*m.parts, *m.deletes, *(i["path"] for i in m.indexes.values() if i["path"])]}
        out = [c for c in files.children(self.spark, self.folder(table)) if c != VERSIONS and c not in named]
        out += [f"{VERSIONS}/{v}" for v in self.versions(table)[:-1]]
        for c in out:
            files.remove(self.spark, f"{self.folder(table)}/{c}")
        return out
