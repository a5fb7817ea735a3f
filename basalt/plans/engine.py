"""Statements to DataFrames: the front door of the table engine."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions.codec import ColumnType, encode
from basalt.operators import indexes
from basalt.operators.store import RID, SEQ, Manifest, Store
from basalt.sources import csv as csv_source

from . import ast
from .expr import Compiler
from .lexer import SqlError
from .parser import parse

#: Hash buckets of an index.
BUCKETS = 64
#: An index is written anew once this share of its rows, and this many at least, have come since.
STALE_SHARE, STALE_ROWS = 0.2, 1000


@dataclass
class Result:
    """What a statement gave: rows of a SELECT, or a message and a count."""

    rows: DataFrame | None = None
    message: str = ""
    count: int = 0


class Engine:
    """Runs statements over the tables below `root`.

    `strict_order`: WHERE evaluates AND and OR left to right, an error on the way drops the row (costs pushdown).
    """

    def __init__(self, spark: SparkSession, root: str, strict_order: bool = False):
        self.spark, self.store, self.strict_order = spark, Store(spark, root), strict_order

    # -- statements

    def execute(self, text: str) -> Result:
        statement = parse(text)
        return getattr(self, "_" + type(statement).__name__.lower())(statement)

    def sql(self, text: str) -> DataFrame:
        """The rows of a SELECT."""
        result = self.execute(text)
        if result.rows is None:
            raise SqlError("the statement has no rows")
        return result.rows

    def answer(self, text: str) -> dict:
        """The statement's result as plain data: `{"ok": True, "result": ...}`, or `{"ok": False, "error": ...}`. A SELECT's rows are all held; see `answer_pieces`."""
        return json.loads("".join(self.answer_pieces(text)))

    def answer_pieces(self, text: str) -> Iterator[str]:
        """The JSON text of `answer` in pieces, all rows of a SELECT one by one: the driver holds one partition at a time.

        `ok` comes last: where a later row fails, the rows before it are followed by `"ok": false` and the error.
        """
        opened = False
        try:
            result = self.execute(text)
            if result.rows is None:
                yield json.dumps({"ok": True, "result": {"success": True, "message": result.message, "count": result.count}})
                return
            names = result.rows.columns
            for line in result.rows.toJSON().toLocalIterator():
                row = json.loads(line)
                yield (", " if opened else '{"result": [') + json.dumps({n: row.get(n) for n in names})
                opened = True
            yield ("" if opened else '{"result": [') + '], "ok": true}'
        except Exception as problem:
            error = json.dumps({"ok": False, "error": str(problem).splitlines()[0] if str(problem) else type(problem).__name__})
            yield "], " + error[1:] if opened else error

    def _createtable(self, s: ast.CreateTable) -> Result:
        self.store.create(s.table, [(c.name, c.type) for c in s.columns])
        for c in s.columns:
            if c.index:
                self.create_index(s.table, c.index, c.name)
        return Result(message=f"table {s.table} created with {len(s.columns)} columns", count=len(s.columns))

    def _createindex(self, s: ast.CreateIndex) -> Result:
        self.create_index(s.table, s.kind, s.column)
        return Result(message=f"{s.kind} index on {s.table}({s.column}) created")

    def _insert(self, s: ast.Insert) -> Result:
        """By place; what is missing at the end becomes the type's default, what is too much is dropped."""
        m = self.store.manifest(s.table)
        texts = []
        for row in s.rows:
            row = [*row, *[None] * len(m.columns)][: len(m.columns)]
            texts.append(tuple(None if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in row))
        names = m.schema.names
        raw = self.spark.createDataFrame(texts, T.StructType([T.StructField(n, T.StringType()) for n in names]))
        n = self.append(s.table, self.typed(raw.coalesce(1), m.types))
        return Result(message=f"{n} rows inserted into {s.table}", count=n)

    def append(self, table: str, rows: DataFrame) -> int:
        """Adds rows by place, and brings the table's indexes up to date where they are empty or much has come since."""
        n = self.store.append(table, rows)
        if n:
            self.refresh(table)
        return n

    def refresh(self, table: str, every: bool = False) -> None:
        """Writes indexes anew that are empty or stale, or all of them."""
        m = self.store.manifest(table)
        for column, entry in m.indexes.items():
            come = m.rows - entry.get("rows", 0)
            if every or (m.rows and (entry["empty"] or come > max(STALE_ROWS, STALE_SHARE * m.rows))):
                self.create_index(table, entry["kind"], column, entry["step"])

    def compact(self, table: str, key: str | None = None) -> None:
        """Folds the table into one part and its indexes with it."""
        self.store.compact(table, key)
        self.refresh(table, every=True)

    def typed(self, raw: DataFrame, columns: list[tuple[str, ColumnType]]) -> DataFrame:
        """Text columns as typed ones. A number beyond 32 bits is an error."""
        out = []
        for name, kind in columns:
            value = F.coalesce(F.col(f"`{name}`"), F.lit(""))
            made = encode(value, kind)
            if kind.name == "INT":
                made = F.coalesce(made, F.raise_error(F.concat(F.lit(f"{name}: out of range: "), value)).cast("int"))
            out.append(made.alias(name))
        return raw.select(*out)

    def _delete(self, s: ast.Delete) -> Result:
        compiler = Compiler(self.store.manifest(s.table).schema, self.strict_order)
        n = self.store.delete(s.table, compiler.condition(s.where))
        return Result(message=f"{n} rows deleted from {s.table}", count=n)

    def _select(self, s: ast.Select) -> Result:
        m = self.store.manifest(s.table)
        rows = self._scan(s, m)
        return Result(rows=select_rows(s, rows, m.schema, self.strict_order, RID))

    # -- indexes

    def create_index(self, table: str, kind: str, column: str, step: float = 1.0) -> None:
        """Writes the live rows once more, arranged for `kind`; what changes later is read beside the copy, see `_scan`, until the
        index is refreshed. Without rows the index is only declared."""
        with self.store.lock(table):
            m = self.store.manifest(table)
            if column not in m.schema.names:
                raise SqlError(f"unknown column: {column}")
            if kind == "rtree" and not isinstance(m.schema[column].dataType, T.ArrayType):
                raise SqlError("an rtree index needs a column of points")
            path = self.store.new_path(table, "index") if m.parts else ""
            if path:
                rows = self.store.stored(table, m)
                if kind == "hash":
                    indexes.write_hashed(rows, column, path, BUCKETS)
                elif kind == "rtree":
                    indexes.write_gridded(rows, column, path, step)
                else:
                    indexes.write_sorted(rows, column, path)
            m.indexes[column] = {"kind": kind, "path": path, "seq": m.seq, "step": step, "empty": not path, "rows": m.rows}
            self.store.save(table, m)

    def _scan(self, s: ast.Select, m: Manifest) -> DataFrame:
        """The base table, or an index that helps: its copy, plus what changed since, minus what was deleted since. An index that
        the statement names and that is still empty is written first."""
        if s.using is not None and m.rows and any(e["empty"] and e["kind"] == s.using for e in m.indexes.values()):
            self.refresh(s.table)
            m = self.store.manifest(s.table)
        for column, value in _equalities(s.where):
            entry = m.indexes.get(column)
            if column in m.schema.names and isinstance(m.schema[column].dataType, T.StringType) != isinstance(value, str):
                continue
            if entry and not entry["empty"] and (s.using is None or s.using == entry["kind"]):
                if entry["kind"] == "rtree":
                    continue
                if entry["kind"] == "hash":
                    stored = T.StructType([*m.stored.fields, T.StructField(indexes.BUCKET, T.IntegerType())])
                    copy = indexes.read_hashed(self.spark, entry["path"], column, value, BUCKETS, stored)
                else:
                    copy = self.spark.read.schema(m.stored).parquet(entry["path"])
                return self._with_changes(s.table, copy, m, entry)
        for column in _compared(s.where):
            entry = m.indexes.get(column)
            if entry and not entry["empty"] and entry["kind"] in ("sequential", "isam", "btree") and (s.using is None or s.using == entry["kind"]):
                return self._with_changes(s.table, self.spark.read.schema(m.stored).parquet(entry["path"]), m, entry)
        return self.store.stored(s.table, m)

    def _with_changes(self, table: str, copy: DataFrame, m: Manifest, entry: dict) -> DataFrame:
        if m.seq == entry["seq"]:
            return copy
        return self.store.live(copy, m).unionByName(self.store.stored(table, m, after=entry["seq"]))

    def near(self, table: str, column: str, rectangle: tuple[float, float, float, float]) -> DataFrame:
        """Rows whose point lies in (low x, high x, low y, high y); an rtree index is used if it is there."""
        m = self.store.manifest(table)
        x0, x1, y0, y1 = rectangle
        inside = F.col(column)[0].between(x0, x1) & F.col(column)[1].between(y0, y1)
        entry = m.indexes.get(column)
        if not entry or entry["empty"] or entry["kind"] != "rtree":
            return self.store.stored(table, m).where(inside).select(*m.schema.names)
        step = entry["step"]
        cells = T.StructType([*m.stored.fields, T.StructField("_cx", T.IntegerType()), T.StructField("_cy", T.IntegerType())])
        copy = self.spark.read.schema(cells).parquet(entry["path"])
        copy = copy.where(F.col("_cx").between(int(x0 // step), int(x1 // step)) & F.col("_cy").between(int(y0 // step), int(y1 // step)))
        return self._with_changes(table, copy.drop("_cx", "_cy"), m, entry).where(inside).select(*m.schema.names)

    # -- uploads

    def upload(self, path: str, table: str = "uploaded_table", multi_line: bool | None = None, file_name: str | None = None) -> dict:
        """Stores a CSV file as a table of text columns; see `read_upload`. Returns the report. `recordCount` counts what was read,
        failed records too."""
        if self.store.has(table):
            raise SqlError(f"table exists: {table}")
        up = csv_source.read_upload(self.spark, path, multi_line)
        kind = ColumnType("VARCHAR", 100)
        self.store.create(table, [(h, kind) for h in up.headers])
        inserted = self.append(table, self.typed(up.rows, [(h, kind) for h in up.headers])) if up.headers else 0
        return {
            "ok": True, "fileName": file_name or path.rsplit("/", 1)[-1], "tableName": table.lower(), "fileSize": up.size, "recordCount": inserted + up.failed,
            "inserted": inserted, "failed": up.failed, "headers": up.headers, "rows": up.preview,
            "message": f"table {table.lower()} created with {inserted} rows",
        }


def select_rows(s: ast.Select, rows: DataFrame, schema: T.StructType, strict_order: bool = False, order: str | None = None) -> DataFrame:
    """A SELECT over `rows`, whose columns for the statement are those of `schema`; `order` names the column of insertion order, for LIMIT."""
    compiler = Compiler(schema, strict_order)
    if s.where is not None:
        rows = rows.where(compiler.condition(s.where))
    if s.group_by or any(i.count for i in s.items):
        out = _grouped(s, rows)
    else:
        out = rows
        if s.order_by:
            out = out.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in s.order_by))
        elif s.limit is not None and order:
            out = out.orderBy(order)
        out = out.select(*_items(s, schema, compiler))
    return out if s.limit is None else out.limit(s.limit)


def query(rows: DataFrame, text: str, strict_order: bool = False) -> DataFrame:
    """A SELECT statement over any DataFrame; its table name is not looked up."""
    statement = parse(text)
    if not isinstance(statement, ast.Select):
        raise SqlError("only SELECT runs over a DataFrame")
    return select_rows(statement, rows, rows.schema, strict_order)


def _items(s: ast.Select, schema: T.StructType, compiler: Compiler) -> list:
    """Columns of the select list; repeated names collapse, unknown plain names are null columns."""
    if not s.items:
        return [F.col(f"`{n}`") for n in schema.names]
    known, out = {n.lower(): n for n in schema.names}, {}
    for k, item in enumerate(s.items):
        if isinstance(item.value, ast.Name):
            name = item.alias or item.value.name
            column = F.col(f"`{known[item.value.name]}`") if item.value.name in known else F.lit(None).cast("string")
        else:
            name, column = item.alias or f"c{k}", compiler.typed(item.value).column
        out.setdefault(name, column.alias(name))
    return list(out.values())


def _grouped(s: ast.Select, rows: DataFrame) -> DataFrame:
    counts = [i.alias or "count" for i in s.items if i.count]
    plain = [i for i in s.items if not i.count]
    if not all(isinstance(i.value, ast.Name) and i.value.name in s.group_by for i in plain):
        raise SqlError("a selected column is neither counted nor grouped by")
    out = rows.groupBy(*s.group_by).agg(F.count("*").alias(counts[0] if counts else "count"))
    out = out.select(*(F.col(i.value.name).alias(i.alias or i.value.name) for i in plain), *(F.col(counts[0]).alias(c) for c in counts))
    return out.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in s.order_by)) if s.order_by else out


def _and_parts(node) -> list:
    return [*_and_parts(node.left), *_and_parts(node.right)] if isinstance(node, ast.Logical) and node.word == "AND" else [node]


def _equalities(where) -> list[tuple[str, object]]:
    """(column, literal) of each `column = literal` that must hold."""
    out = []
    for part in _and_parts(where):
        if isinstance(part, ast.Chain) and len(part.rest) == 1 and part.rest[0][0] == "=":
            a, b = part.first, part.rest[0][1]
            for x, y in ((a, b), (b, a)):
                if isinstance(x, ast.Name) and isinstance(y, ast.Literal):
                    out.append((x.name, y.value))
    return out


def _compared(where) -> list[str]:
    """Columns that some part of the condition which must hold compares with a literal."""
    out = []
    for part in _and_parts(where):
        if isinstance(part, ast.Chain):
            operands = [part.first, *(o for _, o in part.rest)]
            if any(isinstance(o, ast.Literal) for o in operands):
                out += [o.name for o in operands if isinstance(o, ast.Name)]
        if isinstance(part, ast.Among) and isinstance(part.value, ast.Name) and not part.negated:
            out.append(part.value.name)
    return out
