"""A table's appended parts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basalt.operators.store import Store


def stream_appends(store: Store, table: str) -> DataFrame:
    """A streaming DataFrame of the rows that inserts add to a table, `_rid` and `_seq` with them; updates, deletes and compactions
    do not show. A failed insert's files keep a hidden name and do not show either."""
    m = store.manifest(table)
    return store.spark.readStream.schema(m.stored).parquet(f"{store.folder(table)}/insert-*")
