"""Files of fixed-width records: one record after another in native byte order, a record of NUL bytes being deleted.

Reading splits the file at record borders, and numpy decodes records in blocks. Spark's reader of such files also tells each
record's place, so that numbering them needs no pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basalt.functions.codec import ColumnType

from . import files


#: The sales record: 52 bytes, texts in latin-1 padded with NULs.
SALES = (
    ("id", ColumnType("INT")), ("producto", ColumnType("VARCHAR", 20)), ("cantidad", ColumnType("INT")),
    ("precio", ColumnType("FLOAT")), ("fecha", ColumnType("VARCHAR", 20)),
)


def layout(columns: Sequence[tuple[str, ColumnType]]) -> np.dtype:
    """The record as a numpy type, aligned as C would align it, without padding at its end."""
    at, names, formats, offsets = 0, [], [], []
    for name, kind in columns:
        form = {"INT": "i4", "FLOAT": "f4", "DATE": "S10"}.get(kind.name) or (("f4", 2) if kind.name == "ARRAY" else f"S{kind.length}")
        step = 1 if kind.name in ("VARCHAR", "DATE") else 4
        at = -(-at // step) * step
        names.append(name)
        formats.append(form)
        offsets.append(at)
        at += np.dtype(form).itemsize
    return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": max(at, 1)})


def decode(records: bytes, columns: Sequence[tuple[str, ColumnType]], encoding: str = "utf-8") -> pd.DataFrame:
    """Records as rows, deleted ones too. Blanks and NULs at the ends of texts go."""
    table = np.frombuffer(records, layout(columns))
    out = {}
    for name, kind in columns:
        values = table[name]
        if kind.name in ("VARCHAR", "DATE"):
            out[name] = [v.decode(encoding, "replace").strip(" \0\t\n\r") for v in values]
        else:
            out[name] = list(values) if kind.name == "ARRAY" else values
    return pd.DataFrame(out)


def encode(rows: pd.DataFrame, columns: Sequence[tuple[str, ColumnType]], encoding: str = "utf-8", padding: bytes = b" ") -> bytes:
    """Rows whose values fit their types as records; texts are cut to their width and padded (blanks, or NULs as sales records have)."""
    table = np.zeros(len(rows), layout(columns))
    for name, kind in columns:
        if kind.name in ("VARCHAR", "DATE"):
            size = 10 if kind.name == "DATE" else kind.length
            table[name] = [str(v).encode(encoding, "replace")[:size].ljust(size, padding) for v in rows[name]]
        else:
            table[name] = np.array(rows[name].tolist(), "f4").reshape(-1, 2) if kind.name == "ARRAY" else rows[name].to_numpy()
    return table.tobytes()


#: Records that are decoded at once.
BLOCK = 4096


def read_fixed(spark: SparkSession, path: str, columns: Sequence[tuple[str, ColumnType]], encoding: str = "utf-8") -> DataFrame:
    """Live records of a file, with `_rid`: the record's place among all that the file holds."""
    width = layout(columns).itemsize
    schema = T.StructType([*(T.StructField(n, k.spark) for n, k in columns), T.StructField("_rid", T.LongType())])
    dead = bytes(width)

    def rows(records: Iterator[tuple[int, bytearray]]) -> Iterator[tuple]:
        for block in batched(records, BLOCK):
            live = [(place, bytes(data)) for place, data in block if data != dead]
            table = decode(b"".join(data for _, data in live), columns, encoding)
            values = [[v.tolist() for v in table[n]] if k.name == "ARRAY" else table[n].tolist() for n, k in columns]
            yield from zip(*values, [place for place, _ in live], strict=True)

    form = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    conf = {f"{form}.recordLength": str(width)}
    records = spark.sparkContext.newAPIHadoopFile(path, form, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    return spark.createDataFrame(records.mapPartitions(rows), schema)


def write_fixed(rows: DataFrame, path: str, columns: Sequence[tuple[str, ColumnType]], encoding: str = "utf-8", padding: bytes = b" ") -> None:
    """Writes rows, whose values fit their types, as one file of records in their order. Tasks encode them; their bytes pass the
    driver partition by partition, as a single file has a single writer."""
    names = [n for n, _ in columns]

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"data": [encode(frame, columns, encoding, padding)]})

    made = rows.select(*names).mapInPandas(blocks, "data binary")
    files.write_stream(rows.sparkSession, path, (bytes(r["data"]) for r in made.toLocalIterator()))
