"""CSV sources: uploads whose columns are all text, and typed loads."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions.codec import normalise_headers, strip_quotes
from basalt.session import cut

from . import files

BAD = "__basalt_bad"


@dataclass
class Upload:
    """An upload before it is stored: `rows` (accepted, all text), and what there is to report."""

    rows: DataFrame
    headers: list[str]
    preview: list[list[str]]
    accepted: int
    failed: int
    size: int


def _first_line(spark: SparkSession, path: str) -> str:
    line = spark.read.text(path).first()
    return (line[0] if line else "").lstrip("﻿")


def _odd_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a field may go on in the next line."""
    return bool(spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).limit(1).count())


def _blank_outside_quotes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts the blank lines that are not inside quotes, over lines in the order of the file."""
    open_, n = False, 0
    for frame in frames:
        for line in frame["value"]:
            n += not open_ and not line.strip()
            open_ ^= line.count('"') % 2 == 1
    yield pd.DataFrame({"n": [n]})


def _fields(line: Column) -> Column:
    """Fields of a record: commas outside quotes, and one. What quotes hold goes first, by a pattern that never goes back."""
    return F.regexp_count(F.regexp_replace(line, '"[^"]*+"', ""), F.lit(",")) + 1


def read_upload(spark: SparkSession, path: str, multi_line: bool | None = None, preview_rows: int = 10) -> Upload:
    """A CSV file with a header, commas, double quotes and UTF-8.

    Every value is trimmed and kept as text, an empty one as "". Rows with fewer fields than the header fail, longer ones
    are cut. Blank lines outside quotes count as failed. Header names are normalised, repeated ones numbered. Large files are
    split among tasks; where `multi_line` is set, or some line has an odd number of quotes, a field may hold line ends, and
    then each file is read by one task.
    """
    header = next(csv.reader(io.StringIO(_first_line(spark, path))), [])
    names = normalise_headers(header)
    if not names:
        return Upload(spark.createDataFrame([], T.StructType()), [], [], 0, 0, 0)
    whole = _odd_quotes(spark, path) if multi_line is None else multi_line
    raw = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*raw, BAD]])
    read = spark.read.schema(schema).option("header", True).option("escape", '"').option("columnNameOfCorruptRecord", BAD).option("enforceSchema", True)
    read = read.option("maxColumns", 200_000).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    rows = cut(read.option("multiLine", whole).csv(path))  # parsed once, for the rows and for the report
    # Spark marks rows of any other length; commas outside quotes tell the short ones
    short = F.col(BAD).isNotNull() & (_fields(F.col(BAD)) < len(names))
    taken = rows.where(~short).select(*(strip_quotes(F.coalesce(c, F.lit(""))).alias(n) for c, n in zip(raw, names, strict=True)))
    failed = rows.where(short).count()
    lines = spark.read.text(path)
    if whole:
        blank = lines.coalesce(1).mapInPandas(_blank_outside_quotes, "n long").agg(F.sum("n")).first()[0] or 0
    else:
        blank = lines.where(F.trim("value") == "").count()
    head = rows.where(~short).select(*raw).limit(preview_rows).collect()
    preview = [[v if v is not None else "" for v in r] for r in head]
    return Upload(taken, names, preview, taken.count(), failed + blank, files.size_of(spark, path))


#: The typed sales file: columns in order.
SALES = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("producto", T.StringType()), T.StructField("cantidad", T.IntegerType()),
    T.StructField("precio", T.FloatType()), T.StructField("fecha", T.StringType()),
])


def read_typed(spark: SparkSession, path: str, schema: T.StructType = SALES, separator: str = ";", first: int | None = None) -> DataFrame:
    """A CSV file, or a folder of them, with headers and typed columns; `first` rows by file name and place in the file, or all."""
    rows = spark.read.schema(schema).option("header", True).option("sep", separator).csv(path)
    if first is None:
        return rows
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())  # Spark reads large files first
    return rows.select("*", at.alias("__at")).orderBy("__at").limit(first).drop("__at")


def export(rows: DataFrame, path: str) -> None:
    """Writes rows as CSV files with a header, quoted as uploads are read."""
    rows.write.option("header", True).option("escape", '"').csv(path)
