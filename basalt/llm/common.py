"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.session import cut  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes table that lower-cases A-Z only; UTF-8 needs no more.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def utf8(text: object) -> bytes:
    """UTF-8 bytes of a cell; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def chunks(frames: Iterator[pd.DataFrame], text_col: str, max_chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Re-cuts Arrow batches so that a piece holds about `max_chars` characters (one row at least): memory stays bounded when texts are long."""
    for frame in frames:
        sizes = [len(t) if isinstance(t, str) else 0 for t in frame[text_col]]
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_chars:
                yield frame.iloc[start:i].reset_index(drop=True)
                start, total = i, 0
            total += n
        if start < len(frame):
            yield frame.iloc[start:].reset_index(drop=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows for each Arrow batch, as texts may be long; a session that has set its own number keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default; plans read the setting when they run, so it stays
        spark.conf.set(key, str(rows))


#: Rows that `if_small` broadcasts at most; its callers' rows are under 100 bytes.
MOST_BROADCAST = 500_000


def if_small(rows: DataFrame) -> DataFrame:
    """`rows`, which have been computed, marked for broadcast if there are `MOST_BROADCAST` at most; beyond that a join with it shuffles."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows
