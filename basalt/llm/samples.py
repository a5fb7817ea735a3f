"""Bounded samples of rows for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_bucket

#: Own columns of these samples.
HASH, RANK, ID, LABEL = "__basalt_hash", "__basalt_rank", "__basalt_id", "__basalt_label"


def _below(share: float | Column) -> Column:
    """Whether the hash of a row lies in the lowest `share` of all hashes."""
    return F.col(HASH).cast("double") <= F.lit(share) * float(2**64) - float(2**63)


def bounded(rows: DataFrame, most: int, by: Sequence[str], made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`most` rows of `rows` at most, chosen by the hash of the columns `by`, with that hash as `__basalt_hash`.

    Rows alike in `by` count once; reruns agree. A first cut by the hash leaves about twice as many rows as are wanted (by an
    estimate of how many differ), so that no task holds more; the exact bound comes after it. `by` names a text beside the id, so that rows with null
    or repeated ids are spread like any others. The exact bound brings the sample into one task: where that needs no texts, `made`
    turns the rows of the first cut into small ones, `__basalt_hash` kept, where they lie.
    """
    hashed = rows.withColumn(HASH, F.xxhash64(*by))
    share = min(1.0, 2 * most / max(1, hashed.agg(F.approx_count_distinct(HASH)).first()[0]))
    few = hashed.where(_below(share))
    return (made(few) if made else few).dropDuplicates([HASH]).orderBy(HASH).limit(most)


def bounded_by(rows: DataFrame, group: str, most: int, by: Sequence[str]) -> DataFrame:
    """Like `bounded`, `most` rows of each value of `group` at most."""
    hashed = rows.withColumn(HASH, F.xxhash64(*by))
    shares = hashed.groupBy(group).agg(F.least(F.lit(1.0), 2 * most / F.approx_count_distinct(HASH)).alias("__basalt_share"))  # one row for each value
    few = hashed.join(F.broadcast(shares), group).where(_below(F.col("__basalt_share")))
    few = few.drop("__basalt_share").dropDuplicates([group, HASH])
    return few.withColumn(RANK, F.row_number().over(Window.partitionBy(group).orderBy(HASH))).where(F.col(RANK) <= most).drop(RANK)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, most: int, value: int | None = None, held_mod: int = 5, held: int = 0, made: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(text, label, __basalt_hash) of `most` labelled documents at most whose crc32 of the id modulo `held_mod` is not `held`;
    with `value` only those with that label. Ids of any type; rows without id or label are none. Ids labelled twice take the higher label.
    `made` as in `bounded`; the columns are its own then."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), held_mod) != held))
    usable = usable.groupBy(F.col("doc_id").alias(ID)).agg(F.max(label_col).cast("int").alias(LABEL))
    chosen = bounded(usable if value is None else usable.where(F.col(LABEL) == value), most, [ID]).drop(HASH)
    texts = docs.select(F.col("doc_id").alias("__basalt_doc"), F.col("text").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("__basalt_doc") == F.col(ID))  # `most` rows at most are broadcast
    found = found.select("text", F.col(LABEL).alias("label"), F.xxhash64(ID, "text").alias(HASH))
    return (made(found) if made else found).dropDuplicates([HASH]).orderBy(HASH).limit(most)
