"""Exact dedup by a heavy-hitter split.

A Misra-Gries style frequent-items sketch over the text digests names candidates for frequent digests. An exact count
verifies them; the verified winners are few by construction, so they are broadcast and their copies are settled on
the map side, without a shuffle of the hot groups. All other digests, whose groups are small, are settled by one
ordinary shuffle. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, if_small


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with A-Z lower-cased; null counts as an empty text."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _keyed_and_winners(docs: DataFrame, id_col: str, text_col: str, winners: int, counters: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_sha256, row) of every row, and the verified winners: text_sha256, group_size, keep_id, keep_row, same (rows
    that repeat the kept id). `row` numbers the rows; it tells rows apart that are alike in id and text."""
    ident = F.col(id_col).alias("doc_id")
    keyed = cut(docs.select(ident, text_digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    candidates = keyed.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {counters})").alias("top")).select(
        F.explode("top.item").alias("text_sha256")
    )
    heavy = keyed.join(F.broadcast(candidates), "text_sha256", "left_semi")
    by_id = heavy.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("same"), F.max("row").alias("row"))
    # max over (is not null, id): a null id sorts below all others
    verified = cut(
        by_id.groupBy("text_sha256")
        .agg(
            F.sum("same").alias("group_size"),
            F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "same")).alias("best"),
        )
        .where("group_size > 1")
        .select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.same").alias("same"))
    )
    return keyed, verified


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", winners: int = 2000, counters: int = 20_000
) -> DataFrame:
    """One row per row of `docs`: `doc_id, keep_id, group_size, kept, text_sha256`.

    Rows with the same digest form a group; the row with the largest id stays. `winners` bounds what is broadcast
    (about 100 bytes each), `counters` bounds the sketch; neither changes the result, since a digest that the sketch
    misses takes the shuffle path.

    Nulls: a null text is an empty text; a null id loses to any other id and stays only where its group has no other.
    Repeated rows (same id, same text) count one by one in `group_size`; exactly one of them can be kept.
    Empty table: empty result. Columns other than the two named are not looked at.
    """
    keyed, verified = _keyed_and_winners(docs, id_col, text_col, winners, counters)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    map_side = keyed.join(F.broadcast(verified), "text_sha256").withColumn("kept", F.col("row") == F.col("keep_row")).select(out)
    group = Window.partitionBy("text_sha256")
    rest = (
        keyed.join(F.broadcast(verified.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("kept", F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1)
        .select(out)
    )
    return rest.unionByName(map_side)


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", winners: int = 2000, counters: int = 20_000
) -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with all their columns, under the same rules.

    Copies of winners go on the map side. Of the other groups, what is to go is listed by id and digest; texts meet that list
    by broadcast while it is small, else by a shuffle. Repeated rows (same id, same text) of a row that stays are folded.
    """
    key, keep, act, listed_key, listed_id = (f"__basalt_{x}" for x in ("digest", "keep", "act", "listed_key", "listed_id"))
    keyed, verified = _keyed_and_winners(docs, id_col, text_col, winners, counters)
    order = Window.partitionBy("text_sha256").orderBy(F.col("doc_id").desc_nulls_last())
    rest = keyed.join(F.broadcast(verified.select("text_sha256")), "text_sha256", "left_anti")
    placed = rest.withColumn("rank", F.row_number().over(order)).withColumn("first", F.first("doc_id").over(order)).where("rank > 1")
    act_of = F.when(F.col("doc_id").eqNullSafe(F.col("first")), "fold").otherwise("drop")
    listed = cut(placed.select(F.col("text_sha256").alias(listed_key), F.col("doc_id").alias(listed_id), act_of.alias(act)).distinct())
    repeats = listed.where(F.col(act) == "fold").limit(1).count() + verified.where("same > 1").limit(1).count()

    hot = verified.select(F.col("text_sha256").alias(key), F.struct("keep_id", "same").alias(keep))
    held = docs.withColumn(key, text_digest(F.col(text_col))).join(F.broadcast(hot), key, "left")
    held = held.join(if_small(listed), (F.col(key) == F.col(listed_key)) & F.col(id_col).eqNullSafe(F.col(listed_id)), "left")
    settled = (
        F.when(F.col(keep).isNull(), F.col(act))
        .when(~F.col(id_col).eqNullSafe(F.col(f"{keep}.keep_id")), "drop")
        .when(F.col(f"{keep}.same") > 1, "fold")
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = held.where(settled.isNull()).select(columns)
    return kept.unionByName(held.where(settled == "fold").dropDuplicates([key]).select(columns)) if repeats else kept


def op3_exact_dedup(spark, sf_dir):
    """Every document with the copy that stays for it."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
