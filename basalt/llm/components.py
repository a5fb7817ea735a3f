"""Connected components of a table of edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A node with more than this share of all edges (and more than LEAST_HOT) is hot; so there are 2 / HOT_SHARE hot nodes at most.
HOT_SHARE, LEAST_HOT = 1 / 1000, 100
#: Edges of a partition: few edges are not dealt over many tasks and files in each round.
PART_EDGES = 50_000


def _joined(rows: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """`rows` (a, b) with `m` of their `a` in `least` (a, m, degree). Hot nodes are few and broadcast; the rest joins by shuffle."""
    tagged = rows.join(F.broadcast(least.where(F.col("degree") > hot).select("a", F.col("m").alias("hm"))), "a", "left")
    rest = tagged.where("hm IS NULL").join(least.where(F.col("degree") <= hot).select("a", "m"), "a")
    return rest.select("a", "b", "m").unionByName(tagged.where("hm IS NOT NULL").select("a", "b", F.col("hm").alias("m")))


def _large_star(edges: DataFrame, hot: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("a", "m"))
    return _joined(both.where("b > a"), least, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, hot: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    moved = _joined(down, least, hot).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`node, root` for every node of `edges` (a, b) but the roots; the root is the least node of its component.

    Least neighbours come from partial aggregates. Nulls and loops are no edges. Raises if `most_rounds` rounds do not
    suffice (they grow with the logarithm of the longest chain).
    """
    state = cut(edges.where("a <> b").select("a", "b").distinct())
    mark = parts = None
    while most_rounds:
        row = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not row["n"] or (row["n"], row["h"]) == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if parts is None:
            state = state.coalesce(parts := 1 + row["n"] // PART_EDGES)  # rounds never add edges
        mark, hot = (row["n"], row["h"]), max(LEAST_HOT, int(row["n"] * HOT_SHARE))
        state = cut(_small_star(cut(_large_star(state, hot).coalesce(parts)), hot).coalesce(parts))
        most_rounds -= 1
    raise RuntimeError("components did not settle")
