"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a budget of words. Whole passes over the source (epochs) are spent first; what is left of the budget
takes documents in the order of exponential keys -ln(u)/quality, the smallest first, until the words are used up, so
that a document's chance grows with its quality weight.

A source may hold a third of all rows, so it is never sorted as a whole: keys fall into a histogram for each source,
whose prefix sums tell the one bin in which the budget ends. While that bin holds more than `BIN_DOCS` documents it gets a
histogram of its own, from its least key to its greatest, or from its first row to its last where all its keys are alike;
only the documents of the last bin are sorted. So no spread of the keys, and no tie, makes a large sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST_BROADCAST, cut

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
MARKS, UNMARKED = r"[#$%&*|!@=<>]+", r"[^#$%&*|!@=<>]+"
#: Documents of a source that are sorted at most, bins of a histogram, and the share of all documents that makes a source hot.
BIN_DOCS, BINS, HOT_SHARE = 2000, 1024, 1 / 1000


def n_words(text: Column) -> Column:
    """How many runs `WORD` a text has. Nothing is made that outgrows the text: `regexp_count` would make an array of all words,
    several times as large, which ends an executor where a text has some 100 MB."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), GAP, ""))


def n_marks(text: Column) -> Column:
    """How many runs `MARKS` a text has, likewise."""
    return F.length(F.replace(F.regexp_replace(F.regexp_replace(text, UNMARKED, " "), MARKS, "x"), F.lit(" "), F.lit("")))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """`sources` (source, source_size) with `target`: the words each source shall give.

    Sources in code point order, null last, weigh `weights` again and again, and share the sum of all sizes. A target
    stops at `most_epochs` times its source's size; the excess is shared anew by weight until none is above. Sorted by
    cap over weight, the sources that stop are a prefix, so running sums find the final level in one pass.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sources.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most_epochs)
    t = (
        t.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("stops", wide("cap") * wide("left_w") <= wide("left_words") * wide("w"))
    )
    stopped = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(0)).over(everything)
    t = t.withColumn("words", F.sum("source_size").over(everything) - stopped("cap")).withColumn(
        "weight_sum", F.sum("w").over(everything) - stopped("w")
    )
    shared = F.col("words").cast("double") * F.col("w").cast("double") / F.col("weight_sum").cast("double")
    return t.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(shared)).select(
        "source", "source_size", "target"
    )


def _meet(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """Documents beside their source's row of `state`. That table is broadcast up to `MOST_BROADCAST` sources; beyond that only
    hot sources are, which are few by their share, and the rest meets by a shuffle."""
    same = F.col("source").eqNullSafe(F.col("s"))
    if state.count() <= MOST_BROADCAST:
        return keyed.join(F.broadcast(state), same)
    bound = state.agg(F.sum("all_docs")).first()[0] * HOT_SHARE
    tagged = keyed.join(F.broadcast(state.where(F.col("all_docs") > bound)), same, "left")
    cold = tagged.where("all_docs IS NULL").select(keyed.columns).join(state.where(F.col("all_docs") <= bound), same)
    return tagged.where("all_docs IS NOT NULL").unionByName(cold)


#: Whether a document lies in the bin where its source's budget ends.
_INSIDE = "key BETWEEN k0 AND k1 AND (k0 < k1 OR row BETWEEN r0 AND r1)"


def _narrowed(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """`state` with the bin (keys k0 to k1; of equal keys rows r0 to r1) in which the budget ends narrowed until it is small."""
    wide = f"rest > 0 AND docs > {BIN_DOCS} AND (k0 < k1 OR r0 < r1)"
    while state.where(wide).limit(1).count():  # each round splits a bin: its ends never share one
        part = F.when(F.col("k0") < F.col("k1"), (F.col("key") - F.col("k0")) / (F.col("k1") - F.col("k0")))
        part = part.otherwise((F.col("row") - F.col("r0")) / (F.col("r1") - F.col("r0")))
        bin_ = F.least(F.floor(part * BINS), F.lit(BINS - 1))
        # hot sources are summed on the map side first
        hist = _meet(keyed, state.where(wide)).where(_INSIDE).groupBy("s", "rest", "ahead", bin_.alias("bin")).agg(
            F.sum("size").alias("words"), F.count("*").alias("docs"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("row").alias("r0"), F.max("row").alias("r1")
        )
        upto = Window.partitionBy("s").orderBy("bin")
        ends = hist.withColumn("ahead", F.col("ahead") + F.sum("words").over(upto) - F.col("words")).where("ahead < rest AND ahead + words >= rest")
        ends = ends.select(F.col("s").alias("s2"), *(F.col(c).alias(f"n_{c}") for c in ("ahead", "docs", "k0", "k1", "r0", "r1")))
        new = state.where(wide).join(ends, F.col("s").eqNullSafe(F.col("s2"))).withColumns({c: F.col(f"n_{c}") for c in ("ahead", "docs", "k0", "k1", "r0", "r1")})
        state = cut(new.select(state.columns).unionByName(state.where(f"NOT ({wide})")))
    return state


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality_col: str | None = None,
    weights: tuple[int, ...] = (1, 2, 3),
    most_epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: `doc_id, size, source_size, target, taken`, and `source, quality`.

    `quality_col` names a positive quality weight; without it, or where it is null, a text weighs
    1 / (1 + marks per word), marks being runs of characters such as # $ % |. The document at which a source's budget
    ends gives just the words that are left, so a source's taken words are its target, rounded.

    Nulls: a null text has size 0 and takes 0; a null source is a source of its own, the last; a null id counts as an
    empty id. Keys tie only between rows alike in id and text, which are interchangeable, be they ever so many.
    Empty texts and empty tables: size 0, empty result. Other columns of `docs` are not looked at. Reruns agree: keys
    come from the md5 of the id, the md5 of the text and `seed`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.md5(text.cast("binary")).alias("of_text"),
        n_words(text).cast("long").alias("size"),
        (F.lit(1.0) / (1.0 + n_marks(text) / F.greatest(F.lit(1), n_words(text)))).alias("by_text"),
        (F.col(quality_col).cast("double") if quality_col else F.lit(None).cast("double")).alias("given"),
    )
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "of_text", F.lit(seed))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(2**52 + 1)
    keyed = cut(
        base.withColumn("quality", F.coalesce(F.when(F.col("given") > 0, F.col("given")), F.col("by_text")))
        .withColumn("key", -F.log(u) / F.col("quality"))
        .select("doc_id", "source", "size", "quality", "key", F.monotonically_increasing_id().alias("row"))
    )
    # hot sources are summed on the map side first
    ends = (F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    sources = cut(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), *ends))
    state = (
        with_targets(sources.select("source", "source_size"), weights, most_epochs)
        .withColumnRenamed("source", "s")
        .join(sources.drop("source_size"), F.col("s").eqNullSafe(F.col("source")))
        .drop("source")
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumns({"rest": F.col("budget") - F.col("epochs") * F.col("source_size"), "ahead": F.lit(0).cast("long"), "all_docs": F.col("docs")})
    )
    placed = _meet(keyed, _narrowed(keyed, cut(state)))
    cols = ["doc_id", "size", "source_size", "target", "taken", "source", "quality"]
    inside = F.expr(f"rest > 0 AND {_INSIDE}")
    first = F.expr("rest > 0 AND (key < k0 OR (k0 = k1 AND key = k0 AND row < r0))")
    whole = placed.where(~inside).withColumn("taken", (F.col("epochs") + F.when(first, 1).otherwise(0)) * F.col("size"))
    run = Window.partitionBy("s").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(inside).withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    edge = edge.withColumn(
        "taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    )
    return whole.select(cols).unionByName(edge.select(cols))


def op4_mix_sources(spark, sf_dir):
    """The words the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(len(regexp_extract_all(t, '[#$%&*|!@=<>]+')) AS DOUBLE) AS marks,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t) || ':mix'), 1, 13) AS BIGINT)::DOUBLE + 1) / 4503599627370497.0 AS u
  FROM base
), keyed AS (
  SELECT doc_id, source, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + marks / greatest(1, size)::DOUBLE)) AS key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w, 3 * source_size AS cap FROM sources
), run AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS wtotal,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM weighed
  WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap * (wtotal - w_before) <= (total - cap_before) * w AS stops FROM run
), levelled AS (
  SELECT *, total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS words,
         wtotal - sum(CASE WHEN stops THEN w ELSE 0 END) OVER () AS wsum FROM marked
), plan AS (
  SELECT source, source_size,
         CASE WHEN stops THEN cap::DOUBLE ELSE words::DOUBLE * w::DOUBLE / wsum::DOUBLE END AS target FROM levelled
), budget AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM plan
), ranked AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken
FROM ranked
"""
