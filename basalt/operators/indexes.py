"""Index-like physical layouts: copies of rows arranged so that the scan itself prunes.

sequential, isam, btree: range-partitioned and sorted by the key; row group statistics skip what a filter excludes.
hash: partitioned by a hash of the key, so that an equality reads one bucket.
rtree: partitioned by range of grid cells of a point, so that a rectangle reads the cells it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basalt.session import cut

from . import spatial

BUCKET = "_bucket"


def write_sorted(rows: DataFrame, key: str, path: str) -> None:
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)


def write_hashed(rows: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    marked = rows.withColumn(BUCKET, bucket)
    marked.repartition(BUCKET).sortWithinPartitions(BUCKET, key).write.option("parquet.bloom.filter.enabled", "true").partitionBy(BUCKET).parquet(path)


def read_hashed(spark: SparkSession, path: str, key: str, value, buckets: int = 64, schema=None) -> DataFrame:
    """Rows whose key equals `value`; one bucket is read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.parquet(path)
    typed = F.lit(value).cast(rows.schema[key].dataType)
    return rows.where((F.col(BUCKET) == F.pmod(F.xxhash64(typed), F.lit(buckets)).cast("int")) & (F.col(key) == typed)).drop(BUCKET)


def write_gridded(rows: DataFrame, point: str, path: str, step: float = 1.0) -> None:
    x, y = spatial.cell(F.col(point)[0], step), spatial.cell(F.col(point)[1], step)
    marked = rows.withColumns({"_cx": x, "_cy": y})
    marked.repartitionByRange("_cx", "_cy").sortWithinPartitions("_cx", "_cy").write.parquet(path)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `here` to sorted rows (v, is_probe, part): the last index key up to each row."""
    last = None
    for batch in batches:
        v, is_probe, part = batch.columns
        own = pc.if_else(pc.equal(is_probe, 0), v, pa.scalar(None, v.type))
        here = pc.fill_null_forward(pa.concat_arrays([pa.array([last], v.type), own])).slice(1)
        last = here[-1].as_py() if len(here) else last
        yield pa.RecordBatch.from_arrays([v, is_probe, part, here], ["v", "is_probe", "part", "here"])


def sparse_floor(probes: DataFrame, probe: str, index: DataFrame, key: str) -> DataFrame:
    """For each probe the greatest index key not above it, as `floor_key`; null below all keys, and for a null.

    Both sides are put into one order by range partitions. Within a partition the last key seen so far answers, which one pass
    over the sorted rows carries along without another shuffle; what a partition inherits from those before it is one value
    each, so the fix-up table has as many rows as partitions.
    """
    both = index.select(F.col(key).alias("v"), F.lit(0).alias("is_probe")).unionByName(probes.select(F.col(probe).alias("v"), F.lit(1).alias("is_probe")))
    parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = both.repartitionByRange(parts, "v").sortWithinPartitions("v", "is_probe").withColumn("part", F.spark_partition_id())
    kind = both.schema["v"].dataType.simpleString()
    seen = cut(ranged.mapInArrow(_carried, f"v {kind}, is_probe int, part int, here {kind}"))
    tops = seen.groupBy("part").agg(F.max(F.when(F.col("is_probe") == 0, F.col("v"))).alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inherited = tops.withColumn("inherited", F.max("top").over(before)).select("part", "inherited")
    out = seen.where("is_probe = 1").join(F.broadcast(inherited), "part")
    return out.select(F.col("v").alias(probe), F.when(F.col("v").isNotNull(), F.coalesce("here", "inherited")).alias("floor_key"))


#: Places within a partition, in Spark's increasing ids.
_BITS = 33
#: Share of all rows that makes a page hot; so there are 1 / HOT_SHARE hot pages at most.
HOT_SHARE = 1 / 1000


def ranked(rows: DataFrame, *by: str, name: str = "__rank") -> DataFrame:
    """Rows with their place in the order of `by`, from 0, without sorting the table in one task.

    Ranges are sorted apart, and a row's increasing id tells its range and its place there, so that no second shuffle is
    needed; each range's first place comes from a table of range sizes, which has as many rows as there are ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("__at"), _BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__part", "__start")
    met = placed.join(F.broadcast(starts), part == F.col("__part"))
    return met.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << _BITS) - 1)).drop("__part", "__at", "__start")


def paged(rows: DataFrame, key: str, per_page: int = 2) -> DataFrame:
    """Rows with `page_no` and `slot`: pages of `per_page` rows in key order."""
    place = F.col("__rank")
    return ranked(rows, key).withColumns({"page_no": F.floor(place / per_page).cast("long"), "slot": (place % per_page).cast("int")}).drop("__rank")


def _beside_pages(rows: DataFrame, pages: DataFrame, size: str) -> DataFrame:
    """Rows with what `pages` says of their `page_no`. Pages with more than a fixed share of all rows are few by that share and
    are broadcast, so that no page's rows come into one task; the others meet by a shuffle."""
    bound = (pages.agg(F.sum(size)).first()[0] or 0) * HOT_SHARE
    hot, cold = pages.where(F.col(size) > bound), pages.where(F.col(size) <= bound)
    first = rows.join(F.broadcast(hot), "page_no")
    return first.unionByName(rows.join(F.broadcast(hot.select("page_no")), "page_no", "left_anti").join(cold, "page_no"))


def _placed(index: DataFrame, first_key: str, page: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows with `page_no`, the page of the greatest first key not above the row's key (the first page below all), and
    `__rank`, their place in key order. Only distinct keys and page numbers meet the index."""
    floors = sparse_floor(rows.select(key).distinct(), key, index.select(first_key), first_key)
    least = index.agg(F.min(first_key)).first()[0]
    found = floors.withColumn("__first", F.coalesce("floor_key", F.lit(least)))
    pages = index.select(F.col(first_key).alias("__first"), F.col(page).alias("page_no"))
    return ranked(rows.join(found.join(pages, "__first").select(key, "page_no"), key), key)


def overflow(index: DataFrame, first_key: str, page: str, rows: DataFrame, key: str, per_page: int = 2) -> DataFrame:
    """Rows placed in existing pages: `page_no` of the greatest first key not above the row's key (the first page below all),
    and `chain`, the number of the page in that page's chain of overflow pages, in key order.

    `index` has one row for each page. A page's rows are neighbours in key order, so a place in the chain is a place in the
    whole order less that of the page's first row; a long chain is never one task.
    """
    placed = cut(_placed(index, first_key, page, rows, key))
    pages = cut(placed.groupBy("page_no").agg(F.min("__rank").alias("__least"), F.count("*").alias("__rows")))
    met = _beside_pages(placed, pages, "__rows")
    return met.withColumn("chain", F.floor((F.col("__rank") - F.col("__least")) / per_page).cast("int")).drop("__rank", "__least", "__rows")


def page_search(pages: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    """Rows of `pages` (with `page_no`, and a chain's rows under the number of its page) that have a probed key, beside the probe.

    The index is the first key of each page; a probe's floor in it names the page, and the key is looked for in that page only.
    Chains hold what is above their page's first key and below the next, the first page's chain also what is below all.
    """
    index = pages.groupBy("page_no").agg(F.min(key).alias("__first"))
    found = _placed(index, "__first", "page_no", probes.select(F.col(probe)).distinct(), probe).drop("__rank")
    return pages.join(found, [pages["page_no"] == found["page_no"], pages[key] == found[probe]]).select(found[probe], *(pages[c] for c in pages.columns))


def split_insert(pages: DataFrame, key: str, rows: DataFrame, per_page: int = 2) -> DataFrame:
    """All keys after `rows` have come into `pages` (key, `page_no`): key, `page_no` (where the key went), `first` and `size` (the
    piece of that page that holds the key: its first place in the page's key order, and its keys).

    A page that holds too many is split in half, the lower half being the smaller one, and halves that hold too many again.
    """
    index = pages.groupBy("page_no").agg(F.min(key).alias("__first"))
    came = _placed(index, "__first", "page_no", rows.select(key), key).drop("__rank")
    placed = cut(ranked(pages.select(key, "page_no").unionByName(came.select(key, "page_no")), "page_no", key))
    sizes = cut(placed.groupBy("page_no").agg(F.min("__rank").alias("__least"), F.count("*").alias("__rows")))
    met = _beside_pages(placed, sizes, "__rows").withColumn("__at", F.col("__rank") - F.col("__least"))
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.col("__rows").cast("double"))).cast("int"))

    def halve(piece: Column, _: Column) -> Column:
        half = F.floor(piece["size"] / 2)
        lower = F.struct(piece["first"].alias("first"), half.alias("size"))
        upper = F.struct((piece["first"] + half).alias("first"), (piece["size"] - half).alias("size"))
        return F.when(piece["size"] <= per_page, piece).when(F.col("__at") < piece["first"] + half, lower).otherwise(upper)

    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("__rows").alias("size"))
    return met.withColumn("__piece", F.aggregate(halvings, whole, halve)).select(key, "page_no", "__piece.first", "__piece.size")


def merged(main: DataFrame, delta: DataFrame, live: Column) -> DataFrame:
    """Main file and delta as one, without what is deleted."""
    return main.unionByName(delta).where(live)
