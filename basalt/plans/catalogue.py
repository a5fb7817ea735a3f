"""The query catalogue: every operator of the table engine over the test tables, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import codec
from basalt.operators import indexes, spatial
from basalt.operators.sequential import SequentialTable
from basalt.plans.engine import Engine, query
from basalt.session import checkpoint_dir
from basalt.sources import csv as csv_source
from basalt.sources import fixed

Query = Callable[[SparkSession, str], DataFrame]

#: Eight Peruvian cities: id, name, latitude, longitude, inhabitants (fixed values).
CITIES = (
    (1, "Lima", -12.0464, -77.0428, 9674755),
    (2, "Arequipa", -16.409, -71.5375, 1008290),
    (3, "Cusco", -13.5319, -71.9675, 428450),
    (4, "Trujillo", -8.1116, -79.0288, 919899),
    (5, "Chiclayo", -6.7714, -79.841, 600440),
    (6, "Piura", -5.1945, -80.6328, 484475),
    (7, "Iquitos", -3.7437, -73.2516, 437376),
    (8, "Huancayo", -12.0653, -75.2049, 376657),
)
CITY_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', {a}::DOUBLE, {o}::DOUBLE, {p})" for i, n, a, o, p in CITIES) + ") AS c(id, name, lat, lng, population)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CITIES), "id int, name string, lat double, lng double, population int")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/catalogue-{uuid.uuid4().hex[:12]}"


def _statement(name: str, text: str) -> Query:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name), text)


def _loaded(spark: SparkSession, sf_dir: str, name: str, columns: str, order: tuple[str, ...] = ()) -> Engine:
    """An engine whose table `t` holds the columns of a test table, all rows, in the order of columns if some are named."""
    engine = Engine(spark, scratch(spark))
    rows = table(spark, sf_dir, name)
    engine.execute(f"CREATE TABLE t ({columns})")
    names = [n for n, _ in engine.store.manifest("t").types]
    engine.append("t", (rows.orderBy(*order) if order else rows).select(*names))
    return engine


ORDERS = "o_orderkey INT{}, o_custkey INT, o_orderstatus VARCHAR[1], o_orderpriority VARCHAR[15]"
ORDERS_SQL = "SELECT CAST(o_orderkey AS INT) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_orderpriority FROM orders"


def fetch_by_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "orders", ORDERS.format(""))
    rid = e.store.stored("t").where("o_orderkey = 614").first()
    return e.store.fetch("t", rid["_rid"] if rid else -1)


def _searched(kind: str, where: str) -> Query:
    """A search through an index that CREATE TABLE declares and the load fills."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _loaded(spark, sf_dir, "orders", ORDERS.format(f" INDEX {kind}"))
        return e.sql(f"SELECT * FROM t WHERE {where} USING {kind}")

    return run


def index_rtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch(spark))
    e.execute("CREATE TABLE t (vec_id INT, at ARRAY[FLOAT] INDEX rtree)")
    e.append("t", table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 2)))
    e.create_index("t", "rtree", "at", 0.05)
    return e.near("t", "at", (-0.05, 0.05, -0.05, 0.05)).select("vec_id")


def json_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a SELECT as the HTTP answer gives them."""
    e = _loaded(spark, sf_dir, "nation", "n_nationkey INT, n_name VARCHAR[25]")
    answer = e.answer("SELECT n_nationkey, n_name, nothing FROM t")
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], r["nothing"]) for r in answer["result"]], "n_nationkey int, n_name string, nothing string")


def sequential_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of the delta before and after a compaction of all orders, as a table that is opened again has it."""
    e = _loaded(spark, sf_dir, "orders", "o_orderkey INT")
    first = SequentialTable(e.store, "t", "o_orderkey")
    before = first.limit
    first.reconstruct()
    return spark.createDataFrame([(before, SequentialTable(e.store, "t", "o_orderkey").limit)], "before long, after long")


def truncate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is emptied and filled again."""
    e = _loaded(spark, sf_dir, "orders", ORDERS.format(" INDEX btree"))
    t = SequentialTable(e.store, "t", "o_orderkey")
    t.truncate()
    left = t.size()
    e.execute("INSERT INTO t VALUES (1, 2, 'F', 'x')")
    return e.sql("SELECT * FROM t WHERE o_orderkey = 1 USING btree").withColumn("left_over", F.lit(left).cast("long"))


def fixed_width_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of part as sales records in one file, and read back."""
    path = f"{scratch(spark)}.dat"
    part = table(spark, sf_dir, "part").orderBy("p_partkey")
    sales = part.select(F.col("p_partkey").cast("int").alias("id"), F.substring("p_name", 1, 20).alias("producto"), F.col("p_size").alias("cantidad"), F.col("p_retailprice").cast("float").alias("precio"), F.lit("10/08/2024").alias("fecha"))
    fixed.write_fixed(sales, path, fixed.SALES, "latin-1", b"\0")
    return fixed.read_fixed(spark, path, fixed.SALES, "latin-1")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a SELECT as CSV, and read back."""
    e, path = _loaded(spark, sf_dir, "customer", "c_custkey INT, c_name VARCHAR[25], c_mktsegment VARCHAR[10]"), f"{scratch(spark)}.csv"
    csv_source.export(e.sql("SELECT * FROM t WHERE c_mktsegment != 'BUILDING'"), path)
    return csv_source.read_upload(spark, path).rows


# -- changes


def insert_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "region", "r_regionkey INT, r_name VARCHAR[25]")
    e.execute("INSERT INTO t VALUES (99, 'ATLANTIS', 'dropped')")
    return e.sql("SELECT * FROM t")


def insert_short_tuple_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "region", "r_regionkey INT, r_name VARCHAR[25]")
    e.execute("INSERT INTO t VALUES (99)")
    return e.sql("SELECT * FROM t")


def update_by_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "region", "r_regionkey INT, r_name VARCHAR[25]")
    rid = e.store.stored("t").where("r_regionkey = 2").first()["_rid"]
    e.store.update("t", rid, {"r_name": F.lit("CHANGED")})
    return e.sql("SELECT * FROM t")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "events", "event_id INT, user_id INT, event_type VARCHAR[20]")
    e.execute("DELETE FROM t WHERE event_type = 'error'")
    return e.sql("SELECT * FROM t")


def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "events", "event_id INT, event_type VARCHAR[20]")
    n = e.execute("DELETE FROM t WHERE event_type = 'error'").count
    return spark.createDataFrame([(n,)], "deleted long")


def create_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch(spark))
    e.execute("CREATE TABLE Restaurantes (id INT INDEX isam, nombre VARCHAR[20] INDEX btree, fechaRegistro DATE, ubicacion ARRAY[FLOAT] INDEX rtree)")
    e.execute("INSERT INTO Restaurantes VALUES (1, 'KFC', '01-02-2023', [-12.0, -77.0]), (10, 'Bembos', '2023-01-01', [-12.1, -77.1])")
    return e.sql("SELECT * FROM restaurantes WHERE id = 10 USING btree")


# -- sequential and paged files


def _lines(spark: SparkSession, sf_dir: str) -> SequentialTable:
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = _loaded(spark, sf_dir, "lineitem", ", ".join(f"{c} INT" for c in columns), columns)
    t = SequentialTable(e.store, "t", "l_orderkey")
    t.reconstruct()
    return t


def index_remove_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several rows with the key, the first in order of insertion goes."""
    t = _lines(spark, sf_dir)
    t.remove(7)
    return t.store.rows("t").select("l_orderkey", "l_linenumber")


def index_remove_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir)
    t.remove_all(7)
    return t.store.rows("t").select("l_orderkey", "l_linenumber")


def sequential_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main part in key order, a delta beside it, and deleted rows: read as one."""
    e = Engine(spark, scratch(spark))
    e.execute("CREATE TABLE t (event_id INT, event_type VARCHAR[20])")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    t = SequentialTable(e.store, "t", "event_id")
    t.insert(events.where("event_id % 10 <> 0"))
    t.insert(events.where("event_id % 10 = 0"))
    e.execute("DELETE FROM t WHERE event_type = 'error'")
    return t.range_search(-(2**31), 2**31 - 1)


def sparse_index_floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order key in an index of the first key of each page of 64 events."""
    pages = indexes.paged(table(spark, sf_dir, "events").select("event_id"), "event_id", 64)
    keys = pages.groupBy("page_no").agg(F.min("event_id").alias("k"))
    return indexes.sparse_floor(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", keys, "k")


def paged_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = indexes.paged(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 2)
    return placed.groupBy("page_no").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def sequential_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts in two loads with a compaction between, one row removed, then a range."""
    e = Engine(spark, scratch(spark))
    e.execute("CREATE TABLE t (o_orderkey INT, o_orderstatus VARCHAR[1])")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = SequentialTable(e.store, "t", "o_orderkey")
    t.insert(orders.where("o_orderkey % 2 = 1"))
    t.insert(orders.where("o_orderkey % 2 = 0"))
    t.remove(150)
    return t.range_search(100, 200)


def _early_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages made of every fourth order key, and the keys that come later."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return indexes.paged(orders.where("o_orderkey % 4 = 0"), "o_orderkey", 2), orders.where("o_orderkey % 4 <> 0")


def paged_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come later, in the chains of the pages."""
    early, late = _early_pages(spark, sf_dir)
    pages = early.groupBy("page_no").agg(F.min("o_orderkey").alias("first_key"))
    return indexes.overflow(pages, "first_key", "page_no", late, "o_orderkey", 2)


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come later, in pages that are split."""
    early, late = _early_pages(spark, sf_dir)
    return indexes.split_insert(early, "o_orderkey", late, 2)


def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key looked for in the pages of orders and their chains."""
    early, late = _early_pages(spark, sf_dir)
    first = early.select("o_orderkey", "page_no")
    pages = early.groupBy("page_no").agg(F.min("o_orderkey").alias("first_key"))
    chained = indexes.overflow(pages, "first_key", "page_no", late, "o_orderkey", 2).select("o_orderkey", "page_no")
    return indexes.page_search(first.unionByName(chained), "o_orderkey", table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "page_no")


# -- layouts


KEYS = (7, 614, 681, 405)


def index_btree_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    indexes.write_sorted(table(spark, sf_dir, "orders"), "o_orderkey", path)
    return spark.read.parquet(path).where(F.col("o_orderkey").isin(*KEYS))


def index_hash_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, orders = scratch(spark), table(spark, sf_dir, "orders")
    indexes.write_hashed(orders, "o_orderkey", path)
    out = indexes.read_hashed(spark, path, "o_orderkey", KEYS[0])
    for key in KEYS[1:]:
        out = out.unionByName(indexes.read_hashed(spark, path, "o_orderkey", key))
    return out.select(*orders.columns)


# -- types


def codec_varchar_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", codec.to_varchar(F.col("p_name"), 5).alias("p_name"))


def codec_date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = codec.to_date_text(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", turned.alias("d"))


def codec_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = codec.to_float(F.col("l_discount").cast("string")).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("v"))


def str_strip_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("  '"), "n_name", F.lit("' "))
    return table(spark, sf_dir, "nation").select("n_nationkey", codec.strip_quotes(quoted).alias("n_name"))


# -- CSV


def csv_ingest_all_varchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}.csv"
    table(spark, sf_dir, "nation").coalesce(1).write.option("header", True).csv(path)
    engine = Engine(spark, scratch(spark))
    engine.upload(path, "nation")
    return engine.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def csv_upload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations as a file: those of region 0 lack fields, those of region 1 have one too many, the others are quoted."""
    path = f"{scratch(spark)}.csv"
    line = F.when(F.col("n_regionkey") == 0, F.col("n_name")).when(F.col("n_regionkey") == 1, F.concat_ws(",", "n_name", F.lit("1990"), F.lit("x"), F.lit("more")))
    line = line.otherwise(F.concat(F.lit('"'), "n_name", F.lit(', the ""great""",'), F.col("n_nationkey").cast("string"), F.lit(",y")))
    lines = table(spark, sf_dir, "nation").select(F.lit(1).alias("at"), line.alias("value"))
    head = spark.createDataFrame([(0, "Full Name,birth-year,Full Name")], "at int, value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    report = Engine(spark, scratch(spark)).upload(path, "people")
    return spark.createDataFrame([(report["recordCount"], report["inserted"], report["failed"], ",".join(report["headers"]))], "records long, inserted long, failed long, headers string")


def csv_load_typed_limit10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}.csv"
    part = table(spark, sf_dir, "part").orderBy("p_partkey")
    sales = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("producto"), F.col("p_size").alias("cantidad"), F.col("p_retailprice").alias("precio"), F.lit("10/08/2024").alias("fecha"))
    sales.write.option("header", True).option("sep", ";").csv(path)
    return csv_source.read_typed(spark, path, first=10)


# -- spatial


def spatial_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_circle(cities(spark), "lat", "lng", -12.0464, -77.0428, 500.0).select("id", "name")


def spatial_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cities(spark).where(spatial.in_rectangle(F.col("lat"), F.col("lng"), -13, -6, -80, -75)).select("id", "name", "lat", "lng")


def spatial_rect_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("embedding")[0], F.col("embedding")[1]
    return table(spark, sf_dir, "embeddings").where(spatial.in_rectangle(x, y, -0.05, 0.05, -0.05, 0.05)).select("vec_id")


def spatial_map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top = spatial.map_place(F.col("lat"), F.col("lng"))
    return cities(spark).select("id", left.alias("left_pct"), top.alias("top_pct"))


QUERIES: dict[str, Query] = {
    "scan_table": _statement("nation", "SELECT * FROM nation"),
    "fetch_by_rowid": fetch_by_rowid,
    "index_point_search": _searched("btree", "o_orderkey = 614"),
    "index_hash_search": _searched("hash", "o_orderkey = 614"),
    "index_range_search": _searched("btree", "o_orderkey BETWEEN 100 AND 200"),
    "index_isam_search": _searched("isam", "o_orderkey BETWEEN 100 AND 200"),
    "index_rtree_search": index_rtree_search,
    "project_columns": _statement("customer", "SELECT c_custkey, c_name, c_custkey FROM customer"),
    "project_missing_as_null": _statement("customer", "SELECT c_name, missing_col FROM customer"),
    "filter_eq_string": _statement("customer", 'SELECT * FROM customer WHERE c_mktsegment = "BUILDING"'),
    "filter_gt": _statement("customer", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 30"),
    "filter_le_ge": _statement("part", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20"),
    "filter_ne": _statement("part", "SELECT p_partkey, p_size FROM part WHERE p_size != 5"),
    "filter_and_or_not": _statement("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_orderpriority = '1-URGENT' OR o_totalprice > 400000"),
    "filter_in": _statement("part", "SELECT * FROM part WHERE p_size IN (1, 5, 9)"),
    "filter_between": _statement("orders", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200"),
    "filter_arith_mul": _statement("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 = 20"),
    "filter_chained": _statement("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE 10 < l_quantity < 20"),
    "filter_col_col": _statement("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = l_discount"),
    "filter_truthy": _statement("labels", "SELECT doc_id, toxic FROM labels WHERE toxic"),
    "filter_len": _statement("part", "SELECT p_partkey, p_name FROM part WHERE len(p_name) > 8"),
    "filter_int_cast": lambda spark, sf_dir: query(
        table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_linenumber").cast("string")), "SELECT l_orderkey, l_linenumber, l_returnflag, n FROM t WHERE int(n) > 5"
    ).select("l_orderkey", "l_linenumber", codec.to_int(F.col("l_returnflag")).alias("v")),
    "filter_functions": _statement(
        "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_quantity - 25) > 10 AND min(l_quantity, 45) = l_quantity AND max(l_tax, l_discount) = l_tax AND float(str(l_linenumber)) > 2 AND round(l_tax * 100) = 4"
    ),
    "limit_first_n": _statement("nation", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10"),
    "insert_positional": insert_positional,
    "insert_short_tuple_defaults": insert_short_tuple_defaults,
    "update_by_rowid": update_by_rowid,
    "delete_where": delete_where,
    "delete_count": delete_count,
    "create_insert_select": create_insert_select,
    "index_remove_one": index_remove_one,
    "index_remove_all": index_remove_all,
    "truncate_table": truncate_table,
    "json_answer": json_answer,
    "sequential_limit": sequential_limit,
    "fixed_width_roundtrip": fixed_width_roundtrip,
    "csv_export": csv_export,
    "table_row_count": _statement("lineitem", "SELECT COUNT(*) AS n FROM lineitem"),
    "sequential_merge": sequential_merge,
    "sparse_index_floor_lookup": sparse_index_floor_lookup,
    "paged_layout": paged_layout,
    "paged_overflow": paged_overflow,
    "page_split": page_split,
    "page_search": page_search,
    "sequential_table": sequential_table,
    "index_btree_layout": index_btree_layout,
    "index_hash_layout": index_hash_layout,
    "codec_float32": codec_float32,
    "codec_varchar_truncate": codec_varchar_truncate,
    "codec_date_normalize": codec_date_normalize,
    "str_strip_quotes": str_strip_quotes,
    "csv_ingest_all_varchar": csv_ingest_all_varchar,
    "csv_upload_report": csv_upload_report,
    "csv_load_typed_limit10": csv_load_typed_limit10,
    "spatial_circle": spatial_circle,
    "spatial_rect": spatial_rect,
    "spatial_rect_embeddings": spatial_rect_embeddings,
    "spatial_map_project": spatial_map_project,
    "ui_group_count": _statement("events", "SELECT event_type, COUNT(*) AS total FROM events GROUP BY event_type"),
}

#: Pages of two from every fourth order key, and the later keys with the page of the greatest first key not above them.
PAGES_SQL = (
    "WITH RECURSIVE early AS (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 2) AS BIGINT) AS page_no FROM orders WHERE o_orderkey % 4 = 0), "
    "p AS (SELECT page_no, min(o_orderkey) AS first_key FROM early GROUP BY 1), "
    "late AS (SELECT o_orderkey, coalesce(page_no, 0) AS page_no FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0) ASOF LEFT JOIN p ON o_orderkey >= first_key)"
)

SQL = {
    "scan_table": "SELECT * FROM nation",
    "fetch_by_rowid": f"{ORDERS_SQL} WHERE o_orderkey = 614",
    "index_point_search": f"{ORDERS_SQL} WHERE o_orderkey = 614",
    "index_hash_search": f"{ORDERS_SQL} WHERE o_orderkey = 614",
    "index_range_search": f"{ORDERS_SQL} WHERE o_orderkey BETWEEN 100 AND 200",
    "index_isam_search": f"{ORDERS_SQL} WHERE o_orderkey BETWEEN 100 AND 200",
    "index_rtree_search": "SELECT CAST(vec_id AS INT) AS vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.05 AND 0.05 AND embedding[2] BETWEEN -0.05 AND 0.05",
    "project_columns": "SELECT c_custkey, c_name FROM customer",
    "project_missing_as_null": "SELECT c_name, CAST(NULL AS VARCHAR) AS missing_col FROM customer",
    "filter_eq_string": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_gt": "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 30",
    "filter_le_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20",
    "filter_ne": "SELECT p_partkey, p_size FROM part WHERE p_size <> 5",
    "filter_and_or_not": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_orderpriority = '1-URGENT' OR o_totalprice > 400000",
    "filter_in": "SELECT * FROM part WHERE p_size IN (1, 5, 9)",
    "filter_between": "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200",
    "filter_arith_mul": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 = 20",
    "filter_chained": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE 10 < l_quantity AND l_quantity < 20",
    "filter_col_col": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = l_discount",
    "filter_truthy": "SELECT doc_id, toxic FROM labels WHERE toxic <> 0",
    "filter_len": "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 8",
    "filter_int_cast": "SELECT l_orderkey, l_linenumber, coalesce(try_cast(l_returnflag AS INT), 0) AS v FROM lineitem WHERE coalesce(try_cast(CAST(l_linenumber AS VARCHAR) AS INT), 0) > 5",
    "filter_functions": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_quantity - 25) > 10 AND least(l_quantity, 45) = l_quantity AND greatest(l_tax, l_discount) = l_tax AND l_linenumber > 2 AND round_even(l_tax * 100, 0) = 4",
    "json_answer": "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS nothing FROM nation",
    "sequential_limit": "SELECT CAST(3 AS BIGINT) AS before, CAST(floor(log2(count(*) + 3)) AS BIGINT) AS after FROM orders",
    "limit_first_n": "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10",
    "insert_positional": "SELECT * FROM region UNION ALL SELECT CAST(99 AS INT), 'ATLANTIS'",
    "insert_short_tuple_defaults": "SELECT * FROM region UNION ALL SELECT CAST(99 AS INT), ''",
    "update_by_rowid": "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'CHANGED' ELSE r_name END AS r_name FROM region",
    "delete_where": "SELECT CAST(event_id AS INT) AS event_id, CAST(user_id AS INT) AS user_id, event_type FROM events WHERE NOT (event_type = 'error')",
    "delete_count": "SELECT count(*) AS deleted FROM events WHERE event_type = 'error'",
    "create_insert_select": "SELECT CAST(10 AS INT) AS id, 'Bembos' AS nombre, '2023-01-01' AS fecharegistro, [-12.1::FLOAT, -77.1::FLOAT] AS ubicacion",
    "index_remove_one": "SELECT CAST(l_orderkey AS INT) AS l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE NOT (l_orderkey = 7 AND rn = 1)",
    "index_remove_all": "SELECT CAST(l_orderkey AS INT) AS l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey <> 7",
    "truncate_table": "SELECT CAST(1 AS INT) AS o_orderkey, CAST(2 AS INT) AS o_custkey, 'F' AS o_orderstatus, 'x' AS o_orderpriority, CAST(0 AS BIGINT) AS left_over",
    "fixed_width_roundtrip": "SELECT CAST(p_partkey AS INT) AS id, trim(substr(p_name, 1, 20)) AS producto, p_size AS cantidad, CAST(p_retailprice AS FLOAT) AS precio, '10/08/2024' AS fecha, row_number() OVER (ORDER BY p_partkey) - 1 AS _rid FROM part",
    "csv_export": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "table_row_count": "SELECT count(*) AS n FROM lineitem",
    "sequential_merge": "SELECT CAST(event_id AS INT) AS event_id, event_type FROM events WHERE event_type <> 'error' ORDER BY event_id",
    "sparse_index_floor_lookup": "WITH k AS (SELECT min(event_id) AS k FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS p FROM events) GROUP BY p) SELECT o_orderkey, k AS floor_key FROM orders ASOF LEFT JOIN k ON o_orderkey >= k",
    "paged_layout": "SELECT CAST(floor((rn - 1) / 2) AS BIGINT) AS page_no, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1",
    "paged_overflow": f"{PAGES_SQL} SELECT o_orderkey, page_no, CAST(floor((row_number() OVER (PARTITION BY page_no ORDER BY o_orderkey) - 1) / 2) AS INT) AS chain FROM late",
    "page_split": f"{PAGES_SQL}, w AS (SELECT o_orderkey, page_no, row_number() OVER (PARTITION BY page_no ORDER BY o_orderkey) - 1 AS place FROM (SELECT * FROM late UNION ALL SELECT o_orderkey, page_no FROM early)), "
    "pieces AS (SELECT page_no, CAST(0 AS BIGINT) AS first, count(*) AS size FROM w GROUP BY page_no UNION ALL "
    "SELECT page_no, unnest([first, first + size // 2]), unnest([size // 2, size - size // 2]) FROM pieces WHERE size > 2) "
    "SELECT o_orderkey, page_no, first, size FROM w JOIN pieces USING (page_no) WHERE size <= 2 AND place >= first AND place < first + size",
    "page_search": f"{PAGES_SQL} SELECT c_custkey, page_no FROM customer JOIN (SELECT * FROM late UNION ALL SELECT o_orderkey, page_no FROM early) ON c_custkey = o_orderkey",
    "sequential_table": "SELECT CAST(o_orderkey AS INT) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200 AND o_orderkey <> 150",
    "index_btree_layout": "SELECT * FROM orders WHERE o_orderkey IN (7, 614, 681, 405)",
    "index_hash_layout": "SELECT * FROM orders WHERE o_orderkey IN (7, 614, 681, 405)",
    "codec_float32": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS v FROM lineitem",
    "codec_varchar_truncate": "SELECT p_partkey, trim(substr(p_name, 1, 5)) AS p_name FROM part",
    "codec_date_normalize": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders",
    "str_strip_quotes": "SELECT n_nationkey, n_name FROM nation",
    "csv_ingest_all_varchar": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, trim(n_name) AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    "csv_upload_report": "SELECT count(*) AS records, count(*) FILTER (n_regionkey <> 0) AS inserted, count(*) FILTER (n_regionkey = 0) AS failed, 'full_name,birth_year,full_name_2' AS headers FROM nation",
    "csv_load_typed_limit10": "SELECT CAST(p_partkey AS INT) AS id, p_name AS producto, p_size AS cantidad, CAST(p_retailprice AS FLOAT) AS precio, '10/08/2024' AS fecha FROM part ORDER BY p_partkey LIMIT 10",
    "spatial_circle": f"SELECT id, name FROM {CITY_SQL} WHERE 2 * 6371 * asin(sqrt(pow(sin(radians(lat + 12.0464) / 2), 2) + cos(radians(-12.0464)) * cos(radians(lat)) * pow(sin(radians(lng + 77.0428) / 2), 2))) <= 500",
    "spatial_rect": f"SELECT id, name, lat, lng FROM {CITY_SQL} WHERE lat BETWEEN -13 AND -6 AND lng BETWEEN -80 AND -75",
    "spatial_rect_embeddings": "SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.05 AND 0.05 AND embedding[2] BETWEEN -0.05 AND 0.05",
    "spatial_map_project": f"SELECT id, (lng + 81) / 13 * 100 AS left_pct, (lat + 18) / 15 * 100 AS top_pct FROM {CITY_SQL}",
    "ui_group_count": "SELECT event_type, count(*) AS total FROM events GROUP BY event_type",
}
