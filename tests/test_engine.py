import pytest
from pyspark.sql import functions as F

from basalt.plans.engine import query
from basalt.plans.lexer import SqlError


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


@pytest.fixture
def people(engine):
    engine.execute("CREATE TABLE People (id INT, name VARCHAR[10], age FLOAT)")
    engine.execute("INSERT INTO people VALUES (1, 'Ana', 30), (2, 'Bob', 40.5), (3, 'Cid'), (4, 'a=b', 20, 'extra'), (5)")
    return engine


def test_insert_fills_defaults_and_drops_extras(people):
    rows = {r["id"]: (r["name"], r["age"]) for r in people.sql("SELECT * FROM PEOPLE").collect()}
    assert rows == {1: ("Ana", 30.0), 2: ("Bob", 40.5), 3: ("Cid", 0.0), 4: ("a=b", 20.0), 5: ("", 0.0)}


def test_limit_follows_insertion_order(people):
    assert [r["id"] for r in people.sql("SELECT id FROM people LIMIT 2").collect()] == [1, 2]
    assert people.sql("SELECT id FROM people LIMIT 0").collect() == []


def test_literal_with_equals_sign(people):
    assert ids(people.sql("SELECT * FROM people WHERE name = 'a=b'")) == [4]


def test_types_never_coerce(people):
    assert ids(people.sql("SELECT * FROM people WHERE id = '1'")) == []
    assert ids(people.sql("SELECT * FROM people WHERE id != '1'")) == [1, 2, 3, 4, 5]
    assert ids(people.sql("SELECT * FROM people WHERE id < '3'")) == []


def test_text_column_beside_a_number_reads_as_a_number(engine, tmp_path):
    (tmp_path / "u.csv").write_text("id,age\n1,31\n2,x\n3,9\n")
    engine.upload(str(tmp_path / "u.csv"), "u")
    assert [r["id"] for r in engine.sql("SELECT id FROM u WHERE age > 30").collect()] == ["1"]


def test_delete_twice_hits_the_right_rows(people):
    assert people.execute("DELETE FROM people WHERE id = 2").count == 1
    assert people.execute("DELETE FROM people WHERE id = 4").count == 1
    assert people.execute("DELETE FROM people WHERE id = 99").count == 0
    assert ids(people.sql("SELECT * FROM people")) == [1, 3, 5]


def test_all_zero_row_is_visible(engine):
    engine.execute("CREATE TABLE z (id INT, v FLOAT)")
    engine.execute("INSERT INTO z VALUES (0, 0)")
    assert ids(engine.sql("SELECT * FROM z")) == [0]


def test_update_keeps_the_place(people):
    rid = people.store.stored("people").where("id = 2").first()["_rid"]
    assert people.store.update("people", rid, {"name": F.lit("Bea")}) == 1
    assert [(r["id"], r["name"]) for r in people.sql("SELECT * FROM people LIMIT 2").collect()] == [(1, "Ana"), (2, "Bea")]
    assert people.store.fetch("people", rid).first()["name"] == "Bea"
    assert people.store.update("people", -1, {"name": F.lit("x")}) == 0


def test_compact_and_vacuum(people):
    people.execute("DELETE FROM people WHERE id = 1")
    people.store.compact("people", "id")
    assert len(people.store.manifest("people").parts) == 1
    assert people.store.vacuum("people")
    assert ids(people.sql("SELECT * FROM people")) == [2, 3, 4, 5]
    people.store.truncate("people")
    assert people.store.count("people") == 0


@pytest.mark.parametrize("kind", ["sequential", "isam", "btree", "hash"])
def test_indexed_lookups_equal_plain_ones(people, kind):
    plain = {w: ids(people.sql(f"SELECT * FROM people WHERE {w}")) for w in ("id = 3", "id > 2", "id BETWEEN 2 AND 4", "id = 3 AND name = 'Cid'")}
    people.execute(f"CREATE INDEX {kind} ON people (id)")
    for where, want in plain.items():
        assert ids(people.sql(f"SELECT * FROM people WHERE {where} USING {kind}")) == want
    people.execute("INSERT INTO people VALUES (3, 'Dup', 1)")
    people.execute("DELETE FROM people WHERE name = 'Cid'")
    assert [r["name"] for r in people.sql("SELECT name FROM people WHERE id = 3").collect()] == ["Dup"]


def test_hash_index_reads_one_bucket(people):
    people.execute("CREATE INDEX hash ON people (id)")
    plan = people.sql("SELECT * FROM people WHERE id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_rtree_rectangle(engine):
    engine.execute("CREATE TABLE p (id INT, at ARRAY[FLOAT] INDEX rtree)")
    engine.execute("INSERT INTO p VALUES (1, [-12.0, -77.0]), (2, [-16.4, -71.5]), (3, [-8.1, -79.0])")
    want = ids(engine.near("p", "at", (-13, -6, -80, -75)))
    engine.execute("CREATE INDEX rtree ON p (at)")
    assert want == ids(engine.near("p", "at", (-13, -6, -80, -75))) == [1, 3]
    engine.execute("INSERT INTO p VALUES (4, [-12.5, -76.0])")
    engine.execute("DELETE FROM p WHERE id = 1")
    assert ids(engine.near("p", "at", (-13, -6, -80, -75))) == [3, 4]


def test_out_of_range_integer_is_an_error(people):
    with pytest.raises(Exception, match="out of range"):
        people.execute("INSERT INTO people VALUES (2147483648)")
    assert people.store.count("people") == 5


def test_errors_are_answers(people):
    for text, says in (("SELECT * FROM nowhere", "no such table"), ("", "empty"), ("CREATE TABLE people (a INT)", "exists"), ("CREATE INDEX hash ON people (x)", "unknown column"), ("SELECT * FROM people WHERE nope = 1", "unknown column")):
        got = people.answer(text)
        assert not got["ok"] and says in got["error"]
    assert people.answer("SELECT id, nope FROM people WHERE id = 1") == {"ok": True, "result": [{"id": 1, "nope": None}]}


def test_group_count(people):
    people.execute("INSERT INTO people VALUES (6, 'Ana', 1)")
    got = people.sql("SELECT name, COUNT(*) AS total FROM people GROUP BY name ORDER BY total DESC LIMIT 1").collect()
    assert [tuple(r) for r in got] == [("Ana", 2)]
    with pytest.raises(SqlError):
        people.sql("SELECT age, COUNT(*) FROM people GROUP BY name")


CONDITIONS = {
    "1 < id < 4": [2, 3], "id IN (1, 5)": [1, 5], "id NOT IN (1, 5)": [2, 3, 4], "name IN ('Ana')": [1], "id * 2 = 6": [3], "age": [1, 2, 4],
    "NOT name": [5], "len(name) = 3 AND id > 1": [2, 3, 4], "abs(-id) >= 4": [4, 5], "round(2.5) = id": [2], "min(id, 3) = 3": [3, 4, 5],
    "id NOT BETWEEN 2 AND 4": [1, 5], "-id = -2": [2], "id - 1 = 1": [2], "lower(name) = 'ana'": [1], "str(id) = '4'": [4], "float(name) > 0 OR id = 1": [1],
}


@pytest.mark.parametrize("where", CONDITIONS)
def test_conditions(people, where):
    assert ids(people.sql(f"SELECT * FROM people WHERE {where}")) == CONDITIONS[where]


def test_strict_order_treats_an_error_on_the_way_as_an_error(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "5")], "id int, name string")
    text = "SELECT id FROM t WHERE int(name) > 1 OR id = 1"
    assert ids(query(rows, text)) == [1, 2]
    assert ids(query(rows, text, strict_order=True)) == [2]
    text = "SELECT id FROM t WHERE NOT (int(name) > 1 AND id = 7)"
    assert ids(query(rows, text)) == [1, 2]
    assert ids(query(rows, text, strict_order=True)) == [2]


def test_pushdown_and_pruning(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS w").write.parquet(str(tmp_path / "p"))
    plan = query(spark.read.parquet(str(tmp_path / "p")), "SELECT v FROM t WHERE id >= 10 AND id <= 20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "LessThanOrEqual(id,20)" in plan and "w:string" not in plan


def test_names_with_signs(engine, tmp_path):
    (tmp_path / "u.csv").write_text('observation_id,observed_length_(m),country/region\n1," 2.5 ",Peru\n')
    engine.upload(str(tmp_path / "u.csv"), "Prueba")
    assert engine.sql("SELECT `country/region` FROM prueba WHERE `observed_length_(m)` > 2").first()[0] == "Peru"


def streamed(store, table, spark, name):
    from basalt.streaming.appends import stream_appends

    q = stream_appends(store, table).writeStream.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).count()


def test_stream_of_appends(people, spark):
    assert streamed(people.store, "people", spark, "appended") == 5


def test_stream_shows_inserts_only(people, spark):
    rid = people.store.stored("people").first()["_rid"]
    people.store.update("people", rid, {"name": F.lit("x")})
    people.execute("DELETE FROM people WHERE id = 2")
    people.compact("people", "id")
    assert people.store.count("people") == 4 and streamed(people.store, "people", spark, "after_compact") == 5


def test_a_failed_insert_leaves_nothing_to_be_seen(people, spark, monkeypatch):
    bad = spark.range(20).selectExpr("IF(id < 10, CAST(id AS INT), CAST(raise_error('no') AS INT)) AS id", "'x' AS name", "CAST(1 AS FLOAT) AS age")
    with pytest.raises(Exception, match="no"):
        people.store.append("people", bad)
    monkeypatch.setattr(people.store, "save", lambda *a: (_ for _ in ()).throw(RuntimeError("crash before the manifest")))
    with pytest.raises(RuntimeError):
        people.store.append("people", spark.range(5).selectExpr("CAST(id AS INT) AS id", "'x' AS name", "CAST(1 AS FLOAT) AS age"))
    monkeypatch.undo()
    assert ids(people.sql("SELECT * FROM people")) == [1, 2, 3, 4, 5]
    assert people.store.vacuum("people") and people.store.count("people") == 5


def test_of_two_writers_the_second_is_told(people):
    from basalt.operators.store import Store

    other = Store(people.spark, people.store.root)
    mine, theirs = people.store.manifest("people"), other.manifest("people")
    people.store.save("people", mine)
    with pytest.raises(SqlError, match="another writer"):
        other.save("people", theirs)


def test_inserts_at_once_lose_nothing(people):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: people.execute(f"INSERT INTO people VALUES ({i}, 'T', 1)"), range(10, 18)))
    assert ids(people.sql("SELECT * FROM people")) == [1, 2, 3, 4, 5, *range(10, 18)]
    assert people.store.stored("people").select("_rid").distinct().count() == 13


def files_of(rows):
    return {f.rsplit("/", 2)[1] for f in rows.inputFiles()}


def test_a_declared_index_is_filled_and_used(engine):
    engine.execute("CREATE TABLE d (id INT INDEX btree, name VARCHAR[5] INDEX hash)")
    engine.execute("INSERT INTO d VALUES (1, 'a'), (2, 'b')")
    found = engine.sql("SELECT * FROM d WHERE id = 2 USING btree")
    assert ids(found) == [2] and all(f.startswith("index-") for f in files_of(found))
    assert "index-" in engine.sql("SELECT * FROM d WHERE name = 'a' USING hash").inputFiles()[0]
    engine.execute("INSERT INTO d VALUES (2, 'c')")
    assert ids(engine.sql("SELECT * FROM d WHERE id = 2 USING btree")) == [2, 2]
    engine.store.compact("d")
    found = engine.sql("SELECT * FROM d WHERE id = 2 USING btree")
    assert ids(found) == [2, 2] and all(f.startswith("index-") for f in files_of(found))
    engine.store.truncate("d")
    assert ids(engine.sql("SELECT * FROM d WHERE id = 2 USING btree")) == [] and set(engine.store.manifest("d").indexes) == {"id", "name"}


def test_a_stale_index_is_written_anew(engine, spark):
    engine.execute("CREATE TABLE d (id INT INDEX btree)")
    for start in (0, 2000, 4000):
        engine.append("d", spark.range(start, start + 2000).selectExpr("CAST(id AS INT) AS id"))
    m = engine.store.manifest("d")
    assert m.indexes["id"]["rows"] == m.rows == 6000


def test_many_delete_lists_are_folded(engine, spark):
    from basalt.operators import store

    engine.execute("CREATE TABLE d (id INT)")
    engine.store.append("d", spark.range(40).selectExpr("CAST(id AS INT) AS id"))
    for i in range(store.MOST_LISTS + 1):
        engine.execute(f"DELETE FROM d WHERE id = {i}")
    m = engine.store.manifest("d")
    assert len(m.deletes) == 1 and m.gone == 17 and ids(engine.sql("SELECT * FROM d")) == list(range(17, 40)) and m.rows == 23


def test_functions_that_overflow_drop_the_row(spark):
    rows = spark.createDataFrame([(1, -(2**31), float("nan")), (2, -5, 1e30), (3, 4, 2.5)], "id int, n int, d double")
    assert ids(query(rows, "SELECT id FROM t WHERE abs(n) > 3")) == [2, 3]
    assert ids(query(rows, "SELECT id FROM t WHERE round(d) = 2")) == [3]
