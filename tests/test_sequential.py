import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basalt.operators.sequential import SequentialTable
from basalt.plans.engine import Engine
from basalt.sources import csv as csv_source
from basalt.sources import fixed


@pytest.fixture
def table(engine):
    engine.execute("CREATE TABLE s (id INT, name VARCHAR[5])")
    return SequentialTable(engine.store, "s", "id")


def add(table, spark, *keys):
    return table.insert(spark.createDataFrame([(k, f"n{k}") for k in keys], "id int, name string"))


def keys(rows):
    return [r["id"] for r in rows.collect()]


def test_a_removed_key_hides_no_other(table, spark):
    add(table, spark, 3, 1, 2)
    table.reconstruct()
    assert table.remove(2) and not table.remove(2)
    assert keys(table.search(1)) == [1] and keys(table.range_search(1, 3)) == [1, 3] and keys(table.search(2)) == []


def test_delta_is_folded_in_when_full(table, spark):
    add(table, spark, 5, 4, 3)
    assert table.main_rows == 0
    add(table, spark, 2)
    assert table.main_rows == 3 and table.limit == 2 and keys(table.delta()) == [2]
    assert keys(table.range_search(0, 9)) == [2, 3, 4, 5]


def test_minus_one_is_a_key_like_any_other(table, spark):
    add(table, spark, -1, -1, 7)
    assert table.remove(-1) and keys(table.range_search(-5, 0)) == [-1]
    assert table.remove_all(-1) and not table.remove_all(-1)
    table.truncate()
    assert table.size() == 0


def test_limit_and_main_part_outlive_the_object(table, spark):
    add(table, spark, 5, 4, 3)
    add(table, spark, 2)
    again = SequentialTable(table.store, "s", "id")
    assert (again.limit, again.main_seq, again.main_rows) == (2, table.main_seq, 3) and keys(again.delta()) == [2]


def test_fixed_records_with_deleted_ones(spark, tmp_path):
    n = 10_000
    rows = pd.DataFrame({"id": range(n), "producto": [f"P{i}" for i in range(n)], "cantidad": 1, "precio": 0.5, "fecha": "x"})
    data = bytearray(fixed.encode(rows, fixed.SALES, "latin-1", b"\0"))
    data[52 * 7 : 52 * 8] = bytes(52)
    (tmp_path / "f.dat").write_bytes(data)
    got = sorted((r["_rid"], r["id"], r["producto"]) for r in fixed.read_fixed(spark, str(tmp_path / "f.dat"), fixed.SALES, "latin-1").collect())
    assert got == [(i, i, f"P{i}") for i in range(n) if i != 7]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.tuples(st.just("add"), st.lists(st.integers(0, 6), min_size=1, max_size=4)), st.tuples(st.just("remove"), st.integers(0, 6))), max_size=4))
def test_like_a_list(spark, tmp_path_factory, steps):
    engine, held = Engine(spark, str(tmp_path_factory.mktemp("t"))), []
    engine.execute("CREATE TABLE s (id INT, name VARCHAR[5])")
    table = SequentialTable(engine.store, "s", "id")
    for what, value in steps:
        if what == "add":
            held += value
            add(table, spark, *value)
        else:
            assert table.remove(value) == (value in held)
            if value in held:
                held.remove(value)
    assert keys(table.range_search(0, 6)) == sorted(held)


def test_sales_records():
    rows = pd.DataFrame({"id": [405], "producto": ["Tabléta"], "cantidad": [5], "precio": [750.0], "fecha": ["10/08/2024"]})
    data = fixed.encode(rows, fixed.SALES, "latin-1", b"\0")
    assert len(data) == 52 and data[4:11] == "Tabléta".encode("latin-1") and data[11] == 0
    assert fixed.decode(data, fixed.SALES, "latin-1").iloc[0].tolist() == [405, "Tabléta", 5, 750.0, "10/08/2024"]


def test_export_reads_back(engine, spark, tmp_path):
    csv_source.export(spark.createDataFrame([("a,b", 'say "x" now'), ("", "y")], "p string, q string").coalesce(1), str(tmp_path / "out"))
    engine.upload(str(tmp_path / "out"), "back")
    assert sorted(tuple(r) for r in engine.sql("SELECT * FROM back").collect()) == [("", "y"), ("a,b", 'say "x" now')]
