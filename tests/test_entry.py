import duckdb
import pytest

import __spark_entry__ as entry
from basalt.plans import catalogue
from compare import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_engine_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_orders_go_through_the_sequential_table(spark, monkeypatch):
    taken, insert = [], catalogue.SequentialTable.insert
    monkeypatch.setattr(catalogue.SequentialTable, "insert", lambda self, new: taken.append(insert(self, new)) or taken[-1])
    assert catalogue.sequential_table(spark, "/root/testdata/sf0.01").count() == 100
    assert sum(taken) == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count() > 1001


def test_all_of_part_goes_through_the_csv_file(spark, monkeypatch):
    held, read = [], catalogue.csv_source.read_typed
    monkeypatch.setattr(catalogue.csv_source, "read_typed", lambda spark, path, first: held.append(read(spark, path).count()) or read(spark, path, first=first))
    assert catalogue.csv_load_typed_limit10(spark, SF).count() == 10
    assert held == [spark.read.parquet(f"{SF}/part.parquet").count()] and held[0] > 20
