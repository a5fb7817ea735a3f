import pandas as pd
import pytest
from pyspark.sql import functions as F

from basalt.functions import codec
from basalt.functions.codec import ColumnType, parse_type
from basalt.sources import fixed


def through(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_int(spark):
    assert through(spark, ["", "0", " 12 ", "3.7", "abc", "2147483648", "-5"], codec.to_int) == [0, 0, 12, 0, 0, None, -5]


def test_float(spark):
    got = through(spark, ["", "0.1", "x", "1e3", None], codec.to_float)
    assert got == pytest.approx([0.0, 0.1, 0.0, 1000.0, 0.0], abs=1e-6)


def test_varchar_cuts_at_a_character(spark):
    assert through(spark, ["añb", "abc", " a ", "'x'", None, "\tñandu\n"], lambda v: codec.to_varchar(v, 2)) == ["a", "ab", "a", "x", "", "ñ"]


def test_date(spark):
    got = through(spark, ["01-02-2024", "1-2-2024", "2024-02-01", "10/08/2024", ""], codec.to_date_text)
    assert got == ["2024-02-01", "2024-2-1", "2024-02-01", "10/08/2024", "0000-00-00"]


def test_typed_date(spark):
    got = through(spark, ["2024-02-01", "2024-2-1", "0000-00-00", "no"], codec.date_of)
    assert [str(g) for g in got] == ["2024-02-01", "2024-02-01", "None", "None"]


def test_point(spark):
    assert through(spark, ["[1.5, -2]", "3", "", "1,2,3"], codec.to_point) == [[1.5, -2.0], [0.0, 0.0], [0.0, 0.0], [1.0, 2.0]]


def test_headers():
    assert codec.normalise_headers([" Full Name", "birth-year", "Full Name", "country/region"]) == ["full_name", "birth_year", "full_name_2", "country/region"]


def test_strict_types():
    with pytest.raises(ValueError, match="unsupported type"):
        parse_type("BLOB", strict=True)


COLUMNS = [("id", ColumnType("INT")), ("producto", ColumnType("VARCHAR", 20)), ("cantidad", ColumnType("INT")), ("precio", ColumnType("FLOAT")), ("fecha", ColumnType("VARCHAR", 20)), ("p", ColumnType("ARRAY"))]


def test_fixed_records_round_trip(spark, tmp_path):
    rows = pd.DataFrame({"id": [614, 681, 0], "producto": ["Tablet", "Ñandú", ""], "cantidad": [5, 1, 0], "precio": [750.0, 0.1, 0.0], "fecha": ["10/08/2024"] * 2 + [""], "p": [[1.0, 2.0], [0.5, -1.0], [0.0, 0.0]]})
    assert fixed.layout(COLUMNS[:5]).itemsize == 52
    data = fixed.encode(rows, COLUMNS)
    back = fixed.decode(data, COLUMNS)
    assert back["producto"].tolist() == rows["producto"].tolist() and back["id"].tolist() == [614, 681, 0]
    width = fixed.layout(COLUMNS).itemsize
    path = tmp_path / "sales.dat"
    path.write_bytes(data[:width] + bytes(width) + data[width:])  # the second record is deleted
    got = fixed.read_fixed(spark, str(path), COLUMNS).orderBy("_rid").collect()
    assert [(r["id"], r["producto"], r["_rid"]) for r in got] == [(614, "Tablet", 0), (681, "Ñandú", 2), (0, "", 3)]
