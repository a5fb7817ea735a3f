import json
import threading
import urllib.error
import urllib.request

import pytest

from basalt.api import serve
from basalt.plans.lexer import SqlError
from basalt.sources import csv as csv_source


def test_upload_report(engine, tmp_path):
    (tmp_path / "ragged.csv").write_text('Full Name,birth-year,Full Name\n"Doe, J",1990, x \nshort,1\nlong,1,2,3\n\n,,\n"say ""hi""",2,\'q\'\n')
    report = engine.upload(str(tmp_path / "ragged.csv"), "People")
    assert report["headers"] == ["full_name", "birth_year", "full_name_2"]
    assert (report["inserted"], report["failed"], report["recordCount"]) == (4, 2, 6)
    rows = [tuple(r) for r in engine.sql("SELECT * FROM people ORDER BY full_name").collect()]
    assert rows == [("", "", ""), ("Doe, J", "1990", "x"), ("long", "1", "2"), ('say "hi', "2", "q")]
    with pytest.raises(SqlError, match="exists"):
        engine.upload(str(tmp_path / "ragged.csv"), "PEOPLE")


@pytest.mark.parametrize("multi_line", [None, True])
def test_line_ends_inside_quotes(engine, tmp_path, multi_line):
    (tmp_path / "q.csv").write_text('a,b\n"one\n\ntwo",2\n\n"x ""y"" z",3\nshort\n')
    report = engine.upload(str(tmp_path / "q.csv"), "q", multi_line)
    assert (report["inserted"], report["failed"], report["recordCount"]) == (2, 2, 4)
    assert sorted(r["a"] for r in engine.sql("SELECT a FROM q").collect()) == ["one\n\ntwo", 'x "y" z']


def test_a_long_ragged_record_is_counted_quickly(engine, tmp_path):
    (tmp_path / "l.csv").write_text("a,b\n" + ",".join(['"x,y"'] * 50_000) + "\n")
    assert engine.upload(str(tmp_path / "l.csv"), "l")["inserted"] == 1


def test_empty_upload(engine, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert engine.upload(str(tmp_path / "e.csv"), "e")["inserted"] == 0


def test_typed_load_takes_the_first_rows(spark, tmp_path):
    lines = ["id;producto;cantidad;precio;fecha"] + [f"{i};P{i};{i};{i}.5;10/08/2024" for i in (614, 3, 681, 9, 1, 2, 4, 5, 6, 7, 8)]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    got = csv_source.read_typed(spark, str(tmp_path / "s.csv"), first=10).collect()
    assert [r["id"] for r in got] == [614, 3, 681, 9, 1, 2, 4, 5, 6, 7]
    assert got[0]["precio"] == 614.5


def test_http(engine):
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(path, body):
        data = body if isinstance(body, bytes) else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(base + path, data=data)) as reply:
            return json.load(reply)

    try:
        with urllib.request.urlopen(base + "/health") as reply:
            assert json.load(reply)["status"] == "ok"
        assert post("/upload?table_name=u", b"id,city\n1,Lima\n2,Cusco\n")["inserted"] == 2
        assert post("/create_index", {"index_type": "btree", "table_name": "u", "column": "city"})["ok"]
        assert post("/query", {"query": 'SELECT id FROM u WHERE city = "Lima"'}) == {"ok": True, "result": [{"id": "1"}]}
        assert not post("/query", {"query": "DROP TABLE u"})["ok"]
        with pytest.raises(urllib.error.HTTPError) as refused:
            post("/upload?table_name=u", b"id\n1\n")
        assert refused.value.code == 400 and json.load(refused.value) == {"ok": False, "error": "table exists: u"}
        mark = "----mark"
        form = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="p.csv"\r\nContent-Type: text/csv\r\n\r\nid,city\r\n1,"Li--{mark}ma"\n2,Cusco\n\r\n--{mark}\r\nContent-Disposition: form-data; name="table_name"\r\n\r\nforms\r\n--{mark}--\r\n'
        request = urllib.request.Request(base + "/upload", data=form.encode(), headers={"Content-Type": f"multipart/form-data; boundary={mark}"})
        with urllib.request.urlopen(request) as reply:
            report = json.load(reply)
        assert (report["ok"], report["fileName"], report["tableName"], report["inserted"]) == (True, "p.csv", "forms", 2)
        assert post("/query", {"query": "SELECT city FROM forms WHERE id = '1'"})["result"] == [{"city": f"Li--{mark}ma"}]
        assert engine.store.tables() == ["forms", "u"]
    finally:
        server.shutdown()


def test_first_rows_come_by_file_name(spark, tmp_path):
    head = "id;producto;cantidad;precio;fecha\n"
    (tmp_path / "part-0.csv").write_text(head + "1;a;1;1.0;x\n2;b;1;1.0;x\n")
    (tmp_path / "part-1.csv").write_text(head + "".join(f"{i};a longer name;1;1.0;x\n" for i in range(3, 50)))
    assert [r["id"] for r in csv_source.read_typed(spark, str(tmp_path), first=4).collect()] == [1, 2, 3, 4]


def test_query_returns_every_row(engine, spark):
    engine.execute("CREATE TABLE many (id INT, v INT)")
    engine.store.append("many", spark.range(10_500).selectExpr("cast(id AS int) id", "cast(nullif(id % 3, 0) AS int) v"))
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        data = json.dumps({"query": "SELECT id, v FROM many ORDER BY id"}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/query", data=data)) as reply:
            got = json.load(reply)
    finally:
        server.shutdown()
    assert got == {"ok": True, "result": [{"id": i, "v": i % 3 or None} for i in range(10_500)]}


def test_a_row_that_fails_after_others_is_told(engine, spark, monkeypatch):
    from basalt.plans.engine import Result

    rows = spark.range(0, 100, 1, 4).selectExpr("if(id < 90, id, raise_error('row ninety')) AS id")
    monkeypatch.setattr(engine, "execute", lambda text: Result(rows=rows))
    got = engine.answer("SELECT id FROM t")
    assert not got["ok"] and got["error"] and [r["id"] for r in got["result"]][:75] == list(range(75))
    monkeypatch.setattr(engine, "execute", lambda text: Result(rows=rows.limit(0)))
    assert engine.answer("SELECT id FROM t") == {"ok": True, "result": []}
