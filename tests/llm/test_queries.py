import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from basalt.llm import decontaminate, queries
from compare import TABLES, rows

from .helpers import AWKWARD, clashing, docs as make_docs
from .test_decontaminate import words
from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(queries.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(spark, name):
    table = "pages" if name.startswith("op2") else "documents"
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_near_dedup_query_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.queries()["op7_near_dedup"](spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == near_brute(docs, 3, 85)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against what it is to do with the rows it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mixing"]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        given, left = [tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()]
        kept[name] = len(left)
        if name == "quality":
            assert docs.columns == columns and set(left) <= set(given) and 0.7 < len(left) / len(given) < 0.95
        elif name == "exact_dedup":
            best = {}
            for r in given:
                key = r[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                best[key] = max(best.get(key, r), r, key=lambda x: x[0])
            assert docs.columns == columns and sorted(left) == sorted(best.values())
        elif name == "near_dedup":
            want = {r[0] for r in near_brute([r[:2] for r in given], 5, 80) if r[3]}
            assert docs.columns == columns and sorted(r[0] for r in left) == sorted(want)
        elif name == "decontaminate":
            items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            wins = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
            dirty = {r[0] for r in given if any(tuple(words(r[1])[i : i + 10]) in wins for i in range(len(words(r[1]))))}
            assert docs.columns == columns and {r for r in given if r[0] not in dirty} <= set(left)
            changed = {r[0]: r[1] for r in left if r[0] in dirty}
            assert all(r[4] == len(r[1]) for r in left)
            assert all(len(changed[d]) < len(t) for d, t, *_ in given if d in changed)
        else:
            assert len(left) == len(given) and docs.columns[:2] == ["doc_id", "source"]
    assert corpus_pipeline.run(spark, SF).count() == kept["mixing"]


def test_a_failed_run_goes_on_after_its_last_finished_stage(spark, tmp_path, monkeypatch):
    called = []

    def stage(name, fail):
        def run(spark, docs, sf_dir):
            called.append(name)
            if fail and called.count(name) == 1:
                raise RuntimeError("lost")
            return docs.where(docs["doc_id"] % 3 != len(name) % 3)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a", False), stage("bb", False), stage("ccc", True)])
    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, SF, folder)
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["1-bb"]
    assert corpus_pipeline.run(spark, SF, folder).count() == 0 and called == ["a", "bb", "ccc", "ccc"]
    # a run without a folder of its own leaves nothing when it fails
    called.clear()
    before = set(corpus_pipeline.files.children(spark, corpus_pipeline.checkpoint_dir(spark)))
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, SF)
    assert set(corpus_pipeline.files.children(spark, corpus_pipeline.checkpoint_dir(spark))) == before


def test_the_mix_weighs_documents_by_their_quality_score(spark):
    from basalt.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect():
        assert r["quality"] == pytest.approx(scores[r["doc_id"]], rel=1e-6)


@pytest.mark.parametrize("texts", [[None, None], ["", ""], ["...", "\n"], ["same text", "same text"]])
def test_every_query_over_dull_tables(spark, tmp_path, texts):
    for t in ("documents", "pages", "labels", "benchmark"):
        frame = spark.read.parquet(f"{SF}/{t}.parquet").limit(0)
        if t == "documents":
            frame = frame.unionByName(spark.createDataFrame([(i, x, None, None, None) for i, x in enumerate(texts)], frame.schema))
        if t == "pages":
            frame = frame.unionByName(spark.createDataFrame([(i, x, None) for i, x in enumerate(texts)], frame.schema))
        frame.write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == len(texts), name


@pytest.mark.parametrize("rows", [AWKWARD, [], [(1, None)]])
def test_stages_over_awkward_tables(spark, rows):
    frame = clashing(make_docs(spark, rows))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        got = out.collect()
        if name == "mixing":
            assert len(got) == len(rows)
        else:
            assert out.columns == frame.columns and len(got) <= len(rows)
        if name in ("exact_dedup", "near_dedup") and rows is AWKWARD:
            ids = [r["doc_id"] for r in got]
            assert {4, 5, None, 9} <= set(ids) and len([i for i in ids if i in (6, 7)]) == 1
        if name == "decontaminate":
            assert sorted(map(str, got)) == sorted(map(str, frame.collect()))


def test_window_is_the_one_of_the_contract():
    assert decontaminate.WINDOW == 10
