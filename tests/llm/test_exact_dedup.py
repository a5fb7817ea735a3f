import hashlib

import pytest

from basalt.llm import exact_dedup

from .helpers import AWKWARD, clashing, docs


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault((text or "").translate(low), []).append((doc is not None, doc or 0, i))
    out = []
    for text, group in groups.items():
        known, best, place = max(group)
        for has, doc, i in group:
            out.append((doc if has else None, best if known else None, len(group), i == place, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = AWKWARD + [(10, "Abc"), (11, "aBC"), (12, "ÄBC"), (13, "äbc"), (14, "abc"), (None, "only null"), (None, "only null")] + [(100 + i, "hot copy") for i in range(200)]


@pytest.mark.parametrize("winners", [1, 3, 2000])
def test_equals_brute_force_however_many_winners(spark, winners):
    assert got(exact_dedup.exact_dedup(docs(spark, ROWS), winners=winners, counters=max(4, winners))) == brute(ROWS)


def test_extra_columns_and_empty_table(spark):
    assert got(exact_dedup.exact_dedup(clashing(docs(spark, ROWS), ()))) == brute(ROWS)
    assert got(exact_dedup.exact_dedup(docs(spark, []))) == []


def test_dropping_keeps_one_whole_row_of_each_group(spark):
    frame = clashing(docs(spark, ROWS))
    kept = exact_dedup.drop_exact_copies(frame, winners=2, counters=10)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in brute(ROWS) if r[3]), key=str)
    assert exact_dedup.drop_exact_copies(docs(spark, [])).count() == 0


def test_a_row_repeated_very_often_keeps_one(spark):
    frame = spark.range(300_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text")
    out = exact_dedup.exact_dedup(frame).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in out} == {True: 1, False: 299_999}
    assert exact_dedup.drop_exact_copies(frame).count() == 1


def test_columns_with_names_once_used_inside(spark):
    frame = docs(spark, ROWS).selectExpr("*", "'x' AS __key", "'x' AS __id", "1 AS row", "2 AS same", "3 AS rank")
    kept = exact_dedup.drop_exact_copies(frame, winners=2, counters=10)
    assert kept.columns == frame.columns and kept.count() == sum(r[3] for r in brute(ROWS))
