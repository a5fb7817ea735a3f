import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.operators import indexes, spatial
from basalt.plans.catalogue import CITIES, cities

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(st.lists(st.integers(-20, 20), max_size=30), st.lists(st.integers(-25, 25), max_size=15))
def test_sparse_floor(spark, keys, probes):
    index = spark.createDataFrame([(k,) for k in keys], "k long")
    asked = spark.createDataFrame([(p,) for p in probes], "p long")
    got = [(r["p"], r["floor_key"]) for r in indexes.sparse_floor(asked, "p", index, "k").collect()]
    want = [(p, max((k for k in keys if k <= p), default=None)) for p in probes]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sparse_floor_of_texts_and_nulls(spark):
    index = spark.createDataFrame([("b",), ("m",), (None,)], "k string")
    asked = spark.createDataFrame([("a",), ("c",), ("z",), (None,), ("c",)], "p string")
    got = sorted(map(str, ((r["p"], r["floor_key"]) for r in indexes.sparse_floor(asked, "p", index, "k").collect())))
    assert got == sorted(map(str, [("a", None), ("c", "b"), ("c", "b"), ("z", "m"), (None, None)]))


@QUICK
@given(st.lists(st.integers(0, 1000), max_size=40), st.integers(1, 4))
def test_pages(spark, keys, per_page):
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = sorted((r["page_no"], r["slot"], r["k"]) for r in indexes.paged(rows, "k", per_page).collect())
    assert got == [(i // per_page, i % per_page, k) for i, k in enumerate(sorted(keys))]


def halved(keys, most):
    return [keys] if len(keys) <= most else halved(keys[: len(keys) // 2], most) + halved(keys[len(keys) // 2 :], most)


@QUICK
@given(st.sets(st.integers(0, 60), min_size=1, max_size=12), st.sets(st.integers(-10, 90), max_size=40), st.integers(1, 3))
def test_pages_chain_split_and_are_searched(spark, first, later, per_page):
    later, first = sorted(later - first), sorted(first)
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "k long")
    pages = indexes.paged(frame(first), "k", per_page)
    index = {first[i]: i // per_page for i in range(0, len(first), per_page)}
    page_of = lambda k: index[max((f for f in index if f <= k), default=first[0])]
    came = {p: [k for k in later if page_of(k) == p] for p in index.values()}
    ends = pages.groupBy("page_no").agg(F.min("k").alias("f"))
    chains = indexes.overflow(ends, "f", "page_no", frame(later), "k", per_page)
    assert sorted((r["k"], r["page_no"], r["chain"]) for r in chains.collect()) == sorted((k, p, i // per_page) for p, ks in came.items() for i, k in enumerate(ks))
    held = {p: sorted([*came[p], *(k for k in first if page_of(k) == p)]) for p in came}
    got = sorted((r["page_no"], r["first"], r["size"], r["k"]) for r in indexes.split_insert(pages, "k", frame(later), per_page).collect())
    want = []
    for p, ks in held.items():
        at = 0
        for piece in halved(ks, per_page):
            want += [(p, at, len(piece), k) for k in piece]
            at += len(piece)
    assert got == sorted(want)
    asked = spark.createDataFrame([(k,) for k in range(-12, 95, 3)], "p long")
    everything = pages.select("k", "page_no").unionByName(chains.select("k", "page_no"))
    found = sorted((r["p"], r["page_no"]) for r in indexes.page_search(everything.where(F.col("k") >= first[0]), "k", asked, "p").collect())
    assert found == sorted((k, p) for p, ks in held.items() for k in ks if k >= first[0] and (k + 12) % 3 == 0)


def test_a_long_chain_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(indexes, "HOT_SHARE", 0.5)
    pages = indexes.paged(spark.range(10).selectExpr("id AS k"), "k", 2)
    ends = pages.groupBy("page_no").agg(F.min("k").alias("f"))
    got = indexes.overflow(ends, "f", "page_no", spark.range(10, 3000).selectExpr("id AS k"), "k", 2)
    assert {(r["k"], r["chain"]) for r in got.collect()} == {(k, (k - 10) // 2) for k in range(10, 3000)}


@QUICK
@given(st.lists(st.integers(0, 9), max_size=20), st.lists(st.integers(0, 9), max_size=20), st.sets(st.integers(0, 9)))
def test_merge_is_a_bag_without_the_deleted(spark, main, delta, gone):
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "k long")
    got = indexes.merged(frame(main), frame(delta), ~F.col("k").isin(*gone) if gone else F.lit(True))
    assert sorted(r["k"] for r in got.collect()) == sorted(k for k in main + delta if k not in gone)


def test_circle_equals_plain_haversine(spark):
    def km(lat, lng):
        a = math.sin(math.radians(lat + 12.0464) / 2) ** 2 + math.cos(math.radians(-12.0464)) * math.cos(math.radians(lat)) * math.sin(math.radians(lng + 77.0428) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(a))

    for radius in (0, 150, 500, 800, 20000):
        got = {r["id"] for r in spatial.within_circle(cities(spark), "lat", "lng", -12.0464, -77.0428, radius).collect()}
        assert got == {i for i, _, lat, lng, _ in CITIES if km(lat, lng) <= radius}


@pytest.mark.parametrize("at", [(0.0, 179.9), (89.5, 10.0), (-89.9, 0.0)])
def test_box_holds_the_circle(spark, at):
    rows = spark.range(0, 36 * 18).selectExpr("(id % 36) * 10.0 - 180 AS lng", "(id div 36) * 10.0 - 85 AS lat").selectExpr("cast(lng AS double) lng", "cast(lat AS double) lat")
    boxed = spatial.within_circle(rows, "lat", "lng", *at, 1500.0).count()
    assert boxed == rows.where(spatial.haversine_km(F.col("lat"), F.col("lng"), *at) <= 1500.0).count() > 0


def test_map_place(spark):
    left, top = spatial.map_place(F.col("lng") * 0 - 18, F.col("lng") * 0 - 81)
    assert tuple(cities(spark).select(left, top).first()) == (0.0, 0.0)
