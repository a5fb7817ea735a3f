import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from basalt.llm import mixing

from .helpers import AWKWARD, clashing, docs


def water(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        target |= {s: float(3 * sizes[s]) for s in over} if over else {s: level * weight[s] for s in open_}
        open_ -= over or open_
    return target


ROWS = [(i, "word " * (i % 17), None, ("a", "b", "c", None)[i % 4 if i % 5 else 0]) for i in range(400)] + [(1000, "big " * 3000, None, "d"), (1001, "", None, "e"), (1002, None, None, "f")] + [(2000 + i, "x ###", None, "tiny") for i in range(2)]


def test_targets_and_budgets(spark):
    out = mixing.mix(docs(spark, ROWS)).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    sizes = {(None if s != s or s is None else s): int(n) for s, n in sizes.items()}
    want = water(sizes)
    assert len(out) == len(ROWS)
    for source, part in out.groupby("source", dropna=False):
        key = None if source != source or source is None else source
        assert part["target"].iloc[0] == pytest.approx(want[key])
        assert part["source_size"].iloc[0] == sizes[key]
        assert part["taken"].sum() == int(part["target"].iloc[0] + 0.5)
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] >= 0).all()
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_epochs_come_before_the_fraction(spark):
    out = mixing.mix(docs(spark, ROWS)).toPandas()
    for _, part in out[out["size"] > 0].groupby("source", dropna=False):
        times = part["taken"] / part["size"]
        assert times.max() - times.min() <= 1


def test_bins_do_not_change_the_choice(spark, monkeypatch):
    first = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, ROWS)).collect()}
    monkeypatch.setattr(mixing, "BIN_DOCS", 2)
    monkeypatch.setattr(mixing, "BINS", 3)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, ROWS)).collect()} == first


@pytest.mark.parametrize("quality", [0.01, 1.0, 100.0])
def test_a_large_source_is_narrowed_to_a_small_sort(spark, monkeypatch, quality):
    monkeypatch.setattr(mixing, "BIN_DOCS", 50)
    states, narrowed = [], mixing._narrowed
    monkeypatch.setattr(mixing, "_narrowed", lambda keyed, state: states.append(narrowed(keyed, state)) or states[-1])
    frame = docs(spark, [(i, f"word {i} of it", None, "hot" if i < 4000 else "b") for i in range(6000)]).withColumn("q", F.lit(quality))
    out = mixing.mix(frame, quality_col="q", weights=(1, 1)).toPandas()
    assert max(r["docs"] for r in states[0].where("rest > 0").collect()) <= 50
    for _, part in out.groupby("source"):
        assert part["taken"].sum() == int(part["target"].iloc[0] + 0.5)


def test_rows_all_alike_are_split_by_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_DOCS", 20)
    rows = [(None, "the same words", None, "a")] * 3000 + [(i, "other words", None, "b") for i in range(1000)]
    out = mixing.mix(docs(spark, rows), weights=(1, 2)).toPandas()
    assert len(out) == 4000
    for _, part in out.groupby("source"):
        assert part["taken"].sum() == int(part["target"].iloc[0] + 0.5)


def test_many_sources_meet_without_broadcast(spark, monkeypatch):
    first = sorted(map(str, mixing.mix(docs(spark, ROWS)).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    monkeypatch.setattr(mixing, "HOT_SHARE", 0.2)
    assert sorted(map(str, mixing.mix(docs(spark, ROWS)).collect())) == first


def test_quality_raises_the_chance(spark):
    rows = [(i, "w " * 10, None, "a" if i < 1000 else "b") for i in range(1500)]
    frame = docs(spark, rows).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    out = mixing.mix(frame, quality_col="q", weights=(1, 3)).toPandas()
    part = out[out["source"] == "a"]
    good, poor = part[part["doc_id"] % 2 == 0]["taken"].sum(), part[part["doc_id"] % 2 == 1]["taken"].sum()
    assert good > 1.5 * poor


def test_awkward_rows(spark):
    out = mixing.mix(clashing(docs(spark, AWKWARD))).toPandas()
    assert len(out) == len(AWKWARD) and out["taken"].sum() == out["size"].sum()
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")])).toPandas()["taken"].tolist() == [0, 0]


def test_counts_equal_the_patterns(spark):
    texts = ["", " ", "\t\n\x0b\x0c\r ", "x", " x", "x ", " x  xx\r\n", "a\x1cb\x85c\u00a0d\u2003e \x00", "$1 \\ x# #x ##$ |", "####", "  # ", "Ä 中文 \U0001f600\U0001f600 ñ", "x " * 3000, " " * 3000]
    frame = docs(spark, list(enumerate(texts))).select("doc_id", mixing.n_words(F.col("text")).alias("w"), mixing.n_marks(F.col("text")).alias("m"))
    got = {r["doc_id"]: (r["w"], r["m"]) for r in frame.collect()}
    assert got == {i: (len(re.findall(mixing.WORD, t)), len(re.findall(mixing.MARKS, t))) for i, t in enumerate(texts)}


LONG_TEXT = """
from pyspark.sql import functions as F
from basalt.llm import mixing
from basalt.session import local_session
spark = local_session(cores=1, memory="512m", shuffle_partitions=1)
text = F.repeat(F.concat(F.lit("a "), F.when(F.col("id") > 0, "b").otherwise("")), (F.col("id") + 8_000_000).cast("int"))
docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), text.alias("text"))
print("taken", mixing.mix(docs).first()["taken"])
"""


def test_a_long_text_takes_no_multiple_of_its_size():
    """16 MB of short words in a heap of 512 MB; an array of all words does not fit there."""
    done = subprocess.run([sys.executable, "-c", LONG_TEXT], capture_output=True, text=True, timeout=240)
    assert "taken 8000000" in done.stdout, done.stderr[-2000:]
