import random
import re

import numpy as np
import pytest

from basalt.llm import near_dedup, shingles
from basalt.llm.components import components

from .helpers import AWKWARD, clashing, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    out = []
    for (doc, _), s, r in zip(rows, sets, root, strict=True):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None] if s else [doc]
        least = min((i for i in ids if i is not None), default=None)
        out.append((doc, len(s), least, doc == least))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def corpus(seed, n=160):
    """Unlike texts, chains of texts each a little unlike the one before, copies with some words changed, copies in capitals."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rng.randint(2, 80))]
        for _ in range(rng.choice((1, 1, 1, 4, 12))):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.2:
                rows.append((len(rows), "\n".join(base).upper()))
    return rows + [(1000 + (i or 0), t) if i is not None else (None, t) for i, t in AWKWARD if t is None or len(t) < 1000]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus(k)
    assert got(near_dedup.near_groups(docs(spark, rows), k=k, percent=percent)) == brute(rows, k, percent)


@pytest.mark.parametrize("split", [2, 10**6])
def test_large_buckets_and_components_too_large_for_a_task(spark, monkeypatch, split):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "SPLIT_BUCKET", split)
    monkeypatch.setattr(near_dedup, "TASK_CLASSES", 3)
    rows = corpus(9)
    assert got(near_dedup.near_groups(docs(spark, rows), k=3, percent=85)) == brute(rows, 3, 85)


@pytest.mark.parametrize("split", [8, 10**6])
def test_a_large_group_beside_texts_with_one_passage(spark, monkeypatch, split):
    """Near copies of one text, and texts that only share a passage, in buckets that are large here."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 8)
    monkeypatch.setattr(near_dedup, "SPLIT_BUCKET", split)
    monkeypatch.setattr(near_dedup, "TASK_CLASSES", 16)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(80)], [word() for _ in range(60)]
    texts = []
    for _ in range(90):
        near = list(base)
        near[rng.randrange(80)] = word()
        texts += [" ".join(near), " ".join([*passage, *(word() for _ in range(rng.randint(5, 40)))])]
    rows = list(enumerate(texts))
    seen, large = [], near_dedup._links_of_large
    monkeypatch.setattr(near_dedup, "_links_of_large", lambda rows, percent: seen.append(rows.count()) or large(rows, percent))
    assert got(near_dedup.near_groups(docs(spark, rows), k=3, percent=85)) == brute(rows, 3, 85)
    assert seen


def test_hot_classes_meet_their_component_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_SHARE", 0.01)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(150)] + [(200 + i, " ".join([*base[:59], f"x{i}"])) for i in range(5)] + [(300 + i, None) for i in range(200)] + [(None, "by itself it stands")]
    assert got(near_dedup.near_groups(docs(spark, rows), k=3, percent=85)) == brute(rows, 3, 85)


def test_null_and_repeated_ids_lose_no_link(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:59], "other"]
    far = [*base[:58], "and", "then"]
    rows = [(None, " ".join(base)), (8, " ".join(near)), (8, " ".join(far)), (8, " ".join(far)), (None, "alone it stands here"), (None, " ".join(far).upper())] + [(5, " ".join(near))] * 40
    assert got(near_dedup.near_groups(docs(spark, rows), k=3, percent=85)) == brute(rows, 3, 85)
    kept = near_dedup.drop_near_copies(docs(spark, rows), k=3, percent=85).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["5", "None"]


def test_clashing_columns_and_empty_tables(spark):
    rows = corpus(4, 30)
    frame = clashing(docs(spark, rows))
    assert got(near_dedup.near_groups(frame, k=3, percent=85)) == brute(rows, 3, 85)
    kept = near_dedup.drop_near_copies(frame, k=3, percent=85)
    assert kept.columns == frame.columns
    want = {r[0] for r in brute(rows, 3, 85) if r[3]}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == want and len(ids) == len(want)
    assert near_dedup.near_groups(docs(spark, [])).count() == 0
    assert near_dedup.near_groups(docs(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_word_hashes_split_as_the_pattern_does():
    texts = ["a b\tc\x0bd\x0c e", "", None, "Ä ä x", " lead", "x" * 1000]
    hashes, counts = shingles.word_hashes(texts)
    assert counts.tolist() == [len(WORD.findall((t or "").translate(LOW))) for t in texts]
    seen = {}
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        for w, h in zip(WORD.findall((t or "").translate(LOW)), hashes[at : at + n].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
        at += n
    assert len(set(seen.values())) == len(seen)


def test_sketches_fill_and_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(base[:n]) for n in (0, 1, 2, 50, 300, 1000)] + [np.unique(base[200:1200])]
    made = shingles.sketches(sets, 256)
    assert (made[0] == shingles.EMPTY).all() and (made[1:] != shingles.EMPTY).all()
    assert abs((made[5] == made[6]).mean() - 800 / 1200) < 0.12
    assert (made[3] == shingles.sketches([sets[3]], 256)[0]).all()


def test_bands_hold_what_they_promise():
    for threshold in (0.5, 0.8, 0.85):
        bands, rows = shingles.bands_for(threshold, 256)
        assert (1 - threshold**rows) ** bands < 1e-5


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: r for x, r in root.items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
