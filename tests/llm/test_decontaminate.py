import hashlib
import random
import re
import weakref

import pytest

from basalt.llm import decontaminate as d

from .helpers import AWKWARD, clashing, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items, window=10):
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            n = min(window, len(b))
            if not n:
                continue
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(str(item) if item is not None else "null")
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r)[:6] for r in frame.collect()), key=repr)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def cases(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "dé", "e1"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(1, 25))) for i in range(25)] + [(30, None), (31, "!!!"), (None, say(12)), (5, say(14)), (7, "b b")]
    rows = [(i, say(rng.randint(0, 60))) for i in range(40)] + [(100, "z " + items[3][1].upper() + " z"), (101, "z, ".join(items[4][1].split(" ")))] + AWKWARD
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most_words", [10**6, 60, 20])
def test_equals_brute_force(spark, seed, most_words):
    rows, items = cases(seed)
    assert got(d.scan_documents(docs(spark, rows), bench(spark, items), most_words=most_words)) == brute(rows, items)


def test_long_windows_and_repeats(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "x " + item + " y"), (2, " ".join(item.split()[:9])), (3, " ".join(item.split()[2:12]) + " one two"), (4, "a " * 30)]
    items = [(1, item), (2, "a " * 11)]
    assert got(d.scan_documents(docs(spark, rows), bench(spark, items))) == brute(rows, items)


def test_empty_tables_and_clashing_columns(spark):
    rows, items = cases(3)
    assert got(d.scan_documents(clashing(docs(spark, rows)), clashing(bench(spark, items)))) == brute(rows, items)
    assert got(d.scan_documents(docs(spark, []), bench(spark, items))) == []
    assert got(d.scan_documents(docs(spark, rows), bench(spark, []))) == brute(rows, [])


def test_spans_are_cut_out_and_mostly_benchmark_goes(spark):
    item = "one two three four five six seven eight nine ten"
    clean = "Nothing, to see here."
    rows = [(1, clean), (2, "Before it: " + item.upper() + "! After it, there is more than enough to keep in this text today."), (3, item + " end"), (4, None)]
    frame = clashing(docs(spark, rows), ("cleaned",))
    kept = {r["doc_id"]: r["text"] for r in d.decontaminate(frame, bench(spark, [(1, item)])).collect()}
    assert kept == {1: clean, 2: "Before it: ! After it, there is more than enough to keep in this text today.", 4: None}
    assert d.decontaminate(frame, bench(spark, [(1, item)])).columns == frame.columns


def test_the_driver_holds_one_automaton_at_a_time(spark, monkeypatch):
    make, made = d.SuffixAutomaton.__init__, []

    def count(self, *args):
        assert not any(ref() for ref in made)  # the ones before are gone
        made.append(weakref.ref(self))
        make(self, *args)

    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(9)] + [(100, " ".join(f"long{j}" for j in range(500)))]
    lists = list(d.dealt(items, most_words=120))
    assert len(lists) >= 3 and all(sum(len(w) for _, w in part) <= 120 for part in lists)
    monkeypatch.setattr(d.SuffixAutomaton, "__init__", count)
    rows = [(1, items[0][1]), (2, items[8][1] + " and " + items[3][1]), (3, " ".join(items[9][1].split()[100:130])), (4, "nothing")]
    assert got(d.scan_documents(docs(spark, rows), bench(spark, items), most_words=120)) == brute(rows, items)
    assert len(made) == len(lists)


def test_one_automaton_takes_one_pass(spark):
    plan = d.scan_documents(docs(spark, [(1, "a")]), bench(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
