import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import language, licenses, quality, toxicity

from .helpers import AWKWARD, clashing, docs

SF = "/root/testdata/sf0.01"


def bucket(doc, mod):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % mod


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    pos = (label == 1).sum()
    return (rank[label == 1].sum() - pos * (pos - 1) / 2) / (pos * (label != 1).sum())


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(frame, labels, column):
    joined = frame.join(labels, "doc_id").where("held_out").toPandas()
    return joined["score"].to_numpy(), joined[column].to_numpy(), joined["predicted"].to_numpy()


def test_quality_on_held_out_rows(corpus):
    documents, labels = corpus
    scored = quality.score_quality(documents, quality.fit(documents, labels))
    score, label, predicted = held_out(scored, labels, "quality")
    assert auc(score, label) > 0.9 and (predicted == label).mean() > 0.9
    rows = scored.toPandas()
    assert len(rows) == documents.count() and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == [bucket(d, 5) == 0 for d in rows["doc_id"]]).all()


def two_classes(share, n=3000, seed=0):
    """(positives, unlabelled rows, which of those are positive)"""
    rng = np.random.default_rng(seed)
    draw = lambda n, at: rng.normal(at, 1, (n, quality.WIDTH)).astype(np.float32)
    truth = rng.random(n) < share
    return draw(n // 3, 0.2), np.where(truth[:, None], draw(n, 0.2), draw(n, -0.2)), truth


def test_quality_learns_without_any_negative():
    positive, unlabelled, truth = two_classes(0.6)
    net = quality.train(positive, unlabelled, steps=200)
    assert (net.score(unlabelled[truth]) > 0.5).mean() > 0.9 and (net.score(unlabelled[~truth]) < 0.5).mean() > 0.9


@pytest.mark.parametrize("share", [0.1, 0.35, 0.6, 0.9])
def test_prior_is_near_the_hidden_share(share):
    positive, unlabelled, truth = two_classes(share, seed=int(share * 100))
    assert abs(quality.estimate_prior(positive, unlabelled) - truth.mean()) < 0.1


def test_prior_of_the_corpus(spark, corpus):
    documents, labels = corpus
    found, estimate = [], quality.estimate_prior
    try:
        quality.estimate_prior = lambda *a: found.append(estimate(*a)) or found[-1]
        # the labels of negatives are not read: without them the model is the same
        both = [quality.fit(documents, part) for part in (labels, labels.where("quality = 1"))]
    finally:
        quality.estimate_prior = estimate
    assert abs(found[0] - labels.toPandas()["quality"].mean()) < 0.1
    assert all(np.array_equal(a, b) for a, b in zip(*(net.p for net in both), strict=True))


@pytest.mark.parametrize("case", ["null ids", "one id", "one row"])
def test_samples_stay_bounded_whatever_the_ids(spark, case):
    from basalt.llm import samples

    key = {"null ids": "CAST(NULL AS BIGINT)", "one id": "CAST(7 AS BIGINT)", "one row": "CAST(7 AS BIGINT)"}[case]
    text = "'the same'" if case == "one row" else "CONCAT('text ', id)"
    frame = spark.range(20_000).selectExpr(f"{key} AS doc_id", f"{text} AS text", "'en' AS lang", "1 AS label", "2 AS __id", "3 AS __key")
    labels = spark.range(20_000).selectExpr(f"{key} AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS text")
    assert samples.bounded(frame, 500, ["doc_id", "text"]).count() == (1 if case == "one row" else 500)
    assert samples.bounded_by(frame, "lang", 500, ["doc_id", "text"]).count() == (1 if case == "one row" else 500)
    got = samples.labelled_sample(frame, labels, "quality", 500).toPandas()
    assert len(got) == {"null ids": 0, "one id": 500, "one row": 1}[case] and set(got.columns) == {"text", "label", samples.HASH}


def test_samples_agree_on_reruns_and_take_the_whole_of_a_small_table(corpus):
    from basalt.llm import samples

    documents, labels = corpus
    a, b = (sorted(r["doc_id"] for r in samples.bounded(d, 100, ["doc_id", "text"]).collect()) for d in (documents, documents.repartition(7)))
    assert a == b and len(a) == 100
    assert samples.bounded(documents, 10**6, ["doc_id", "text"]).count() == documents.count()


LONG_TEXTS = """
from pyspark.sql import functions as F
from basalt.llm import quality
from basalt.session import local_session
spark = local_session(cores=1, memory="512m", shuffle_partitions=1)
rows = spark.range(0, 90, 1, 15).withColumn("doc_id", F.col("id"))
docs = rows.select("doc_id", F.repeat(F.concat(F.lit("a"), F.col("id").cast("string")), 2_500_000).alias("text"))
print("fitted", quality.fit(docs, rows.select("doc_id", F.lit(1).alias("quality"))).mean.shape)
"""


def test_a_sample_of_long_texts_is_in_no_task_as_a_whole():
    """Some 70 texts of 7 MB are sampled in a heap of 512 MB: only their features may meet there."""
    done = subprocess.run([sys.executable, "-c", LONG_TEXTS], capture_output=True, text=True, timeout=400)
    assert f"fitted ({quality.WIDTH},)" in done.stdout, done.stderr[-2000:]


def test_ids_may_be_texts(corpus):
    documents, labels = (t.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")) for t in corpus)
    assert quality.score_quality(documents, quality.fit(documents, labels)).schema["doc_id"].dataType.simpleString() == "string"
    assert language.identify(documents, language.fit(documents)).count() == documents.count()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(documents, labels, most=1500)
    scored = toxicity.score_toxicity(documents.join(labels.select("doc_id"), "doc_id", "left_semi"), model)
    score, label, predicted = held_out(scored, labels, "toxic")
    assert auc(score, label) > 0.85 and (predicted == label).mean() > 0.95
    # an insult at the end of a very long clean text is found
    clean = documents.where("doc_id = 1").first()["text"]
    insult = "you are a worthless stupid idiot and a pathetic moron"
    low, high = model.scores([clean * 40, clean * 40 + " " + insult + "."])
    assert low < 0.5 < high


def test_toxicity_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "SPAN", 7)
    rng = np.random.default_rng(0)
    words = [b"w%d" % i for i in range(20)]
    net = toxicity.Network({w: i + 1 for i, w in enumerate(words[:10])})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, mask = rng.integers(0, 20, (5, 7)), np.ones((5, 7), bool)
    mask[1, 4:] = mask[3, 2:] = False
    ids[~mask] = 20
    y = np.array([1.0, 0, 1, 0, 0])

    def run():
        x = net.inputs(words)
        logits, kept = net.forward(net.gates(x[0], "f"), net.gates(x[0], "b"), ids, mask, True)
        s = toxicity.sigmoid(logits)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum(), s, kept, x

    _, s, kept, x = run()
    grads = net.backward(s - y, kept, ids, x)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        at = int(np.abs(grads[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = run()[0]
        flat[at] = old - 1e-2
        down = run()[0]
        flat[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(grads[name].reshape(-1)[at]), rel=0.05, abs=1e-3), name


def test_windows_cover_every_word_and_overlap():
    counts = np.array([0, 1, 48, 49, 72, 73, 500])
    text, first, size = toxicity.windows(counts)
    starts = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        seen = np.zeros(n, int)
        for f, s in zip(first[text == t] - starts[t], size[text == t], strict=True):
            assert 0 <= s <= toxicity.SPAN
            seen[f : f + s] += 1
        assert (seen >= 1).all() and (n <= 72 or (seen[24 : n - 48] == 2).all())


def test_language_on_held_out_rows(corpus):
    documents, _ = corpus
    rows = language.identify(documents, language.fit(documents)).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 200 and (rows["lang_pred"] == rows["lang"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_code_lengths_by_walking_the_tree():
    import pandas as pd

    texts = {"x": ["abab abba", "ab"], "y": ["baab", "ccc ab"]}
    grams = pd.concat(list(language.count_grams(iter([pd.DataFrame([(lang, t) for lang, ts in texts.items() for t in ts], columns=["lang", "text"])]))))
    model = language.Model(grams)
    counts = {lang: {} for lang in texts}
    for lang, ts in texts.items():
        for t in ts:
            b = language.text_bytes(t)
            for i in range(3, len(b)):
                for k in range(4):
                    follow = counts[lang].setdefault(b[i - k : i], {})
                    follow[b[i]] = follow.get(b[i], 0) + 1

    def bits(lang, text):
        b, total = language.text_bytes(text), 0.0
        for i in range(3, len(b)):
            for k in (3, 2, 1, 0):
                follow = counts[lang].get(b[i - k : i])
                if follow is None:
                    continue
                n = sum(follow.values()) + len(follow)
                if b[i] in follow:
                    total -= np.log2(follow[b[i]] / n)
                    break
                total -= np.log2(len(follow) / n)
            else:
                total += 8
        return total

    for text in ("abba", "cab ab", "", "aaaa", "ba"):
        assert model.code_lengths([text])[0] == pytest.approx([bits("x", text), bits("y", text)], abs=1e-3)


def test_order_3_holds_for_many_bytes_and_languages():
    import pandas as pd

    rng = np.random.default_rng(3)
    letters = [chr(i) for i in (*range(33, 127), *range(0x80, 0x800, 17), *range(0x800, 0xD7FF, 251))]
    texts = {f"l{k:02}": "".join(rng.choice(letters, 300)) for k in range(20)}
    grams = pd.concat(list(language.count_grams(iter([pd.DataFrame(list(texts.items()), columns=["lang", "text"])]))))
    model = language.Model(grams)
    assert len({b for t in texts.values() for b in language.text_bytes(t)}) ** 3 * len(texts) > 24_000_000  # cells of a table of all contexts
    for k, text in enumerate(texts.values()):
        b = language.text_bytes(text)
        want = 0.0
        for i in range(3, len(b)):  # in its own text every context of order 3 has been seen
            after = [b[j] for j in range(3, len(b)) if b[j - 3 : j] == b[i - 3 : i]]
            want -= np.log2(after.count(b[i]) / (len(after) + len(set(after))))
        assert model.code_lengths([text])[0, k] == pytest.approx(want, rel=1e-5)


def test_every_language_can_be_predicted(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    texts = {f"l{k:03}": " ".join("".join(rng.choice(letters, 6)) for _ in range(8)) for k in range(210)}
    rows = [(i, text, lang, None) for i, (lang, text) in enumerate((x, t) for x, t in texts.items() for _ in range(6))]
    train = docs(spark, rows)
    got = {r["lang_pred"] for r in language.identify(train, language.fit(train)).collect()}
    learnt = {lang for i, _, lang, _ in rows if bucket(i, 3) != 1}
    assert got == learnt and len(learnt) > 200


def test_language_without_letters(spark):
    train = docs(spark, [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", None) for i in range(40)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "the dog"), (5, "le chien")]), language.fit(train)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "fr"
    assert {r["lang_pred"] for r in language.identify(train, language.fit(docs(spark, []))).collect()} == {"und"}


LICENSED = [
    (1, "Some words.\nReleased under the MIT License.\nMore words"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
    (4, "The license plate of my car is new"), (5, "He was released under the old bridge."), (6, "PERMISSION IS HEREBY GRANTED, FREE OF CHARGE, to any person obtaining a copy of this software and associated documentation files"), (7, None), (8, ""), (9, "\n\n"),
]


def test_licences(spark, corpus):
    model = licenses.fit(corpus[0])
    got = {r["doc_id"]: (r["families"], r["n_licence"], r["n_paragraphs"]) for r in licenses.scan_licenses(docs(spark, LICENSED), model).collect()}
    assert got == {1: ("mit", 1, 3), 2: ("apache", 1, 1), 3: ("cc-by-nc,gpl", 2, 2), 4: ("", 0, 1), 5: ("", 0, 1), 6: ("mit", 1, 1), 7: ("", 0, 0), 8: ("", 0, 0), 9: ("", 0, 0)}


WRAPPED = """Some code of ours

Redistribution and use in source and binary
forms, with or without modification, are
permitted provided that the following conditions are met:

more of it"""


def test_wrapped_notices_are_one_paragraph(spark, corpus):
    got = licenses.scan_licenses(docs(spark, [(1, WRAPPED), (2, WRAPPED.replace("\n", "\r\n"))]), licenses.fit(corpus[0])).collect()
    assert [(r["n_paragraphs"], r["n_licence"], r["families"]) for r in got] == [(3, 1, "bsd")] * 2


#: Licence paragraphs in other words than the templates', and paragraphs that only sound like them.
OTHER_WORDS = {
    "This project is released under the MIT License, see the file for more.": "mit", "The library is distributed under the MIT License by its authors.": "mit", "Code in this folder: licensed under the Apache License, Version 2.0, as is the rest.": "apache",
    "You may use these sources under the Apache License 2.0 or later.": "apache", "Our tools are free software under the GNU General Public License, version 2.": "gpl", "The text is available under the Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Photographs are licensed under CC BY-NC 4.0 unless noted.": "cc-by-nc", "Covered by the 3-Clause BSD License of the university.": "bsd", "Linking is allowed under the GNU Lesser General Public License.": "lgpl",
    "Files here fall under the Mozilla Public License, version 2.0.": "mpl", "Copyright 2020 by the publisher. All rights reserved.": "proprietary", "Permission is hereby granted, free of charge, to any person who has a copy of this software and associated documentation files": "mit",
    "under the terms of the": "", "free of charge, to any person": "", "He was released under the old bridge.": "", "The license plate of my car is new.": "", "You may not use this room without permission.": "", "Modification of the source and of binary forms is hard.": "",
    "Creative people share common ground.": "", "The public library is general and free.": "", "All people reserved their rights to speak.": "", "Apache helicopters need a license.": "", "The university granted permission to redistribute the books.": "", "A general public meeting about GNU herds": "",
}


def test_precision_and_recall_on_other_words(spark, corpus):
    got = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(docs(spark, list(enumerate(OTHER_WORDS))), licenses.fit(corpus[0])).collect()}
    pairs = [(got[i], want) for i, want in enumerate(OTHER_WORDS.values())]
    right = sum(g == w for g, w in pairs if w)
    assert right / sum(bool(g) for g, _ in pairs) >= 0.9 and right / sum(bool(w) for _, w in pairs) >= 0.9, [(t, g) for (t, w), (g, _) in zip(OTHER_WORDS.items(), pairs) if g != w]


def test_chances_are_calibrated():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, (20_000, 4))
    p = np.exp(0.4 * z + [0, 0, 0, 1.0])
    p /= p.sum(1, keepdims=True)
    y = (rng.random(len(z))[:, None] > p.cumsum(1)).sum(1)
    model = licenses.Model(np.zeros((1, 4)), 0.0, *licenses.calibrated(z, y))
    # every class counts alike, so the offset answers for the unknown class being common
    assert model.heat == pytest.approx(0.4, rel=0.15)
    top = model.chances(z.copy())
    assert abs(top.max(1).mean() - (top.argmax(1) == y).mean()) < 0.12


BARE = {
    "All rights reserved.": "proprietary", "ALL RIGHTS RESERVED": "proprietary", "Copyright 2021 Acme. All rights reserved.": "proprietary", "MIT License": "mit", "The MIT License": "mit", "Apache License 2.0": "apache",
    "Apache License, Version 2.0": "apache", "BSD 3-Clause License": "bsd", "CC BY 4.0": "cc-by", "CC BY-NC 4.0": "cc-by-nc", "CC BY-SA 4.0.": "cc-by-sa", "GNU General Public License": "gpl", "GNU Lesser General Public License": "lgpl",
    "Mozilla Public License 2.0": "mpl", "License": "", "All rights": "", "version 4.0 of all": "", "The public was reserved": "", "all roads lead home": "",
}


def test_bare_notices(spark, corpus):
    got = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(docs(spark, [(i, f"Some words.\n{line}\nMore words") for i, line in enumerate(BARE)]), licenses.fit(corpus[0])).collect()}
    assert {line: got[i] for i, line in enumerate(BARE)} == BARE


def test_every_licence_line_of_the_corpus_counts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    names = {"apache": "Apache License", "cc-by-nc": "CC BY-NC", "gpl": "GNU General Public", "mit": "MIT License", "proprietary": "All rights reserved"}
    found = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(documents, licenses.fit(documents)).collect()}
    want = {r["doc_id"]: ",".join(f for f, n in names.items() if n in r["text"]) for r in documents.collect()}
    assert found == want and sum(map(bool, want.values())) == 328


def test_awkward_rows(spark, corpus):
    documents, labels = corpus
    frame, empty = clashing(docs(spark, AWKWARD)), docs(spark, [])
    q, lang, lic = quality.fit(documents, labels), language.fit(documents), licenses.train([])
    tox = toxicity.train(["you idiot", "a nice day", "so nice a day", "idiot you are"] * 3, np.array([1, 0, 0, 1] * 3), passes=2)
    for make in (lambda d: quality.score_quality(d, q), lambda d: language.identify(d, lang), lambda d: licenses.scan_licenses(d, lic), lambda d: toxicity.score_toxicity(d, tox)):
        got = make(frame).toPandas()
        assert len(got) == len(AWKWARD) and got["score"].between(0, 1).all()
        twins = got[got["doc_id"].isin([6, 7])]
        assert twins["score"].nunique() == 1
        assert make(empty).count() == 0
    assert quality.keep_quality(frame, q).columns == frame.columns
    # without any labels there still is a model
    assert quality.score_quality(frame, quality.fit(empty, labels.limit(0))).count() == len(AWKWARD)
    assert toxicity.score_toxicity(frame, toxicity.fit(empty, labels.limit(0))).count() == len(AWKWARD)
