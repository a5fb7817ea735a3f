"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines up to a blank line or a line that ends a sentence, so that wrapped notices are one paragraph;
its lines are judged too, as a notice may follow other text. Hashed word 1- to 3-grams go through a softmax regression over
licence families and an unknown class. Training takes the templates below, each many times with words dropped and strange
words put in, and ordinary paragraphs of a bounded sample of the corpus as unknown. A second part of both calibrates: a
temperature and an offset of the unknown class make chances true to their frequency, and the margin over unknown that a
family must reach is set so that at most `FALSE_ALARMS` of the unknown paragraphs reach it. What reaches it is confirmed if
it and a template of its family share enough of the word pairs of both, or if it holds all of a template or bare notice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, chunks, small_batches, table, utf8
from .samples import bounded
from .shingles import U, mix, word_hashes

DIM, ORDERS = 1 << 15, 3
#: Documents whose paragraphs stand for unknown text, this many at most; paragraphs of them at most.
MOST_DOCS, MOST_PARAGRAPHS = 500, 4000
#: What ends a paragraph at the end of a line.
STOPS = (b".", b"!", b"?", b":", b";")
COPIES, FALSE_ALARMS, CONFIRM = 40, 0.001, 0.6

#: Licence notices and openings by family (fixed values).
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU General Public License, version 2.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License, version 2.1.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This document is proprietary and confidential. All rights reserved.",
    ),
}
FAMILIES = sorted(TEMPLATES)
#: Bare notices, which name a licence in a few words (fixed values); training drops none of their words.
NOTICES = {
    "apache": ("Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0"),
    "bsd": ("BSD License", "3-Clause BSD License", "BSD 3-Clause License", "BSD 2-Clause License"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "gpl": ("GNU General Public License", "GNU GPL"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL"),
    "mit": ("MIT License", "The MIT License"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0"),
    "proprietary": ("All rights reserved.",),
}


def candidates(data: bytes) -> tuple[list[bytes], list[int], int]:
    """(what is judged, its paragraph's number, paragraphs): every paragraph with words, and the lines of those with several."""
    out, number, lines, n = [], [], [], 0
    for line in [*data.split(b"\n"), b""]:
        if line.strip(b" \t\r\v\f"):
            lines.append(line)
            if not line.rstrip().endswith(STOPS):
                continue
        if lines:
            parts = [b" ".join(lines), *lines] if len(lines) > 1 else lines
            out += parts
            number += [n] * len(parts)
            n, lines = n + 1, []
    return out, number, n


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece of each gram, its feature) over pieces of text."""
    hashes, counts = word_hashes([p.decode("utf-8", "replace") for p in pieces])
    line = np.repeat(np.arange(len(pieces)), counts)
    rows, feats = [], []
    code = np.zeros(len(hashes), U)
    for n in range(ORDERS):
        if len(hashes) <= n:
            break
        code = mix(code[: len(hashes) - n] * U(3) + hashes[n:])
        inside = line[: len(hashes) - n] == line[n:]
        rows.append(line[: len(hashes) - n][inside])
        feats.append((code[inside] >> U(40)).astype(np.int64) % DIM)
    none = np.empty(0, np.int64)
    rows, feats = np.concatenate([*rows, none]), np.concatenate([*feats, none])
    order = np.argsort(rows, kind="stable")
    return rows[order], feats[order]


def word_pairs(text: str | bytes) -> set:
    data = text if isinstance(text, bytes) else utf8(text)
    words = data.translate(LOWER_BYTES).translate(_BARE).split()
    return set(zip(words, words[1:]))


#: Punctuation around words counts as blank.
_BARE = bytes(32 if chr(b) in ",.;:()\"'`*#/<>" else b for b in range(256))
_PAIRS = {family: [word_pairs(t) for t in (*texts, *NOTICES[family])] for family, texts in TEMPLATES.items()}


def likeness(line: str | bytes | set, family: str) -> float:
    """How like a paragraph (or its word pairs) is to a family: 1 where it has all word pairs of a template or notice of the family; else the lesser of the shares that the
    common pairs have of the template and of it, for the template where that is most."""
    have, best = line if isinstance(line, set) else word_pairs(line), 0.0
    for pairs in _PAIRS[family]:
        common = len(have & pairs)
        if common == len(pairs):
            return 1.0
        best = max(best, common / max(len(pairs), len(have)))
    return best


class Model:
    def __init__(self, weights: np.ndarray, margin: float = 0.0, heat: float = 1.0, offset: float = 0.0):
        """`weights`: (DIM + 1, families + unknown), the last row is the bias; `heat` and `offset` (of unknown) calibrate chances."""
        self.weights, self.margin, self.heat, self.offset = weights, margin, heat, offset

    def logits(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.weights.shape[1]), np.float32)
        if len(rows):
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            count = np.diff(np.append(starts, len(rows)))
            out[rows[starts]] = np.add.reduceat(self.weights[feats], starts, 0) / np.sqrt(count)[:, None]
        return out + self.weights[-1]

    def chances(self, z: np.ndarray) -> np.ndarray:
        """Calibrated chances of all classes."""
        z = z * self.heat
        z[:, -1] += self.offset
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def judged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(family, margin over unknown, calibrated chance of the family) of every piece."""
        z = self.logits(*grams(pieces), len(pieces))
        best = z[:, :-1].argmax(1)
        at = np.arange(len(z))
        return best, z[at, best] - z[:, -1], self.chances(z.astype(np.float64))[at, best]


def noisy(text: str, strange: list[str], rng: np.random.Generator) -> str:
    """A template with some words dropped and some strange ones put in or around."""
    words = [w for w in text.split() if rng.random() > 0.08] or text.split()
    for _ in range(rng.integers(0, 4)):
        words.insert(int(rng.integers(0, len(words) + 1)), strange[int(rng.integers(0, len(strange)))])
    return " ".join(words)


def around(text: str, strange: list[str], rng: np.random.Generator) -> str:
    """A bare notice, whole, with some strange words before and after."""
    before, after = ([strange[int(i)] for i in rng.integers(0, len(strange), rng.integers(0, 3))] for _ in range(2))
    return " ".join([*before, text, *after])


def train(unknown: list[str], steps: int = 60, rate: float = 40.0, seed: int = 5) -> Model:
    """A calibrated model; `unknown`: ordinary paragraphs. Half of all examples fit the weights, the other half sets the margin."""
    rng = np.random.default_rng(seed)
    strange = sorted({w for u in unknown[:500] for w in u.split()[:20]}) or ["lorem", "ipsum"]
    unknown = unknown or ["lorem ipsum dolor sit amet", "an ordinary line of text"]
    texts, labels = [], []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            texts += [t, *(noisy(t, strange, rng) for _ in range(COPIES - 1))]
            labels += [k] * COPIES
        for t in NOTICES[family]:
            for form in (t.rstrip("."), t.rstrip(".") + "."):
                texts += [form, form, *(around(form, strange, rng) for _ in range(COPIES // 2 - 2))]
                labels += [k] * (COPIES // 2)
    texts, y = texts + unknown, np.array(labels + [len(FAMILIES)] * len(unknown))
    rows, feats = grams([utf8(t) for t in texts])
    fit = np.arange(len(y)) % 2 == 0
    classes = len(FAMILIES) + 1
    weight = 1 / np.bincount(y, minlength=classes)[y]  # every class counts alike
    weight = weight * fit / (weight * fit).sum()
    count = np.bincount(rows, minlength=len(y))
    scale = (1 / np.sqrt(np.maximum(1, count)))[rows]
    model = Model(np.zeros((DIM + 1, classes), np.float32))
    target = np.eye(classes)[y]
    for _ in range(steps):
        z = model.logits(rows, feats, len(y))
        p = np.exp(z - z.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - target) * weight[:, None]
        for c in range(classes):
            model.weights[:-1, c] -= rate * (np.bincount(feats, off[rows, c] * scale, DIM) + 1e-5 * model.weights[:-1, c])
        model.weights[-1] -= rate * off.sum(0)
    z = model.logits(rows, feats, len(y)).astype(np.float64)
    free = np.sort((z[:, :-1].max(1) - z[:, -1])[~fit & (y == len(FAMILIES))])
    held = free[min(len(free) - 1, int(np.ceil((1 - FALSE_ALARMS) * len(free))))] if len(free) else 0.0
    model.margin = float(max(0.0, held))
    model.heat, model.offset = calibrated(z[~fit], y[~fit])
    return model


def calibrated(z: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05) -> tuple[float, float]:
    """The heat and the offset of the unknown class under which the held-out examples `z` are likeliest, all classes counting
    alike; Adam over the logarithm of the heat and the offset. A little of the loss keeps both finite where nothing is doubtful."""
    weight = 1 / np.bincount(y, minlength=z.shape[1])[y]
    weight /= weight.sum()
    at, target, first, second = np.zeros(2), np.eye(z.shape[1])[y], np.zeros(2), np.zeros(2)
    for step in range(1, steps + 1):
        heat = np.exp(at[0])
        s = z * heat
        s[:, -1] += at[1]
        p = np.exp(s - s.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - target) * weight[:, None]
        grad = np.array([(off * z).sum() * heat, off[:, -1].sum()]) + 1e-3 * at
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        at = at - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return float(np.exp(at[0])), float(at[1])


def paragraphs_of(text: str) -> list[str]:
    out, number, _ = candidates(utf8(text))
    return [p.decode("utf-8", "replace") for i, p in enumerate(out) if i == 0 or number[i] != number[i - 1]]


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model whose unknown class is learnt from the paragraphs of a bounded sample of `docs`, chosen by the hash of id and
    text; paragraphs much like a template do not count as unknown."""
    small_batches(docs.sparkSession)
    rows = bounded(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), MOST_DOCS, ["doc_id", "text"]).select("text").toPandas()
    found = sorted({p for text in rows["text"].dropna() for p in paragraphs_of(text)}, key=lambda x: (hash_of(x), x))
    plain = [x for x in found if max(likeness(have, f) for have in [word_pairs(x)] for f in FAMILIES) < 0.3]
    return train(plain[:MOST_PARAGRAPHS])


def hash_of(line: str) -> int:
    return int.from_bytes(utf8(line)[:8].ljust(8, b"\0"), "little") * 0x9E3779B97F4A7C15 % (1 << 64)


def scan_licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, n_paragraphs` (with words), `n_licence` (confirmed paragraphs), `families`
    (their families, sorted, comma-joined; empty if none), `n_unconfirmed` (paragraphs the model names but no template
    confirms), `score` (highest calibrated chance of a confirmed paragraph, else 0).

    Nulls: a null text counts as empty, a null id stays null. Empty texts have no paragraphs; repeated rows are scanned one
    by one; very long texts are scanned whole; an empty table gives an empty result. Ties between families go to the first
    in alphabetical order. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for piece in chunks(frames, "text"):
            parts = [candidates(utf8(t)) for t in piece["text"]]
            pieces = [p for out, _, _ in parts for p in out]
            owner = np.repeat(np.arange(len(parts)), [len(out) for out, _, _ in parts])
            number = [k for _, numbers, _ in parts for k in numbers]
            best, margin, chance = model.judged(pieces)
            sure: list[set] = [set() for _ in parts]
            named: list[set] = [set() for _ in parts]
            found: list[set] = [set() for _ in parts]
            score = np.zeros(len(parts))
            for i in np.flatnonzero(margin > model.margin).tolist():
                t, family = int(owner[i]), FAMILIES[best[i]]
                named[t].add(number[i])
                if likeness(pieces[i], family) >= CONFIRM:
                    sure[t].add(number[i])
                    found[t].add(family)
                    score[t] = max(score[t], chance[i])
            yield pd.DataFrame({
                "doc_id": piece["doc_id"], "n_paragraphs": [n for _, _, n in parts], "n_licence": [len(x) for x in sure],
                "families": [",".join(sorted(f)) for f in found], "n_unconfirmed": [len(a - b) for a, b in zip(named, sure, strict=True)], "score": score,
            })

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_paragraphs long, n_licence long, families string, n_unconfirmed long, score double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scan, schema)


def op5_license_scan(spark, sf_dir):
    """The licences that every document names."""
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, fit(docs))
