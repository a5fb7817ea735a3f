"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text give the non-negative unbiased risk
    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),   l(z) = 1 / (1 + e^z),
which is minimised for a small network over text statistics. Positives are documents labelled 1; the unlabelled set is a
sample of all documents that are not held out, whatever their labels. Labels of negatives are never read.

The class prior is estimated from these two sets: a network tells positives from unlabelled text on one half of each; on
the other half, the share of unlabelled text above a cut over that of positives above it bounds the prior from above, and
comes near it where the cut leaves out the negatives. The cut with the least upper confidence bound is taken, and the
halves take turns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, small_batches, table, utf8
from .samples import HASH, bounded, labelled_sample

#: Positives, and unlabelled documents, that training takes at most.
MOST_LABELLED, MOST_UNLABELLED = 6000, 6000
#: Bounds of an estimated prior; chance that its confidence bound fails.
LEAST_PRIOR, DELTA = 0.02, 0.1
_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",;:", b"!?", b"|", b"#$%&*@^~=+<>", b"'\"()[]{}-_/\\", bytes(range(128, 256)))
CLASSES = len(_GROUPS) + 1
_CLASS = np.zeros(256, np.int32)
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _i + 1
#: Byte class pairs, and eight statistics of words and lines.
WIDTH = CLASSES * CLASSES + 8


def features(texts: list) -> np.ndarray:
    """One row of `WIDTH` numbers for each text; an empty or null text gives zeros."""
    data = [utf8(t) for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    out = np.zeros((len(data), WIDTH), np.float32)
    cls = _CLASS[np.frombuffer(b"".join(data), np.uint8)]
    if len(cls) > 1:
        owner = np.repeat(np.arange(len(data), dtype=np.int64), sizes)
        pair = (owner[:-1] * CLASSES**2 + cls[:-1] * CLASSES + cls[1:])[owner[:-1] == owner[1:]]
        counts = np.bincount(pair, minlength=len(data) * CLASSES**2).reshape(len(data), -1)
        out[:, : CLASSES**2] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    for row, d in zip(out, data, strict=True):
        words = d.split()
        n = len(words)
        if not n:
            continue
        lines = d.split(b"\n")
        row[CLASSES**2 :] = (
            np.log1p(len(d)) / 10, np.log1p(n) / 10, len(d) / n / 10, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
            len(set(zip(words, words[1:]))) / n, len(set(lines)) / len(lines), n / len(lines) / 50,
        )
    return out


class Network:
    """Features, standardised, through one layer of tanh units to one number g; the score is the logistic of g."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(g, hidden units) of standardised features."""
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0], h

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.standard(x))[0])

    def gradient(self, x: np.ndarray, h: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dg, self.p[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]


def _descend(net: Network, x: np.ndarray, slopes: Callable[[np.ndarray], np.ndarray], steps: int, rate: float, l2: float) -> Network:
    """Full batch, Adam; `slopes` gives the derivative of the risk by each row's g."""
    first, second, z = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p], net.standard(x)
    for step in range(1, steps + 1):
        g, h = net.forward(z)
        for k, grad in enumerate(net.gradient(z, h, slopes(g))):
            grad = grad + l2 * net.p[k] * (k % 2 == 0)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            net.p[k] = net.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _network(x: np.ndarray) -> Network:
    std = x.std(0)
    return Network(x.mean(0), np.where(std > 1e-6, 1 / np.maximum(std, 1e-6), 0.0))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 150, rate: float = 0.01, l2: float = 1e-3) -> float:
    """The share of positives in the unlabelled rows, from features of both; 0.5 where one of them has fewer than four rows."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    found = []
    for half in (0, 1):  # each half in turn is held out, so that the estimate is of the whole sample
        p, u = positive[half::2].astype(np.float64), unlabelled[half::2].astype(np.float64)
        x, y = np.vstack((p, u)), np.concatenate((np.ones(len(p)), np.zeros(len(u))))
        weight = np.where(y == 1, 0.5 / len(p), 0.5 / len(u))
        net = _descend(_network(x), x, lambda g, y=y, weight=weight: (_sigmoid(g) - y) * weight, steps, rate, l2)
        held_p, held_u = np.sort(net.score(positive[1 - half :: 2])), np.sort(net.score(unlabelled[1 - half :: 2]))
        above_p = 1 - np.arange(len(held_p)) / len(held_p)  # with the cut at each held positive
        above_u = 1 - np.searchsorted(held_u, held_p, "left") / len(held_u)
        doubt = np.sqrt(np.log(4 / DELTA) / (2 * len(held_u))) + np.sqrt(np.log(4 / DELTA) / (2 * len(held_p)))
        best = int(((above_u + doubt) / above_p).argmin())
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), LEAST_PRIOR, 1 - LEAST_PRIOR))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, rate: float = 0.01, l2: float = 1e-3) -> Network:
    """Minimises the non-negative PU risk of features of trusted positives and of unlabelled rows; the prior is estimated where it is not given."""
    prior = prior if prior is not None else estimate_prior(positive, unlabelled)
    x = np.vstack((positive, unlabelled)).astype(np.float64)
    if not len(x):
        x = np.zeros((1, WIDTH))
    n, m = len(positive), max(1, len(x) - len(positive))

    def slopes(g: np.ndarray) -> np.ndarray:
        s = _sigmoid(g)  # l(-g) = s, l(g) = 1 - s
        slope = s * (1 - s)
        for_p, for_n = np.zeros(len(x)), slope / m
        negative = s[n:].mean() if len(s) > n else 0.0
        if n:
            for_p[:n] = for_n[:n] = -prior * slope[:n] / n
            negative -= prior * s[:n].mean()
        return for_p + for_n if negative >= 0 else -for_n

    return _descend(_network(x), x, slopes, steps, rate, l2)


def _features_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for piece in chunks(frames, "text"):
        yield pd.DataFrame({HASH: piece[HASH], "x": list(features(piece["text"].tolist()))})


def _featured(rows: DataFrame) -> DataFrame:
    """Features in place of texts, made where the rows lie: a sample's whole texts would not fit into one task, nor be read by one in time."""
    return rows.select(HASH, "text").mapInPandas(_features_of, f"{HASH} long, x array<float>")


def _matrix(sample: DataFrame) -> np.ndarray:
    """Features of a sample, in the order of its hashes."""
    rows = sample.toPandas().sort_values(HASH, kind="stable")
    return np.array(rows["x"].tolist(), np.float32).reshape(len(rows), WIDTH)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, most: int = MOST_LABELLED, most_unlabelled: int = MOST_UNLABELLED) -> Network:
    """A network from documents with `labels.quality` of 1 and from unlabelled ones; rows that are held out (crc32 of the id
    modulo 5 is 0) are in neither sample. Ids of any type; a null id takes part in the unlabelled sample."""
    small_batches(docs.sparkSession)
    positive = _matrix(labelled_sample(docs, labels, "quality", most, value=1, made=_featured))
    free = docs.where(crc_bucket(F.col("doc_id"), 5) != 0).select("doc_id", "text")
    return train(positive, _matrix(bounded(free, most_unlabelled, ["doc_id", "text"], _featured)), prior)


def score_quality(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs`: `doc_id, held_out, score, predicted`.

    Nulls: a null text counts as empty, a null id as an empty id for `held_out`. Empty texts get the score of all-zero
    statistics; very long texts are read whole; repeated rows are scored one by one; an empty table gives an empty result.
    Only the text is an input of the score; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(frames, "text"):
            yield pd.DataFrame({"doc_id": piece["doc_id"], "score": held.value.score(features(piece["text"].tolist()))})

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(score, f"doc_id {id_type}, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_of(model: Network, text: Column) -> Column:
    """The score of a text column, as a column."""
    held = SparkSession.active().sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            scores = [held.value.score(features(p["t"].tolist())) for p in chunks(iter([texts.to_frame("t").reset_index(drop=True)]), "t")]
            yield pd.Series(np.concatenate(scores) if scores else np.empty(0))

    return F.pandas_udf(score, "double")(text)


def keep_quality(docs: DataFrame, model: Network, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.where(quality_of(model, F.col(text_col)) >= threshold)


def op1_quality(spark, sf_dir):
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
