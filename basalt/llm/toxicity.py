"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (for words seen in training) beside the sum of its hashed character n-grams' vectors over
the root of their number, so that a telling stem is not lost in a long word.
Both directions' gate inputs depend on the word alone and are worked out once for each distinct word of a batch.
A text is read in windows of `SPAN` words, one starting every `STRIDE` words, so that each word is seen in two
windows; the window with the highest score gives the score of the text.

Labels belong to whole texts. Training is multi-instance: of each text, the window that scores highest takes the label;
before the first pass, windows are ranked by how much more common their words, word beginnings and word ends are in toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, small_batches, table, utf8
from .decontaminate import WORD_BYTES
from .samples import HASH, labelled_sample

#: Labelled rows that training takes at most.
MOST_LABELLED = 3000
SPAN, STRIDE = 48, 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
#: Lengths and hash range of character n-grams; most words with a vector of their own.
LENGTHS, GRAMS, MOST_WORDS = (3, 4, 5), 1 << 15, 20_000
BATCH = 2048


def words_of(text: object) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the windows over texts of so many words; offsets count over all texts together. A text without words has one empty window."""
    number = np.maximum(0, -(-(counts - SPAN) // STRIDE)) + 1
    text = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    return text, (np.cumsum(counts) - counts)[text] + nth * STRIDE, np.minimum(SPAN, counts[text] - nth * STRIDE)


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) pairs of the hashed byte n-grams of `^word$`, by word."""
    data = np.frombuffer(b"".join([b"^%b$" % w for w in words]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, codes = [], []
    for n in LENGTHS:
        last = len(data) - n + 1
        if last <= 0:
            continue
        code = np.full(last, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(1_000_003) + data[k : k + last]
        inside = owner[:last] == owner[n - 1 :]
        owners.append(owner[:last][inside])
        codes.append((code[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % GRAMS)
    none = np.empty(0, np.int64)
    owners, codes = np.concatenate([*owners, none]), np.concatenate([*codes, none])
    order = np.argsort(owners, kind="stable")
    return owners[order], codes[order]


def odds(where: np.ndarray, what: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    """For each thing (a number in `what`, in text `where`) its log odds of toxic texts, 0 if below 0 or in fewer than `least` texts."""
    things = int(what.max()) + 1 if len(what) else 0
    pairs = np.unique(where * max(1, things) + what)
    where, what = pairs // max(1, things), pairs % max(1, things)
    toxic, all_ = np.bincount(what[label[where] == 1], minlength=things), np.bincount(what, minlength=things)
    out = np.log((toxic + 0.5) / (label.sum() + 1)) - np.log((all_ - toxic + 0.5) / (len(label) - label.sum() + 1))
    return np.where(all_ >= least, np.maximum(0, out), 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters `p`, and the vocabulary: word -> row of the word vectors (row 0: any other word)."""

    def __init__(self, vocab: dict[bytes, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        wide = WORD_DIM + CHAR_DIM
        self.vocab = vocab
        self.p = {
            "word": rng.normal(0, 0.1, (len(vocab) + 1, WORD_DIM)).astype(np.float32), "char": rng.normal(0, 0.1, (GRAMS, CHAR_DIM)).astype(np.float32),
            "wf": draw(wide, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32), "uf": draw(HIDDEN, 3 * HIDDEN),
            "wb": draw(wide, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32), "ub": draw(HIDDEN, 3 * HIDDEN),
            "att": draw(2 * HIDDEN, ATTENTION), "v": draw(ATTENTION), "out": draw(2 * HIDDEN), "c": np.zeros(1, np.float32),
        }

    # -- words

    def inputs(self, words: list[bytes]) -> tuple:
        """Vectors of distinct words, and what the backward pass needs of them."""
        rows = np.fromiter((self.vocab.get(w, 0) for w in words), np.int64, len(words))
        owner, gram = ngrams(words)
        share = (1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(words))))).astype(np.float32)
        mean = np.zeros((len(words), CHAR_DIM), np.float32)
        if len(owner):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            mean[owner[starts]] = np.add.reduceat(self.p["char"][gram], starts, 0)
        return np.hstack((self.p["word"][rows], mean * share[:, None])), rows, owner, gram, share

    def gates(self, x: np.ndarray, d: str) -> np.ndarray:
        """Gate inputs of each word; the last row is padding, which keeps the state as it is."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = 30
        return np.vstack((x @ self.p["w" + d] + self.p["b" + d], pad))

    # -- one batch of windows: ids (windows, SPAN) of distinct words, padding is the last id

    def run(self, gate: np.ndarray, u: np.ndarray, ids: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
        n, steps = len(ids), range(SPAN - 1, -1, -1) if back else range(SPAN)
        h, states, held = np.zeros((n, HIDDEN), np.float32), np.empty((SPAN, n, HIDDEN), np.float32), []
        for t in steps:
            g, s = gate[ids[:, t]], h @ u
            zr = 1 / (1 + np.exp(-np.clip(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN], -30, 30)))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            un = s[:, 2 * HIDDEN :]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * un)
            if keep:
                held.append((t, h, z, r, un, c))
            h = c + z * (h - c)
            states[t] = h
        return states, held

    def forward(self, gf: np.ndarray, gb: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        forth, kf = self.run(gf, self.p["uf"], ids, False, keep)
        back, kb = self.run(gb, self.p["ub"], ids, True, keep)
        h = np.concatenate((forth, back), 2)
        q = np.tanh(h @ self.p["att"])
        a = np.where(mask.T, q @ self.p["v"], np.float32(-1e9))
        a = np.exp(a - a.max(0)) * mask.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", a, h)
        return pooled @ self.p["out"] + self.p["c"][0], (kf, kb, h, q, a, pooled)

    def backward(self, dlogit: np.ndarray, kept: tuple, ids: np.ndarray, x: tuple) -> dict[str, np.ndarray]:
        (kf, kb, h, q, a, pooled), p = kept, self.p
        grad = {"out": pooled.T @ dlogit, "c": dlogit.sum(keepdims=True)}
        dp = dlogit[:, None] * p["out"]
        da = np.einsum("nk,tnk->tn", dp, h)
        ds = a * (da - (a * da).sum(0))
        dq = ds[:, :, None] * p["v"] * (1 - q * q)
        grad["v"] = np.einsum("tn,tnk->k", ds, q)
        grad["att"] = np.einsum("tnk,tnj->kj", h, dq)
        dh = a[:, :, None] * dp + dq @ p["att"].T
        vectors, rows, owner, gram, share = x
        dx = np.zeros_like(vectors)
        for d, held, part in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, 2 * HIDDEN))):
            dgate, du = np.zeros((len(vectors) + 1, 3 * HIDDEN), np.float32), np.zeros_like(p["u" + d])
            carry = np.zeros((ids.shape[0], HIDDEN), np.float32)
            for t, before, z, r, un, c in reversed(held):
                now = carry + dh[t][:, part]
                dn = now * (1 - z) * (1 - c * c)
                dz, dr = now * (before - c) * z * (1 - z), dn * un * r * (1 - r)
                np.add.at(dgate, ids[:, t], np.hstack((dz, dr, dn)))
                ds_ = np.hstack((dz, dr, dn * r))
                du += before.T @ ds_
                carry = now * z + ds_ @ p["u" + d].T
            dgate = dgate[:-1]
            grad |= {"w" + d: vectors.T @ dgate, "b" + d: dgate.sum(0), "u" + d: du}
            dx += dgate @ p["w" + d].T
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], rows, dx[:, :WORD_DIM])
        np.add.at(grad["char"], gram, (dx[:, WORD_DIM:] * share[:, None])[owner])
        return grad

    # -- texts

    def window_logits(self, numbers: np.ndarray, distinct: list[bytes], first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows over `numbers`, the words of all texts as places in `distinct`."""
        x = self.inputs(distinct)[0]
        gf, gb = self.gates(x, "f"), self.gates(x, "b")
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), BATCH):
            ids, mask = window_ids(numbers, first[i : i + BATCH], size[i : i + BATCH], len(distinct))
            out[i : i + BATCH] = self.forward(gf, gb, ids, mask)[0]
        return out

    def scores(self, texts: list) -> np.ndarray:
        numbers, distinct, counts = numbered([words_of(t) for t in texts])
        text, first, size = windows(counts)
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, text, self.window_logits(numbers, distinct, first, size))
        return sigmoid(best.astype(np.float64))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(all words as places in the list of distinct words, that list, words of each text)."""
    place: dict[bytes, int] = {}
    numbers = [np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)) for words in texts]
    counts = np.array([len(w) for w in texts], np.int64)
    return np.concatenate(numbers) if numbers else np.empty(0, np.int32), list(place), counts


def window_ids(numbers: np.ndarray, first: np.ndarray, size: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(SPAN)
    mask = at < size[:, None]
    if not len(numbers):
        return np.full(mask.shape, padding), mask
    return np.where(mask, numbers[np.minimum(first[:, None] + at, len(numbers) - 1)], padding), mask


def train(texts: list, label: np.ndarray, passes: int = 10, size: int = 256, rate: float = 0.01, seed: int = 3) -> Network:
    """Multi-instance training with Adam; the same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    numbers, distinct, counts = numbered([words_of(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    label = np.asarray(label, np.int64)
    pairs = np.unique(owner * max(1, len(distinct)) + numbers)
    where, word = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
    spread = np.bincount(word, minlength=len(distinct))
    common = np.argsort(-spread, kind="stable")[:MOST_WORDS]
    net = Network({distinct[k]: i + 1 for i, k in enumerate(k for k in common.tolist() if spread[k] >= 3)})
    if not len(texts):
        return net
    weight = odds(where, word, label, 3)
    for cut in (slice(0, 4), slice(0, 5), slice(-4, None), slice(-5, None)):
        place: dict[bytes, int] = {}
        part = np.array([place.setdefault(w[cut], len(place)) for w in distinct], np.int64)
        weight = np.maximum(weight, odds(where, part[word], label, 5)[part])
    text, first, span = windows(counts)
    total = np.concatenate(([0], np.cumsum(weight[numbers])))
    logit = total[first + span] - total[first]
    first_moment, second, step = {}, {}, 0
    for number in range(passes):
        order = np.lexsort((-logit, text))
        top = order[np.flatnonzero(np.diff(text[order], prepend=-1))]  # the highest window of each text
        random = rng.integers(0, len(text), len(top))
        chosen = np.concatenate((top, random[label[text[random]] == 0]))
        rng.shuffle(chosen)
        for i in range(0, len(chosen), size):
            part = chosen[i : i + size]
            raw, mask = window_ids(numbers, first[part], span[part], -1)
            used, ids = np.unique(raw[mask], return_inverse=True)
            placed = np.full(raw.shape, len(used))
            placed[mask] = ids
            x = net.inputs([distinct[k] for k in used.tolist()])
            logits, kept = net.forward(net.gates(x[0], "f"), net.gates(x[0], "b"), placed, mask, keep=True)
            y = label[text[part]].astype(np.float32)
            grads = net.backward(((sigmoid(logits) - y) / len(part)).astype(np.float32), kept, placed, x)
            step += 1
            for k, g in grads.items():
                first_moment[k] = 0.9 * first_moment.get(k, 0) + 0.1 * g
                second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                move = (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
                net.p[k] = (net.p[k] - rate * (1 - 0.8 * number / passes) * move).astype(np.float32)
        logit = net.window_logits(numbers, distinct, first, span) if number + 1 < passes else logit
    return net


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Network:
    """A network from `labels.toxic` of rows that are not held out (crc32 of the id modulo 5 is not 0)."""
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", most).toPandas()
    rows["text"] = rows["text"].fillna("")
    rows = rows.sort_values(HASH, kind="stable")
    return train(rows["text"].tolist(), rows["label"].to_numpy())


def score_toxicity(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs`: `doc_id, held_out, score, predicted`.

    Nulls: a null text counts as empty, a null id as an empty id for `held_out`. A text without words gets the score of an
    empty window; very long texts are read whole, window by window; repeated rows are scored one by one; an empty table
    gives an empty result. Only the text is an input of the score; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(frames, "text"):
            yield pd.DataFrame({"doc_id": piece["doc_id"], "score": held.value.scores(piece["text"].tolist())})

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(score, f"doc_id {id_type}, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir):
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
