"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to order 3 with the counts of what followed them. A byte costs
-log2(n / (T + D)) bits in the longest context that has seen it, and -log2(D / (T + D)) for each longer context that was
escaped from (T: all counts of the context, D: distinct bytes; contexts never seen cost nothing). Statistics are frozen
after training, so the cost of a byte depends on the three before it alone. A tree holds only what its language has
shown, as sorted arrays for each order; its size is that of the training sample, whatever the alphabet and the number of
languages. A text's exact code length is a sum over its 4-byte strings, each distinct one of which is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, small_batches, table
from .samples import bounded_by

#: Training documents of each language at most.
MOST_DOCS = 400
ORDER = 3
#: Languages whose costs are side by side, and bytes of a text that are summed at once: these bound memory, not results.
SIDE_BY_SIDE, SPAN = 16, 1 << 18
LETTER = regex.compile(r"\p{L}")
START = b"\n\n\n"


def text_bytes(text: object) -> bytes:
    """Lower-cased UTF-8, after a start that gives the first bytes a context."""
    return START + (text.lower().encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")


def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, code, n): the 4-byte strings of the texts."""
    for piece in chunks(frames, "text"):
        for lang, group in piece.groupby("lang"):
            parts = []
            for text in group["text"]:
                b = np.frombuffer(text_bytes(text), np.uint8).astype(np.int64)
                parts.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"lang": lang, "code": codes, "n": n.astype(np.int64)})


class Tree:
    """The contexts of one language: for each order the strings seen with their costs, and the contexts seen with their escapes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            seen, at = np.unique(codes & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            counts = np.bincount(at, n, len(seen))
            contexts, first, distinct = np.unique(seen >> 8, return_index=True, return_counts=True)
            whole = np.add.reduceat(counts, first) + distinct
            own, escape = -np.log2(counts / np.repeat(whole, distinct)), -np.log2(distinct / whole)
            self.levels.append((seen.astype(np.uint32), own.astype(np.float32), contexts.astype(np.uint32), escape.astype(np.float32)))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each 4-byte string."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            seen, own, contexts, escape = self.levels[order]
            code = codes[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            at = np.searchsorted(seen[:-1], code)
            hit = seen[at] == code
            out[left[hit]] += own[at[hit]]
            left, code = left[~hit], code[~hit] >> np.uint32(8)
            at = np.searchsorted(contexts[:-1], code)
            out[left] += np.where(contexts[at] == code, escape[at], 0)
        out[left] += 8
        return out


class Model:
    """The context trees of all languages."""

    def __init__(self, grams: pd.DataFrame):
        self.langs = sorted(grams["lang"].unique())
        codes, n = grams["code"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)
        which = np.searchsorted(self.langs, grams["lang"].to_numpy()) if self.langs else np.empty(0, np.int64)
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(np.bincount(which, minlength=len(self.langs)))[:-1] if self.langs else []
        self.trees = [Tree(codes[i], n[i]) for i in np.split(order, ends)] if self.langs else []

    def code_lengths(self, texts: list) -> np.ndarray:
        """Bits for each text and language."""
        data = [text_bytes(t) for t in texts]
        ends = np.cumsum([len(d) for d in data])
        b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
        out = np.zeros((len(data), len(self.langs)))
        if len(b) > ORDER:
            codes, index = np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_inverse=True)
            starts = np.concatenate(([0], ends[:-1]))
            for k in range(0, len(self.trees), SIDE_BY_SIDE):
                cost = np.stack([tree.costs(codes) for tree in self.trees[k : k + SIDE_BY_SIDE]], 1).astype(np.float32)
                for i, (start, end) in enumerate(zip(starts.tolist(), (ends - ORDER).tolist(), strict=True)):
                    for at in range(start, end, SPAN):
                        out[i, k : k + SIDE_BY_SIDE] += cost[index[at : min(end, at + SPAN)]].sum(0, dtype=np.float64)
        return out

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        bits = self.code_lengths(texts)
        spread = np.exp2(-np.clip(bits - bits.min(1, keepdims=True), 0, 60)) if self.langs else bits
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not self.langs or not isinstance(text, str) or not LETTER.search(text):
                names.append("und")
                continue
            k = int(bits[i].argmin())
            names.append(self.langs[k])
            scores[i] = spread[i, k] / spread[i].sum()
        return names, scores


def fit(docs: DataFrame, most_docs: int = MOST_DOCS) -> Model:
    """Trees from text and non-null lang of documents whose crc32 of the id modulo 3 is not 1.

    Documents are chosen by the hash of id and text, `most_docs` of each language at most; the counting is distributed and
    its result is bounded by that sample.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & (crc_bucket(F.col("doc_id"), 3) != 1)).select("doc_id", "lang", "text")
    chosen = bounded_by(usable, "lang", most_docs, ["doc_id", "text"])
    grams = chosen.select("lang", "text").mapInPandas(count_grams, "lang string, code long, n long")
    return Model(grams.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, held_out, lang_pred, score` (score: share of the language among all, given equal priors).

    Nulls: a null text, and a text without a letter (empty ones too), is `und` with score 0; a null id counts as an empty
    id for `held_out`. Ties go to the language first in code point order. Very long texts are read whole; repeated rows
    are judged one by one; an empty table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(frames, "text"):
            names, scores = held.value.predict(piece["text"].tolist())
            yield pd.DataFrame({"doc_id": piece["doc_id"], "lang_pred": names, "score": scores})

    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(predict, f"doc_id {id_type}, lang_pred string, score double")
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_language(spark, sf_dir):
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
