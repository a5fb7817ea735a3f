"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items form one automaton of all their substrings. Words of a document stream through it; at
each word the automaton knows the longest run of words ending there that some item contains. A run that reaches the
window length marks its last words as hit; an item shorter than the window counts when it occurs as a whole.

The automaton is broadcast. Items come to the driver as a stream and fill automata of at most `MOST_WORDS` words, an item
with more in overlapping pieces. One automaton is built, used and dropped before the next, so what the driver, a broadcast
and a worker hold is bounded whatever the benchmark holds; the documents pass once for each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, small_batches, table, utf8

#: A-Z lower-cased; ASCII that is neither digit nor letter becomes a blank; other bytes stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WINDOW = 10
#: Words of the items in one automaton; about 300 bytes of memory for each.
MOST_WORDS = 300_000


class SuffixAutomaton:
    """All substrings of the items, over word numbers."""

    def __init__(self, items: Sequence[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # item, words so far, state
        self.ids = [item for item, _ in items]
        for number, (_, words) in enumerate(items):
            state = 0
            for k, word in enumerate(words):
                state = self._extend(state, self.vocab.setdefault(word, len(self.vocab)))
                ends.append((number, k + 1, state))
        sizes = [len(words) for _, words in items]  # pieces of an item share its id
        found: list[set[int]] = [set() for _ in self.next]
        self.at_window = [self._ancestor(s, window) for s in range(len(self.next))]
        whole: dict[int, list[tuple[int, int]]] = {}
        for number, k, state in ends:
            if k >= window:
                found[self.at_window[state]].add(number)
            elif k == sizes[number]:
                whole.setdefault(self._ancestor(state, k), []).append((k, number))
        self.items = [tuple(sorted(x)) for x in found]
        #: (length, item) of the short items that end where a state's runs end
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = self.short[self.link[s]] + tuple(whole.get(s, ()))
        self.least = min([window, *(n for n in sizes if n)]) if any(sizes) else 0

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return state

    def _ancestor(self, state: int, length: int) -> int:
        """The state of the last `length` words of `state`'s runs; `state` itself if those are shorter."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes], hit: np.ndarray, items: set[int]) -> int:
        """Marks hit words in `hit` and adds the items found; returns the longest run of words that some item contains."""
        get, most = self.vocab.get, 0
        ids = [get(w, -1) for w in words]
        known = np.array(ids, np.int64) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        following, link, length, short, at_window, found = self.next, self.link, self.length, self.short, self.at_window, self.items
        window = self.window
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < self.least:
                continue
            state = run = 0
            for i in range(start, end):
                word = ids[i]
                step = following[state].get(word)
                while step is None and state:
                    state = link[state]
                    run = length[state]
                    step = following[state].get(word)
                if step is None:
                    run = 0
                    continue
                state, run = step, run + 1
                if run > most:
                    most = run
                if run >= window:
                    hit[i + 1 - window : i + 1] = True
                    items.update(found[at_window[state]])
                for size, item in short[state]:
                    if size <= run:
                        hit[i + 1 - size : i + 1] = True
                        items.add(item)
        return most


def words_of(text: object) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


def dealt(items: Iterable[tuple[object, object]], window: int = WINDOW, most_words: int = MOST_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item, words) lists of `most_words` words at most, one list at least. A longer item comes in pieces that share
    `window` - 1 words, so that each of its windows lies in one of them."""
    now, size, most_words = [], 0, max(most_words, 2 * window)
    for item, text in items:
        words = words_of(text)
        step = most_words - window + 1
        for at in range(0, len(words) if len(words) <= most_words else len(words) - window + 1, step if len(words) > most_words else max(1, len(words))):
            piece = words[at : at + most_words]
            if now and size + len(piece) > most_words:
                yield now
                now, size = [], 0
            now.append((item, piece))
            size += len(piece)
    yield now


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep: Sequence[str] = (),
    cleaned: bool = False,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest`, the columns named in `keep`, and
    with `cleaned` the text without its hit words (from the first byte of the first to the last byte of the last word of each hit run).

    Nulls: a null document or item text has no words; a null item id counts as the text "null"; a null doc id stays null.
    Repeated rows are scanned one by one; items that repeat an id count once. Without documents the result is empty,
    without items nothing is hit. Very long texts are scanned whole, one at a time. Other columns are ignored. `longest` is the
    longest run of words that an item (or a piece of one longer than `most_words`) contains.

    Items that fit into one automaton take one pass. Otherwise documents are numbered and written once, each automaton's
    hits are noted by number, and the notes meet the texts at the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = ((str(r[0]) if r[0] is not None else "null", r[1]) for r in benchmark.select(item_col, item_text_col).toLocalIterator())
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + (", cleaned string" if cleaned else "")

    def row(text: object, words: list[bytes], hit: np.ndarray, names: list[str], longest: int) -> tuple:
        count = int(hit.sum())
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        return len(words), count, len(names), sha, count > 0, longest, (without(utf8(text), hit) if count else text) if cleaned else None

    def results(piece: pd.DataFrame, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "cleaned"])
        made.insert(0, "doc_id", piece["doc_id"])
        made = made.assign(**{c: piece[f"__keep_{c}"] for c in keep})
        return made[["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", *keep, *(["cleaned"] if cleaned else [])]]

    lists = dealt(items, window, most_words)
    held = spark.sparkContext.broadcast(SuffixAutomaton(next(lists), window))
    following = next(lists, None)
    if following is None:

        def scan_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = held.value
            for piece in chunks(frames, "__text"):
                rows = []
                for text in piece["__text"]:
                    words = words_of(text)
                    hit, found = np.zeros(len(words), bool), set()
                    longest = automaton.scan(words, hit, found)
                    rows.append(row(text, words, hit, sorted({automaton.ids[i] for i in found}), longest))
                yield results(piece, rows)

        return frame.mapInPandas(scan_all, schema)

    base = cut(frame.withColumn("__row", F.monotonically_increasing_id()))
    notes = None
    while held is not None:

        def note(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            automaton = held.value
            for piece in chunks(frames, "__text"):
                out = []
                for number, text in zip(piece["__row"], piece["__text"], strict=True):
                    words = words_of(text)
                    hit, found = np.zeros(len(words), bool), set()
                    longest = automaton.scan(words, hit, found)
                    if longest:
                        out.append((number, np.packbits(hit).tobytes() if hit.any() else None, sorted({automaton.ids[i] for i in found}), longest))
                yield pd.DataFrame(out, columns=["row", "hits", "names", "longest"])

        made = cut(base.select("__row", "__text").mapInPandas(note, "row long, hits binary, names array<string>, longest long"))
        notes = made if notes is None else notes.unionByName(made)
        held.destroy()
        held = spark.sparkContext.broadcast(SuffixAutomaton(following, window)) if following is not None else None
        following = next(lists, None) if held is not None else None
    noted = notes.groupBy("row").agg(F.collect_list("hits").alias("__hits"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("__items"), F.max("longest").alias("__longest"))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(frames, "__text"):
            rows = []
            for text, hits, names, longest in zip(piece["__text"], piece["__hits"], piece["__items"], piece["__longest"], strict=True):
                words = words_of(text)
                hit = np.zeros(len(words), bool)
                for bits in hits if hits is not None else ():
                    hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                rows.append(row(text, words, hit, list(names) if names is not None else [], longest))
            yield results(piece, rows)

    met = base.join(noted, F.col("__row") == F.col("row"), "left").drop("row", "__row").withColumn("__longest", F.coalesce("__longest", F.lit(0).cast("long")))
    return met.mapInPandas(finish, schema)


def without(data: bytes, hit: np.ndarray) -> str:
    """The text without its hit words: each run of hit words goes, with what stands between them."""
    raw = np.frombuffer(data.translate(WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], raw, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    out, at = [], 0
    for first, last in zip(turns[::2], turns[1::2], strict=True):
        out.append(data[at : starts[first]])
        at = int(ends[last - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_coverage: float = 0.5, window: int = WINDOW
) -> DataFrame:
    """`docs` without what is in the benchmark, all columns kept: spans of hit words are cut out of the text, and a
    document goes as a whole if more than `most_coverage` of its words are hit. Documents without a hit stay as they are."""
    places = [f"__c{i}" for i in range(len(docs.columns))]  # own names cannot clash with those of the columns
    ident, text = (places[docs.columns.index(c)] for c in (id_col, text_col))
    rest = [c for c in places if c not in (ident, text)]
    scanned = scan_documents(docs.toDF(*places), benchmark, ident, text, window=window, keep=rest, cleaned=True)
    scanned = scanned.where(F.col("n_hit") <= most_coverage * F.col("n_words"))
    chosen = {ident: F.col("doc_id"), text: F.col("cleaned")}
    return scanned.select(*(chosen.get(p, F.col(p)).alias(c) for p, c in zip(places, docs.columns, strict=True)))


def op8_decontaminate(spark, sf_dir):
    """How much of every document is benchmark text, and which items it holds."""
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest")


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), dwin AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM dw, sizes)
), found AS (
  SELECT r, i, n, item FROM dwin JOIN win USING (n, g)
), spans AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spans USING (r) LEFT JOIN items USING (r)
"""
