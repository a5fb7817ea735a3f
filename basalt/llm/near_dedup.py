"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. Every text becomes the set of its word shingles and a sketch of it. Texts with the same set form a class; only
   classes go on (hot groups of exact copies are folded by a partial aggregate).
2. Bands of the sketch put classes into buckets. In a small bucket, sketches are compared and a spanning forest of the
   pairs that may be similar enough leaves it; in a large one every class is tied to the least. Buckets so large that the
   components made by such ties would cost too much to settle are split first, by pairs of such bands that classes share, which
   keeps apart what merely has a passage in common. No bucket emits its pairs.
3. Connected components of these ties hold every link. Each is settled on the full shingle sets: a union-find compares
   a class with those it is not joined to yet, and emits who joins whom.
   A component too large for one task is dealt into blocks: first each block is settled by itself, then some pivots meet
   every block, then what the largest group has not taken in meets every block. Every pair that is not joined
   already has then met, so nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, cut, if_small, small_batches, table
from .components import components
from .shingles import U, band_keys, bands_for, mix, shingle_sets, sketches

#: Coordinates of a sketch, largest bucket whose sketches are compared, largest set of classes and of shingles for one task.
COORDINATES, SMALL_BUCKET, TASK_CLASSES, TASK_SHINGLES = 256, 512, 256, 3_000_000
#: Largest bucket that is not split: its classes, if none were alike, would meet in 2e8 pairs, some 20 seconds of work over many tasks.
SPLIT_BUCKET = 20_000
#: Most buckets whose rows are broadcast; share of all rows that makes a class hot, so that there are 1 / HOT_SHARE hot classes at most.
HOT_BUCKETS, HOT_SHARE = 5000, 1 / 1000
#: Deviations of the estimate that a pair may lie under the threshold and still be verified.
SLACK = 5.0
PIVOTS = 16


def set_id(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    a, b = shingles.sum(dtype=U), mix(shingles + U(0x632BE59BD9B4E019)).sum(dtype=U)
    return mix(np.array([a, b + U(len(shingles))], U)).tobytes()


def short_id(sid: bytes) -> int:
    """The first half of a set's id. Numbers are cheaper to group than bytes; classes that share one are merely compared."""
    return int.from_bytes(sid[:8], "little", signed=True)


def by_group(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come in the order of `key`; a group may span batches."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        names = list(zip(*(frame[k] for k in key), strict=True))
        turns = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        for start, end in zip([0, *turns], [*turns, len(names)], strict=True):
            if last is not None and names[start] != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[start:end])
            last = names[start]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


class Joined:
    """Labels of numbered nodes, merged by union."""

    def __init__(self, labels: np.ndarray):
        self.label = labels

    def merge(self, a: int, others: np.ndarray) -> bool:
        names = np.unique(self.label[others])
        names = names[names != self.label[a]]
        if not len(names):
            return False
        self.label[np.isin(self.label, names)] = self.label[a]
        return True


def settle(sets: list[np.ndarray], labels: np.ndarray, probes: np.ndarray, percent: int, slack: float = SLACK) -> np.ndarray:
    """Compares each of `probes` (places in `sets`) with every set under another label, and merges labels of sets whose
    100 * intersection reaches `percent` * union. A sketch estimate far below the threshold spares the exact comparison."""
    joined = Joined(labels.copy())
    threshold, t = percent / 100, COORDINATES
    least = threshold - slack * np.sqrt(threshold * (1 - threshold) / t)
    sketch = (sketches(sets, t) & U(0xFF)).astype(np.uint8)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    offset = np.cumsum(sizes) - sizes
    mark = np.zeros(code.max() + 1, bool)
    for p in probes.tolist():
        n = sizes[p]
        open_ = np.flatnonzero((joined.label != joined.label[p]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
        if not len(open_):
            continue
        open_ = open_[(sketch[open_] == sketch[p]).mean(1) >= least]
        if not len(open_):
            continue
        mine = code[offset[p] : offset[p] + n]
        mark[mine] = True
        width = sizes[open_]
        at = np.repeat(offset[open_] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        common = np.add.reduceat(mark[code[at]].astype(np.int64), np.cumsum(width) - width)
        mark[mine] = False
        joined.merge(p, open_[100 * common >= percent * (n + width - common)])
    return joined.label


def _sketched(percent: int, k: int) -> Callable:
    bands, rows = bands_for(percent / 100, COORDINATES)

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in chunks(frames, "text"):
            sets = shingle_sets(piece["text"].tolist(), k)
            made = sketches(sets, COORDINATES)
            keys = band_keys(made, bands, rows).view(np.int64)
            some = [len(s) > 0 for s in sets]
            ids = [set_id(s) if x else None for s, x in zip(sets, some, strict=True)]
            yield pd.DataFrame({
                "doc_id": piece["doc_id"], "text_key": piece["text_key"], "n_shingles": [len(s) for s in sets],
                "sid": ids, "cid": [short_id(i) if x else None for i, x in zip(ids, some, strict=True)],
                "bands": [b if x else None for b, x in zip(keys, some, strict=True)],
                "sketch": [c.tobytes() if x else None for c, x in zip((made & U(0xFF)).astype(np.uint8), some, strict=True)],
            })

    return sketch


def _forest(percent: int) -> Callable:
    """For each list of classes, a spanning forest of the pairs whose sketches may reach the threshold."""
    threshold = percent / 100
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / COORDINATES)

    def ties(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, ["lid"]):
            cid = group["cid"].to_numpy()
            sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
            label, a, b = np.arange(len(group)), [], []
            for i in range(len(group) - 1):
                other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                near = other[(sketch[other] == sketch[i]).mean(1) >= least]
                if len(near):
                    names, first = np.unique(label[near], return_index=True)
                    a.append(cid[near[first]])
                    b.append(np.full(len(names), cid[i]))
                    label[np.isin(label, names)] = label[i]
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return ties


def _settled(percent: int) -> Callable:
    """For each (comp, part): the classes marked `probe` meet all others; emits (a, b) for each class that got a new label."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(frames, ["comp", "part"]):
            group = group.sort_values("sid", kind="stable").drop_duplicates("sid")
            sets = [np.asarray(s).view(U) for s in group["shingles"]]
            _, start = np.unique(group["label"].to_numpy(), return_inverse=True)
            end = settle(sets, start, np.flatnonzero(group["probe"].to_numpy()), percent)
            # one tie for each label that joined another, between two labels' names
            names = group["label"].to_numpy()
            pairs = pd.DataFrame({"a": names, "end": end}).drop_duplicates()
            pairs["b"] = pairs.groupby("end")["a"].transform("min")
            pairs = pairs[pairs["a"] != pairs["b"]]
            if len(pairs):
                yield pairs[["a", "b"]]

    return run


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    dealt = rows.repartition("comp", "part").sortWithinPartitions("comp", "part")
    return dealt.select("comp", "part", "sid", "label", "probe", "shingles").mapInPandas(_settled(percent), "a binary, b binary")


def _links_of_large(rows: DataFrame, percent: int) -> DataFrame:
    """Ties inside components too large for one task; `rows`: comp, blocks, sid, shingles."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    ties = cut(_meet(rows.select("comp", F.col("block").alias("part"), "sid", F.col("sid").alias("label"), F.lit(True).alias("probe"), "shingles"), percent))
    for stage in ("pivots", "rest"):
        roots = components(ties)
        named = rows.join(roots, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "sid")).drop("node", "root")
        sizes = named.groupBy("comp", "label").count()
        top = sizes.groupBy("comp").agg(F.max(F.struct("count", "label")).alias("x")).select("comp", F.col("x.label").alias("top"), F.col("x.count").alias("among"))
        named = named.join(if_small(cut(top.coalesce(8))), "comp")  # one row for each component that is too large
        base = named.select("comp", F.col("block").alias("part"), "sid", "label", F.lit(False).alias("probe"), "shingles")
        if stage == "pivots":
            # the hash leaves a few times as many as are wanted, whatever the size of the group
            h = F.xxhash64(F.lit("pivot"), "sid")
            keys = named.where("label = top").select("comp", "sid", h.alias("h"), "among")
            keys = keys.where(F.col("h").cast("double") <= float(2**64) * 4 * PIVOTS / F.col("among") - float(2**63))
            chosen = keys.withColumn("n", F.row_number().over(Window.partitionBy("comp").orderBy("h", "sid"))).where(f"n <= {PIVOTS}").select("sid")
            probes = named.join(if_small(cut(chosen.coalesce(8))), "sid", "left_semi")
        else:
            probes = named.where("label <> top")
        # each probe visits every block; probes of one block are kept apart so that a task stays small
        to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to")
        visits = probes.select("comp", to, F.col("block").alias("of"), "blocks", "sid", "label", F.lit(True).alias("probe"), "shingles")
        if stage == "pivots":
            meet = base.unionByName(visits.select("comp", F.col("to").alias("part"), "sid", "label", "probe", "shingles"))
        else:
            visits = visits.withColumn("part", F.col("to").cast("long") * F.col("blocks") + F.col("of"))
            pairs = visits.select(F.col("comp").alias("c"), "to", F.col("part").alias("meeting")).distinct()
            hosts = base.join(pairs, (F.col("comp") == F.col("c")) & (F.col("part") == F.col("to")))
            meet = hosts.select("comp", F.col("meeting").alias("part"), "sid", "label", "probe", "shingles")
            meet = meet.unionByName(visits.select("comp", "part", "sid", "label", "probe", "shingles"))
        # a probe that meets its own block is there twice
        meet = meet.groupBy("comp", "part", "sid", "label").agg(F.max("probe").alias("probe"), F.first("shingles").alias("shingles"))
        ties = cut(ties.unionByName(_meet(meet, percent)))
    return ties


def _bucketed(member: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """From rows (cid, key): the sorted `cids` of every bucket that is small, and the rows of large ones (cid, key, least, size), or
    None if there are none. Buckets above a bound hold so large a share of all rows that they are few, and are broadcast."""
    buckets = cut(member.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("least")).where("size > 1"))
    seen = buckets.agg(F.sum("size").alias("n"), F.max("size").alias("most")).first()
    bound = max(SMALL_BUCKET, (seen["n"] or 0) // HOT_BUCKETS)
    hot = F.broadcast(buckets.where(F.col("size") > bound))
    placed = member.join(hot.select("key"), "key", "left_anti").join(buckets.where(F.col("size") <= bound), "key")
    lists = placed.where(F.col("size") <= SMALL_BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("cid")).alias("cids")).select("cids")
    if (seen["most"] or 0) <= SMALL_BUCKET:
        return lists, None
    columns = ["cid", "key", "least", "size"]
    return lists, placed.where(F.col("size") > SMALL_BUCKET).select(columns).unionByName(member.join(hot, "key").select(columns))


def _coarse_ties(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) between classes: their components hold every pair that may be similar enough.

    A pair that shares a small bucket meets there, one that shares a large bucket is tied. One that shares buckets beyond
    `SPLIT_BUCKET` only meets, or is tied, in those that two of its bands make; with one band in common and that so large it
    would not, which has a chance of 2e-5 at a threshold of 0.85 and of 5e-5 at 0.8.
    """
    lists, large = _bucketed(classes.select("cid", F.explode("bands").alias("key")))
    stars = []
    if large is not None:
        large = cut(large)
        stars.append(large.where(F.col("size") <= SPLIT_BUCKET))
        huge = large.where(F.col("size") > SPLIT_BUCKET)
        if huge.limit(1).count():
            both = cut(huge.groupBy("cid").agg(F.array_sort(F.collect_set("key")).alias("keys")))  # as many as there are bands
            first = F.posexplode("keys").alias("at", "one")
            pairs = both.select("cid", "keys", first).select("cid", "one", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias("two"))
            small, large = _bucketed(pairs.select("cid", F.xxhash64("one", "two").alias("key")))
            lists = lists.unionByName(small)
            stars += [large] if large is not None else []
    lists = lists.distinct()
    listed = lists.select(F.xxhash64("cids").alias("lid"), F.explode("cids").alias("cid")).join(classes.select("cid", "sketch"), "cid")
    forest = listed.repartition("lid").sortWithinPartitions("lid", "cid").select("lid", "cid", "sketch").mapInPandas(_forest(percent), "a long, b long")
    for star in stars:
        forest = forest.unionByName(star.where("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b")).distinct())
    return forest


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_shingles, component_id, kept, text_key`.

    Two documents are linked if 100 * intersection >= `percent` * union of their sets of distinct `k`-word shingles (words:
    runs of anything but blank and U+0009 to U+000D, A-Z lower-cased; fewer than `k` words: the sequence is one shingle).
    `component_id` is the smallest id reachable over links, `kept` tells the document with that id. The bands lose a pair
    at the threshold with a chance below 1e-5 (5e-5 where all its buckets are beyond `SPLIT_BUCKET`); every pair that is found is verified on full sets of 64-bit hashes.

    Nulls: a null text, like one without words, has no shingles and is linked with nothing; a null id never is a
    component's id where another exists. Repeated rows share a class; ties cannot arise, as ids decide. An empty table
    gives an empty result. Very long texts are read whole. Other columns are ignored. `text_key` is xxhash64 of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    schema = f"doc_id {id_type}, text_key long, n_shingles long, sid binary, cid long, bands array<long>, sketch binary"
    made = cut(base.mapInPandas(_sketched(percent, k), schema))
    classes = made.where("sid IS NOT NULL").groupBy("sid")
    classes = cut(classes.agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("cid").alias("cid"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    coarse = components(_coarse_ties(classes, percent))

    comp = coarse.select(F.col("node").alias("cid"), F.col("root").alias("comp")).unionByName(coarse.select(F.col("root").alias("cid"), F.col("root").alias("comp")).distinct())
    comp = comp.join(classes.select("cid", "sid", "rep", "n"), "cid").drop("cid")
    load = comp.groupBy("comp").agg(F.sum("n").alias("shingles"), F.count("*").alias("classes"))
    blocks = F.greatest(F.ceil(F.col("shingles") / TASK_SHINGLES), F.ceil(F.col("classes") / TASK_CLASSES)).cast("int")
    comp = cut(comp.join(load.select("comp", blocks.alias("blocks")), "comp"))

    def shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for piece in chunks(frames, "text"):
            piece = piece[[key not in seen for key in piece["text_key"]]].drop_duplicates("text_key")  # repeated rows of a representative
            seen.update(piece["text_key"])
            sets = shingle_sets(piece["text"].tolist(), k)
            yield pd.DataFrame({"sid": [set_id(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    rep = if_small(cut(comp.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")).distinct()))
    texts = base.join(rep, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")), "left_semi").select("text_key", "text")
    full = texts.mapInPandas(shingled, "sid binary, shingles array<long>").join(comp, "sid")
    small = full.where("blocks = 1").select("comp", F.lit(0).alias("part"), "sid", F.col("sid").alias("label"), F.lit(True).alias("probe"), "shingles")
    ties = _meet(small, percent)
    large = comp.where("blocks > 1")
    if large.limit(1).count():
        held = full.where("blocks > 1").select("comp", "blocks", "sid", "shingles").dropDuplicates(["comp", "sid"])
        ties = cut(ties).unionByName(_links_of_large(cut(held), percent))
        ties = components(ties).select(F.col("node").alias("a"), F.col("root").alias("b"))
    ties = cut(ties)  # (class, root) stars

    named = ties.select(F.col("a").alias("sid"), F.col("b").alias("root")).unionByName(ties.select(F.col("b").alias("sid"), F.col("b").alias("root")).distinct())
    named = named.join(classes.select("sid", "first_id"), "sid")
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    joined = named.join(least, "root").select("sid", "component")
    # only classes with copies or links name another document; the rest name themselves
    moved = classes.where("copies > 1").select("sid", F.col("first_id").alias("component")).unionByName(joined)
    moved = moved.groupBy("sid").agg(F.min("component").alias("component"))
    # rows of hot classes meet their component on the map side, rows without shingles meet none
    out = made.select("doc_id", "text_key", "n_shingles", "sid")
    hot = classes.where(F.col("copies") > max(100, made.count() * HOT_SHARE)).select(F.col("sid").alias("hot"))
    named_hot = F.broadcast(cut(moved.join(F.broadcast(hot), F.col("sid") == F.col("hot")).select("hot", F.col("component").alias("hot_component"))))
    out = out.join(named_hot, F.col("sid") == F.col("hot"), "left")
    settled = F.col("sid").isNull() | F.col("hot").isNotNull()
    met = out.where(~settled).drop("hot", "hot_component").join(moved, "sid", "left")
    out = out.where(settled).withColumnRenamed("hot_component", "component").drop("hot").unionByName(met)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` of which one document of each group stays, with all their columns.

    Of repeated rows (same id, same text) of a document that stays, one stays if it has shingles.
    """
    ident, key, action = "__basalt_id", "__basalt_key", "__basalt_action"
    decided = near_groups(docs, id_col, text_col, k, percent).groupBy("doc_id", "text_key").agg(
        F.min("kept").alias("kept"), F.max("n_shingles").alias("n"), F.count("*").alias("rows")
    )
    verdict = F.when(~F.col("kept"), "drop").when((F.col("rows") > 1) & (F.col("n") > 0), "fold")
    marked = cut(decided.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key), verdict.alias(action)).where(F.col(action).isNotNull()))
    text_key = F.xxhash64(F.col(text_col))
    held = docs.join(if_small(marked), F.col(id_col).eqNullSafe(F.col(ident)) & (text_key == F.col(key)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = held.where(F.col(action).isNull()).select(columns)
    if not marked.where(F.col(action) == "fold").limit(1).count():
        return kept
    return kept.unionByName(held.where(F.col(action) == "fold").dropDuplicates([ident, key]).select(columns))


def op7_near_dedup(spark, sf_dir):
    """The near-duplicate component of every document, by 3-word shingles and a similarity of 0.85."""
    return near_groups(table(spark, sf_dir, "documents"), k=3, percent=85).drop("text_key")


#: Every pair of different sets that share a shingle is counted, and links are followed to their end: for tables of test size.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g
  FROM w
), classed AS (
  SELECT r, doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN min(r) OVER (PARTITION BY g) ELSE r END AS c, g FROM s
), shingle AS (
  SELECT c, n, unnest(g) AS x FROM classed WHERE r = c AND n > 0
), link AS (
  SELECT a.c AS a, b.c AS b FROM shingle a JOIN shingle b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT DISTINCT a AS c, a AS o FROM both_ways UNION SELECT reach.c, both_ways.b FROM reach JOIN both_ways ON reach.o = both_ways.a
), least AS (
  SELECT c, min(doc_id) AS first_id FROM classed GROUP BY c
), component AS (
  SELECT reach.c, min(first_id) AS component_id FROM reach JOIN least ON reach.o = least.c GROUP BY reach.c
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, first_id) AS component_id, doc_id = coalesce(component_id, first_id) AS kept
FROM classed JOIN least USING (c) LEFT JOIN component USING (c)
"""
