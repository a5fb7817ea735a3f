"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table and is a vector of `dim` weights (256 KB), which is
all that travels to the executors. A row needs nothing but its own url, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, ascii_lower, table

DIM, GRAMS = 1 << 16, (3, 4, 5)
#: What all rows to block together count beside all rows to allow.
BLOCK_WEIGHT = 4.0
#: Most labelled rows that `train` takes from a table.
MOST_LABELLED = 50_000

#: (verdict, host and path prefix): a rule fits its host and all subdomains, the longest fitting rule wins.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Words of unwanted and of ordinary sites, and what stands around them in names (fixed values).
_BAD = (
    "casino poker bets betting jackpot slots lotto roulette pills viagra pharma steroids adult xxx porn sex cams escorts spam ads adserver banners popups "
    "clickbait tracker payday loans warez cracks keygen torrents malware phishing replica"
).split()
_GOOD = (
    "news library university museum weather science garden cooking history sports travel music theatre bakery school council journal wiki docs river "
    "hospital orchestra transport elections recipes chemistry athletics gallery parliament physics mountain harbour thinking northern weekly reading "
    "medicine hiking island teachers printing festival railway planning forest teaching astronomy cathedral heritage research volunteers engineering"
).split()
_ONSETS, _VOWELS, _CODAS = "b c d f g h k l m n p r s t v w br ch cl cr dr fl gr pl pr sh st th tr wh".split(), "a e i o u ai ea ee io ou".split(), ["", "", *"n r s t l nd nt ng st sh th ck".split()]
#: Made-up ordinary names in the built-in table.
MADE_UP = 500
_AROUND = ("{}", "best-{}", "{}-zone", "my{}", "{}hub", "top-{}", "{}4u", "the-{}-club", "{}-online", "{}s-daily")


def default_labelled() -> list[tuple[str, int]]:
    """The built-in labelled URL table, (url, 1 = block): names made of unwanted and of ordinary words in the same forms, under
    several hosts. Every word stands in four forms as a host, alone as another, and some in a path. Made-up names of one to four
    syllables are ordinary, so that a name is not unwanted for being strange."""
    rng = np.random.default_rng(17)
    out = [("", 0)]
    tlds, subs, langs = ("com", "net", "org"), ("", "www.", "blog.", "m."), ("en", "fr", "de", "es")
    for label, words in ((0, _GOOD), (1, _BAD)):
        for i, word in enumerate(words):
            for k, sub in enumerate(subs):
                name = _AROUND[(i * 3 + k) % len(_AROUND)].format(word)
                out.append((f"https://{sub}{name}{('.example', '')[(i + k) % 2]}.{tlds[(i + k) % 3]}/{langs[(i // 3 + k) % 4]}/{i * 37 + k}{('', '.html', '/')[(i // 2 + k) % 3]}", label))
            out.append((f"http://{word}.{tlds[i % 3]}/", label))
            if label or i % 2:
                out.append((f"https://{_GOOD[(i + 7) % len(_GOOD)]}.example.{tlds[i % 3]}/{word}/page", label))
    for i in range(MADE_UP):
        name = "".join("".join(part[int(rng.integers(len(part)))] for part in (_ONSETS, _VOWELS, _CODAS)) for _ in range(1 + i % 4))
        out.append((f"https://{subs[i // 3 % 4]}{name}{('.example', '')[i % 2]}.{tlds[i % 3]}/{langs[i // 12 % 4]}/{i * 37}{('', '.html', '/')[i % 3]}", 0))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. Null or no `://`: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Of rules as long, the one listed first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def features(hosts: Sequence[str], paths: Sequence[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of the hashed byte n-grams of `^host$` and of `path$`, in separate hash ranges."""
    rows, feats = [], []
    for part, (texts, fmt) in enumerate(((hosts, "^{}$"), (paths, "{}$"))):
        pieces = [fmt.format(t).encode("utf-8", "surrogatepass").translate(LOWER_BYTES) for t in texts]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(pieces)), lengths)
        for n in GRAMS:
            if len(data) < n:
                continue
            code = np.full(len(data) - n + 1, 2 * n + part, np.uint64)
            for k in range(n):
                code = code * np.uint64(1_000_003) + data[k : len(data) - n + 1 + k]
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = row[: len(code)] == row[n - 1 :]
            rows.append(row[: len(code)][inside])
            feats.append(((code >> np.uint64(32)) % np.uint64(dim)).astype(np.int64)[inside])
    return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(feats or [np.empty(0, np.int64)])


def _split(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    return rest[:end], path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def _scores(rows: np.ndarray, feats: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.bincount(rows, weights[feats], n)
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(bias + total / np.sqrt(count), -30, 30)))


def train(labelled: Sequence[tuple[str, int]], dim: int = DIM, steps: int = 1200, rate: float = 8.0, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; the same table gives the same model."""
    parts = [_split(url) for url, _ in labelled]
    y = np.array([label for _, label in labelled], float)
    rows, feats = features([h for h, _ in parts], [p for _, p in parts], dim)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    weights, bias = np.zeros(dim), 0.0
    heavy = np.where(y == 1, BLOCK_WEIGHT * (y == 0).sum() / max(1, y.sum()), 1.0)
    heavy /= max(1e-9, heavy.mean())
    for _ in range(steps):
        off = (_scores(rows, feats, len(y), weights, bias) - y) * heavy
        weights -= rate * (np.bincount(feats, (off * scale)[rows], dim) / len(y) + l2 * weights)
        bias -= rate * off.mean()
    return weights.astype(np.float32), float(bias)


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    labelled: DataFrame | Sequence[tuple[str, int]] | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per row of `pages`: `page_id, host, path, rule, verdict, score` (score: chance of block by the model).

    `labelled`: a table (url, label) of which `MOST_LABELLED` rows at most are used, a list, or None for the built-in
    table. Nulls: a null url, or one without `://`, has empty host and path and gets the model's verdict on those; a null
    id stays null. Repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored.
    """
    if isinstance(labelled, DataFrame):
        labelled = [(r[0], int(r[1])) for r in labelled.select("url", "label").dropna().limit(MOST_LABELLED).collect()]
    weights, bias = train(labelled if labelled is not None else default_labelled())
    held = pages.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights, bias = held.value
        for hosts, paths in batches:
            rows, feats = features(hosts.tolist(), paths.tolist())
            yield pd.Series(_scores(rows, feats, len(hosts), weights, bias))

    score = F.pandas_udf(score, "double")
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("score", score("host", "path"))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")


def op2_url_filter(spark, sf_dir):
    """Rule and verdict for the url of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))
