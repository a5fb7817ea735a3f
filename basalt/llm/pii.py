"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Only DataFrame functions are used. A row needs nothing but its own text, so there is no shuffle. Patterns start at the
first character of a run or at the end of the match before (`\\G`), and repeat possessively: a long run without a match
is passed once, and no repetition recurses. A text with no `@`, `+` or digit skips the patterns that need one.

Kinds: email, ip, card and phone as their patterns say (the base); iban (checked mod 97); ssn, which counts only beside
words that name it; secret, keys and tokens in their issuers' formats, heads of private keys, and values with a digit that
are set to a name such as password or api_key. Of an iban printed in groups of four the pattern finds the head; mod 97 tells how many of the
groups after it belong to it. Every span has a score: what its kind gives, raised by context words nearby.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}(?![A-Za-z0-9_])|(?=(?:\x20[A-Z0-9]{4}){2}\x20[A-Z0-9]))",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
    "secret": r"-----BEGIN\x20[A-Z\x20]{0,30}PRIVATE\x20KEY-----|(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_])|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|sk_(?:live|test)_[A-Za-z0-9]{16,}|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x22\x27]?[\x20\x09]{0,3}[:=][\x20\x09]{0,3}[\x22\x27]?[^\x00-\x20\x22\x27,;]{8,})",
}
#: What a proposed secret must be: of an issuer's format, or with a digit in what is set.
SECRET = r"^(?:-----|AKIA|ASIA|gh[pousr]_|xox|AIza|sk_)|[:=].*[0-9]"
#: An iban printed in groups, with what may follow it.
GROUPS = r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
#: What a text must hold for the pattern to have a chance.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]"}
#: The same for secrets, as plain strings, the second ones in any case: a search for a string is far cheaper than one for a pattern.
SECRET_NEEDS = ("PRIVATE KEY", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_"), ("passw", "pwd", "secret", "token", "key")
#: (score alone, score beside context words, context words)
SCORES = {
    "email": (0.9, 1.0, "mail|contact|write"),
    "ip": (0.6, 0.9, "ip|address|host|server|login"),
    "card": (0.8, 1.0, "card|visa|credit|payment|mastercard"),
    "phone": (0.7, 1.0, "phone|call|tel|mobile|fax|contact"),
    "iban": (0.9, 1.0, "iban|account|bank|transfer"),
    "ssn": (0.3, 0.9, "ssn|social security"),
    "secret": (0.9, 1.0, "aws|credential|credentials|login|private|config"),
}
THRESHOLD, NEARBY = 0.5, 40
#: Matches whose offsets are summed together.
BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _with_groups(x: Column) -> Column:
    """A match of the iban pattern; a head alone is led on over the most groups that pass the check."""
    groups = F.split(F.regexp_extract(F.substr(F.col("__text"), x.start + 1, F.lit(43)), GROUPS, 0), " ")
    sizes = F.reverse(F.sequence(F.lit(4), F.greatest(F.size(groups), F.lit(4))))
    fits = F.filter(F.transform(sizes, lambda n: F.array_join(F.slice(groups, F.lit(1), n), " ")), _iban)
    whole = F.when(F.length(x.match) > 4, x.match).otherwise(F.coalesce(F.get(fits, F.lit(0)), x.match))
    return F.struct(x.start.alias("start"), (x.start + F.length(whole)).alias("end"), whole.alias("match"))


def _iban(match: Column) -> Column:
    code = F.replace(match, F.lit(" "), F.lit(""))
    return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "secret":
        return match.rlike(SECRET)
    return _iban(match) if kind == "iban" else F.lit(True)


def _may_hold_secrets(text: Column) -> Column:
    exact, lowered = SECRET_NEEDS
    named = reduce(or_, (F.lower(text).contains(x) for x in lowered))
    return reduce(or_, (text.contains(x) for x in exact)) | ((text.contains("=") | text.contains(":")) & named)


def _located(frame: DataFrame, kind: str) -> DataFrame:
    """Adds `__kind`: array of (start, end, match) of all matches of the kind's pattern, code points, end exclusive.

    The gaps between matches come from splitting the text by the same pattern; sums of lengths, first by block, give the
    offsets, so that the work stays near linear for texts with very many matches.
    """
    text, pattern, none = F.col("__text"), PATTERNS[kind], F.array().cast("array<string>")
    m, g, lens, sums, offs = (f"__{kind}_{x}" for x in ("m", "g", "lens", "sums", "offs"))
    some = _may_hold_secrets(text) if kind == "secret" else text.rlike(NEEDS[kind])
    frame = frame.withColumn(m, F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none))
    frame = frame.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    frame = frame.withColumn(lens, F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, gap: F.length(x) + F.length(gap)))
    add = lambda a, b: a + b
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")))
    frame = frame.withColumn(sums, F.transform(blocks, lambda j: F.aggregate(F.slice(lens, j * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add)))
    frame = frame.withColumn(offs, F.transform(blocks, lambda j: F.aggregate(F.slice(sums, F.lit(1), j), F.lit(0), add)))

    def place(x: Column, i: Column) -> Column:
        j = F.floor(i / BLOCK).cast("int")
        before = F.aggregate(F.slice(lens, j * BLOCK + 1, i % BLOCK), F.lit(0), add)
        end = F.get(F.col(offs), j) + before + F.get(F.col(lens), i)
        return F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("match"))

    return frame.withColumn(f"__{kind}", F.transform(m, place)).drop(m, g, lens, sums, offs)


def _good(kind: str) -> Column:
    """The confirmed matches of a kind, with their scores."""
    alone, beside, words = SCORES[kind]

    def scored(x: Column) -> Column:
        first = F.greatest(F.lit(0), x.start - NEARBY)
        around = F.concat_ws(" ", F.substr(F.col("__text"), first + 1, x.start - first), F.substr(F.col("__text"), x.end + 1, F.lit(NEARBY)))
        score = F.when(around.rlike(rf"(?i)(?<![a-z])({words})(?![a-z])"), beside).otherwise(alone)
        return F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), score.alias("score"))

    return F.transform(F.filter(f"__{kind}", lambda x: _confirmed(kind, x.match)), scored)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, found`, an array of (kind, start, end, score), by kind as in `KINDS`, then start.

    Base kinds are always found where pattern and check say so; the others need a score of `THRESHOLD` or more.
    Nulls: a null text counts as empty, a null id stays null. Empty texts have no spans, an empty table gives an empty
    result, repeated rows are treated one by one, very long texts are searched whole. Other columns are ignored.
    """
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    for kind in KINDS:
        frame = _located(frame, kind)
        if kind == "iban":
            frame = frame.withColumn("__iban", F.transform("__iban", _with_groups))
        good = _good(kind)
        frame = frame.withColumn(f"__{kind}", good if kind in BASE else F.filter(good, lambda x: x.score >= THRESHOLD))
    return frame.select("doc_id", F.concat(*(F.col(f"__{k}") for k in KINDS)).alias("found"))


def op9_pii(spark, sf_dir):
    """Counts and places of personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    base = F.filter("found", lambda x: x.kind.isin(*BASE))
    scores = F.array_join(F.transform("found", lambda x: x.score.cast("string")), ",").alias("scores")  # of all spans, in their order
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), scores)


def _kind_sql(kind: str, check: str) -> str:
    """Spans of one kind as a list of structs; `x` is the match in `check`."""
    return f"""
  list_filter(list_transform(range(1, len({kind}_m) + 1), lambda i: {{
      'kind': '{kind}', 'x': {kind}_m[i],
      'start': list_sum(list_transform({kind}_g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform({kind}_m[1:i-1], lambda y: length(y))), 0)
  }}), lambda s: {check.replace('@x', 's.x')}) AS {kind}_f"""


def _scored_sql(kind: str) -> str:
    """The same spans with their scores as text."""
    alone, beside, words = SCORES[kind]
    return f"""
  list_transform({kind}_f, lambda s: {{'kind': s.kind, 'start': CAST(s.start AS BIGINT), 'end': CAST(s.start AS BIGINT) + length(s.x), 'score': CASE WHEN regexp_matches(
        t[greatest(0, CAST(s.start AS BIGINT) - {NEARBY}) + 1 : CAST(s.start AS BIGINT)] || ' ' || t[CAST(s.start AS BIGINT) + length(s.x) + 1 : CAST(s.start AS BIGINT) + length(s.x) + {NEARBY}],
        '(?i)(^|[^a-z])({words})([^a-z]|$)') THEN '{beside}' ELSE '{alone}' END}}) AS {kind}"""


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": PATTERNS["secret"].replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b"),
}
_DIGITS = "regexp_replace(@x, '[^0-9]', '', 'g')"
_SQL_CHECKS = {
    "email": "true",
    "ip": r"regexp_full_match(@x, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: "
    f"CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN 2 * CAST({_DIGITS}[i] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[i] AS INT) END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(@x[5:] || @x[1:4], ''), lambda c: ascii(c))), "
    "lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1",
    "ssn": "true",
    "secret": f"regexp_matches(@x, '{SECRET}')",
}


def _sql() -> str:
    parts = ", ".join(f"regexp_extract_all(t, '{p}') AS {k}_m, string_split_regex(t, '{p}') AS {k}_g" for k, p in _SQL_PATTERNS.items())
    lists = ",".join(_kind_sql(k, _SQL_CHECKS[k]) for k in _SQL_PATTERNS)
    scored = ",".join(_scored_sql(k) for k in _SQL_PATTERNS)
    text = lambda v: f"array_to_string(list_transform({v}, lambda s: s.kind || ':' || CAST(s.start AS VARCHAR) || ':' || CAST(s.end AS VARCHAR)), ',')"
    base = f"list_concat({', '.join(BASE)})"
    every = f"list_concat({', '.join(KINDS)})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, t, {parts} FROM d),
found AS (SELECT doc_id, t, {lists} FROM cut),
scored AS (SELECT doc_id, {scored} FROM found),
chosen AS (SELECT * REPLACE (list_filter(ssn, lambda s: CAST(s.score AS DOUBLE) >= {THRESHOLD}) AS ssn) FROM scored)
SELECT doc_id, {', '.join(f'CAST(len({k}) AS BIGINT) AS n_{k}' for k in BASE)}, sha256({text(base)}) AS base_sha256, {text(every)} AS spans,
       array_to_string(list_transform({every}, lambda s: s.score), ',') AS scores
FROM chosen
"""


SQL = _sql()
