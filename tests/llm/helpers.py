"""Small tables that hold the awkward cases."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use for their own columns or results.
CLASHES = ("size", "target", "taken", "score", "kept", "keep_id", "sid", "bands", "sketch", "label", "comp", "text_sha256", "found", "verdict", "rule", "host", "path", "key", "n_words", "cleaned", "longest")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r + (None,) * 4)[:4] + (len(r[1]) if r[1] is not None else None,) for r in rows]
    return spark.createDataFrame(full, DOC)


def clashing(frame, but=()):
    """The same rows with further columns named like those that operators make."""
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit("clash") for c in CLASHES if c not in (*frame.columns, *but)})


LONG = "long words " * 50_000
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, LONG), (6, "tie tie tie tie"), (7, "tie tie tie tie"), (7, "tie tie tie tie"), (None, "no id at all"), (9, "ÄÖ ñandú 中文 text")]
