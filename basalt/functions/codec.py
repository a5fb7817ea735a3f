"""Column types of the table engine, and the expressions that turn text into their values.

No value is missing in a typed table: what cannot be read becomes the type's default (0, 0.0, empty text, 0000-00-00, [0, 0]).
All of it is Catalyst expressions, so encoding a load never leaves the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LENGTH = 100
NO_DATE = "0000-00-00"


@dataclass(frozen=True)
class ColumnType:
    """One of INT, FLOAT, VARCHAR (with a length in bytes), DATE, ARRAY."""

    name: str
    length: int = 0

    @property
    def spark(self) -> T.DataType:
        return {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "ARRAY": T.ArrayType(T.FloatType())}.get(self.name, T.StringType())

    @property
    def default(self) -> Column:
        return {
            "INT": F.lit(0), "FLOAT": F.lit(0.0).cast("float"), "VARCHAR": F.lit(""), "DATE": F.lit(NO_DATE),
            "ARRAY": F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>"),
        }[self.name]

    def __str__(self) -> str:
        return f"VARCHAR[{self.length}]" if self.name == "VARCHAR" else "ARRAY[FLOAT]" if self.name == "ARRAY" else self.name


def parse_type(text: str, strict: bool = False) -> ColumnType:
    """`INT`, `FLOAT`, `DATE`, `VARCHAR[n]` or `VARCHAR(n)`, `CHAR[n]` (the same), `ARRAY[FLOAT]`. Another name is VARCHAR[100], or an error if `strict`."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:[\[(]\s*(\w+)\s*[\])])?\s*", text)
    name, size = (m[1].upper(), m[2]) if m else ("", None)
    if name in ("INT", "INTEGER"):
        return ColumnType("INT")
    if name in ("FLOAT", "DATE"):
        return ColumnType(name)
    if name == "ARRAY" and (size or "FLOAT").upper() == "FLOAT":
        return ColumnType("ARRAY")
    if name in ("VARCHAR", "CHAR"):
        return ColumnType("VARCHAR", int(size) if size and size.isdigit() else DEFAULT_LENGTH)
    if strict:
        raise ValueError(f"unsupported type: {text.strip()}")
    return ColumnType("VARCHAR", DEFAULT_LENGTH)


def strip_quotes(value: Column) -> Column:
    """White space off both ends, then quotes off both ends."""
    return F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), r"""^['"]+|['"]+$""", "")


def to_int(value: Column) -> Column:
    """32-bit integer; 0 for what is none, null for a whole number out of range (the row is to be rejected)."""
    number = F.regexp_replace(strip_quotes(value), r"^\s+|\s+$", "")
    whole = number.rlike(r"^[+-]?[0-9]+$")
    return F.when(whole, number.try_cast("int")).otherwise(F.lit(0))


def to_float(value: Column) -> Column:
    """32-bit float; 0 for what is none."""
    return F.coalesce(strip_quotes(value).try_cast("float"), F.lit(0.0).cast("float"))


def to_varchar(value: Column, length: int) -> Column:
    """The longest prefix of at most `length` bytes of UTF-8 that cuts no character, without white space at its ends."""
    text = strip_quotes(F.coalesce(value, F.lit("")))
    raw = text.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(length, max(length - 4, -1), -1)]
    short = F.when(F.octet_length(text) <= length, text).otherwise(F.coalesce(*cuts, F.lit("")))
    return F.regexp_replace(short, r"^\s+|\s+$", "")


def to_date_text(value: Column) -> Column:
    """`D-M-Y` turned to `Y-M-D`, cut to ten characters; empty is 0000-00-00."""
    text = strip_quotes(F.coalesce(value, F.lit("")))
    turned = F.regexp_replace(text, r"^([^-]{0,2})-([^-]*)-([^-]*)$", "$3-$2-$1")
    return F.when(text == "", NO_DATE).otherwise(F.substring(turned, 1, 10))


def date_of(text: Column) -> Column:
    """The stored text as a date, null if it is none."""
    return F.to_date(F.try_to_timestamp(text, F.lit("y-M-d")))


def to_point(value: Column) -> Column:
    """The first two numbers of a text such as `[1.5, -2]`; [0, 0] if there are fewer."""
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"), 0)
    two = F.slice(F.transform(found, lambda x: x.try_cast("float")), 1, 2)
    return F.when(F.size(two) == 2, two).otherwise(F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>"))


def encode(value: Column, kind: ColumnType) -> Column:
    """A text column as values of `kind`."""
    if kind.name == "VARCHAR":
        return to_varchar(value, kind.length)
    return {"INT": to_int, "FLOAT": to_float, "DATE": to_date_text, "ARRAY": to_point}[kind.name](value)


def normalise_headers(names: list[str]) -> list[str]:
    """Trimmed, blanks and dashes to `_`, lower case; a name that repeats gets `_2`, `_3`, ..."""
    out: list[str] = []
    for name in names:
        base = name.strip().replace(" ", "_").replace("-", "_").lower()
        new, n = base, 1
        while new in out:
            n += 1
            new = f"{base}_{n}"
        out.append(new)
    return out
