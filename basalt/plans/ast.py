"""Statements and expressions as plain data."""

from __future__ import annotations

from dataclasses import dataclass

from basalt.functions.codec import ColumnType


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    function: str
    arguments: tuple


@dataclass(frozen=True)
class Arithmetic:
    sign: str
    left: object
    right: object


@dataclass(frozen=True)
class Chain:
    """`a < b <= c`: each neighbouring pair is compared."""

    first: object
    rest: tuple  # of (sign, operand)


@dataclass(frozen=True)
class Among:
    value: object
    options: tuple
    negated: bool = False


@dataclass(frozen=True)
class Not:
    value: object


@dataclass(frozen=True)
class Logical:
    word: str  # AND, OR
    left: object
    right: object


@dataclass(frozen=True)
class Item:
    """One place of a select list; `count` stands for COUNT(*)."""

    value: object
    alias: str | None = None
    count: bool = False


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple = ()
    where: object = None
    using: str | None = None
    group_by: tuple = ()
    order_by: tuple = ()  # of (name, descending)
    limit: int | None = None


@dataclass(frozen=True)
class Column:
    name: str
    type: ColumnType
    index: str | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple


@dataclass(frozen=True)
class CreateIndex:
    table: str
    kind: str
    column: str


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple


@dataclass(frozen=True)
class Delete:
    table: str
    where: object
