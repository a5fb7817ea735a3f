"""From expressions to typed Catalyst columns.

Types are settled while the plan is built: numbers and texts are never equal, and comparing their order is an error,
which is a null here and drops the row. The one exception is a text column beside a number, as in uploaded tables whose
columns are all text: the column is read as a number where it is one.

In `strict_order` AND and OR are evaluated left to right with errors as errors; the default uses plain AND and OR, which
Catalyst can push into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ast
from .lexer import SqlError


@dataclass
class Typed:
    column: Column
    type: str  # number, text, truth, other
    literal: bool = False


def _type(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return "text" if isinstance(kind, T.StringType) else "truth" if isinstance(kind, T.BooleanType) else "other"


def _function(name: str, given: list[Typed]) -> Typed:
    first = given[0] if given else None
    count = len(given)
    if first is None:
        raise SqlError(f"{name} needs an argument")
    if name == "len" and count == 1:
        return Typed(F.char_length(first.column), "number")
    if name == "int" and count == 1:
        text = first.type == "text"
        return Typed(F.regexp_replace(first.column, r"^\s+|\s+$", "").try_cast("long") if text else first.column.try_cast("long"), "number")
    if name == "float" and count == 1:
        return Typed(first.column.try_cast("double"), "number")
    if name == "str" and count == 1:
        return Typed(first.column.cast("string"), "text")
    if name == "abs" and count == 1:
        return Typed(F.when(first.column < 0, F.try_subtract(F.lit(0), first.column)).otherwise(first.column), "number")
    if name == "round" and count == 1:
        return Typed(F.bround(first.column).try_cast("long"), "number")
    if name in ("lower", "upper") and count == 1:
        return Typed(getattr(F, name)(first.column), "text")
    if name in ("min", "max") and count >= 2 and len({g.type for g in given}) == 1:
        return Typed((F.least if name == "min" else F.greatest)(*(g.column for g in given)), first.type)
    raise SqlError(f"unsupported function: {name}/{count}")


def _truth(x: Typed) -> Column:
    if x.type == "truth":
        return x.column
    if x.type == "number":
        return x.column != 0
    return x.column != "" if x.type == "text" else x.column.isNotNull()


class Compiler:
    def __init__(self, schema: T.StructType, strict_order: bool = False):
        self.fields = {f.name.lower(): f for f in schema.fields}
        self.strict_order = strict_order

    def condition(self, node) -> Column:
        """A predicate; null stands for an error and drops the row."""
        return _truth(self.typed(node))

    def typed(self, node) -> Typed:
        if isinstance(node, ast.Literal):
            return Typed(F.lit(node.value), "text" if isinstance(node.value, str) else "number", True)
        if isinstance(node, ast.Name):
            field = self.fields.get(node.name)
            if field is None:
                raise SqlError(f"unknown column: {node.name}")
            return Typed(F.col(f"`{field.name}`"), _type(field.dataType))
        if isinstance(node, ast.Call):
            return _function(node.function, [self.typed(a) for a in node.arguments])
        if isinstance(node, ast.Arithmetic):
            return self.arithmetic(node)
        if isinstance(node, ast.Chain):
            return Typed(self.chain(node), "truth")
        if isinstance(node, ast.Among):
            return Typed(self.among(node), "truth")
        if isinstance(node, ast.Not):
            return Typed(~self.condition(node.value), "truth")
        if isinstance(node, ast.Logical):
            return Typed(self.logical(node.word, self.condition(node.left), self.condition(node.right)), "truth")
        raise SqlError(f"cannot compile {node}")

    def logical(self, word: str, left: Column, right: Column) -> Column:
        if not self.strict_order:
            return left & right if word == "AND" else left | right
        settled = ~left if word == "AND" else left
        return F.when(left.isNull(), F.lit(None).cast("boolean")).when(settled, F.lit(word == "OR")).otherwise(right)

    def arithmetic(self, node: ast.Arithmetic) -> Typed:
        left, right = self.typed(node.left), self.typed(node.right)
        if left.type != "number" or right.type != "number":
            raise SqlError(f"{node.sign} needs numbers")
        a, b = left.column, right.column
        if node.sign == "/":
            return Typed(F.try_divide(a.cast("double"), b.cast("double")), "number")
        return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[node.sign](a, b), "number")

    def chain(self, node: ast.Chain) -> Column:
        left, out = self.typed(node.first), None
        for sign, operand in node.rest:
            right = self.typed(operand)
            pair = self.compare(sign, left, right)
            out = pair if out is None else self.logical("AND", out, pair)
            left = right
        return out

    def compare(self, sign: str, left: Typed, right: Typed) -> Column:
        a, b = left.column, right.column
        if {left.type, right.type} == {"text", "number"}:
            # a text column beside a number is read as a number; a text literal never is
            if left.type == "text" and not left.literal:
                a = a.try_cast("double")
            elif right.type == "text" and not right.literal:
                b = b.try_cast("double")
            else:
                unequal = {"=": F.lit(False), "!=": F.lit(True)}
                return unequal.get(sign, F.lit(None).cast("boolean"))
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]

    def among(self, node: ast.Among) -> Column:
        value, options = self.typed(node.value), [self.typed(o) for o in node.options]
        if all(o.literal and o.type == value.type for o in options):
            inside = value.column.isin([o.value for o in node.options])
        else:
            inside = F.lit(False)
            for o in options:
                inside = inside | self.compare("=", value, o)
        return ~inside if node.negated else inside
