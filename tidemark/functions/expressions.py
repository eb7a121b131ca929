"""A safe expression language over feature columns, compiled to Spark columns.

The text is a Python expression over whitelisted names: numbers, + - * / % **, unary + - not, and/or,
chained comparisons. Its rules differ from SQL in one way that matters: a row is *unavailable*, and so
never selected, as soon as a name that is evaluated has no finite value, even in ``false and x``. Only a
chained comparison stops early, at its first false link; names to the right of it do not count.
"""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MAX_NODES = 1000, 100


class ExpressionError(ValueError):
    """The text is not an expression of this language."""


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


class Compiled:
    """A parsed expression: the names it uses, and the column that selects rows."""

    def __init__(self, text: str, allowed: set[str]):
        if len(text) > MAX_CHARS:
            raise ExpressionError("too long")
        try:
            tree = ast.parse(text, mode="eval").body
        except SyntaxError as error:
            raise ExpressionError(str(error)) from error
        if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
            raise ExpressionError("too many nodes")
        self.names = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)})
        if unknown := set(self.names) - allowed:
            raise ExpressionError(f"unknown names {sorted(unknown)}")
        value, self._available, kind = self._build(tree)
        if kind != "bool":
            raise ExpressionError("the expression is not a condition")
        self._value = value

    def selected(self) -> Column:
        """True where every evaluated name is available and the condition holds; never null."""
        return F.coalesce(F.when(self._available, self._value), F.lit(False))

    def available(self) -> Column:
        return self._available

    def _build(self, node: ast.expr) -> tuple[Column, Column, str]:
        """(value, availability, kind) of a node."""
        match node:
            case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v):
                return F.lit(float(v)), F.lit(True), "number"
            case ast.Name(id=name):
                return F.col(name).cast("double"), _usable(F.col(name).cast("double")), "number"
            case ast.UnaryOp(op=op, operand=operand):
                x, ok, kind = self._build(operand)
                if isinstance(op, ast.Not):
                    self._want(kind, "bool")
                    return ~x, ok, "bool"
                self._want(kind, "number")
                if isinstance(op, ast.USub | ast.UAdd):
                    return (-x if isinstance(op, ast.USub) else x), ok, "number"
            case ast.BinOp(left=left, op=op, right=right):
                (x, ok1, k1), (y, ok2, k2) = self._build(left), self._build(right)
                self._want(k1, "number")
                self._want(k2, "number")
                return self._arithmetic(op, x, y), ok1 & ok2, "number"
            case ast.BoolOp(op=op, values=values):
                parts = [self._build(v) for v in values]
                out, ok = parts[0][0], parts[0][1]
                for _, _, kind in parts:
                    self._want(kind, "bool")
                for x, more, _ in parts[1:]:
                    out, ok = (out & x if isinstance(op, ast.And) else out | x), ok & more
                return out, ok, "bool"
            case ast.Compare(left=left, ops=ops, comparators=comparators):
                x, ok, kind = self._build(left)
                self._want(kind, "number")
                holds = F.lit(True)
                for op, right in zip(ops, comparators, strict=True):
                    y, more, kind = self._build(right)
                    self._want(kind, "number")
                    ok = ok & (~F.coalesce(holds, F.lit(False)) | more)
                    holds = F.coalesce(holds, F.lit(False)) & self._comparison(op, x, y)
                    x = y
                return F.coalesce(holds, F.lit(False)), ok, "bool"
        raise ExpressionError(f"{type(node).__name__} is not allowed")

    @staticmethod
    def _want(kind: str, wanted: str) -> None:
        if kind != wanted:
            raise ExpressionError(f"a {kind} where a {wanted} is needed")

    @staticmethod
    def _arithmetic(op: ast.operator, x: Column, y: Column) -> Column:
        match op:
            case ast.Add():
                out = x + y
            case ast.Sub():
                out = x - y
            case ast.Mult():
                out = x * y
            case ast.Div():
                out = x / y  # a zero divisor fails the job
            case ast.Mod():
                out = x - y * F.floor(x / y)  # the sign of the divisor
            case ast.Pow():
                out = F.pow(x, y)
            case _:
                raise ExpressionError(f"{type(op).__name__} is not allowed")
        return F.when(F.isnan(out) | (F.abs(out) == F.lit(math.inf)), F.raise_error(F.lit("a result is not finite")).cast("double")).otherwise(out)

    @staticmethod
    def _comparison(op: ast.cmpop, x: Column, y: Column) -> Column:
        match op:
            case ast.Eq():
                return x == y
            case ast.NotEq():
                return x != y
            case ast.Lt():
                return x < y
            case ast.LtE():
                return x <= y
            case ast.Gt():
                return x > y
            case ast.GtE():
                return x >= y
        raise ExpressionError(f"{type(op).__name__} is not allowed")


def compile_expression(text: str, allowed) -> Compiled:
    return Compiled(text, set(allowed))


def encode_number(value: float) -> str:
    """Number as part of a parameterised name: 2.5 is 2p5, -1 is m1."""
    return format(value, ".8g").replace(".", "p").replace("-", "m")


def decode_number(text: str) -> float:
    return float(text.replace("p", ".").replace("m", "-"))


def rules_to_expression(rules: list[tuple[str, str, float, str]]) -> str:
    """Visual rules (name, operator, number, joiner to the next) as a left-associated expression."""
    if not 0 < len(rules) <= 50:
        raise ExpressionError("between 1 and 50 rules")
    out = ""
    joiner = ""
    for name, op, number, after in rules:
        term = f"{name} {op} {number:g}"
        out = f"({out}) {joiner} {term}" if out else term
        joiner = after
    return out
