"""Bounded arithmetic over numeric literals, as an Arrow UDF: no SQL function evaluates a column of expressions."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits of the calculator.
MOST_CHARS, MOST_EXPONENT, MOST_RESULT = 500, 100, 1e15

_TWO = {"Add": operator.add, "Sub": operator.sub, "Mult": operator.mul, "Div": operator.truediv, "FloorDiv": operator.floordiv, "Mod": operator.mod, "Pow": operator.pow}


class Refused(ValueError):
    """The expression is not one that the calculator answers."""


def _checked(value):
    if isinstance(value, complex) or not math.isfinite(value) or abs(value) > MOST_RESULT:
        raise Refused("result too large or not a real number")
    return value


def evaluate(text: str) -> float:
    """Value of + - * / // % ** and unary minus over numbers, depth first with an explicit stack."""
    if len(text) > MOST_CHARS:
        raise Refused(f"expression longer than {MOST_CHARS} characters")
    try:
        todo = [(ast.parse(text.strip(), mode="eval").body, False)]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise Refused(f"invalid syntax: {getattr(error, 'msg', error)}") from None
    values: list = []
    while todo:
        node, ready = todo.pop()
        name = type(node).__name__
        if name == "Constant" and type(node.value) in (int, float):
            values.append(_checked(node.value))
        elif name == "UnaryOp" and isinstance(node.op, ast.USub):
            if ready:
                values.append(_checked(-values.pop()))
            else:
                todo += [(node, True), (node.operand, False)]
        elif name == "BinOp" and (run := _TWO.get(type(node.op).__name__)):
            if not ready:
                todo += [(node, True), (node.right, False), (node.left, False)]
                continue
            right, left = values.pop(), values.pop()
            if run is operator.pow and abs(right) > MOST_EXPONENT:
                raise Refused(f"exponent larger than {MOST_EXPONENT}")
            try:
                values.append(_checked(run(left, right)))
            except ZeroDivisionError:
                raise Refused("division by zero") from None
            except OverflowError:
                raise Refused("result too large") from None
        else:
            raise Refused(f"unsupported element: {name}")
    return float(values[0])


def number_text(x: float) -> str:
    return str(int(x)) if x.is_integer() else format(x, ".10g")


def answer(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return number_text(evaluate(text))
    except Refused as error:
        return f"error: {error}"


@F.pandas_udf(StringType())
def calculate(texts: pd.Series) -> pd.Series:
    """The value of each expression as text, or `error: ...`."""
    return texts.map(answer)
