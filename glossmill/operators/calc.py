"""Exact arithmetic on short expressions, as an Arrow function; nothing is ever evaluated as code."""

from __future__ import annotations

import ast
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 200
_NAMED = {"pi": math.pi, "e": math.e}
_FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "exp": math.exp, "abs": abs, "factorial": lambda n: math.factorial(int(n)) if 0 <= n <= 500 else _bad()}


def _bad():
    raise ValueError


def _value(node: ast.AST) -> Fraction | float:
    match node:
        case ast.Expression(body=body):
            return _value(body)
        case ast.Constant(value=bool()):
            return _bad()
        case ast.Constant(value=int() | float() as number):
            return Fraction(str(number))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_value(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _value(x)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _value(a), _value(b)
            match op:
                case ast.Add():
                    return x + y
                case ast.Sub():
                    return x - y
                case ast.Mult():
                    return x * y
                case ast.Div():
                    return x / y
                case ast.Mod():
                    return x % y
                case ast.Pow() if abs(y) <= 200 and abs(x) <= 10**9:
                    return x**y
            return _bad()
        case ast.Name(id=name) if name.lower() in _NAMED:
            return _NAMED[name.lower()]
        case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in _FUNCTIONS:
            return _FUNCTIONS[name](_value(x))
    return _bad()


def shown(value: Fraction | float) -> str:
    """Whole numbers and simple fractions as they are, others with ten decimals at most."""
    if isinstance(value, Fraction):
        if value.denominator == 1:
            return str(value.numerator)
        value = float(value)
    if not math.isfinite(value):
        return _bad()
    return f"{value:.10f}".rstrip("0").rstrip(".")


def compute(expression: str | None) -> str | None:
    """The value of an expression as text; null for what isn't one, is too long, or has no value."""
    if not expression or len(expression) > LONGEST:
        return None
    plain = expression.translate({0x2212: "-", 0xD7: "*", 0xF7: "/"}).replace("^", "**").replace(",", "")
    try:
        return shown(_value(ast.parse(plain.strip(), mode="eval")))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError, MemoryError):
        return None


def evaluate(expression: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(compute)

    return run(expression)
