"""A safe evaluator of arithmetic: + - * / ** % and unary minus on numbers."""

from __future__ import annotations

import ast
import operator

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod}


def evaluate(expression: str, largest_power: int = 1000) -> float:
    """The value; ValueError for anything but arithmetic."""

    def value(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and abs(b) > largest_power:
                raise ValueError("exponent too large")
            return _BINARY[type(node.op)](a, b)
        raise ValueError(f"not arithmetic: {ast.dump(node)[:60]}")

    try:
        return value(ast.parse(expression, mode="eval").body)
    except (SyntaxError, ZeroDivisionError, OverflowError) as e:
        raise ValueError(str(e)) from e
