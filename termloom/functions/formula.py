"""User formulas over component scores, compiled to Column expressions: no evaluation at run time."""

from __future__ import annotations

import ast
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names a formula may use.
NAMES = ("label", "synonyms", "definition")
MOST_CHARS = 500


@lru_cache(maxsize=32)
def parse(formula: str) -> ast.expr:
    if len(formula) > MOST_CHARS:
        raise ValueError("the formula is too long")
    try:
        return ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a formula: {formula!r}") from e


def compile_formula(formula: str, label: Column, synonyms: Column, definition: Column) -> Column:
    """``label`` and ``definition`` are numbers, ``synonyms`` an array; a missing score is 0.0, missing synonyms are [0.0].

    Allowed: numbers, the three names, + - * /, unary signs, comparisons, ``a if c else b``, ``or``, min, max and avg.
    Division by zero gives 0.0.
    """
    zero = F.lit(0.0)
    filled = F.coalesce(F.when(F.size(synonyms) > 0, synonyms), F.array(zero))
    names = {"label": F.coalesce(label, zero), "synonyms": filled, "definition": F.coalesce(definition, zero)}
    lists = {"synonyms"}

    def scalars(nodes: list[ast.expr]) -> Column:
        """An array of all arguments' values."""
        if len(nodes) == 1 and isinstance(nodes[0], ast.Name) and nodes[0].id in lists:
            return names[nodes[0].id]
        parts = [names[n.id] if isinstance(n, ast.Name) and n.id in lists else F.array(go(n)) for n in nodes]
        return F.concat(*parts)

    def go(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool()):
                raise ValueError("truth values are no scores")
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name in names and name not in lists:
                return names[name]
            case ast.Name(id=name) if name in lists:
                return F.array_max(names[name])
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -go(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return go(x)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return go(a) + go(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return go(a) - go(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return go(a) * go(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.coalesce(F.try_divide(go(a), go(b)), zero)
            case ast.Call(func=ast.Name(id="max"), args=args, keywords=[]) if args:
                return F.array_max(scalars(args))
            case ast.Call(func=ast.Name(id="min"), args=args, keywords=[]) if args:
                return F.array_min(scalars(args))
            case ast.Call(func=ast.Name(id="avg"), args=args, keywords=[]) if args:
                x = scalars(args)
                return F.aggregate(x, zero, lambda s, v: s + v) / F.size(x)
            case ast.IfExp(test=c, body=a, orelse=b):
                return F.when(go_test(c), go(a)).otherwise(go(b))
            case ast.BoolOp(op=ast.Or(), values=values):
                out = go(values[-1])
                for v in reversed(values[:-1]):
                    x = go(v)
                    out = F.when(x != 0, x).otherwise(out)
                return out
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    def go_test(node: ast.expr) -> Column:
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            a, b = go(node.left), go(node.comparators[0])
            match node.ops[0]:
                case ast.Gt():
                    return a > b
                case ast.GtE():
                    return a >= b
                case ast.Lt():
                    return a < b
                case ast.LtE():
                    return a <= b
                case ast.Eq():
                    return a == b
                case ast.NotEq():
                    return a != b
        return go(node) != 0

    return go(parse(formula))
