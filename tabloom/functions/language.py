"""A restricted expression language for features that users write: it compiles to a Column.

Grammar: + - * /, unary signs, numbers, column names and six functions. Division by zero is
null, log1p and sqrt see nothing below zero, rank is the average rank over the filled count
of the whole table. Nothing is ever executed: the text is parsed, checked and translated.
"""

from __future__ import annotations

import ast
import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import average_rank, clip, div, finite, null, num

MAX_TEXT, MAX_NODES, MAX_NAME = 160, 40, 128
ARITY = {"log1p": 1, "abs": 1, "sqrt": 1, "rank": 1, "fark": 2, "clip": 3}


class ExpressionError(ValueError):
    """The text is no expression of this language."""


def _names(node: ast.AST) -> set[str]:
    called = {id(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and id(n) not in called}


def names(text: str) -> list[str]:
    """The columns that an expression names, in order of the alphabet; they needn't exist."""
    try:
        return sorted(_names(ast.parse(text.strip(), mode="eval")))
    except SyntaxError as e:
        raise ExpressionError(f"can't be read: {e.msg}") from e


def parse(text: str, columns: list[str]) -> ast.expr:
    """The checked tree of an expression over columns."""
    if len(text) > MAX_TEXT:
        raise ExpressionError(f"longer than {MAX_TEXT} characters")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"can't be read: {e.msg}") from e
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise ExpressionError(f"more than {MAX_NODES} parts")

    def check(node: ast.expr) -> None:
        match node:
            case ast.BinOp(left=a, op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div(), right=b):
                check(a)
                check(b)
            case ast.UnaryOp(op=ast.UAdd() | ast.USub(), operand=a):
                check(a)
            case ast.Constant(value=bool()):
                raise ExpressionError("only numbers are constants")
            case ast.Constant(value=int() | float()):
                pass
            case ast.Name(id=name):
                if name not in columns:
                    raise ExpressionError(f"no column {name}")
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                if ARITY.get(name) != len(args):
                    raise ExpressionError(f"no function {name} of {len(args)} arguments")
                if not _names(args[0]):
                    raise ExpressionError(f"the first argument of {name} must hold a column")
                for a in args:
                    check(a)
            case _:
                raise ExpressionError(f"{type(node).__name__} is not part of the language")

    check(tree)
    if not _names(tree):
        raise ExpressionError("no column is used")
    return tree


def _compile(node: ast.expr) -> Column:
    match node:
        case ast.Constant(value=v):
            return F.lit(float(v))
        case ast.Name(id=name):
            return num(F.col(f"`{name}`"))
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -_compile(a)
        case ast.UnaryOp(operand=a):
            return _compile(a)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _compile(a), _compile(b)
            match op:
                case ast.Add():
                    return x + y
                case ast.Sub():
                    return x - y
                case ast.Mult():
                    return x * y
            return div(x, y)
        case ast.Call(func=ast.Name(id=name), args=args):
            x, *rest = map(_compile, args)
            match name:
                case "log1p":
                    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
                case "sqrt":
                    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
                case "abs":
                    return F.abs(x)
                case "fark":
                    return x - rest[0]
                case "clip":
                    return clip(x, *rest)
                case "rank":
                    from pyspark.sql import Window

                    return average_rank(x) / F.nullif(F.count(x).over(Window.partitionBy()), F.lit(0))
    raise ExpressionError(type(node).__name__)


def expression(text: str, columns: list[str]) -> Column:
    """The Column of an expression: a double, infinities as null."""
    return finite(_compile(parse(text, columns)).cast("double"))


def checked_name(name: str) -> str:
    """A name for a generated column: an identifier of at most 128 characters that is no keyword."""
    if not name.isidentifier() or keyword.iskeyword(name) or len(name) > MAX_NAME:
        raise ExpressionError(f"{name!r} can't name a column")
    return name


def source(name: str, text: str, columns: list[str]) -> str:
    """One line of PySpark that adds the column; only checked names and expressions get into it."""
    checked_name(name)
    parse(text, columns)
    return f"df = df.withColumn({name!r}, expression({text.strip()!r}, df.columns))"


def script(steps: list[tuple[str, str]], columns: list[str]) -> str:
    """A whole PySpark script that rebuilds a stage from its steps; later steps may use earlier columns."""
    known, lines = list(columns), ["from tabloom.functions.language import expression", "", "", "def build(df):"]
    for name, text in steps:
        lines.append("    " + source(name, text, known))
        known.append(name)
    return "\n".join([*lines, "    return df", ""])


class _Ranks(ast.NodeTransformer):
    """Ranks of an expression become columns of the table, from counts of distinct values: no task sees all rows."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.made = df, []

    def visit_Call(self, node: ast.Call) -> ast.expr:  # noqa: N802  the name that ast asks for
        node = self.generic_visit(node)
        if node.func.id != "rank":
            return node
        from tabloom.functions.joins import attach
        from tabloom.operators import measures
        from tabloom.sources.store import materialise

        name, names = f"__rank{len(self.made)}", self.df.columns
        rows = self.df.withColumn("__x", _compile(node.args[0]).cast("double"))
        values = materialise(rows.where("__x IS NOT NULL").groupBy("__x").agg(F.count(F.lit(1)).alias("n")), "rank-values")
        total = values.agg(F.sum("n")).first()[0] or 0
        ranks = materialise(measures.value_ranks(values, [], "__x", "n").select("__x", "n", (F.col("rank") / F.lit(max(total, 1))).alias(name)), "ranks")
        self.df = attach(rows, ranks, "__x", "n", total).select(*[f"`{c}`" for c in names], name)
        self.made.append(name)
        return ast.Name(name, ast.Load())


def apply(df, steps: list[tuple[str, str]]):
    """Add the columns of steps, in order; a step that can't be compiled stops the build. Ranks run their own jobs."""
    for name, text in steps:
        checked_name(name)
        ranks = _Ranks(df)
        tree = ranks.visit(parse(text, df.columns))
        df = ranks.df.withColumn(name, finite(_compile(tree).cast("double"))).drop(*ranks.made)
    return df


__all__ = ["ExpressionError", "apply", "checked_name", "expression", "names", "null", "parse", "script", "source"]
