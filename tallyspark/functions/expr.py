"""The safe expression language: Python syntax, a short list of constructs, compiled to Spark columns.

An expression is parsed to a syntax tree, each node of which must be on the list and fit the types of its operands; the
columns are then composed node by node, never through text. Types are inferred as far as they are known and what is not known is
not held against an expression.

Arithmetic keeps IEEE results, which Spark's SQL semantics would replace by errors or nulls: x / 0 is inf, -inf or NaN for doubles,
log(0) is -inf, the log and square root of negative numbers are NaN. Integers divide to integers, truncated; dividing an integer by integer 0 fails, as does
overflow. The remainder has the dividend's sign. min and max are null if either argument is, NaN if either is.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DType, Schema, column

_NAME = re.compile(r"[^\W\d]\w*\Z", re.ASCII)
_NUMBERS = {DType.INT64, DType.FLOAT64}
_INF, _NAN = float("inf"), float("nan")


class Typed(NamedTuple):
    """A compiled expression and its type, None where that isn't known."""

    value: Column
    dtype: DType | None


def _number(who: str, *dtypes: DType | None) -> None:
    for t in dtypes:
        if t is not None and t not in _NUMBERS:
            raise ValueError(f"{who} takes numbers, not {t.value}")


def _bool(who: str, *dtypes: DType | None) -> None:
    for t in dtypes:
        if t not in (None, DType.BOOL):
            raise ValueError(f"{who} takes booleans, not {t.value}")


def _wider(a: DType | None, b: DType | None) -> DType | None:
    if DType.FLOAT64 in (a, b):
        return DType.FLOAT64
    return None if a is None or b is None else DType.INT64


def _family(t: DType | None) -> object:
    return "number" if t in _NUMBERS else t


def _divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF)).when(a.isNotNull(), F.lit(_NAN))
    return F.when(F.isnan(a), F.lit(_NAN)).when(b == 0, by_zero).otherwise(a / b)


def _remainder(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a.cast("double")) | (b.cast("double") == 0), F.when(a.isNotNull(), F.lit(_NAN))).otherwise(a.cast("double") % b.cast("double"))


def _arith(op: ast.operator, a: Typed, b: Typed) -> Typed:
    _number(_SIGNS[type(op)], a.dtype, b.dtype)
    dtype = _wider(a.dtype, b.dtype)
    if isinstance(op, ast.Div):
        whole = dtype is DType.INT64
        return Typed(F.call_function("div", a.value, b.value) if whole else _divide(a.value, b.value), dtype)
    if isinstance(op, ast.Mod) and dtype is not DType.INT64:
        return Typed(_remainder(a.value, b.value), dtype)
    return Typed(_APPLY[type(op)](a.value, b.value), dtype)


_SIGNS = dict(zip((ast.Div, ast.Mod, ast.Add, ast.Mult, ast.Sub), "/%+*-"))
_APPLY: dict[type, Callable[[Column, Column], Column]] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Mod: operator.mod}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def _log(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)).otherwise(F.log(x))


def _sqrt(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x < 0, F.lit(_NAN)).otherwise(F.sqrt(x))


_ONE = {"sqrt": _sqrt, "log": _log, "exp": lambda x: F.exp(x.cast("double"))}
_TWO = {"min": F.least, "max": F.greatest}


def _extreme(pick: Callable[..., Column], a: Typed, b: Typed) -> Typed:
    dtype = _wider(a.dtype, b.dtype)
    out = F.when(a.value.isNotNull() & b.value.isNotNull(), pick(a.value, b.value))
    if dtype is not DType.INT64:
        x, y = a.value.cast("double"), b.value.cast("double")
        out = F.when(x.isNotNull() & y.isNotNull(), F.when(F.isnan(x) | F.isnan(y), F.lit(_NAN)).otherwise(pick(x, y)))
    return Typed(out, dtype)


class _Compiler:
    def __init__(self, schema: Schema, null_test: bool):
        self.schema, self.null_test = schema, null_test

    def compile(self, node: ast.expr) -> Typed:
        handler = getattr(self, "_" + type(node).__name__.lower(), None)
        if handler is None:
            raise ValueError(f"{type(node).__name__} is not part of the expression language")
        return handler(node)

    def _constant(self, node: ast.Constant) -> Typed:
        for kind, dtype in ((bool, DType.BOOL), (int, DType.INT64), (float, DType.FLOAT64), (str, DType.STRING)):
            if type(node.value) is kind:
                if dtype is DType.INT64 and not -(2**63) <= node.value < 2**63:
                    raise ValueError(f"{node.value} exceeds 64 bits")
                return Typed(F.lit(node.value).cast(dtype.spark), dtype)
        raise ValueError(f"a literal of type {type(node.value).__name__} is not part of the expression language")

    def _name(self, node: ast.Name) -> Typed:
        if node.id.startswith("__"):
            raise ValueError(f"{node.id}: names with two leading underscores are reserved")
        if node.id not in self.schema.names:
            raise ValueError(f"there is no column {node.id}; the columns are {', '.join(self.schema.names)}")
        return Typed(column(node.id), self.schema.dtype(node.id))

    def _binop(self, node: ast.BinOp) -> Typed:
        if type(node.op) not in _SIGNS:
            raise ValueError(f"operator {type(node.op).__name__} is not part of the expression language")
        return _arith(node.op, self.compile(node.left), self.compile(node.right))

    def _unaryop(self, node: ast.UnaryOp) -> Typed:
        x = self.compile(node.operand)
        if isinstance(node.op, ast.Not):
            _bool("not", x.dtype)
            return Typed(~x.value, DType.BOOL)
        if isinstance(node.op, (ast.USub, ast.UAdd)):
            _number("a sign", x.dtype)
            return Typed(-x.value, x.dtype) if isinstance(node.op, ast.USub) else x
        raise ValueError(f"operator {type(node.op).__name__} is not part of the expression language")

    def _compare(self, node: ast.Compare) -> Typed:
        sides = [self.compile(x) for x in (node.left, *node.comparators)]
        out = None
        for op, a, b in zip(node.ops, sides, sides[1:]):
            if type(op) not in _COMPARE:
                raise ValueError(f"comparison {type(op).__name__} is not part of the expression language")
            if a.dtype and b.dtype and _family(a.dtype) != _family(b.dtype):
                raise ValueError(f"{a.dtype.value} and {b.dtype.value} can't be compared")
            one = _COMPARE[type(op)](a.value, b.value)
            out = one if out is None else out & one
        return Typed(out, DType.BOOL)

    def _boolop(self, node: ast.BoolOp) -> Typed:
        sides = [self.compile(x) for x in node.values]
        _bool(type(node.op).__name__.lower(), *(x.dtype for x in sides))
        out = sides[0].value
        for x in sides[1:]:
            out = out & x.value if isinstance(node.op, ast.And) else out | x.value
        return Typed(out, DType.BOOL)

    def _call(self, node: ast.Call) -> Typed:
        if not isinstance(node.func, ast.Name) or node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise ValueError("only plain calls of the listed functions are part of the expression language")
        name, args = node.func.id, [self.compile(a) for a in node.args]
        if name == "isNull" and self.null_test and len(args) == 1:
            return Typed(args[0].value.isNull(), DType.BOOL)
        if name not in _ONE and name not in _TWO and name != "abs":
            raise ValueError(f"function {name} is not part of the expression language")
        _number(name, *(a.dtype for a in args))
        if len(args) != (2 if name in _TWO else 1):
            raise ValueError(f"{name} takes {2 if name in _TWO else 1} argument(s), not {len(args)}")
        if name in _TWO:
            return _extreme(_TWO[name], *args)
        if name == "abs":
            return Typed(F.abs(args[0].value), args[0].dtype)
        return Typed(_ONE[name](args[0].value), DType.FLOAT64)


def _tree(text: str) -> ast.expr:
    if not isinstance(text, str) or not text.strip():
        raise ValueError("the expression is empty")
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ValueError(f"{text!r} is not an expression: {e}") from None


def compile_expression(text: str, schema: Schema) -> Typed:
    """The column that an expression over the schema's columns means, and its type; ValueError for anything off the list."""
    try:
        return _Compiler(schema, null_test=False).compile(_tree(text))
    except ValueError as e:
        raise ValueError(f"expression {text!r}: {e}") from None


def compile_predicate(text: str, schema: Schema) -> Column:
    """The boolean column that a filter predicate means.

    Beside the expression language, predicates may be written with &&, ||, !, a single =, strings in back quotes, and isNull(column).
    """
    try:
        out = _Compiler(schema, null_test=True).compile(_tree(_pythonic(text)))
        if out.dtype not in (None, DType.BOOL):
            raise ValueError(f"it is {out.dtype.value}, not a condition")
        return out.value
    except ValueError as e:
        raise ValueError(f"predicate {text!r}: {e}") from None


_TOKEN = re.compile(r"""(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<quoted>`[^`]*`)|(?P<keep>==|!=|<=|>=)|(?P<and>&&)|(?P<or>\|\|)|(?P<not>!)|(?P<equal>=)|(?P<true>\btrue\b)|(?P<false>\bfalse\b)""")


def _pythonic(text: str) -> str:
    def swap(m: re.Match[str]) -> str:
        kind, found = m.lastgroup, m.group()
        if kind == "quoted":
            return repr(found[1:-1])
        return {"and": " and ", "or": " or ", "not": " not ", "equal": " == ", "true": " True ", "false": " False "}.get(kind, found)

    return _TOKEN.sub(swap, text) if isinstance(text, str) else text


def check_name(name: str) -> str:
    """The name of a new column, if it may be one."""
    if not isinstance(name, str) or not _NAME.match(name) or name.startswith("__"):
        raise ValueError(f"{name!r} can't name a column")
    return name
