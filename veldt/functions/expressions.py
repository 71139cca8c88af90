"""Expressions of the query language as columns, and the names of result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError, UnsupportedFeatureError
from ..plans import ast as A
from . import vector as V

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def display(e: A.Expr) -> str:
    """Result name of an expression without alias, in the query's own case."""
    if isinstance(e, A.Prop):
        return f"{e.var}.{e.name}"
    if isinstance(e, A.Var):
        return e.name
    if isinstance(e, A.Call):
        inner = "*" if e.star else ", ".join(display(a) for a in e.args)
        return f"{e.name}({'DISTINCT ' if e.distinct else ''}{inner})"
    if isinstance(e, A.VectorCall):
        return f"vector_{e.kind}({display(e.left)}, {display(e.right)}, {e.metric})"
    return "expr"


class Columns:
    """Builds columns over the frame of a scope.

    ``entities`` maps node and relationship variables to their key column; all of their
    columns are called ``variable__column``.  Other variables are plain columns.
    """

    def __init__(self, frame: DataFrame | None, entities: dict[str, str], nulls: str = "error"):
        self.frame, self.entities, self.nulls = frame, entities, nulls

    def integral(self, *cols: Column) -> bool:
        if self.frame is None:
            return False
        return all(isinstance(f.dataType, _INTEGRAL) for f in self.frame.select(*cols).schema.fields)

    def prop(self, e: A.Prop) -> Column:
        var, name = e.var.lower(), e.name.lower()
        if var in self.entities:
            column = f"{var}__{name}"
            if self.frame is not None and column not in self.frame.columns:
                known = sorted(c.removeprefix(f"{var}__") for c in self.frame.columns if c.startswith(f"{var}__"))
                raise PlanError(f"Property '{e.name}' not found on '{e.var}'; there are {known}")
            return F.col(f"`{column}`")
        return F.col(f"`{var}`")[name]

    def of(self, e: A.Expr) -> Column:
        if isinstance(e, A.Literal):
            return F.lit(e.value)
        if isinstance(e, A.Prop):
            return self.prop(e)
        if isinstance(e, A.Var):
            return F.col(f"`{self.entities.get(e.name.lower(), e.name.lower())}`")
        if isinstance(e, A.Not):
            return ~self.of(e.item)
        if isinstance(e, A.Negate):
            return -self.of(e.item)
        if isinstance(e, A.IsNull):
            c = self.of(e.item)
            return c.isNotNull() if e.negated else c.isNull()
        if isinstance(e, A.InList):
            item = self.of(e.item)
            if all(isinstance(o, A.Literal) and o.value is not None for o in e.options):
                return item.isin([o.value for o in e.options])
            out = F.lit(False)
            for o in e.options:
                out = out | (item == self.of(o))
            return out
        if isinstance(e, A.ListExpr):
            return F.array(*[self.of(x) for x in e.items])
        if isinstance(e, A.Binary):
            return self.binary(e.op, self.of(e.left), self.of(e.right), e.right)
        if isinstance(e, A.VectorCall):
            fn = V.distance if e.kind == "distance" else V.similarity
            return fn(self.vector(e.left), self.vector(e.right), e.metric, self.nulls)
        if isinstance(e, A.Call):
            return self.call(e)
        raise UnsupportedFeatureError(f"Unsupported expression: {e!r}")

    def vector(self, e: A.Expr) -> Column:
        return self.of(e).cast("array<float>")

    def binary(self, op: str, a: Column, b: Column, right: A.Expr) -> Column:
        if op == "/":
            return F.call_function("div", a, b) if self.integral(a, b) else a / b
        simple = {
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "and": lambda: a & b, "or": lambda: a | b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b,
            "contains": lambda: F.contains(a, b), "starts": lambda: F.startswith(a, b), "ends": lambda: F.endswith(a, b),
            "like": lambda: F.like(a, b), "ilike": lambda: F.ilike(a, b),
        }
        return simple[op]()

    def call(self, e: A.Call) -> Column:
        if e.name in ("tolower", "lower"):
            return F.lower(self.of(e.args[0]))
        if e.name in ("toupper", "upper"):
            return F.upper(self.of(e.args[0]))
        if e.name == "exists":
            return self.of(e.args[0]).isNotNull()
        if e.star:
            return F.count(F.lit(1))
        arg = self.of(e.args[0])
        if e.name == "count":
            return F.count_distinct(arg) if e.distinct else F.count(arg)
        if e.name == "collect":  # collect_list alone would drop nulls
            return F.transform(F.collect_list(F.struct(arg.alias("v"))), lambda s: s["v"])
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name](arg)
