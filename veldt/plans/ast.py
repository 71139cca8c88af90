"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    def children(self) -> list[Expr]:
        return []


@dataclass(frozen=True)
class Literal(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    var: str
    name: str


@dataclass(frozen=True)
class Binary(Expr):
    """Comparison, arithmetic, AND, OR, and the string operators (by name)."""

    op: str
    left: Expr
    right: Expr

    def children(self):
        return [self.left, self.right]


@dataclass(frozen=True)
class Not(Expr):
    item: Expr

    def children(self):
        return [self.item]


@dataclass(frozen=True)
class Negate(Expr):
    item: Expr

    def children(self):
        return [self.item]


@dataclass(frozen=True)
class IsNull(Expr):
    item: Expr
    negated: bool = False

    def children(self):
        return [self.item]


@dataclass(frozen=True)
class InList(Expr):
    item: Expr
    options: tuple[Expr, ...]

    def children(self):
        return [self.item, *self.options]


@dataclass(frozen=True)
class ListExpr(Expr):
    items: tuple[Expr, ...]

    def children(self):
        return list(self.items)


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False

    def children(self):
        return list(self.args)


@dataclass(frozen=True)
class VectorCall(Expr):
    kind: str  # distance or similarity
    left: Expr
    right: Expr
    metric: str

    def children(self):
        return [self.left, self.right]


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, both
    props: tuple[tuple[str, Expr], ...] = ()
    hops: tuple[int | None, int | None] | None = None


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    expr: Expr
    alias: str


@dataclass(frozen=True)
class Where:
    predicate: Expr


@dataclass(frozen=True)
class Projection:
    """RETURN (``final``) or WITH."""

    items: tuple[Item, ...]
    final: bool
    distinct: bool = False
    order: tuple[SortKey, ...] = ()
    skip: int | None = None
    limit: int | None = None


@dataclass
class Query:
    clauses: list = field(default_factory=list)


def walk(e: Expr):
    yield e
    for c in e.children():
        yield from walk(c)


AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
SCALARS = ("tolower", "lower", "toupper", "upper")


def is_aggregate(e: Expr) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))
