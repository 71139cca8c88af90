"""Logical plan to DataFrame.  Nothing runs here except the steps of long
variable-length paths; Catalyst plans the joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GraphConfig
from ..errors import PlanError
from ..functions.expressions import Columns, display
from ..plans import ast as A
from ..plans import logical as L
from . import paths


#: Key column of relationships whose types share none.
HIDDEN = "_key"


@dataclass
class State:
    """A frame and what its variables stand for."""

    frame: DataFrame
    keys: dict[str, str] = field(default_factory=dict)  # entity variable -> key column
    labels: dict[str, str] = field(default_factory=dict)  # node variable -> label

    def columns(self, nulls: str) -> Columns:
        return Columns(self.frame, self.keys, nulls)

    def of(self, var: str) -> list[str]:
        return [c for c in self.frame.columns if c.startswith(f"{var}__")]


def tick(name: str):
    return F.col(f"`{name}`")


class Compiler:
    def __init__(self, spark: SparkSession, config: GraphConfig, tables):
        self.spark, self.config, self.tables = spark, config, tables

    def run(self, op: L.Op) -> DataFrame:
        return self.state(op).frame

    def state(self, op: L.Op) -> State:
        return getattr(self, "do_" + type(op).__name__.strip("_").lower())(op)

    # -- sources

    def table(self, name: str, what: str) -> DataFrame:
        df = self.tables(name)
        if df is None:
            raise PlanError(f"No table for {what} ('{name}')")
        return df

    def node_table(self, label: str, props=()) -> tuple[DataFrame, str]:
        """Rows of a label with lower-case columns, filters applied, and the id column."""
        m = self.config.node(label)
        if not m:
            raise PlanError(f"Node label '{label}' doesn't exist in the configuration")
        df = self.table(m.source, f"label '{label}'")
        return self.filtered(df, m.filter_conditions, props, label), m.id_field.lower()

    def filtered(self, df: DataFrame, conditions: str | None, props, what: str) -> DataFrame:
        df = df.toDF(*[c.lower() for c in df.columns])
        if conditions:
            df = df.filter(conditions)
        for key, value in props:
            if key.lower() not in df.columns:
                raise PlanError(f"Property '{key}' not found on '{what}'; there are {sorted(df.columns)}")
            df = df.filter(tick(key.lower()) == Columns(df, {}).of(value))
        return df

    def edges(self, types, props, direction: str) -> DataFrame:
        """Rows of the relationship types: __from, __to in walking order, and the columns
        that all of the types have."""
        parts = []
        for t in dict.fromkeys(x.lower() for x in types):
            m = self.config.relationship(t)
            if not m:
                raise PlanError(f"Relationship type '{t}' doesn't exist in the configuration")
            df = self.filtered(self.table(m.source, f"relationship '{t}'"), m.filter_conditions, props, t)
            parts.append(df.withColumns({"__from": tick(m.source_id_field.lower()), "__to": tick(m.target_id_field.lower())}))
        shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        out = reduce(DataFrame.unionByName, [p.select(*[tick(c) for c in shared]) for p in parts])
        back = out.withColumns({"__from": F.col("__to"), "__to": F.col("__from")})
        if direction == "in":
            return back
        if direction == "both" and self.config.undirected == "both":
            return out.unionByName(back.filter(~F.col("__from").eqNullSafe(F.col("__to"))))
        return out

    def scan(self, var: str, label: str, props) -> tuple[DataFrame, str]:
        df, key = self.node_table(label, props)
        if key not in df.columns:
            raise PlanError(f"Id field '{key}' not found on label '{label}'")
        return df.select(*[tick(c).alias(f"{var}__{c}") for c in df.columns]), f"{var}__{key}"

    # -- operators

    def do_scanbylabel(self, op: L.ScanByLabel) -> State:
        df, key = self.scan(op.variable, op.label, op.properties)
        return State(df, {op.variable: key}, {op.variable: op.label})

    def do_unwindop(self, op: L.UnwindOp) -> State:
        s = self.state(op.input) if op.input else State(self.spark.range(1).select())
        value = s.columns(self.config.null_vectors).of(op.expression) if not (isinstance(op.expression, A.ListExpr) and not op.expression.items) else F.array().cast("array<string>")
        return State(s.frame.select("*", F.explode(value).alias(op.alias)), s.keys, s.labels)

    def do_filter(self, op: L.Filter) -> State:
        s = self.state(op.input)
        return State(s.frame.filter(s.columns(self.config.null_vectors).of(op.predicate)), s.keys, s.labels)

    def do_join(self, op: L.Join) -> State:
        a, b = self.state(op.left), self.state(op.right)
        if op.how == "cross":
            frame = a.frame.crossJoin(b.frame)
        else:
            shared = [v for v in a.keys if v in b.keys]
            if not shared:
                raise PlanError(f"A {op.how} join needs a shared variable")
            right = b.frame.toDF(*[f"__r_{c}" for c in b.frame.columns])
            on = reduce(lambda x, y: x & y, [tick(a.keys[v]) == tick(f"__r_{b.keys[v]}") for v in shared])
            joined = a.frame.join(right, on, op.how)
            seen = set(a.frame.columns)
            both = [F.coalesce(tick(c), tick(f"__r_{c}")).alias(c) if f"__r_{c}" in right.columns else tick(c) for c in a.frame.columns]
            frame = joined.select(*both, *[tick(f"__r_{c}").alias(c) for c in b.frame.columns if c not in seen])
        return State(frame, {**a.keys, **b.keys}, {**a.labels, **b.labels})

    def do_expand(self, op: L.Expand, how: str = "inner") -> State:
        s = self.state(op.input)
        edges = self.edges(op.types, op.properties, op.direction)
        own = [c for c in edges.columns if c not in ("__from", "__to")]
        m = self.config.relationship(op.types[0])
        key = f"{op.relationship}__{m.source_id_field.lower()}"
        extra = []
        if m.source_id_field.lower() not in own:  # the types have no key column in common
            key = f"{op.relationship}__{HIDDEN}"
            extra = [F.col("__from").alias(key)]
        rel = edges.select("__from", "__to", *[tick(c).alias(f"{op.relationship}__{c}") for c in own], *extra)
        on = tick(s.keys[op.source]) == F.col("__from")
        keys = {**s.keys, op.relationship: key}
        if op.target_bound:
            frame = s.frame.join(rel, on & (tick(s.keys[op.target]) == F.col("__to")), how).drop("__from", "__to")
            out = State(frame, keys, s.labels)
            for name, value in op.target_properties:
                out.frame = out.frame.filter(out.columns(self.config.null_vectors).of(A.Binary("=", A.Prop(op.target, name), value)))
            return out
        target, target_key = self.scan(op.target, op.target_label, op.target_properties)
        if how == "inner":
            frame = s.frame.join(rel, on).join(target, F.col("__to") == tick(target_key))
        else:
            frame = s.frame.join(rel.join(target, F.col("__to") == tick(target_key)), on, how)
        return State(frame.drop("__from", "__to"), {**keys, op.target: target_key}, {**s.labels, op.target: op.target_label})

    def do_optional(self, op: L.Optional_) -> State:
        return self.do_expand(op.step, "left")

    def do_variablelengthexpand(self, op: L.VariableLengthExpand) -> State:
        s = self.state(op.input)
        edges = self.edges(op.types, op.properties, op.direction).select("__from", "__to")
        between, between_key = self.node_table(s.labels[op.source])
        walks = paths.walks(s.frame, s.keys[op.source], edges, between.select(tick(between_key).alias("__node")), op.low, op.high)
        if op.target_bound:
            frame = walks.filter(F.col("__cur") == tick(s.keys[op.target])).drop("__cur")
            out = State(frame, s.keys, s.labels)
            for name, value in op.target_properties:
                out.frame = out.frame.filter(out.columns(self.config.null_vectors).of(A.Binary("=", A.Prop(op.target, name), value)))
            return out
        target, key = self.scan(op.target, op.target_label, op.target_properties)
        return State(walks.join(target, F.col("__cur") == tick(key)).drop("__cur"), {**s.keys, op.target: key}, {**s.labels, op.target: op.target_label})

    def do_offset(self, op: L.Offset) -> State:
        s = self.state(op.input)
        return replace(s, frame=s.frame.offset(op.offset))

    def do_limit(self, op: L.Limit) -> State:
        s = self.state(op.input)
        return replace(s, frame=s.frame.limit(op.count))

    # -- projection

    def expanded(self, s: State, item: A.Item, final: bool):
        """(name, column) pairs of an item; an entity becomes several columns."""
        e, cols = item.expr, s.columns(self.config.null_vectors)
        if isinstance(e, A.Var) and e.name.lower() in s.keys:
            var, name = e.name.lower(), item.alias or e.name
            if not final:
                return [(f"{name.lower()}__{c.removeprefix(var + '__')}", tick(c)) for c in s.of(var)]
            if var in s.labels:
                m = self.config.node(s.labels[var])
                if not m:
                    raise PlanError(f"Node label '{s.labels[var]}' doesn't exist")
                fields = list(dict.fromkeys([m.id_field, *m.property_fields]))
                if self.config.infer_properties and not m.property_fields:
                    fields = [m.id_field, *[c.removeprefix(var + "__") for c in s.of(var) if c != f"{var}__{m.id_field.lower()}"]]
            else:
                fields = [f for c in s.of(var) if (f := c.removeprefix(var + "__")) != HIDDEN]
            return [(f"{name}.{f}", cols.prop(A.Prop(var, f))) for f in fields]
        if item.alias:
            return [(item.alias.lower(), cols.of(e))]
        return [(display(e) if final else display(e).lower(), cols.of(e))]

    def do_project(self, op: L.Project) -> State:
        s = self.state(op.input)
        pairs = [(item, self.expanded(s, item, op.final)) for item in op.items]
        flat = [p for _, ps in pairs for p in ps]
        names = [n for n, _ in flat]
        if len(set(names)) < len(names):
            twice = sorted({n for n in names if names.count(n) > 1})
            raise PlanError(f"Column names appear twice: {twice}; use aliases")
        grouped = any(A.is_aggregate(i.expr) for i in op.items)
        hidden: list[tuple[str, A.Expr]] = []
        order = []
        for k in op.order:
            name = self.sort_name(k.expr, pairs)
            if name is None:
                if grouped or op.distinct:
                    raise PlanError(f"ORDER BY {display(k.expr)} must be a returned expression here")
                name = f"__sort_{len(hidden)}"
                hidden.append((name, k.expr))
            order.append(tick(name).desc_nulls_first() if k.descending else tick(name).asc_nulls_first())
        if grouped:
            keys = [(f"__k{i}", c, n) for i, (n, c) in enumerate((n, c) for item, ps in pairs if not A.is_aggregate(item.expr) for n, c in ps)]
            values = [(n, c) for item, ps in pairs if A.is_aggregate(item.expr) for n, c in ps]
            frame = s.frame.groupBy(*[c.alias(k) for k, c, _ in keys]).agg(*[c.alias(n) for n, c in values])
            by = {n: k for k, _, n in keys}
            frame = frame.select(*[tick(by.get(n, n)).alias(n) for n in names])
        else:
            cols = s.columns(self.config.null_vectors)
            frame = s.frame.select(*[c.alias(n) for n, c in flat], *[cols.of(self.resolved(e, pairs)).alias(n) for n, e in hidden])
        if op.distinct:
            frame = frame.distinct()
        if order:
            frame = frame.orderBy(*order)
        if hidden:
            frame = frame.drop(*[n for n, _ in hidden])
        if op.final:
            return State(frame)
        keys, labels = {}, {}
        for item, _ in pairs:
            if isinstance(item.expr, A.Var) and item.expr.name.lower() in s.keys:
                old, new = item.expr.name.lower(), (item.alias or item.expr.name).lower()
                keys[new] = f"{new}__{s.keys[old].removeprefix(old + '__')}"
                if old in s.labels:
                    labels[new] = s.labels[old]
        return State(frame, keys, labels)

    def sort_name(self, e: A.Expr, pairs) -> str | None:
        """The result column a sort key means: an alias, or an equal expression."""
        for item, ps in pairs:
            if len(ps) == 1 and (isinstance(e, A.Var) and item.alias and item.alias.lower() == e.name.lower() or same(item.expr, e)):
                return ps[0][0]
        return None

    def resolved(self, e: A.Expr, pairs) -> A.Expr:
        """Aliases inside a hidden sort key stand for their expressions."""
        by = {item.alias.lower(): item.expr for item, _ in pairs if item.alias}
        if isinstance(e, A.Var) and e.name.lower() in by:
            return by[e.name.lower()]
        if isinstance(e, A.Binary):
            return A.Binary(e.op, self.resolved(e.left, pairs), self.resolved(e.right, pairs))
        if isinstance(e, A.Call):
            return A.Call(e.name, tuple(self.resolved(a, pairs) for a in e.args), e.distinct, e.star)
        return e


def same(a: A.Expr, b: A.Expr) -> bool:
    """Equal but for the case of identifiers."""
    return lowered(a) == lowered(b)


def lowered(e):
    if isinstance(e, A.Prop):
        return A.Prop(e.var.lower(), e.name.lower())
    if isinstance(e, A.Var):
        return A.Var(e.name.lower())
    if isinstance(e, A.Call):
        return A.Call(e.name, tuple(lowered(a) for a in e.args), e.distinct, e.star)
    if isinstance(e, A.Binary):
        return A.Binary(e.op, lowered(e.left), lowered(e.right))
    if isinstance(e, A.VectorCall):
        return A.VectorCall(e.kind, lowered(e.left), lowered(e.right), e.metric)
    return e
