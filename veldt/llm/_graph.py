"""Connected components of link tables, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b; rows with nulls, of an id with itself and repeated ones don't matter)
    to (id, label): the smallest id of each linked group, for ids
    that have links.  Large-star and small-star steps alternate until every id points at
    its group's smallest one; each step is an aggregate (combined before the shuffle)
    and a join, and its result a table, so nothing is gathered and lineage stays short."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        large = materialize(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, "edges")
        now = tuple(small.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        drop(edges, large)
        edges = small
        if now == sign:
            out = edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
            out = materialize(out, "labels")
            drop(edges)
            return out
        sign = now
