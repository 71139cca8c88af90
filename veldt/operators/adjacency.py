"""Adjacency index, breadth-first search and shortest paths over integer vertex ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..sources.scratch import materialize

_RANGES = 256


class AdjacencyIndexBuilder:
    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.frames, self.vertices = spark, [], [], None

    def add_edge(self, src: int, dst: int) -> AdjacencyIndexBuilder:
        self.rows.append((int(src), int(dst)))
        return self

    def add_edges(self, edges: DataFrame, src: str = "src_id", dst: str = "dst_id") -> AdjacencyIndexBuilder:
        for c in (src, dst):
            if c not in edges.columns:
                raise ConfigError(f"Column '{c}' not found")
            if not isinstance(edges.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                raise ConfigError(f"Column '{c}' must hold integers")
        self.frames.append(edges.select(F.col(src).cast("long").alias("src_id"), F.col(dst).cast("long").alias("dst_id")))
        return self

    add_edges_from_batch = add_edges

    def with_num_vertices(self, n: int) -> AdjacencyIndexBuilder:
        self.vertices = int(n)
        return self

    def build(self) -> AdjacencyIndex:
        edges = self.spark.createDataFrame(self.rows, "src_id long, dst_id long")
        for f in self.frames:
            edges = edges.unionByName(f)
        return AdjacencyIndex(edges, self.vertices)

    def build_bidirectional(self) -> tuple[AdjacencyIndex, AdjacencyIndex]:
        own = self.build()
        back = own.edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
        return own, AdjacencyIndex(back, own.num_vertices())


class AdjacencyIndex:
    """Edges (src_id, dst_id) of vertices 0 to n - 1; parallel edges and loops stay."""

    def __init__(self, edges: DataFrame, vertices: int | None = None):
        self.edges, self._n, self.spark = edges, vertices, edges.sparkSession

    def num_vertices(self) -> int:
        if self._n is None:
            top = self.edges.agg(F.max(F.greatest("src_id", "dst_id"))).first()[0]
            self._n = 0 if top is None else top + 1
        return self._n

    def num_edges(self) -> int:
        return self.edges.count()

    def neighbors(self, vertex: int) -> DataFrame:
        return self.edges.filter(F.col("src_id") == vertex).select("dst_id").orderBy("dst_id")

    def degree(self, vertex: int) -> int:
        return self.edges.filter(F.col("src_id") == vertex).count()

    def offsets(self) -> DataFrame:
        """vertex_id, offset, degree.  Offsets are running totals in two steps: within
        ranges of ids in parallel, then over the ranges' totals."""
        n = self.num_vertices()
        width = max(1, -(-n // _RANGES))
        degree = self.edges.groupBy(F.col("src_id").alias("vertex_id")).agg(F.count(F.lit(1)).alias("degree"))
        rows = self.spark.range(n).withColumnRenamed("id", "vertex_id").join(degree, "vertex_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        rows = rows.withColumn("part", F.floor(F.col("vertex_id") / width))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = rows.groupBy("part").agg(F.sum("degree").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("part", "base")
        within = Window.partitionBy("part").orderBy("vertex_id").rowsBetween(Window.unboundedPreceding, -1)
        return rows.join(F.broadcast(base), "part").select("vertex_id", (F.col("base") + F.coalesce(F.sum("degree").over(within), F.lit(0))).alias("offset"), "degree")

    def neighbor_list(self) -> DataFrame:
        """dst_id ordered by source, then by itself."""
        return self.edges.orderBy("src_id", "dst_id").select("dst_id")

    def bfs(self, start: int, max_hops: int | None = None) -> DataFrame:
        """vertex_id, level; empty for a start that is no vertex.  One join and one
        anti-join a level; each level is a table, and the levels' number bounds the loop."""
        none = self.spark.createDataFrame([], "vertex_id long, level int")
        if not 0 <= start < self.num_vertices():
            return none
        pairs = self.edges.select("src_id", "dst_id").distinct()
        seen = front = self.spark.createDataFrame([(start, 0)], "vertex_id long, level int")
        level = 0
        while max_hops is None or level < max_hops:
            level += 1
            new = front.join(pairs, F.col("vertex_id") == F.col("src_id")).select(F.col("dst_id").alias("vertex_id")).distinct()
            front = materialize(new.join(seen.select("vertex_id"), "vertex_id", "left_anti").withColumn("level", F.lit(level)), "bfs")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        return seen

    def shortest_path(self, source: int, target: int) -> list[int] | None:
        """One shortest path with both ends (of several, that of the smallest parents);
        None if there is none."""
        n = self.num_vertices()
        if not (0 <= source < n and 0 <= target < n):
            return None
        if source == target:
            return [source]
        seen = front = self.spark.createDataFrame([(source, -1)], "vertex_id long, parent long")
        pairs = self.edges.select("src_id", "dst_id")
        while True:
            new = front.join(pairs, F.col("vertex_id") == F.col("src_id")).groupBy(F.col("dst_id").alias("v")).agg(F.min("src_id").alias("parent"))
            front = materialize(new.withColumnRenamed("v", "vertex_id").join(seen.select("vertex_id"), "vertex_id", "left_anti"), "bfs")
            if front.isEmpty():
                return None
            seen = seen.unionByName(front)
            if not front.filter(F.col("vertex_id") == target).isEmpty():
                break
        path = [target]
        while path[-1] != source:  # one row a step
            path.append(seen.filter(F.col("vertex_id") == path[-1]).first().parent)
        return path[::-1]
