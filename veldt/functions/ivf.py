"""Approximate nearest neighbours: vectors stored by cell, of which a search reads a few."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from . import vector as V

#: Vectors that the cells' centres are fitted on.
SAMPLE_ROWS = 100_000


class VectorIndex:
    """A table partitioned by the nearest of ``cells`` centres.  Every row is in it; the
    centres are fitted on at most ``SAMPLE_ROWS`` rows.  Cosine searches need an index of unit
    vectors (``metric="cosine"``), so that near directions share cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.text(f"{self.path}/centres").first()
        if row is None:
            raise ConfigError(f"No index below {path}")
        self.meta = json.loads(row[0])

    @classmethod
    def build(cls, table: DataFrame, column: str, path: str, cells: int = 64, metric: str = "l2", seed: int = 1, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """Write the index; rows with a null vector, or one of another length than the
        first, are kept in a cell of their own that every search reads."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if column not in table.columns:
            raise ConfigError(f"Column '{column}' not found; there are {table.columns}")
        if metric not in V.METRICS:
            raise ConfigError(f"Unknown metric: {metric}")
        spark, own = table.sparkSession, table.withColumn("__v", cls._placed(F.col(f"`{column}`"), metric))
        first = own.filter(F.col("__v").isNotNull()).select(F.size("__v").alias("n")).first()
        size, centres = (first.n if first else 0), []
        fit = F.coalesce(F.size("__v") == size, F.lit(False)) & (F.lit(size) > 0)
        if first:
            points = own.filter(fit).select(array_to_vector("__v").alias("features"))
            total = points.count()
            some = points.sample(min(1.0, 1.2 * sample_rows / total), seed).limit(sample_rows) if total > sample_rows else points
            centres = [[float(x) for x in c] for c in KMeans(k=min(cells, total), seed=seed, maxIter=10).fit(some).clusterCenters()]
        meta = {"column": column, "metric": metric, "size": size, "centres": centres, "schema": table.schema.jsonValue()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/centres")
        cell = F.when(fit, cls._nearest(centres)).otherwise(F.lit(-1)) if centres else F.lit(-1)
        own.withColumn("__cell", cell).drop("__v").repartition("__cell").write.partitionBy("__cell").parquet(f"{path}/rows")
        return cls(spark, path)

    @staticmethod
    def _placed(v: Column, metric: str) -> Column:
        v = v.cast("array<double>")
        if metric != "cosine":
            return v
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(norm > 0, F.transform(v, lambda x: x / norm))

    @staticmethod
    def _nearest(centres: list[list[float]]) -> Column:
        """Number of the centre at the least distance, by x.x - 2 x.c + c.c."""
        parts = [F.struct((sum(x * x for x in c) - 2 * F.aggregate(F.zip_with("__v", F.array(*map(F.lit, c)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
        return F.array_min(F.array(*parts))["i"]

    def cells(self, query: list[float], probes: int) -> list[int]:
        """The ``probes`` cells whose centres are nearest to the query, and the odd one."""
        if self.meta["metric"] == "cosine":
            norm = sum(x * x for x in query) ** 0.5 or 1.0
            query = [x / norm for x in query]
        if self.meta["metric"] == "dot":
            rank = [(-sum(x * y for x, y in zip(c, query)), i) for i, c in enumerate(self.meta["centres"])]
        else:
            rank = [(sum((x - y) ** 2 for x, y in zip(c, query)), i) for i, c in enumerate(self.meta["centres"])]
        return [-1, *(i for _, i in sorted(rank)[:probes])]

    def search(self, search: V.VectorSearch, probes: int = 8) -> DataFrame:
        """The exact search over the probed cells; other cells' files are not opened."""
        if search._query is None:
            raise ConfigError("A query vector is needed")
        if (search._column, search._metric) != (self.meta["column"], self.meta["metric"]):
            raise ConfigError("The index has another column or metric")
        schema = T.StructType([*T.StructType.fromJson(self.meta["schema"]).fields, T.StructField("__cell", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows").filter(F.col("__cell").isin(self.cells(search._query, probes))).drop("__cell")
        return search.search(rows)
