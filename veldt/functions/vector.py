"""Vector distances and similarities as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError

METRICS = ("l2", "cosine", "dot")
#: Largest float32: the distance of vectors of different lengths.
FLOAT_MAX = 3.4028234663852886e38


def _fold(a: Column, b: Column, one) -> Column:
    return F.aggregate(F.zip_with(a, b, one), F.lit(0.0), lambda s, x: s + x)


def _product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def _cosine(a: Column, b: Column, otherwise: float) -> Column:
    norm = F.sqrt(_product(a, a)) * F.sqrt(_product(b, b))
    return F.when(norm == 0, F.lit(otherwise)).otherwise(_product(a, b) / norm)


def _l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def _guarded(a: Column, b: Column, value: Column, mismatch: float, nulls: str) -> Column:
    out = F.when(F.size(a) != F.size(b), F.lit(mismatch)).otherwise(value)
    if nulls == "error":
        out = F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("Null vector"))).otherwise(out)
    else:
        out = F.when(a.isNotNull() & b.isNotNull(), out)
    return out.cast("float")


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in values])


def distance(a: Column, b: Column, metric: str, nulls: str = "error") -> Column:
    """Vectors of different lengths are as far as can be (2 for cosine, as is a zero vector)."""
    if metric == "l2":
        return _guarded(a, b, _l2(a, b), FLOAT_MAX, nulls)
    if metric == "cosine":
        norm = _cosine(a, b, -1.0)
        return _guarded(a, b, 1 - norm, 2.0, nulls)
    if metric == "dot":
        return _guarded(a, b, -_product(a, b), FLOAT_MAX, nulls)
    raise ConfigError(f"Unknown metric: {metric}")


def similarity(a: Column, b: Column, metric: str, nulls: str = "error") -> Column:
    if metric == "l2":
        return _guarded(a, b, 1 / (1 + _l2(a, b)), 1 / (1 + FLOAT_MAX), nulls)
    if metric == "cosine":
        return _guarded(a, b, _cosine(a, b, -1.0), -1.0, nulls)
    if metric == "dot":
        return _guarded(a, b, _product(a, b), -FLOAT_MAX, nulls)
    raise ConfigError(f"Unknown metric: {metric}")


class DistanceMetric:
    L2, Cosine, Dot = "l2", "cosine", "dot"


class VectorSearch:
    """Exact top-k by distance; builder style, every method returns the search itself."""

    def __init__(self, column: str):
        self._column, self._query, self._metric, self._k = column, None, "l2", 10
        self._include, self._name, self._nulls, self._ties = True, "_distance", "error", ()

    def query_vector(self, vector) -> VectorSearch:
        self._query = [float(x) for x in vector]
        return self

    def metric(self, metric: str) -> VectorSearch:
        if metric.lower() not in METRICS:
            raise ConfigError(f"Unknown metric: {metric}")
        self._metric = metric.lower()
        return self

    def top_k(self, k: int) -> VectorSearch:
        self._k = int(k)
        return self

    def include_distance(self, on: bool = True) -> VectorSearch:
        self._include = on
        return self

    def distance_column_name(self, name: str) -> VectorSearch:
        self._name = name
        return self

    def tie_break(self, *columns: str) -> VectorSearch:
        self._ties = columns
        return self

    def null_vectors(self, how: str) -> VectorSearch:
        self._nulls = how
        return self

    def search(self, table: DataFrame) -> DataFrame:
        """The k nearest rows in ascending distance; ties by ``tie_break`` columns.  A sort
        with a limit, so each task keeps k rows and k per task reach the last step."""
        if self._query is None:
            raise ConfigError("A query vector is needed")
        if self._column not in table.columns:
            raise ConfigError(f"Column '{self._column}' not found; there are {table.columns}")
        if self._name in table.columns:
            raise ConfigError(f"Column '{self._name}' already exists")
        value = distance(F.col(f"`{self._column}`").cast("array<float>"), vector(self._query), self._metric, self._nulls)
        out = table.withColumn(self._name, value).orderBy(F.col(f"`{self._name}`").asc_nulls_last(), *[f"`{c}`" for c in self._ties]).limit(self._k)
        return out if self._include else out.drop(self._name)
