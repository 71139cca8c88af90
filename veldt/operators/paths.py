"""Variable-length paths as a frontier of walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walks(frame: DataFrame, start: str, edges: DataFrame, nodes: DataFrame, low: int, high: int) -> DataFrame:
    """All walks of ``low`` to ``high`` edges from ``frame``'s ``start`` column: its rows
    once per walk, and ``__cur``, the walk's last id.

    Cycles and parallel edges count, one row per walk.  Every node between must be in
    ``nodes`` (column ``__node``).  The frontier of k edges is one join away from that of
    k - 1; nothing runs here, and filters on the start reach its scan.  The longer walks'
    plans hold the shorter ones' exchanges, which the adaptive execution reuses.
    """
    first = edges.select(F.col("__from"), F.col("__to").alias("__cur"))
    front = frame.join(first, F.col(f"`{start}`") == F.col("__from")).drop("__from")
    inner = edges.join(nodes, F.col("__from") == F.col("__node")).select(F.col("__from").alias("__at"), F.col("__to").alias("__next"))
    own = [F.col(f"`{c}`") for c in frame.columns]
    found = [front] if low <= 1 else []
    for k in range(2, high + 1):
        front = front.join(inner, F.col("__cur") == F.col("__at")).select(*own, F.col("__next").alias("__cur"))
        if k >= low:
            found.append(front)
    return reduce(DataFrame.unionByName, found)
