"""Pattern matching while edges arrive: a streaming relationship against static nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..config import GraphConfig
from ..engine import CypherQuery


def match_stream(query: CypherQuery, config: GraphConfig, tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """The query as a streaming frame.  One of ``tables`` may be a stream; queries without
    ORDER BY, SKIP and LIMIT and with at most one aggregation compile to plans that
    Structured Streaming runs, since a hop is a stream-static inner join."""
    frames = {k.lower(): v for k, v in tables.items()}
    if not any(f.isStreaming for f in frames.values()):
        raise ValueError("None of the tables is a stream")
    return query.with_config(config).compile(frames.get, spark)


def to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> DataStreamWriter:
    """Append matches as Parquet, exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer
