"""What counts as a dataset, and readers by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError, UnsupportedFeatureError

#: Formats by the extension of a path.
_EXTENSIONS = {"parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc", "txt": "text"}


class TableReader:
    def __init__(self, fmt: str, **options):
        self.format, self.options = fmt, options

    def read(self, spark: SparkSession, location: str, storage_options: dict | None = None, schema=None) -> DataFrame:
        reader = spark.read.format(self.format).options(**{**self.options, **(storage_options or {})})
        if schema is not None:
            reader = reader.schema(schema)
        try:
            return reader.load(location)
        except Exception as e:
            if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e):
                raise UnsupportedFeatureError(f"Format '{self.format}' needs its connector on Spark's class path") from e
            raise


def default_table_readers() -> dict[str, TableReader]:
    out = {f: TableReader(f) for f in ("parquet", "orc", "json", "text", "avro", "delta")}
    out["csv"] = TableReader("csv", header="true", inferSchema="true")
    return out


def as_frame(data, spark: SparkSession) -> DataFrame:
    """DataFrames as they are; pandas, Arrow tables, batches and readers, objects with
    ``to_table()``, paths, and lists of dicts.  Empty tables are tables."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        fmt = _EXTENSIONS.get(data.rstrip("/").rsplit(".", 1)[-1].lower(), "parquet")
        return default_table_readers()[fmt].read(spark, data)
    import pandas as pd
    import pyarrow as pa

    if hasattr(data, "to_table"):
        data = data.to_table()
    if isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, pa.Table):
        return spark.createDataFrame(data)
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    if isinstance(data, list):
        return spark.createDataFrame(data)
    raise ConfigError(f"Not a dataset: {type(data).__name__}")
