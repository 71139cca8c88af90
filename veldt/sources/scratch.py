"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

from ..errors import ConfigError

_OWN: list[str] = []


def scratch_path(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:  # as in tests
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ConfigError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="veldt-"))
        root = _OWN[0]
    return f"{root.rstrip('/')}/veldt/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back: lineage ends here, and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
