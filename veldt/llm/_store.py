"""Where intermediate tables and operator files live.

Everything that outlives one job goes below ``spark.checkpoint.dir``: the only
folder that the driver and every executor share.  A table written there also
cuts lineage, so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI: ``spark.checkpoint.dir``.  Where that is unset a local
    one is made if driver and executors are one process, as in tests; else it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="veldt-"))
        root = _OWN[0]
    return root if "://" in root or root.startswith("file:") else "file://" + root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/veldt/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def tidy(spark: SparkSession):
    """Jobs in here give up their shuffle files as they end: what they write is a table,
    and no later job reads their shuffles."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, with the writer's ``options``, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd").options(**options)
    with tidy(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldt_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_veldt_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a shared URI; works on the driver and in tasks."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Write through ``write(stream)`` to an attempt-private name, then move it
    into place: a half-written file never carries the final name."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, path)
