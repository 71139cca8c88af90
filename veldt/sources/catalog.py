"""Catalogs: metadata, the Unity Catalog REST service, directories of tables."""

from __future__ import annotations

import json
import logging
import urllib.error
import urllib.parse
import urllib.request
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ConfigError, GraphError, PlanError
from .readers import default_table_readers

log = logging.getLogger(__name__)


class CatalogError(GraphError, RuntimeError):
    pass


class NotFoundError(CatalogError):
    pass


class AuthError(CatalogError):
    pass


class CatalogConnectionError(CatalogError):
    pass


class InvalidResponseError(CatalogError):
    pass


@dataclass(frozen=True)
class CatalogInfo:
    name: str
    comment: str | None = None
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class SchemaInfo:
    name: str
    catalog_name: str
    comment: str | None = None
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type_text: str
    type_name: str = ""
    position: int = 0
    nullable: bool = True
    comment: str | None = None


@dataclass(frozen=True)
class TableInfo:
    name: str
    catalog_name: str
    schema_name: str
    table_type: str = "EXTERNAL"
    data_source_format: str = "UNKNOWN"
    columns: tuple[ColumnInfo, ...] = ()
    storage_location: str | None = None
    comment: str | None = None
    properties: dict = field(default_factory=dict)

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type_text or c.type_name), c.nullable) for c in sorted(self.columns, key=lambda c: c.position)])


#: Catalog type names.
_TYPES = {
    "BOOLEAN": T.BooleanType(), "BYTE": T.ByteType(), "TINYINT": T.ByteType(), "SHORT": T.ShortType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "LONG": T.LongType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "DECIMAL": T.DecimalType(38, 10), "NUMERIC": T.DecimalType(38, 10), "DEC": T.DecimalType(38, 10),
    "STRING": T.StringType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType(), "BINARY": T.BinaryType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "NULL": T.NullType(), "VOID": T.NullType(),
}


def spark_type(text: str) -> T.DataType:
    """A catalog's type text as a Spark type; nested types are parsed."""
    name = text.strip().upper()
    if name in _TYPES:
        return _TYPES[name]
    head = name.split("(")[0].split("<")[0].strip()
    if head in ("VARCHAR", "CHAR"):
        return T.StringType()
    if head in ("NUMERIC", "DEC"):
        text = "DECIMAL" + text.strip()[len(head) :]
    try:
        return T.StructType.fromDDL(f"c {text}")["c"].dataType
    except Exception as e:
        raise ConfigError(f"Unknown type: {text}") from e


class CatalogProvider(ABC):
    @abstractmethod
    def list_catalogs(self) -> list[CatalogInfo]: ...

    @abstractmethod
    def get_catalog(self, name: str) -> CatalogInfo: ...

    @abstractmethod
    def list_schemas(self, catalog: str) -> list[SchemaInfo]: ...

    @abstractmethod
    def get_schema(self, catalog: str, schema: str) -> SchemaInfo: ...

    @abstractmethod
    def list_tables(self, catalog: str, schema: str) -> list[TableInfo]: ...

    @abstractmethod
    def get_table(self, catalog: str, schema: str, table: str) -> TableInfo: ...


class UnityCatalog(CatalogProvider):
    """REST client; listings follow page tokens."""

    def __init__(self, base_url: str, token: str | None = None, timeout: float = 30.0):
        self.base, self.token, self.timeout = base_url.rstrip("/"), token, timeout

    def _get(self, path: str, **query) -> dict:
        url = f"{self.base}/{path}" + (f"?{urllib.parse.urlencode(query)}" if query else "")
        request = urllib.request.Request(url, headers={"Accept": "application/json", **({"Authorization": f"Bearer {self.token}"} if self.token else {})})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                body = r.read()
        except urllib.error.HTTPError as e:
            text = e.read().decode(errors="replace")[:500]
            if e.code == 404:
                raise NotFoundError(f"Not found: {path} {text}") from e
            if e.code in (401, 403):
                raise AuthError(f"Not authorised: {path} {text}") from e
            raise CatalogConnectionError(f"HTTP {e.code}: {text}") from e
        except (urllib.error.URLError, TimeoutError, OSError) as e:
            raise CatalogConnectionError(str(e)) from e
        try:
            out = json.loads(body)
        except ValueError as e:
            raise InvalidResponseError(f"Not JSON: {body[:200]!r}") from e
        if not isinstance(out, dict):
            raise InvalidResponseError(f"Not an object: {body[:200]!r}")
        return out

    def _list(self, path: str, key: str, **query) -> list[dict]:
        out, token = [], None
        while True:
            page = self._get(path, **query, **({"page_token": token} if token else {}))
            out += page.get(key) or []
            token = page.get("next_page_token")
            if not token:
                return out

    @staticmethod
    def _made(kind, d: dict):
        try:
            return kind(d)
        except (KeyError, TypeError) as e:
            raise InvalidResponseError(f"Missing field: {e}") from e

    @staticmethod
    def _catalog(d):
        return CatalogInfo(d["name"], d.get("comment"), d.get("properties") or {})

    @staticmethod
    def _schema(d):
        return SchemaInfo(d["name"], d["catalog_name"], d.get("comment"), d.get("properties") or {})

    @staticmethod
    def _table(d):
        cols = tuple(ColumnInfo(c["name"], c.get("type_text") or "", c.get("type_name") or "", c.get("position") or 0, c.get("nullable", True), c.get("comment")) for c in d.get("columns") or [])
        return TableInfo(d["name"], d["catalog_name"], d["schema_name"], d.get("table_type") or "EXTERNAL", (d.get("data_source_format") or "UNKNOWN").upper(), cols, d.get("storage_location"), d.get("comment"), d.get("properties") or {})

    def list_catalogs(self):
        return [self._made(self._catalog, d) for d in self._list("catalogs", "catalogs")]

    def get_catalog(self, name):
        return self._made(self._catalog, self._get(f"catalogs/{urllib.parse.quote(name)}"))

    def list_schemas(self, catalog):
        return [self._made(self._schema, d) for d in self._list("schemas", "schemas", catalog_name=catalog)]

    def get_schema(self, catalog, schema):
        return self._made(self._schema, self._get(f"schemas/{urllib.parse.quote(f'{catalog}.{schema}')}"))

    def list_tables(self, catalog, schema):
        return [self._made(self._table, d) for d in self._list("tables", "tables", catalog_name=catalog, schema_name=schema)]

    def get_table(self, catalog, schema, table):
        return self._made(self._table, self._get(f"tables/{urllib.parse.quote(f'{catalog}.{schema}.{table}')}"))

    def create_sql_engine(self, catalog: str, schema: str, spark: SparkSession | None = None, storage_options: dict | None = None):
        from ..engine import SqlEngine, _session

        spark = _session(spark)
        return SqlEngine(Connector(self, storage_options=storage_options).load_schema(spark, catalog, schema), spark)


class Connector:
    """A catalog and the readers for its formats."""

    def __init__(self, catalog: CatalogProvider, readers: dict | None = None, storage_options: dict | None = None):
        self.catalog, self.readers, self.options = catalog, readers or default_table_readers(), storage_options or {}

    def load(self, spark: SparkSession, info: TableInfo) -> DataFrame:
        """The table's data, or for formats without reader an empty table of its schema."""
        reader = self.readers.get(info.data_source_format.lower())
        if reader is None:
            return spark.createDataFrame([], info.spark_schema())
        if not info.storage_location:
            raise ConfigError(f"Table '{info.name}' has no storage location")
        return reader.read(spark, info.storage_location, self.options)

    def load_schema(self, spark: SparkSession, catalog: str, schema: str) -> dict[str, DataFrame]:
        out = {}
        for info in self.catalog.list_tables(catalog, schema):
            try:
                out[info.name.lower()] = self.load(spark, info)
            except Exception as e:
                log.warning("Skipping table %s: %s", info.name, e)
        return out

    def register_schema(self, spark: SparkSession, catalog: str, schema: str) -> list[str]:
        """Temporary views of all readable tables; the others are skipped with a warning."""
        frames = self.load_schema(spark, catalog, schema)
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return sorted(frames)


class DirNamespace:
    """Tables of a directory: ``<base>/<name>.parquet``; names keep their case."""

    def __init__(self, base_uri: str):
        if not base_uri:
            raise ConfigError("A base URI is needed")
        self.base = base_uri.rstrip("/")

    def describe_table(self, table_id: list[str]) -> str:
        if len(table_id) != 1 or not table_id[0]:
            raise ConfigError("A table id has one component here")
        return f"{self.base}/{table_id[0]}.parquet"

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        location = self.describe_table([name])
        try:
            return spark.read.parquet(location)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise PlanError(f"Table '{name}' not found at {location}") from e
            raise


class SourceCatalog:
    """In-memory catalog of frames by label or type; keys are lower-case."""

    def __init__(self):
        self._frames: dict[str, DataFrame] = {}

    def with_node_source(self, label: str, df: DataFrame) -> SourceCatalog:
        self._frames[label.lower()] = df
        return self

    with_relationship_source = with_node_source

    def source(self, name: str) -> DataFrame | None:
        return self._frames.get(name.lower())

    node_source = relationship_source = source
