"""A persisted knowledge graph on Parquet directories."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GraphConfig
from ..engine import CypherQuery
from ..functions import vector as V
from ..functions.vector import VectorSearch
from ..sources.readers import as_frame


def config_from_dict(schema: dict | None) -> GraphConfig:
    """``nodes: {Label: id or {id_field}}, relationships: {TYPE: {source, target}}``."""
    schema = schema or {}
    b = GraphConfig.builder()
    for label, spec in (schema.get("nodes") or {"Entity": "entity_id"}).items():
        b.with_node_label(label, spec if isinstance(spec, str) else spec.get("id_field") or spec["id"])
    for kind, spec in (schema.get("relationships") or {"RELATIONSHIP": {"source": "source_entity_id", "target": "target_entity_id"}}).items():
        b.with_relationship(kind, spec.get("source") or spec["source_field"], spec.get("target") or spec["target_field"])
    return b.build()


def load_schema(path: str) -> GraphConfig:
    import yaml

    with open(path) as f:
        return config_from_dict(yaml.safe_load(f))


class GraphStore:
    """Datasets ``<root>/<name>.parquet/v-<id>``; a write adds a version and then moves the
    pointer, so readers never see half a dataset and a table can be rewritten from itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _base(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"Not a dataset name: {name!r}")
        return f"{self.root}/{name}.parquet"

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self._base(name)}/_CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def list_datasets(self) -> dict[str, str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {n.removesuffix(".parquet"): f"{self.root}/{n}" for n in sorted(names) if n.endswith(".parquet")}

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            raise FileNotFoundError(f"Dataset '{name}' not found below {self.root}")
        return self.spark.read.parquet(f"{self._base(name)}/{version}")

    def load_tables(self, names=None) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in (names if names is not None else self.list_datasets())}

    def write(self, name: str, data) -> None:
        base, old, version = self._base(name), self._current(name), f"v-{uuid.uuid4().hex[:12]}"
        as_frame(data, self.spark).write.parquet(f"{base}/{version}")
        fs, p = self._fs(f"{base}/_CURRENT")
        out = fs.create(p, True)
        out.write(bytearray(version.encode()))
        out.close()
        if old:
            fs.delete(self._fs(f"{base}/{old}")[1], True)

    def write_tables(self, tables: dict) -> None:
        for name, data in tables.items():
            self.write(name, data)


def _newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one with the largest ``__seq``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("__seq"), F.desc("__tie"))
    return df.withColumn("__tie", F.xxhash64(*[c for c in df.columns if c != "__seq"])).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__seq", "__tie")


class KnowledgeGraphService:
    def __init__(self, store: GraphStore, config: GraphConfig | None = None):
        self.store, self.config, self.spark = store, config or config_from_dict(None), store.spark

    @staticmethod
    def merged_entities(old: DataFrame | None, new: DataFrame) -> DataFrame:
        """Rows without entity_id go; name_lower is derived; of an id the last row wins."""

        def normal(df, seq):
            if "entity_type" not in df.columns:
                df = df.withColumn("entity_type", F.col("type") if "type" in df.columns else F.lit(None).cast("string"))
            elif "type" in df.columns:
                df = df.withColumn("entity_type", F.coalesce("entity_type", "type"))
            name = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
            return df.filter("entity_id is not null and entity_id <> ''").withColumns({"entity_type": F.coalesce("entity_type", F.lit("UNKNOWN")), "name_lower": F.lower(F.coalesce(name, F.lit("")))}).withColumn("__seq", F.lit(seq))

        both = normal(new, 1) if old is None else normal(old, 0).unionByName(normal(new, 1), allowMissingColumns=True)
        return _newest(both, ["entity_id"])

    @staticmethod
    def merged_relationships(old: DataFrame | None, new: DataFrame) -> DataFrame:
        """Rows without an endpoint go; key: both ends, type and description; the last wins."""

        def normal(df, seq):
            if "relationship_type" not in df.columns:
                df = df.withColumn("relationship_type", F.col("type") if "type" in df.columns else F.lit(None).cast("string"))
            if "description" not in df.columns:
                df = df.withColumn("description", F.lit(""))
            df = df.withColumns({"relationship_type": F.coalesce("relationship_type", F.lit("RELATED_TO")), "description": F.coalesce("description", F.lit(""))})
            return df.filter("source_entity_id is not null and target_entity_id is not null").withColumn("__seq", F.lit(seq))

        both = normal(new, 1) if old is None else normal(old, 0).unionByName(normal(new, 1), allowMissingColumns=True)
        return _newest(both, ["source_entity_id", "target_entity_id", "relationship_type", "description"])

    def list_datasets(self) -> list[str]:
        return list(self.store.list_datasets())

    def load_table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def upsert_table(self, name: str, data, merge: bool = True) -> None:
        new = as_frame(data, self.spark)
        old = self.store.read(name) if merge and name in self.store.list_datasets() else None
        if name.lower() == "entity":
            out = self.merged_entities(old, new)
        elif name.lower() == "relationship":
            out = self.merged_relationships(old, new)
        else:
            out = new if old is None else old.unionByName(new, allowMissingColumns=True)
        self.store.write(name, out)

    def _query(self, text: str, params: dict | None) -> CypherQuery:
        return CypherQuery(text).with_config(self.config).with_parameters(params or {})

    def _tables(self, q: CypherQuery, datasets: dict | None) -> dict:
        """Only what the query names is opened; overrides come first."""
        given = {k.lower(): v for k, v in (datasets or {}).items()}
        stored = {n.lower(): n for n in self.store.list_datasets()}
        for name in (*q.referenced_node_labels(), *q.referenced_relationship_types()):
            if name.lower() not in given:
                given[name.lower()] = self.store.read(stored.get(name.lower(), name))
        return given

    def run(self, text: str, params: dict | None = None, datasets: dict | None = None) -> DataFrame:
        q = self._query(text, params)
        return q.execute(self._tables(q, datasets), self.spark)

    query = run

    def run_with_vector_rerank(self, text: str, search: VectorSearch, params: dict | None = None, datasets: dict | None = None) -> DataFrame:
        q = self._query(text, params)
        return q.execute_with_vector_rerank(self._tables(q, datasets), search, spark=self.spark)

    def query_by_text(self, text: str, question: str, embed: Callable[[str], list[float]], column: str = "embedding", top_k: int = 10) -> DataFrame:
        return self.run_with_vector_rerank(text, VectorSearch(column).query_vector(embed(question)).metric("cosine").top_k(top_k))


def find_seed_entities(entities: DataFrame, query: list[float], top_n: int = 5) -> DataFrame:
    """Entities by cosine similarity, highest first; unlike vectors or zero ones score 0."""
    v = F.col("embedding").cast("array<float>")
    q = V.vector(query)
    score = F.when(v.isNull() | (F.size(v) != len(query)) | (V._product(v, v) == 0), F.lit(0.0)).otherwise(V.similarity(v, q, "cosine", "null").cast("double"))
    return entities.withColumn("score", score).orderBy(F.desc("score"), "entity_id").limit(top_n)


def seed_neighbors(relationships: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges at the seeds: seed_id, neighbor_id, direction, relationship_type."""
    s = seeds.select(F.col("entity_id").alias("seed_id")).distinct()
    out = relationships.join(s, F.col("source_entity_id") == F.col("seed_id")).select("seed_id", F.col("target_entity_id").alias("neighbor_id"), F.lit("outgoing").alias("direction"), "relationship_type")
    back = relationships.join(s, F.col("target_entity_id") == F.col("seed_id")).select("seed_id", F.col("source_entity_id").alias("neighbor_id"), F.lit("incoming").alias("direction"), "relationship_type")
    both = out.unionByName(back)
    return both if limit is None else both.orderBy("seed_id", "direction", "neighbor_id", "relationship_type").limit(limit)


class KnowledgeGraphBuilder:
    """An in-memory graph from parts."""

    def __init__(self):
        self._config, self._tables = GraphConfig.builder(), {}

    def with_node(self, label: str, id_field: str, data=None) -> KnowledgeGraphBuilder:
        self._config.with_node_label(label, id_field)
        return self.with_dataset(label, data) if data is not None else self

    def with_relationship(self, kind: str, source: str, target: str, data=None) -> KnowledgeGraphBuilder:
        self._config.with_relationship(kind, source, target)
        return self.with_dataset(kind, data) if data is not None else self

    def with_dataset(self, name: str, data) -> KnowledgeGraphBuilder:
        self._tables[name] = data
        return self

    def build(self) -> KnowledgeGraph:
        return KnowledgeGraph(self._config.build(), self._tables)


class KnowledgeGraph:
    def __init__(self, config: GraphConfig, tables: dict):
        self.config, self._tables = config, dict(tables)

    def tables(self) -> dict:
        return dict(self._tables)

    def _all(self, datasets: dict | None) -> dict:
        return {**{k.lower(): v for k, v in self._tables.items()}, **{k.lower(): v for k, v in (datasets or {}).items()}}

    def run(self, text: str, params: dict | None = None, datasets: dict | None = None) -> DataFrame:
        return CypherQuery(text).with_config(self.config).with_parameters(params or {}).execute(self._all(datasets))

    def run_with_vector_rerank(self, text: str, search: VectorSearch, datasets: dict | None = None) -> DataFrame:
        return CypherQuery(text).with_config(self.config).execute_with_vector_rerank(self._all(datasets), search)
