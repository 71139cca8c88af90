"""The query API."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from .config import GraphConfig
from .errors import ConfigError, ExecutionError, InvalidPatternError, PlanError, UnsupportedFeatureError
from .functions.vector import VectorSearch
from .operators.compile import Compiler
from .plans import ast as A
from .plans import logical, semantic
from .plans.parser import parse
from .plans.sqlgen import SqlDialect, to_sql
from .sources.readers import as_frame


def _session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _frames(datasets: dict, spark: SparkSession) -> dict[str, DataFrame]:
    return {k.lower(): as_frame(v, spark) for k, v in datasets.items()}


class CypherQuery:
    """A parsed query; every ``with_`` method returns a new one."""

    def __init__(self, text: str):
        self._text, self._ast, self._config, self._params = text, parse(text), None, {}

    def _with(self, **changes) -> CypherQuery:
        out = object.__new__(CypherQuery)
        out.__dict__ = {**self.__dict__, **changes}
        return out

    def with_config(self, config: GraphConfig) -> CypherQuery:
        return self._with(_config=config)

    def with_parameter(self, name: str, value) -> CypherQuery:
        return self._with(_params={**self._params, name.lower(): value})

    def with_parameters(self, params: dict) -> CypherQuery:
        return self._with(_params={**self._params, **{k.lower(): v for k, v in params.items()}})

    def query_text(self) -> str:
        return self._text

    def ast(self) -> A.Query:
        return self._ast

    def config(self) -> GraphConfig | None:
        return self._config

    def parameters(self) -> dict:
        return dict(self._params)

    def _patterns(self):
        return [p for c in self._ast.clauses if isinstance(c, A.Match) for p in c.paths]

    def referenced_node_labels(self) -> list[str]:
        return list(dict.fromkeys(x for p in self._patterns() for n in p.nodes for x in n.labels))

    node_labels = referenced_node_labels

    def referenced_relationship_types(self) -> list[str]:
        return list(dict.fromkeys(x for p in self._patterns() for r in p.rels for x in r.types))

    relationship_types = referenced_relationship_types

    def variables(self) -> list[str]:
        out = [v for p in self._patterns() for x in (*p.nodes, *p.rels) if (v := x.var)]
        return list(dict.fromkeys([*out, *(c.alias for c in self._ast.clauses if isinstance(c, A.Unwind))]))

    # -- planning

    def plan(self) -> logical.Op:
        if self._config is None:
            raise ConfigError("Graph configuration is required; use with_config")
        bound = semantic.bind(self._ast, self._params)
        semantic.analyze(bound, self._config)
        return logical.build(bound, self._config)

    def warnings(self) -> list[str]:
        return semantic.analyze(semantic.bind(self._ast, self._params), self._config).warnings

    def compile(self, tables, spark: SparkSession | None = None) -> DataFrame:
        """``tables``: a function from lower-case table names to frames (or None)."""
        plan = self.plan()
        try:
            return Compiler(_session(spark), self._config, tables).run(plan)
        except AnalysisException as e:
            raise PlanError(str(e)) from e

    def execute(self, datasets: dict, spark: SparkSession | None = None) -> DataFrame:
        """``datasets``: table name to DataFrame, pandas, Arrow or a path.  Lazy."""
        if not datasets:
            raise ConfigError("No input datasets")
        spark = _session(spark)
        return self.compile(_frames(datasets, spark).get, spark)

    def execute_with_context(self, spark: SparkSession) -> DataFrame:
        """Tables are those registered in the session."""
        config = self._config or GraphConfig()
        for m in (*config.node_mappings.values(), *config.relationship_mappings.values()):
            if not spark.catalog.tableExists(m.source):
                raise ConfigError(f"Table '{m.source}' is not registered")
        return self.compile(lambda n: spark.table(n) if spark.catalog.tableExists(n) else None, spark)

    def execute_with_namespace(self, namespace, spark: SparkSession | None = None) -> DataFrame:
        spark = _session(spark)
        names = {m.source: m.table or getattr(m, "label", None) or m.relationship_type for m in (*self._config.node_mappings.values(), *self._config.relationship_mappings.values())} if self._config else {}
        return self.compile(lambda n: namespace.load(spark, names.get(n, n)), spark)

    def execute_with_catalog_and_context(self, catalog, spark: SparkSession) -> DataFrame:
        """``catalog``: an object with ``source(name)``; the session's tables come second."""
        return self.compile(lambda n: catalog.source(n) or (spark.table(n) if spark.catalog.tableExists(n) else None), spark)

    def execute_with_vector_rerank(self, datasets: dict, search: VectorSearch, index_first: bool = False, spark: SparkSession | None = None) -> DataFrame:
        """The query, then the nearest rows of its result.  With ``index_first`` (no WITH and
        no WHERE, and the vector column belongs to one label) the label's nearest rows are
        taken first and the result is sorted by distance."""
        spark = _session(spark)
        frames = _frames(datasets, spark)
        if index_first and (label := self._vector_label(search._column)):
            m = self._config.node(label)
            column = search._column.split(".")[-1].lower()
            table = frames[m.source].toDF(*[c.lower() for c in frames[m.source].columns])
            near = VectorSearch(column)
            near.__dict__ = {**search.__dict__, "_column": column, "_include": False, "_ties": (m.id_field.lower(),)}
            frames = {**frames, m.source: near.search(table)}
        return search.search(self.compile(frames.get, spark))

    def _vector_label(self, column: str) -> str | None:
        if any(isinstance(c, A.Where) or isinstance(c, A.Projection) and not c.final for c in self._ast.clauses):
            return None
        labels = {n.var.lower(): n.labels[0] for p in self._patterns() for n in p.nodes if n.var and n.labels}
        if "." in column:
            return labels.get(column.split(".")[0].lower())
        return next(iter(labels.values())) if len(labels) == 1 else None

    def explain(self, datasets: dict, spark: SparkSession | None = None) -> str:
        df = self.execute(datasets, spark)
        q = df._jdf.queryExecution()
        parts = {"Query": self._text, "graph_logical_plan": self.plan().show(), "logical_plan": q.analyzed().toString(), "optimized_plan": q.optimizedPlan().toString(), "physical_plan": q.executedPlan().toString()}
        return "\n".join(f"== {k} ==\n{v}" for k, v in parts.items())

    def to_sql(self, datasets: dict, dialect: str = SqlDialect.Default, spark: SparkSession | None = None) -> str:
        if not datasets:
            raise ConfigError("No input datasets")
        spark = _session(spark)
        return to_sql(self.plan(), self._config, {k: [(c.lower(), t) for c, t in f.dtypes] for k, f in _frames(datasets, spark).items()}, dialect)


class CypherQueryBuilder:
    """Builds a query from parts."""

    def __init__(self):
        self._match, self._return, self._distinct, self._limit, self._skip, self._config = [], [], False, None, None, None

    def match_node(self, variable: str, label: str) -> CypherQueryBuilder:
        self._match.append(A.Path((A.NodePattern(variable, (label,)),), ()))
        return self

    def return_property(self, variable: str, name: str) -> CypherQueryBuilder:
        self._return.append(A.Item(A.Prop(variable, name)))
        return self

    def distinct(self, on: bool = True) -> CypherQueryBuilder:
        self._distinct = on
        return self

    def limit(self, n: int) -> CypherQueryBuilder:
        self._limit = n
        return self

    def skip(self, n: int) -> CypherQueryBuilder:
        self._skip = n
        return self

    def with_config(self, config: GraphConfig) -> CypherQueryBuilder:
        self._config = config
        return self

    def build(self) -> CypherQuery:
        if not self._match:
            raise InvalidPatternError("A query needs a MATCH")
        if not self._return:
            raise InvalidPatternError("A query needs a RETURN")
        q = object.__new__(CypherQuery)
        q._ast = A.Query([A.Match(tuple(self._match)), A.Projection(tuple(self._return), True, self._distinct, (), self._skip, self._limit)])
        q._text, q._config, q._params = "", self._config, {}
        return q


class CypherEngine:
    """Several queries over one set of datasets."""

    def __init__(self, config: GraphConfig, datasets: dict, spark: SparkSession | None = None):
        if not datasets:
            raise ConfigError("No input datasets")
        self._config, self._spark = config, _session(spark)
        self._frames = _frames(datasets, self._spark)

    def config(self) -> GraphConfig:
        return self._config

    def execute(self, query: str, params: dict | None = None) -> DataFrame:
        return CypherQuery(query).with_config(self._config).with_parameters(params or {}).execute(self._frames, self._spark)

    def explain(self, query: str) -> str:
        return CypherQuery(query).with_config(self._config).explain(self._frames, self._spark)

    def execute_with_vector_rerank(self, query: str, search: VectorSearch) -> DataFrame:
        return CypherQuery(query).with_config(self._config).execute_with_vector_rerank(self._frames, search, spark=self._spark)


class SqlQuery:
    """SQL over named datasets; names are case-insensitive."""

    def __init__(self, sql: str):
        self._sql = sql

    def sql(self) -> str:
        return self._sql

    def execute(self, datasets: dict, spark: SparkSession | None = None) -> DataFrame:
        return SqlEngine(datasets, spark).execute(self._sql)

    def execute_with_context(self, spark: SparkSession) -> DataFrame:
        return _run_sql(spark, self._sql)

    def explain(self, datasets: dict, spark: SparkSession | None = None) -> str:
        return SqlEngine(datasets, spark).explain(self._sql)


def _run_sql(spark: SparkSession, sql: str) -> DataFrame:
    try:
        return spark.sql(sql)
    except ParseException as e:
        raise PlanError(f"Invalid SQL: {e}") from e
    except AnalysisException as e:
        raise PlanError(str(e)) from e


class SqlEngine:
    """Views exist only while a statement is analysed; a temporary view that the session
    has under such a name is put back as it was."""

    def __init__(self, datasets: dict, spark: SparkSession | None = None):
        if not datasets:
            raise ConfigError("No input datasets")
        self._spark = _session(spark)
        self._frames = _frames(datasets, self._spark)

    def execute(self, sql: str) -> DataFrame:
        catalog = self._spark._jsparkSession.sessionState().catalog()
        before = {name: catalog.getRawTempView(name) for name in self._frames}
        try:
            for name, df in self._frames.items():
                df.createOrReplaceTempView(name)
            return _run_sql(self._spark, sql)
        finally:
            for name, view in before.items():
                if view.isDefined():
                    catalog.createTempView(name, view.get(), True)
                else:
                    self._spark.catalog.dropTempView(name)

    def explain(self, sql: str) -> str:
        q = self.execute(sql)._jdf.queryExecution()
        return f"== logical_plan ==\n{q.analyzed().toString()}\n== physical_plan ==\n{q.executedPlan().toString()}"


__all__ = ["CypherEngine", "CypherQuery", "CypherQueryBuilder", "ExecutionError", "SqlDialect", "SqlEngine", "SqlQuery", "UnsupportedFeatureError"]
