"""Property-graph analytics on PySpark."""

from .config import GraphConfig, GraphConfigBuilder, NodeMapping, RelationshipMapping
from .engine import CypherEngine, CypherQuery, CypherQueryBuilder, SqlDialect, SqlEngine, SqlQuery
from .functions.ivf import VectorIndex
from .functions.vector import DistanceMetric, VectorSearch
from .operators.adjacency import AdjacencyIndex, AdjacencyIndexBuilder

__all__ = [
    "AdjacencyIndex", "AdjacencyIndexBuilder", "CypherEngine", "CypherQuery", "CypherQueryBuilder", "DistanceMetric", "GraphConfig", "GraphConfigBuilder", "NodeMapping", "RelationshipMapping", "SqlDialect", "SqlEngine", "SqlQuery", "VectorIndex", "VectorSearch",
]
