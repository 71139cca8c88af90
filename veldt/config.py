"""How tables are read as a graph: labels and relationship types with their key columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .errors import ConfigError


@dataclass(frozen=True)
class NodeMapping:
    label: str
    id_field: str
    property_fields: tuple[str, ...] = ()
    filter_conditions: str | None = None
    table: str | None = None

    @property
    def source(self) -> str:
        return (self.table or self.label).lower()


@dataclass(frozen=True)
class RelationshipMapping:
    relationship_type: str
    source_id_field: str
    target_id_field: str
    property_fields: tuple[str, ...] = ()
    filter_conditions: str | None = None
    type_field: str | None = None
    table: str | None = None

    @property
    def source(self) -> str:
        return (self.table or self.relationship_type).lower()


@dataclass(frozen=True)
class GraphConfig:
    """Keys are lower-case: identifiers are case-insensitive throughout.

    ``undirected``: ``"out"`` plans ``-[]-`` like ``-[]->``; ``"both"`` follows edges
    both ways.  ``infer_properties`` lets a returned node variable expand to all columns.
    """

    node_mappings: dict[str, NodeMapping] = field(default_factory=dict)
    relationship_mappings: dict[str, RelationshipMapping] = field(default_factory=dict)
    undirected: str = "out"
    infer_properties: bool = False
    null_vectors: str = "error"

    @staticmethod
    def builder() -> GraphConfigBuilder:
        return GraphConfigBuilder()

    def node(self, label: str) -> NodeMapping | None:
        return self.node_mappings.get(label.lower())

    def relationship(self, kind: str) -> RelationshipMapping | None:
        return self.relationship_mappings.get(kind.lower())

    get_node_mapping, get_relationship_mapping = node, relationship

    def validate(self) -> None:
        for m in self.node_mappings.values():
            if not m.label or not m.id_field:
                raise ConfigError(f"Node mapping '{m.label}' needs a label and an id field")
        for r in self.relationship_mappings.values():
            if not r.relationship_type or not r.source_id_field or not r.target_id_field:
                raise ConfigError(f"Relationship mapping '{r.relationship_type}' needs a type and both id fields")
        if self.undirected not in ("out", "both"):
            raise ConfigError("undirected must be 'out' or 'both'")
        if self.null_vectors not in ("error", "null"):
            raise ConfigError("null_vectors must be 'error' or 'null'")

    def node_labels(self) -> list[str]:
        return [m.label for m in self.node_mappings.values()]

    def relationship_types(self) -> list[str]:
        return [m.relationship_type for m in self.relationship_mappings.values()]


class GraphConfigBuilder:
    def __init__(self):
        self._nodes: list[NodeMapping] = []
        self._rels: list[RelationshipMapping] = []
        self._options: dict = {}

    def with_node_label(self, label: str, id_field: str, property_fields=(), filter_conditions: str | None = None, table: str | None = None) -> GraphConfigBuilder:
        return self.with_node_mapping(NodeMapping(label, id_field, tuple(property_fields), filter_conditions, table))

    def with_node_mapping(self, mapping: NodeMapping) -> GraphConfigBuilder:
        self._nodes.append(mapping)
        return self

    def with_relationship(self, relationship_type: str, source_id_field: str, target_id_field: str, property_fields=(), filter_conditions: str | None = None, table: str | None = None) -> GraphConfigBuilder:
        return self.with_relationship_mapping(RelationshipMapping(relationship_type, source_id_field, target_id_field, tuple(property_fields), filter_conditions, None, table))

    def with_relationship_mapping(self, mapping: RelationshipMapping) -> GraphConfigBuilder:
        self._rels.append(mapping)
        return self

    def with_undirected(self, how: str) -> GraphConfigBuilder:
        self._options["undirected"] = how
        return self

    def with_inferred_properties(self, on: bool = True) -> GraphConfigBuilder:
        self._options["infer_properties"] = on
        return self

    def with_null_vectors(self, how: str) -> GraphConfigBuilder:
        self._options["null_vectors"] = how
        return self

    def build(self) -> GraphConfig:
        config = replace(GraphConfig({m.label.lower(): m for m in self._nodes}, {r.relationship_type.lower(): r for r in self._rels}), **self._options)
        config.validate()
        return config
