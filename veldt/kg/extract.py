"""Entity extraction by capitalised terms, as DataFrame expressions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the heuristic.
TERM = r"\b[A-Z][a-zA-Z0-9_]+\b"
CONTEXT = 50
CONFIDENCE = 0.4


def extract_entities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document and distinct term: id, name, entity_type, context (around the
    first occurrence), confidence.  Terms have three characters or more and are not all
    upper-case."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    terms = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: (F.length(t) > 2) & (t != F.upper(t))))
    rows = docs.select(F.col(id_column), text.alias("__t"), F.explode(terms).alias("name"))
    at = F.expr("regexp_instr(__t, concat('\\\\b', name, '\\\\b'))")
    start = F.greatest(at - CONTEXT, F.lit(1))
    context = F.substring(F.col("__t"), start, at - start + F.length("name") + CONTEXT)
    return rows.select(id_column, "name", F.lit("UNKNOWN").alias("entity_type"), F.trim(context).alias("context"), F.lit(CONFIDENCE).alias("confidence"))


class HeuristicExtractor:
    def extract_entities(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        return extract_entities(docs, id_column, text_column)

    def extract_relationships(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        return docs.sparkSession.createDataFrame([], "source_entity_name string, target_entity_name string, relationship_type string, description string, confidence double")


class CallableExtractor:
    """Extraction by a caller's function from a prompt to JSON text."""

    def __init__(self, complete):
        self.complete = complete

    def _ask(self, what: str, text: str) -> list[dict]:
        answer = self.complete(f"List the {what} of this text as a JSON array of objects.\n\n{text}").strip()
        if answer.startswith("```"):
            answer = answer.strip("`").removeprefix("json").strip()
        try:
            out = json.loads(answer)
        except ValueError:
            return []
        if isinstance(out, dict):
            out = out.get(what) or []
        return [x for x in out if isinstance(x, dict)]

    def extract_entities(self, text: str) -> list[dict]:
        return [{"name": str(x["name"]), "entity_type": str(x.get("type") or x.get("entity_type") or "UNKNOWN"), "context": str(x.get("context") or ""), "confidence": float(x.get("confidence") or 0.5)} for x in self._ask("entities", text) if x.get("name")]

    def extract_relationships(self, text: str) -> list[dict]:
        out = []
        for x in self._ask("relationships", text):
            a, b = x.get("source") or x.get("source_entity_name"), x.get("target") or x.get("target_entity_name")
            if a and b:
                out.append({"source_entity_name": str(a), "target_entity_name": str(b), "relationship_type": str(x.get("type") or x.get("relationship_type") or "RELATED_TO"), "description": str(x.get("description") or ""), "confidence": float(x.get("confidence") or 0.5)})
        return out


def with_entity_ids(entities: DataFrame) -> DataFrame:
    return entities.withColumn("entity_id", F.md5(F.concat_ws("|", "name", "entity_type")))


def resolve_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids for names (case-insensitive); relationships with unknown names go."""
    ids = entities.select(F.lower("name").alias("__n"), "entity_id").groupBy("__n").agg(F.min("entity_id").alias("entity_id"))
    out = relationships
    for side in ("source", "target"):
        own = ids.select(F.col("__n").alias(f"__{side}"), F.col("entity_id").alias(f"{side}_entity_id"))
        out = out.join(own, F.lower(f"{side}_entity_name") == F.col(f"__{side}")).drop(f"__{side}")
    return out
