"""Texts to embed for entities and relationships, and embedding by a caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that go to the embedding function at a time.
BATCH = 64


def _present(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit("")


def entity_texts(entities: DataFrame, column: str = "embedding_text") -> DataFrame:
    """Name, type and context of an entity, one a line; what is missing is left out."""
    parts = F.array(*[_present(entities, c) for c in ("name", "entity_type", "context")])
    return entities.withColumn(column, F.array_join(F.filter(parts, lambda x: x != ""), "\n"))


def relationship_texts(relationships: DataFrame, column: str = "embedding_text") -> DataFrame:
    """``source -[type]-> target`` by names (ids where there are none), and the description."""
    end = lambda side: F.when(_present(relationships, f"{side}_entity_name") != "", _present(relationships, f"{side}_entity_name")).otherwise(_present(relationships, f"{side}_entity_id"))
    kind = F.when(_present(relationships, "relationship_type") != "", _present(relationships, "relationship_type")).otherwise(F.lit("RELATED_TO"))
    head = F.concat(end("source"), F.lit(" -["), kind, F.lit("]-> "), end("target"))
    return relationships.withColumn(column, F.array_join(F.filter(F.array(head, _present(relationships, "description")), lambda x: x != ""), "\n"))


def embed(df: DataFrame, function: Callable[[list[str]], list[list[float]]], text: str = "embedding_text", column: str = "embedding") -> DataFrame:
    """``df`` with the vectors of a text column (null for empty texts).  ``function`` runs in
    the tasks, on up to ``BATCH`` texts at a time."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = [None] * len(part)
            todo = [i for i, x in enumerate(part) if x]
            for k in range(0, len(todo), BATCH):
                some = todo[k : k + BATCH]
                for i, v in zip(some, function([part.iloc[j] for j in some]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(column, F.pandas_udf(run, "array<float>")(F.col(text)))
