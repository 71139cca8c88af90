"""Command line: python -m veldt.kg.cli --root DIR [--init | --list-datasets | ...] [QUERY]."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from .extract import extract_entities, with_entity_ids
from .qa import ask
from .service import GraphStore, KnowledgeGraphService, config_from_dict, load_schema

ENTITY = "entity_id string, name string, entity_type string, context string, confidence double"
RELATIONSHIP = "source_entity_id string, target_entity_id string, relationship_type string, description string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veldt-kg", description=__doc__)
    p.add_argument("query", nargs="?")
    p.add_argument("--root", default="./veldt-graph")
    p.add_argument("--schema", help="YAML file of nodes and relationships")
    p.add_argument("--init", action="store_true", help="create empty Entity and RELATIONSHIP datasets")
    p.add_argument("--list-datasets", action="store_true")
    p.add_argument("--extract-preview", metavar="FILE", help="show the entities of a text file")
    p.add_argument("--extract-and-add", metavar="FILE", help="add the entities of a text file")
    p.add_argument("--ask", metavar="QUESTION", help="answer a question with the language model of --model")
    p.add_argument("--model", metavar="MODULE:FUNCTION", help="a function from a prompt to the model's text")
    p.add_argument("--limit", type=int, default=20, help="rows to print")
    return p


def _entities(spark: SparkSession, path: str):
    with open(path) as f:
        docs = spark.createDataFrame([(path, f.read())], "doc_id string, text string")
    return with_entity_ids(extract_entities(docs)).select("entity_id", "name", "entity_type", "context", F.col("confidence").cast("double"))


def _function(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("veldt-kg").getOrCreate()
    service = KnowledgeGraphService(GraphStore(spark, a.root), load_schema(a.schema) if a.schema else config_from_dict(None))
    if a.init:
        have = service.list_datasets()
        for name, ddl in (("Entity", ENTITY), ("RELATIONSHIP", RELATIONSHIP)):
            if name not in have:
                service.store.write(name, spark.createDataFrame([], ddl))
        print(f"Initialised {a.root}")
    if a.list_datasets:
        for name, path in service.store.list_datasets().items():
            print(f"{name}\t{path}")
    if a.extract_preview:
        _entities(spark, a.extract_preview).show(a.limit, truncate=60)
    if a.extract_and_add:
        new = _entities(spark, a.extract_and_add)
        service.upsert_table("Entity", new)
        print(f"Entity has {service.load_table('Entity').count()} rows")
    if a.ask:
        if not a.model:
            raise ConfigError("--ask needs --model")
        print(ask(service, a.ask, _function(a.model))["answer"])
    if a.query:
        service.run(a.query).show(a.limit, truncate=False)
    elif sys.stdin.isatty() and argv is None and not (a.init or a.list_datasets or a.extract_preview or a.extract_and_add or a.ask):
        shell(service, a.limit)
    return 0


def shell(service: KnowledgeGraphService, limit: int) -> None:
    print("A query, :datasets, :config, :help or :quit")
    while True:
        try:
            line = input("kg> ").strip()
        except EOFError:
            return
        if line in (":quit", ":q", ":exit"):
            return
        if line == ":datasets":
            print("\n".join(service.list_datasets()))
        elif line == ":config":
            print(service.config.node_labels(), service.config.relationship_types())
        elif line == ":help":
            print("A query, :datasets, :config, :help or :quit")
        elif line:
            try:
                service.run(line).show(limit, truncate=False)
            except (ValueError, NotImplementedError, RuntimeError, FileNotFoundError) as e:
                print(f"Error: {e}")


if __name__ == "__main__":
    sys.exit(main())
