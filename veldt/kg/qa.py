"""Question answering over a knowledge graph; the language model is a caller's function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .service import KnowledgeGraphService

MAX_ROWS = 20


def schema_summary(tables: dict[str, DataFrame], samples: int = 5) -> str:
    """Columns of every dataset and a few values of its string columns."""
    lines = []
    for name, df in sorted(tables.items()):
        lines.append(f"{name}: {', '.join(f'{c} {t}' for c, t in df.dtypes)}")
        for c, t in df.dtypes:
            if t == "string":
                values = [r[0] for r in df.select(f"`{c}`").filter(F.col(f"`{c}`").isNotNull()).distinct().limit(samples).collect()]
                lines.append(f"  {c}: {values}")
    return "\n".join(lines)


def _json(text: str):
    text = text.strip()
    m = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    return json.loads(m[1] if m else text)


def normalise_types(query: str, known: list[str]) -> str:
    """Relationship-type literals in the stored spelling; unknown ones widen to all known."""
    by = {re.sub(r"\W+", "_", k).lower(): k for k in known}

    def one(m: re.Match) -> str:
        column, value = m[1], m[3]
        key = re.sub(r"\W+", "_", value).lower()
        if key in by:
            return f"{column} = '{by[key]}'"
        return f"{column} IN [{', '.join(repr(k) for k in known)}]" if known else m[0]

    return re.sub(r"(\w+\.relationship_type)\s*=\s*(['\"])(.*?)\2", one, query)


def ask(service: KnowledgeGraphService, question: str, complete: Callable[[str], str], max_rows: int = MAX_ROWS) -> dict:
    """Plan as JSON steps, run them (``max_rows`` rows of each go into the prompt), answer."""
    tables = service.store.load_tables()
    plan = _json(complete(f"Tables:\n{schema_summary(tables)}\n\nWrite graph queries that help to answer the question, as a JSON array of objects with 'cypher'.\nQuestion: {question}"))
    steps = plan.get("steps", []) if isinstance(plan, dict) else plan
    types = []
    if "RELATIONSHIP" in tables and "relationship_type" in tables["RELATIONSHIP"].columns:
        types = [r[0] for r in tables["RELATIONSHIP"].select("relationship_type").distinct().orderBy("relationship_type").limit(200).collect() if r[0]]
    results = []
    for s in steps:
        query = normalise_types(s["cypher"] if isinstance(s, dict) else str(s), types)
        try:
            results.append({"cypher": query, "rows": [r.asDict(recursive=True) for r in service.run(query).limit(max_rows).collect()]})
        except (ValueError, NotImplementedError, RuntimeError) as e:
            results.append({"cypher": query, "error": str(e)})
    answer = complete(f"Question: {question}\nResults: {json.dumps(results, default=str)}\nAnswer from the results only.")
    return {"question": question, "steps": results, "answer": answer.strip()}
