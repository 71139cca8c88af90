"""The knowledge graph over HTTP, with the standard library's server.

GET /graph/health, /schema, /datasets, /datasets/NAME; POST /datasets/NAME (rows),
/query and /query/vector.  Bodies and answers are JSON; answers hold ``limit`` rows at most.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from ..functions.vector import VectorSearch
from .service import KnowledgeGraphService

#: Rows of an answer, unless the request says otherwise.
LIMIT = 100


class Problem(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def rows(df: DataFrame, limit: int) -> dict:
    return {"columns": df.columns, "rows": [r.asDict(recursive=True) for r in df.limit(limit).collect()]}


class GraphApi:
    """Requests to answers, without a server."""

    def __init__(self, service: KnowledgeGraphService):
        self.service = service

    def answer(self, method: str, path: str, body: dict | list | None = None, args: dict | None = None) -> dict:
        parts, args = [unquote(x) for x in path.strip("/").split("/")], args or {}
        try:
            if (method, parts) == ("GET", ["graph", "health"]):
                return {"status": "ok"}
            if (method, parts) == ("GET", ["schema"]):
                c = self.service.config
                return {"nodes": {m.label: m.id_field for m in c.node_mappings.values()}, "relationships": {m.relationship_type: [m.source_id_field, m.target_id_field] for m in c.relationship_mappings.values()}}
            if (method, parts) == ("GET", ["datasets"]):
                return {"datasets": self.service.list_datasets()}
            if len(parts) == 2 and parts[0] == "datasets":
                if method == "GET":
                    return rows(self.service.load_table(parts[1]), int(args.get("limit", LIMIT)))
                if method == "POST":
                    return self.store(parts[1], body)
            if method == "POST" and parts[0] == "query" and len(parts) <= 2:
                return self.query(parts[1:], body)
        except FileNotFoundError as e:
            raise Problem(404, str(e)) from e
        except (ValueError, NotImplementedError, KeyError, TypeError) as e:
            raise Problem(400, str(e)) from e
        raise Problem(404, f"Nothing at {method} {path}")

    def store(self, name: str, body) -> dict:
        new, merge = (body, True) if isinstance(body, list) else (body["rows"], body.get("merge", True))
        if not new:
            raise ValueError("No rows")
        self.service.upsert_table(name, new, merge)
        return {"dataset": name, "rows": self.service.load_table(name).count()}

    def query(self, kind: list[str], body) -> dict:
        limit, params = int(body.get("limit", LIMIT)), body.get("parameters") or {}
        if not kind:
            return rows(self.service.run(body["query"], params), limit)
        if kind != ["vector"]:
            raise Problem(404, f"No query of kind {kind[0]}")
        near = VectorSearch(body["column"]).query_vector(body["vector"]).metric(body.get("metric", "cosine")).top_k(int(body.get("top_k", 10)))
        return rows(self.service.run_with_vector_rerank(body["query"], near, params), limit)


def server(service: KnowledgeGraphService, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but not yet serving (``serve_forever``); port 0: any free one."""
    api = GraphApi(service)

    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            url = urlsplit(self.path)
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, out = 200, api.answer(method, url.path, json.loads(raw) if raw else None, {k: v[-1] for k, v in parse_qs(url.query).items()})
            except Problem as e:
                status, out = e.status, {"error": str(e)}
            except ValueError as e:  # not JSON
                status, out = 400, {"error": str(e)}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._do("GET")

        def do_POST(self) -> None:
            self._do("POST")

        def log_message(self, *args) -> None:
            """Quiet."""

    return ThreadingHTTPServer((host, port), Handler)
