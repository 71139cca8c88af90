"""Catalogs against a local HTTP server; the knowledge-graph layer on temporary folders."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import types as T

from veldt import CypherQuery, GraphConfig
from veldt.kg import cli, qa
from veldt.kg.extract import CallableExtractor, HeuristicExtractor, extract_entities, resolve_relationships, with_entity_ids
from veldt.kg.service import GraphStore, KnowledgeGraphBuilder, KnowledgeGraphService, config_from_dict, find_seed_entities, load_schema, seed_neighbors
from veldt.sources.catalog import AuthError, CatalogConnectionError, ColumnInfo, Connector, DirNamespace, InvalidResponseError, NotFoundError, TableInfo, UnityCatalog, spark_type
from veldt.sources.readers import TableReader


@pytest.fixture
def server(tmp_path):
    table = lambda name, fmt, location: {"name": name, "catalog_name": "main", "schema_name": "s", "data_source_format": fmt, "storage_location": location, "columns": [{"name": "id", "type_text": "bigint", "position": 0}, {"name": "tags", "type_text": "array<string>", "position": 1}]}
    tables = [table("Good", "PARQUET", f"{tmp_path}/good"), table("lines", "CSV", f"{tmp_path}/lines.csv"), table("broken", "PARQUET", f"{tmp_path}/none"), table("odd", "ICEBERG", "x")]
    pages = {
        "/catalogs": {"catalogs": [{"name": "main", "comment": "c"}], "next_page_token": "2"}, "/catalogs?page_token=2": {"catalogs": [{"name": "more"}]}, "/catalogs/main": {"name": "main"},
        "/schemas?catalog_name=main": {"schemas": [{"name": "s", "catalog_name": "main"}]}, "/schemas/main.s": {"name": "s", "catalog_name": "main"},
        "/tables?catalog_name=main&schema_name=s": {"tables": tables}, "/tables/main.s.Good": tables[0], "/catalogs/odd": ["no object"], "/catalogs/empty": {},
    }
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.headers.get("Authorization"))
            code = {"/catalogs/secret": 403, "/catalogs/down": 500}.get(self.path, 200 if self.path in pages or self.path == "/catalogs/text" else 404)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"not json" if self.path == "/catalogs/text" else json.dumps(pages.get(self.path, {})).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield UnityCatalog(f"http://127.0.0.1:{s.server_port}/", token="t", timeout=5), seen
    s.shutdown()


def test_unity(spark, server, tmp_path):
    uc, seen = server
    spark.createDataFrame([(1, ["a"]), (2, [])], "id long, tags array<string>").write.parquet(f"{tmp_path}/good")
    (tmp_path / "lines.csv").write_text("id,name\n1,x\n")
    assert [c.name for c in uc.list_catalogs()] == ["main", "more"] and uc.get_catalog("main").name == "main" and seen[0] == "Bearer t"
    assert uc.list_schemas("main")[0].catalog_name == "main" and uc.get_schema("main", "s").name == "s"
    assert uc.get_table("main", "s", "Good").spark_schema()["tags"].dataType == T.ArrayType(T.StringType())
    for name, kind in (("none", NotFoundError), ("secret", AuthError), ("down", CatalogConnectionError), ("text", InvalidResponseError), ("odd", InvalidResponseError), ("empty", InvalidResponseError)):
        with pytest.raises(kind):
            uc.get_catalog(name)
    with pytest.raises(CatalogConnectionError):
        UnityCatalog("http://127.0.0.1:9", timeout=1).list_catalogs()
    e = uc.create_sql_engine("main", "s", spark)
    assert e.execute("SELECT count(*) AS n FROM good").first().n == 2 and e.execute("SELECT * FROM odd").count() == 0 and e.execute("SELECT name FROM lines").first().name == "x"
    assert Connector(uc).register_schema(spark, "main", "s") == ["good", "lines", "odd"]
    for v in ("good", "lines", "odd"):
        spark.catalog.dropTempView(v)


def test_types():
    for text, want in (("BIGINT", T.LongType()), ("decimal(10,2)", T.DecimalType(10, 2)), ("NUMERIC", T.DecimalType(38, 10)), ("varchar(20)", T.StringType()), ("timestamp", T.TimestampNTZType()), ("map<string,int>", T.MapType(T.StringType(), T.IntegerType())), ("struct<a:int>", T.StructType([T.StructField("a", T.IntegerType())]))):
        assert spark_type(text) == want
    with pytest.raises(ValueError):
        spark_type("blob of things")
    assert TableInfo("t", "c", "s", columns=(ColumnInfo("b", "int", position=1), ColumnInfo("a", "", "STRING"))).spark_schema().names == ["a", "b"]


def test_namespace(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, Name string").write.parquet(f"{tmp_path}/Person.parquet")
    c = GraphConfig.builder().with_node_label("Person", "id").build()
    ns = DirNamespace(str(tmp_path))
    assert CypherQuery("MATCH (p:Person) RETURN p.name").with_config(c).execute_with_namespace(ns, spark).first()[0] == "x"
    for bad in ([], ["a", "b"], [""]):
        with pytest.raises(ValueError):
            ns.describe_table(bad)
    with pytest.raises(ValueError):
        ns.load(spark, "Nobody")
    with pytest.raises(NotImplementedError):
        TableReader("no_such_format").read(spark, str(tmp_path))


def test_store_and_service(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/kg")
    s = KnowledgeGraphService(store)
    assert s.list_datasets() == []
    with pytest.raises(FileNotFoundError):
        store.read("Entity")
    with pytest.raises(ValueError):
        store.write("../x", spark.range(1))
    s.upsert_table("Entity", spark.createDataFrame([("1", "Ada", "Person"), ("2", "Bob", None), (None, "no id", "x")], "entity_id string, name string, type string"))
    s.upsert_table("Entity", [{"entity_id": "1", "name": "Ada Lovelace", "entity_type": "Person"}])
    assert {(r.entity_id, r.name_lower, r.entity_type) for r in s.load_table("Entity").collect()} == {("1", "ada lovelace", "Person"), ("2", "bob", "UNKNOWN")}
    rel = spark.createDataFrame([("1", "2", None, "a"), ("1", "2", "KNOWS", "a"), ("1", None, "KNOWS", "a")], "source_entity_id string, target_entity_id string, relationship_type string, description string")
    s.upsert_table("RELATIONSHIP", rel)
    s.upsert_table("RELATIONSHIP", rel)
    assert sorted(r.relationship_type for r in s.load_table("RELATIONSHIP").collect()) == ["KNOWS", "RELATED_TO"]
    got = s.run("MATCH (a:Entity)-[r:RELATIONSHIP]->(b:Entity) WHERE r.relationship_type = 'KNOWS' RETURN a.name AS a, b.name AS b").collect()
    assert [tuple(r) for r in got] == [("Ada Lovelace", "Bob")]
    assert s.run("MATCH (a:Entity) RETURN count(*) AS n", datasets={"Entity": [{"entity_id": "9"}]}).first().n == 1
    answers = iter(['```json\n[{"cypher": "MATCH (a:Entity)-[r:RELATIONSHIP]->(b:Entity) WHERE r.relationship_type = \'knows\' RETURN b.name AS b"}, {"cypher": "bad"}]\n```', " Bob "])
    out = qa.ask(s, "Whom does Ada know?", lambda p: next(answers))
    assert out["answer"] == "Bob" and out["steps"][0]["rows"] == [{"b": "Bob"}] and "error" in out["steps"][1]
    assert "IN ['KNOWS', 'RELATED_TO']" in qa.normalise_types("WHERE r.relationship_type = 'likes'", ["KNOWS", "RELATED_TO"])


def test_seeds(spark):
    e = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.6, 0.8]), ("3", None), ("4", [0.0, 0.0]), ("5", [1.0])], "entity_id string, embedding array<float>")
    assert [(r.entity_id, round(r.score, 3)) for r in find_seed_entities(e, [1, 0], 3).collect()] == [("1", 1.0), ("2", 0.6), ("3", 0.0)]
    r = spark.createDataFrame([("1", "2", "A"), ("3", "1", "B"), ("2", "3", "C")], "source_entity_id string, target_entity_id string, relationship_type string")
    assert sorted(tuple(x) for x in seed_neighbors(r, e.limit(1)).collect()) == [("1", "2", "outgoing", "A"), ("1", "3", "incoming", "B")]


def test_extract(spark):
    docs = spark.createDataFrame([(1, "Ada met Bob. NASA and Ada_2 met Ada in To Paris"), (2, None), (3, "")], "doc_id long, text string")
    rows = extract_entities(docs).collect()
    assert [r.name for r in rows] == ["Ada", "Bob", "Ada_2", "Paris"] and rows[0].context.startswith("Ada met Bob") and rows[0].confidence == 0.4
    assert HeuristicExtractor().extract_relationships(docs).count() == 0
    ent = with_entity_ids(extract_entities(docs))
    rel = spark.createDataFrame([("ADA", "bob"), ("Ada", "Nobody")], "source_entity_name string, target_entity_name string")
    assert resolve_relationships(rel, ent).count() == 1
    x = CallableExtractor(lambda p: '```json\n[{"name": "Ada", "type": "Person"}, 3, {"source": "Ada", "target": "Bob"}]\n```')
    assert x.extract_entities("t")[0]["entity_type"] == "Person" and x.extract_relationships("t")[0]["relationship_type"] == "RELATED_TO"
    assert CallableExtractor(lambda p: "no").extract_entities("t") == []


def test_builder_and_schema(spark, tmp_path):
    g = KnowledgeGraphBuilder().with_node("P", "id", [{"id": 1, "n": "x"}]).with_relationship("K", "a", "b", [{"a": 1, "b": 1}]).build()
    assert g.run("MATCH (p:P)-[:K]->(q:P) RETURN q.n AS n").first().n == "x" and set(g.tables()) == {"P", "K"}
    (tmp_path / "s.yaml").write_text("nodes:\n  Person: id\n  City: {id_field: cid}\nrelationships:\n  IN: {source: p, target: c}\n")
    c = load_schema(str(tmp_path / "s.yaml"))
    assert c.node("city").id_field == "cid" and c.relationship("in").target_id_field == "c"
    assert config_from_dict({}).node("Entity").id_field == "entity_id"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("Ada met Bob in Paris")
    root = f"file://{tmp_path}/kg"
    assert cli.main(["--root", root, "--init", "--list-datasets"], spark) == 0
    assert cli.main(["--root", root, "--extract-and-add", f"{tmp_path}/t.txt", "MATCH (e:Entity) RETURN count(*) AS n"], spark) == 0
    out = capsys.readouterr().out
    assert "RELATIONSHIP" in out and "Entity has 3 rows" in out and "|3  |" in out


def test_embeddings_and_asking(spark, tmp_path, capsys, monkeypatch):
    import sys
    import types

    from veldt.kg import cli
    from veldt.kg.embeddings import embed, entity_texts, relationship_texts

    e = entity_texts(spark.createDataFrame([("1", "Ada", "PERSON", None), ("2", "", None, " ")], "entity_id string, name string, entity_type string, context string"))
    assert [r.embedding_text for r in e.orderBy("entity_id").collect()] == ["Ada\nPERSON", ""]
    r = relationship_texts(spark.createDataFrame([("1", "2", "Ada", None, "KNEW", "well")], "source_entity_id string, target_entity_id string, source_entity_name string, target_entity_name string, relationship_type string, description string"))
    assert r.first().embedding_text == "Ada -[KNEW]-> 2\nwell"
    got = embed(e, lambda texts: [[len(t), 1] for t in texts]).orderBy("entity_id").collect()
    assert [x.embedding for x in got] == [[10.0, 1.0], None]
    model = types.ModuleType("veldt_test_model")
    model.complete = lambda prompt: "[]" if "JSON" in prompt else "forty-two"
    monkeypatch.setitem(sys.modules, "veldt_test_model", model)
    assert cli.main(["--root", str(tmp_path), "--init", "--ask", "what?", "--model", "veldt_test_model:complete"], spark) == 0
    assert "forty-two" in capsys.readouterr().out


def test_http(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from veldt.kg.http import server
    from veldt.kg.service import GraphStore, KnowledgeGraphService

    httpd = server(KnowledgeGraphService(GraphStore(spark, f"file://{tmp_path}/graph")))
    threading.Thread(target=httpd.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{httpd.server_port}{path}", data)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/graph/health") == (200, {"status": "ok"}) and call("/datasets") == (200, {"datasets": []})
        entities = [{"entity_id": str(i), "name": n, "entity_type": "T", "embedding": [float(i), 1.0]} for i, n in enumerate("abc")]
        assert call("/datasets/Entity", entities) == (200, {"dataset": "Entity", "rows": 3})
        assert call("/datasets/Entity", {"rows": entities[:1]})[1]["rows"] == 3
        assert call("/datasets/RELATIONSHIP", [{"source_entity_id": "0", "target_entity_id": "2"}])[0] == 200
        assert len(call("/datasets/Entity?limit=2")[1]["rows"]) == 2
        assert call("/schema")[1]["nodes"] == {"Entity": "entity_id"}
        q = "MATCH (a:Entity)-[:RELATIONSHIP]->(b:Entity) WHERE a.name = $n RETURN b.name AS b"
        assert call("/query", {"query": q, "parameters": {"n": "a"}}) == (200, {"columns": ["b"], "rows": [{"b": "c"}]})
        near = {"query": "MATCH (e:Entity) RETURN e.name AS n, e.embedding AS v", "column": "v", "vector": [2, 1], "metric": "l2", "top_k": 1}
        assert call("/query/vector", near)[1]["rows"][0]["n"] == "c"
        assert [call(*x)[0] for x in (("/nothing",), ("/datasets/none",), ("/query", {"query": "MATCH"}), ("/query", {}), ("/query/other", {}))] == [404, 404, 400, 400, 404]
    finally:
        httpd.shutdown()
