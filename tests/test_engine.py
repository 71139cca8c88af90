"""Queries on small graphs with rows worked out by hand."""

import random
from collections import Counter

import pytest

from veldt import AdjacencyIndexBuilder, CypherEngine, CypherQuery, CypherQueryBuilder, GraphConfig, SqlDialect, SqlEngine, SqlQuery, VectorIndex, VectorSearch

STATIONS = [(11, "Mossgate", 12, "amber"), (12, "Harrow", 31, "cobalt"), (13, "Tinsley", 20, None), (14, "Quarry", 45, "amber"), (15, "Fennimore", 8, "jade"), (16, "Ostler", 27, "cobalt")]
TRACKS = [(11, 13, 1961), (13, 12, 1975), (13, 14, 1988), (12, 16, 1990), (16, 14, None), (12, 14, 1979)]
NOTICES = [(11, "Closing", "alert", [2.0, 0.0, 0.0]), (12, "Detour", "alert", [2.0, 1.0, 0.0]), (13, "Plan", "map", [0.0, 2.0, 0.0]), (14, "Lift", "alert", [0.0, 0.0, 2.0]), (15, "Legend", "map", [1.0, 2.0, 0.0])]


def config(**options):
    b = GraphConfig.builder().with_node_label("Station", "code").with_node_label("Notice", "id").with_relationship("TRACK", "from_stop", "to_stop").with_relationship("NEAR", "a", "b")
    for k, v in options.items():
        getattr(b, k)(v)
    return b.build()


@pytest.fixture(scope="module")
def data(spark):
    return {
        "Station": spark.createDataFrame(STATIONS, "code long, title string, Depth long, line string"),
        "TRACK": spark.createDataFrame(TRACKS, "from_stop long, to_stop long, opened long"),
        "NEAR": spark.createDataFrame([(15, 11), (11, 15)], "a long, b long"),
        "Notice": spark.createDataFrame(NOTICES, "id long, head string, kind string, embedding array<float>"),
    }


def run(data, text, params=None, **options):
    q = CypherQuery(text).with_config(config(**options)).with_parameters(params or {})
    df = q.execute(data)
    rows = [tuple(r) for r in df.collect()]
    try:  # the SQL text must give the same rows
        sql = q.to_sql(data, SqlDialect.Spark)
    except NotImplementedError:
        sql = None
    if sql is not None:
        same = SqlQuery(sql).execute(data)
        assert same.columns == df.columns, sql
        assert Counter(map(repr, map(tuple, same.collect()))) == Counter(map(repr, rows)), sql
    return df.columns, rows


CASES = [
    ("MATCH (s:Station) WHERE s.depth > 25 RETURN s.title ORDER BY s.title", [("Harrow",), ("Ostler",), ("Quarry",)]),
    ("MATCH (s:station {TITLE: 'Fennimore'}) RETURN S.Line", [("jade",)]),
    ("MATCH (s:Station) WHERE s.line IS NULL RETURN s.title AS Title", [("Tinsley",)]),
    ("MATCH (s:Station) RETURN s.title ORDER BY s.line, s.title", [("Tinsley",), ("Mossgate",), ("Quarry",), ("Harrow",), ("Ostler",), ("Fennimore",)]),
    ("MATCH (s:Station) RETURN s.title AS t ORDER BY s.line DESC LIMIT 2", [("Tinsley",), ("Fennimore",)]),
    ("MATCH (s:Station) RETURN s.title ORDER BY s.depth SKIP 1 LIMIT 2", [("Mossgate",), ("Tinsley",)]),
    ("MATCH (s:Station) RETURN s.title AS t ORDER BY t SKIP 4", [("Quarry",), ("Tinsley",)]),
    ("MATCH (a:Station)-[r:TRACK]->(b:Station) WHERE r.opened > 1975 RETURN a.title, b.title, r.opened ORDER BY r.opened", [("Harrow", "Quarry", 1979), ("Tinsley", "Quarry", 1988), ("Harrow", "Ostler", 1990)]),
    ("MATCH (b:Station)<-[:TRACK]-(a:Station {title: 'Tinsley'}) RETURN b.title ORDER BY b.title", [("Harrow",), ("Quarry",)]),
    ("MATCH (a:Station)-[:TRACK]-(b:Station) WHERE a.title = 'Ostler' RETURN b.title", [("Quarry",)]),
    ("MATCH (a:Station)-[r:TRACK]->(b:Station) WHERE r.opened IS NULL RETURN a.title", [("Ostler",)]),
    ("MATCH (a:Station)-[:TRACK]->(b:Station)-[:TRACK]->(c:Station) RETURN a.title, c.title ORDER BY a.title, c.title", [("Harrow", "Quarry"), ("Mossgate", "Harrow"), ("Mossgate", "Quarry"), ("Tinsley", "Ostler"), ("Tinsley", "Quarry")]),
    ("MATCH (a:Station)-[:TRACK]->(b:Station)-[:TRACK]->(c:Station), (a)-[:TRACK]->(c) RETURN a.title, b.title, c.title", [("Harrow", "Ostler", "Quarry"), ("Tinsley", "Harrow", "Quarry")]),
    ("MATCH (a:Station)-[:TRACK*1..2]->(b:Station) WHERE a.title = 'Mossgate' RETURN b.title ORDER BY b.title", [("Harrow",), ("Quarry",), ("Tinsley",)]),
    ("MATCH (a:Station {title: 'Mossgate'})-[:TRACK*2..3]->(b:Station {title: 'Quarry'}) RETURN count(*) AS n", [(2,)]),
    ("MATCH (a:Station)-[:TRACK*]->(b:Station) WHERE a.code = 11 RETURN b.code AS b, count(*) AS n ORDER BY b", [(12, 1), (13, 1), (14, 3), (16, 1)]),
    ("MATCH (a:Station)-[:TRACK*1..3]->(b:Station) WHERE a.line = 'amber' AND b.depth < 30 AND a.depth < b.depth RETURN a.title, b.title ORDER BY b.title", [("Mossgate", "Ostler"), ("Mossgate", "Tinsley")]),
    ("MATCH (a:Station)-[:TRACK*1..1]->(b:Station) WHERE a.code = 13 RETURN b.code ORDER BY b.code", [(12,), (14,)]),
    ("MATCH (a:Station)-[:TRACK|NEAR]->(b:Station) WHERE a.code IN [11, 15] RETURN a.code, b.code ORDER BY a.code, b.code", [(11, 13), (11, 15), (15, 11)]),
    ("MATCH (a:Station)-[]->(b:Station) RETURN count(*) AS n", [(8,)]),
    ("MATCH (s:Station) RETURN count(*), count(s.line), min(s.depth) AS lo, max(s.depth) AS hi, sum(s.depth) AS t, avg(s.depth) AS a", [(6, 5, 8, 45, 143, 143 / 6)]),
    ("MATCH (a:Station)-[:TRACK]->(b:Station) RETURN a.title AS who, count(b) AS n ORDER BY n DESC, who LIMIT 2", [("Harrow", 2), ("Tinsley", 2)]),
    ("MATCH (a:Station)-[:TRACK]->(b:Station) WITH a, count(*) AS n WHERE n > 1 RETURN a.title, n", [("Harrow", 2), ("Tinsley", 2)]),
    ("MATCH (s:Station) WITH s.title AS t, s.depth AS g ORDER BY g DESC LIMIT 3 WHERE g < 40 RETURN t ORDER BY t", [("Harrow",), ("Ostler",)]),
    ("MATCH (s:Station) WITH s AS q MATCH (q)-[:TRACK]->(r:Station) RETURN q.title, r.title ORDER BY q.title, r.title LIMIT 1", [("Harrow", "Ostler")]),
    ("MATCH (s:Station) WITH DISTINCT s.depth > 25 AS deep RETURN deep ORDER BY deep", [(False,), (True,)]),
    ("UNWIND [2, 1] AS x RETURN x ORDER BY x", [(1,), (2,)]),
    ("UNWIND ['a', 'b'] AS x RETURN toUpper(x) AS u ORDER BY u", [("A",), ("B",)]),
    ("MATCH (s:Station) UNWIND [s.code, 100] AS v WITH v WHERE v < 13 RETURN v ORDER BY v", [(11,), (12,)]),
    ("MATCH (s:Station) RETURN DISTINCT s.depth / 10 AS d ORDER BY d", [(0,), (1,), (2,), (3,), (4,)]),
    ("MATCH (s:Station) WHERE NOT s.title CONTAINS 'ar' AND s.title ENDS WITH 'e' RETURN s.title", [("Fennimore",), ("Mossgate",)]),
    ("MATCH (s:Station) WHERE s.title LIKE '_arrow' OR s.title ILIKE 'ti%' RETURN toLower(s.title) AS t ORDER BY t", [("harrow",), ("tinsley",)]),
    ("MATCH (s:Station), (d:Notice) WHERE s.code = d.id AND d.kind = 'map' RETURN s.title ORDER BY s.title", [("Fennimore",), ("Tinsley",)]),
    ("MATCH (s:Station) OPTIONAL MATCH (s)-[:NEAR]->(q:Station) RETURN s.code AS s, q.title AS q ORDER BY s", [(11, "Fennimore"), (12, None), (13, None), (14, None), (15, "Mossgate"), (16, None)]),
    ("MATCH (s:Station) RETURN s ORDER BY s.code LIMIT 1", [(11,)]),
    ("MATCH (s:Station) RETURN count(DISTINCT s.line) AS n", [(3,)]),
    ("MATCH (s:Station) WHERE s.title = 'nowhere' RETURN count(*) AS n, collect(s.title) AS c", [(0, [])]),
    ("MATCH (s:Station) WHERE exists(s.line) AND s.depth % 2 = 1 RETURN s.title ORDER BY s.title", [("Harrow",), ("Ostler",), ("Quarry",)]),
]


@pytest.mark.parametrize("text,want", CASES, ids=[str(i) for i in range(len(CASES))])
def test_rows(data, text, want):
    _, rows = run(data, text)
    assert rows == want if "ORDER BY" in text else sorted(rows) == sorted(want)


def test_names(data):
    assert run(data, "MATCH (S:Station) RETURN S.Title, S.depth AS Metres, count(*), count(DISTINCT S.line)")[0] == ["S.Title", "metres", "count(*)", "count(DISTINCT S.line)"]
    assert run(data, "MATCH (s:Station) RETURN s", with_inferred_properties=True)[0] == ["s.code", "s.title", "s.depth", "s.line"]
    assert run(data, "MATCH (s:Station)-[r:TRACK]->(q:Station) RETURN r")[0] == ["r.from_stop", "r.to_stop", "r.opened"]


def test_undirected_both(data):
    _, rows = run(data, "MATCH (a:Station)-[:TRACK]-(b:Station) WHERE a.title = 'Ostler' RETURN b.title", with_undirected="both")
    assert sorted(rows) == [("Harrow",), ("Quarry",)]


def test_collect_keeps_nulls(data):
    _, rows = run(data, "MATCH (s:Station) RETURN collect(s.line) AS c")
    assert len(rows[0][0]) == 6 and None in rows[0][0]


def test_parameters(data):
    assert run(data, "MATCH (s:Station) WHERE s.depth > $Low AND s.title IN $names RETURN s.title", {"low": 25, "NAMES": ["Ostler", "Mossgate"]})[1] == [("Ostler",)]


def test_vectors(data):
    _, rows = run(data, "MATCH (d:Notice) RETURN d.head, vector_distance(d.embedding, [2.0, 0.0, 0.0], l2) AS d ORDER BY d LIMIT 2")
    assert rows == [("Closing", 0.0), ("Detour", 1.0)]
    _, rows = run(data, "MATCH (d:Notice) WHERE vector_similarity(d.embedding, $q, cosine) > 0.4 RETURN d.head ORDER BY d.head", {"q": [1, 0, 0]})
    assert [r[0] for r in rows] == ["Closing", "Detour", "Legend"]
    _, rows = run(data, "MATCH (d:Notice) WHERE d.id = 14 RETURN vector_similarity(d.embedding, [0.0, 0.0, 0.0], cosine) AS a, vector_distance(d.embedding, [1.0], cosine) AS b, vector_distance(d.embedding, [0.0, 0.0, 2.0], dot) AS c, vector_similarity(d.embedding, [0.0, 0.0, 2.0], l2) AS e")
    assert rows == [(-1.0, 2.0, -4.0, 1.0)]


def test_null_vectors(spark, data):
    bad = {**data, "Notice": spark.createDataFrame([(1, None)], "id long, embedding array<float>")}
    text = "MATCH (d:Notice) RETURN vector_distance(d.embedding, [1.0], l2) AS d"
    with pytest.raises(Exception, match="Null vector"):
        CypherQuery(text).with_config(config()).execute(bad).collect()
    assert run(bad, text, with_null_vectors="null")[1] == [(None,)]


def test_vector_search(data):
    s = VectorSearch("embedding").query_vector([1, 0, 0]).metric("cosine").top_k(2)
    assert [(r.head, round(r._distance, 4)) for r in s.search(data["Notice"]).collect()] == [("Closing", 0.0), ("Detour", 0.1056)]
    assert "_distance" not in s.include_distance(False).search(data["Notice"]).columns
    with pytest.raises(ValueError):
        VectorSearch("embedding").search(data["Notice"])
    with pytest.raises(ValueError):
        VectorSearch("nope").query_vector([1]).search(data["Notice"])
    q = CypherQuery("MATCH (d:Notice) RETURN d.head, d.embedding").with_config(config())
    near = VectorSearch("d.embedding").query_vector([0, 1, 0]).top_k(2)
    for first in (False, True):
        assert [r[0] for r in q.execute_with_vector_rerank(data, near, index_first=first).collect()] == ["Plan", "Legend"]


def test_vector_index(spark, data, tmp_path):
    rng = random.Random(7)
    homes = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in homes[i % 12]]) for i in range(1500)] + [(9000, None), (9001, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    for metric in ("l2", "cosine", "dot"):
        index = VectorIndex.build(df, "v", f"{tmp_path}/{metric}", cells=12, metric=metric, sample_rows=600)
        assert spark.read.parquet(f"{tmp_path}/{metric}/rows").count() == len(rows)
        hit = 0
        for k in range(0, 1500, 50):  # queries against brute force
            near = VectorSearch("v").query_vector(rows[k][1]).metric(metric).top_k(10).tie_break("id").null_vectors("null")
            want = {r.id for r in near.search(df).collect()}
            hit += len(want & {r.id for r in index.search(near, probes=4).collect()})
        assert hit >= 0.9 * 10 * 30
    with pytest.raises(ValueError):
        index.search(VectorSearch("v").query_vector([1.0]).metric("l2"))
    none = VectorIndex.build(df.limit(0), "v", f"{tmp_path}/none")
    assert none.search(VectorSearch("v").query_vector([1.0])).count() == 0


def test_joins_on_shared_variables(spark, data):
    from veldt.operators.compile import Compiler
    from veldt.plans import logical as L
    from veldt.plans import ast as A

    frames = {k.lower(): v for k, v in data.items()}
    low = L.Filter(L.ScanByLabel("s", "Station"), A.Binary("<", A.Prop("s", "depth"), A.Literal(28)))
    high = L.Expand(L.Filter(L.ScanByLabel("s", "Station"), A.Binary(">", A.Prop("s", "depth"), A.Literal(10))), "s", "r", ("NEAR",), "out", "t", "Station", False)
    rows = lambda how: sorted(((r.s__code, r.t__code) for r in Compiler(spark, config(), frames.get).run(L.Join(low, high, how)).collect()), key=str)
    assert rows("inner") == [(11, 15)]
    assert rows("left") == [(11, 15), (13, None), (15, None), (16, None)]
    assert rows("right") == rows("inner") and rows("full") == rows("left")


def test_errors(data):
    with pytest.raises(ValueError, match="configuration"):
        CypherQuery("MATCH (s:Station) RETURN s.title").execute(data)
    with pytest.raises(ValueError, match="No input"):
        CypherQuery("MATCH (s:Station) RETURN s.title").with_config(config()).execute({})
    for text in ("MATCH (s:Ghost) RETURN s.x", "MATCH (s:Station) RETURN s.nope", "MATCH (s:Station)-[:GHOST]->(q:Station) RETURN s.title", "MATCH (s:Station) RETURN DISTINCT s.title ORDER BY s.depth"):
        with pytest.raises(ValueError):
            CypherQuery(text).with_config(config()).execute(data)


def test_engines(spark, data):
    e = CypherEngine(config(), data)
    assert e.execute("MATCH (s:Station) WHERE s.depth = $a RETURN s.title", {"a": 45}).first()[0] == "Quarry"
    assert "ScanByLabel" in e.explain("MATCH (s:Station) RETURN s.title") and "== physical_plan ==" in e.explain("MATCH (s:Station) RETURN s.title")
    s = SqlEngine({"Stops": data["Station"]})
    assert s.execute("SELECT count(*) AS n FROM stops").first().n == 6
    for sql in ("SELEC 1", "SELECT * FROM missing"):
        with pytest.raises(ValueError):
            s.execute(sql)
    q = CypherQueryBuilder().match_node("s", "Station").return_property("s", "title").distinct().limit(3).with_config(config()).build()
    assert q.execute(data).count() == 3
    q = CypherQuery("MATCH (s:Station)-[r:TRACK]->(:Notice) UNWIND [1] AS i RETURN s.title")
    assert (q.referenced_node_labels(), q.referenced_relationship_types(), q.variables()) == (["Station", "Notice"], ["TRACK"], ["s", "r", "i"])
    data["Station"].createOrReplaceTempView("station")
    only = CypherQuery("MATCH (s:Station) RETURN count(*) AS n").with_config(GraphConfig.builder().with_node_label("Station", "code").build())
    assert only.execute_with_context(spark).first().n == 6
    spark.catalog.dropTempView("station")
    with pytest.raises(ValueError):
        only.execute_with_context(spark)
    import pandas as pd
    import pyarrow as pa

    for frame in (pd.DataFrame({"code": [1], "title": ["x"]}), pa.table({"code": [1], "title": ["x"]}), pa.RecordBatch.from_pydict({"code": [1], "title": ["x"]}), [{"code": 1, "title": "x"}]):
        assert CypherQuery("MATCH (s:Station) RETURN s.title").with_config(config()).execute({"station": frame}).first()[0] == "x"


def test_sql_engine_leaves_the_sessions_views(spark, data):
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW stops AS SELECT 7 AS own")
    engine = SqlEngine({"stops": data["Station"], "other": data["TRACK"]})
    assert engine.execute("SELECT count(*) AS n FROM stops, other").first().n == 36
    with pytest.raises(ValueError):
        engine.execute("SELECT nothing FROM stops")
    assert spark.table("stops").first().own == 7 and not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("stops")


def test_long_paths_are_lazy_and_start_at_the_filter(spark, data):
    spark.sparkContext.setJobGroup("lazy", "no job while a query is compiled")
    q = CypherQuery("MATCH (a:Station)-[:TRACK*1..6]->(b:Station) WHERE a.code = 11 AND b.depth > 1 RETURN b.code AS b").with_config(config())
    df = q.execute(data)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    lines = q.plan().show().split("\n")
    kinds = [x.split("(")[0].strip() for x in lines]
    assert kinds == ["Project", "Filter", "VariableLengthExpand", "Filter", "ScanByLabel"]
    assert sorted(r.b for r in df.collect()) == [12, 13, 14, 14, 14, 16]


@pytest.mark.parametrize("dialect", ["default", "spark", "postgresql", "mysql", "sqlite"])
def test_dialects(data, dialect):
    q = CypherQuery("MATCH (a:Station)-[:TRACK]->(b:Station) WHERE a.title STARTS WITH 'H' AND b.depth > 20 RETURN a.title AS a, count(*) AS n ORDER BY n DESC LIMIT 5").with_config(config())
    sql = q.to_sql(data, dialect)
    mark = "`" if dialect in ("spark", "mysql") else '"'
    assert f"{mark}a__title{mark}" in sql and "INNER JOIN" in sql and "GROUP BY" in sql and "LIMIT 5" in sql
    if dialect in ("default", "postgresql", "sqlite"):  # these also run elsewhere
        import duckdb

        con = duckdb.connect()
        for k in ("Station", "TRACK"):
            con.register(k.lower(), data[k].toDF(*[c.lower() for c in data[k].columns]).toPandas())
        assert con.execute(sql).fetchall() == [("Harrow", 2)]


def test_random_walks(spark):
    rng = random.Random(5)
    for seed in range(3):
        nodes, edges = list(range(6)), [(rng.randrange(7), rng.randrange(7)) for _ in range(9)]
        want = Counter()
        low, high = rng.choice([(1, 3), (2, 2), (3, 5)])
        walks = [(a, b) for a, b in edges if a in nodes]
        for k in range(1, high + 1):
            if k >= low:
                want.update((a, b) for a, b in walks if b in nodes)
            walks = [(a, d) for a, b in walks if b in nodes for c, d in edges if c == b]
        c = GraphConfig.builder().with_node_label("N", "id").with_relationship("E", "s", "d").build()
        data = {"N": spark.createDataFrame([(n,) for n in nodes], "id long"), "E": spark.createDataFrame(edges, "s long, d long")}
        q = CypherQuery(f"MATCH (a:N)-[:E*{low}..{high}]->(b:N) RETURN a.id AS a, b.id AS b, count(*) AS n").with_config(c)
        assert {(r.a, r.b): r.n for r in q.execute(data).collect()} == dict(want)


def test_adjacency(spark):
    b = AdjacencyIndexBuilder(spark).add_edge(0, 1).add_edge(0, 2)
    own, back = b.add_edges(spark.createDataFrame([(0, 3), (1, 2), (2, 3)], "src_id long, dst_id int")).with_num_vertices(5).build_bidirectional()
    assert [tuple(r) for r in own.offsets().orderBy("vertex_id").collect()] == [(0, 0, 3), (1, 3, 1), (2, 4, 1), (3, 5, 0), (4, 5, 0)]
    assert [r.dst_id for r in own.neighbor_list().collect()] == [1, 2, 3, 2, 3]
    assert own.degree(0) == 3 and own.degree(9) == 0 and [r.dst_id for r in back.neighbors(3).collect()] == [0, 2] and own.num_edges() == 5
    assert {(r.vertex_id, r.level) for r in own.bfs(0).collect()} == {(0, 0), (1, 1), (2, 1), (3, 1)}
    assert own.bfs(1, 1).count() == 2 and own.bfs(99).count() == 0
    assert own.shortest_path(1, 3) == [1, 2, 3] and own.shortest_path(3, 0) is None and own.shortest_path(4, 4) == [4] and own.shortest_path(0, 77) is None
    assert AdjacencyIndexBuilder(spark).build().num_vertices() == 0
    with pytest.raises(ValueError):
        AdjacencyIndexBuilder(spark).add_edges(spark.createDataFrame([("a", 1)], "src_id string, dst_id long"))
