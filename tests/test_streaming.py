import pytest

from veldt import CypherQuery, GraphConfig
from veldt.streaming.edges import match_stream, to_table


def test_new_edges_are_matched(spark, tmp_path):
    config = GraphConfig.builder().with_node_label("P", "id").with_relationship("K", "a", "b").build()
    people = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string")
    edges = str(tmp_path / "edges")
    spark.createDataFrame([(1, 2), (2, 9)], "a long, b long").write.parquet(edges)
    stream = spark.readStream.schema("a long, b long").parquet(edges)
    q = CypherQuery("MATCH (p:P)-[:K]->(q:P) RETURN p.name AS p, q.name AS q")

    def run():
        to_table(match_stream(q, config, {"P": people, "K": stream}, spark), str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination(60)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("x", "y")]
    spark.createDataFrame([(3, 1)], "a long, b long").write.mode("append").parquet(edges)
    assert run() == [("x", "y"), ("z", "x")]
    with pytest.raises(ValueError):
        match_stream(q, config, {"P": people, "K": people}, spark)
