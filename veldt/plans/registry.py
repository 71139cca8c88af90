"""The query registry over the benchmark tables: every graph operator with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GraphConfig
from ..engine import CypherQuery, SqlDialect, SqlQuery
from ..functions.ivf import VectorIndex
from ..functions.vector import VectorSearch
from ..kg.extract import extract_entities
from ..kg.service import KnowledgeGraphService, find_seed_entities, seed_neighbors
from ..operators.adjacency import AdjacencyIndex, AdjacencyIndexBuilder
from ..sources.catalog import DirNamespace
from ..sources.readers import default_table_readers
from ..sources.scratch import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Embedding": ("embeddings", "vec_id")}
RELATIONSHIPS = {
    "IN_REGION": ("nation", "n_nationkey", "n_regionkey"), "LIVES_IN": ("customer", "c_custkey", "c_nationkey"), "BASED_IN": ("supplier", "s_suppkey", "s_nationkey"), "PLACED": ("orders", "o_custkey", "o_orderkey"),
    "CONTAINS": ("lineitem", "l_orderkey", "l_partkey"), "SHIPPED_BY": ("lineitem", "l_orderkey", "l_suppkey"), "SUPPLIES": ("lineitem", "l_suppkey", "l_partkey"), "NEXT": ("next", "src", "dst"), "CYCLE": ("cycle", "src", "dst"),
}


def config(undirected: str = "out", expand: bool = False) -> GraphConfig:
    b = GraphConfig.builder().with_undirected(undirected)
    for label, (table, key) in NODES.items():
        b.with_node_label(label, key, property_fields=("r_name",) if expand and label == "Region" else (), table=table)
    for kind, (table, a, z) in RELATIONSHIPS.items():
        b.with_relationship(kind, a, z, table=table)
    return b.build()


def next_edges(customer: DataFrame) -> DataFrame:
    """A graph among customers: the next and the next but one of the same nation."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    leads = customer.select(F.col("c_custkey").alias("src"), F.lead("c_custkey", 1).over(w).alias("one"), F.lead("c_custkey", 2).over(w).alias("two"))
    leads = leads.select("src", F.explode(F.array(F.struct(F.col("one").alias("dst"), F.lit(1).alias("step")), F.struct(F.col("two").alias("dst"), F.lit(2).alias("step")))).alias("e"))
    return leads.select("src", "e.dst", "e.step").filter("dst is not null")


def cycle_edges(customer: DataFrame) -> DataFrame:
    """NEXT by one step, and an edge from each nation's last customer back to its first."""
    ends = customer.groupBy("c_nationkey").agg(F.max("c_custkey").alias("src"), F.min("c_custkey").alias("dst"))
    return next_edges(customer).filter("step = 1").select("src", "dst").unionByName(ends.select("src", "dst"))


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return {**out, "next": next_edges(out["customer"]), "cycle": cycle_edges(out["customer"])}


class Tables(dict):
    """Tables opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.dir = spark, sf_dir

    def get(self, name, default=None):
        if name not in self:
            if name in ("next", "cycle"):
                self[name] = (next_edges if name == "next" else cycle_edges)(self.get("customer"))
            else:
                self[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self[name]


NEXT = """next_e AS (SELECT c_custkey AS src, unnest([lead(c_custkey, 1) OVER w, lead(c_custkey, 2) OVER w]) AS dst, unnest([1, 2]) AS step FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
 e AS (SELECT src, dst, step FROM next_e WHERE dst IS NOT NULL)"""
CYCLE = f"{NEXT}, c AS (SELECT src, dst FROM e WHERE step = 1 UNION ALL SELECT max(c_custkey), min(c_custkey) FROM customer GROUP BY c_nationkey)"


def walks_sql(head: str, edges: str, low: int, high: int, start: str = "TRUE") -> str:
    return f"WITH RECURSIVE {head}, w AS (SELECT src AS a, dst AS b, 1 AS n FROM {edges} WHERE {start} UNION ALL SELECT w.a, x.dst, w.n + 1 FROM w JOIN {edges} x ON w.b = x.src WHERE w.n < {high}) SELECT a, b, count(*) AS n FROM w WHERE n >= {low} GROUP BY a, b"


_VEC = "list_transform(range(64), lambda i: CAST(((i * 7) % 11) - 5 AS FLOAT))"
QUERY_VECTOR = [float((i * 7) % 11 - 5) for i in range(64)]


def _vector(kind: str, metric: str) -> tuple[str, str]:
    q = f"[{', '.join(str(x) for x in QUERY_VECTOR)}]"
    cypher = f"MATCH (e:Embedding) RETURN e.vec_id AS id, vector_{kind}(e.embedding, {q}, {metric}) AS d"
    dot = f"list_sum(list_transform(list_zip(embedding, {_VEC}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
    l2 = f"sqrt(list_sum(list_transform(list_zip(embedding, {_VEC}), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))))"
    cos = f"({dot}) / ({norm('embedding')} * {norm(_VEC)})"
    value = {("distance", "l2"): l2, ("distance", "cosine"): f"1 - {cos}", ("distance", "dot"): f"-({dot})", ("similarity", "l2"): f"1 / (1 + {l2})", ("similarity", "cosine"): cos, ("similarity", "dot"): dot}[kind, metric]
    return cypher, value


#: name -> (query text, parameters, SQL).  Result columns have aliases on both sides.
CYPHER: dict[str, tuple[str, dict, str]] = {
    "scan_all": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", {}, "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "scan_prop_map": ("MATCH (c:Customer {c_mktsegment: 'BUILDING', c_nationkey: 3}) RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "filter_cmp": ("MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS k, c.c_acctbal AS bal", {}, "SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000"),
    "filter_bool_precedence": ("MATCH (c:Customer) WHERE c.c_nationkey = 1 OR c.c_nationkey = 2 AND NOT c.c_acctbal < 0 RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 1 OR (c_nationkey = 2 AND NOT c_acctbal < 0)"),
    "filter_in": ("MATCH (p:Part) WHERE p.p_size IN [1, 5, 9] RETURN p.p_partkey AS k", {}, "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9)"),
    "filter_like": ("MATCH (c:Customer) WHERE c.c_name LIKE '%00_1' RETURN c.c_name AS name", {}, "SELECT c_name AS name FROM customer WHERE c_name LIKE '%00_1'"),
    "filter_ilike": ("MATCH (c:Customer) WHERE c.c_mktsegment ILIKE 'b%ing' RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment ILIKE 'b%ing'"),
    "filter_contains": ("MATCH (n:Nation) WHERE n.n_name CONTAINS 'A' RETURN n.n_name AS name", {}, "SELECT n_name AS name FROM nation WHERE contains(n_name, 'A')"),
    "filter_starts": ("MATCH (n:Nation) WHERE n.n_name STARTS WITH 'N' RETURN n.n_name AS name", {}, "SELECT n_name AS name FROM nation WHERE starts_with(n_name, 'N')"),
    "filter_ends": ("MATCH (n:Nation) WHERE n.n_name ENDS WITH '1' RETURN n.n_name AS name", {}, "SELECT n_name AS name FROM nation WHERE ends_with(n_name, '1')"),
    "filter_is_null": ("MATCH (o:Orders) WHERE o.o_orderstatus IS NOT NULL AND NOT o.o_totalprice IS NULL RETURN o.o_orderkey AS k", {}, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL"),
    "filter_param": ("MATCH (c:Customer) WHERE c.c_acctbal > $Low AND c.c_nationkey IN $nations RETURN c.c_custkey AS k", {"low": 2500.5, "nations": [1, 2, 3]}, "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 2500.5 AND c_nationkey IN (1, 2, 3)"),
    "filter_exists": ("MATCH (c:Customer) WHERE exists(c.c_acctbal) RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL"),
    "fn_lower_upper": ("MATCH (n:Nation) RETURN toLower(n.n_name) AS lo, toUpper(n.n_name) AS hi", {}, "SELECT lower(n_name) AS lo, upper(n_name) AS hi FROM nation"),
    "arith": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size * 2 + 1 AS a, p.p_size / 2 AS h, p.p_size % 3 AS m, 7 - p.p_size AS s", {}, "SELECT p_partkey AS k, p_size * 2 + 1 AS a, CAST(p_size // 2 AS BIGINT) AS h, p_size % 3 AS m, 7 - p_size AS s FROM part"),
    "expand_out": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN c.c_custkey AS k, n.n_name AS nation", {}, "SELECT c_custkey AS k, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "expand_in": ("MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) RETURN n.n_name AS nation, s.s_suppkey AS s", {}, "SELECT n_name AS nation, s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "expand_undirected_default": ("MATCH (a:Customer)-[:NEXT]-(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", {}, f"WITH {NEXT} SELECT src AS a, dst AS b FROM e"),
    "expand_rel_props": ("MATCH (o:Orders)-[l:CONTAINS {l_linenumber: 1}]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q", {}, "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_linenumber = 1"),
    "expand_target_props": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation {n_regionkey: 2}) RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "expand_multi_type": ("MATCH (o:Orders)-[r:CONTAINS|SHIPPED_BY]->(p:Part) RETURN count(*) AS n, sum(r.l_quantity) AS q", {}, "SELECT count(*) AS n, sum(l_quantity) AS q FROM (SELECT l_partkey AS k, l_quantity FROM lineitem UNION ALL SELECT l_suppkey, l_quantity FROM lineitem) JOIN part ON k = p_partkey"),
    "two_hop": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS k, r.r_name AS region", {}, "SELECT c_custkey AS k, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "three_hop": ("MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Orders)-[l:CONTAINS]->(p:Part) WHERE p.p_size > 25 RETURN n.n_name AS nation, count(*) AS n, count(DISTINCT o.o_orderkey) AS orders", {}, "SELECT n_name AS nation, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY n_name"),
    "shared_var": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_nationkey AS n, count(*) AS pairs", {}, "SELECT n_nationkey AS n, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"),
    "triangle_reuse": ("MATCH (a:Customer)-[:NEXT]->(b:Customer)-[:NEXT]->(c:Customer), (a)-[:NEXT]->(c) RETURN a.c_custkey AS a, b.c_custkey AS b, c.c_custkey AS c", {}, f"WITH {NEXT} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst"),
    "cross_disconnected": ("MATCH (r:Region), (n:Nation) WHERE r.r_regionkey < n.n_regionkey RETURN r.r_name AS r, n.n_name AS n", {}, "SELECT r_name AS r, n_name AS n FROM region, nation WHERE r_regionkey < n_regionkey"),
    "multi_match": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) MATCH (c:Customer)-[:LIVES_IN]->(n) WHERE c.c_acctbal > 9000 RETURN r.r_name AS region, c.c_custkey AS k", {}, "SELECT r_name AS region, c_custkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS k, count(o) AS n", {}, "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "varlen_1_3": ("MATCH (a:Customer)-[:NEXT*1..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", {}, walks_sql(NEXT, "e", 1, 3)),
    "varlen_exact_2": ("MATCH (a:Customer)-[:NEXT*2]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", {}, walks_sql(NEXT, "e", 2, 2)),
    "varlen_distinct": ("MATCH (a:Customer)-[:NEXT*1..2]->(b:Customer) RETURN DISTINCT a.c_custkey AS a, b.c_custkey AS b", {}, f"SELECT DISTINCT a, b FROM ({walks_sql(NEXT, 'e', 1, 2)})"),
    "varlen_rel_props": ("MATCH (a:Customer)-[:NEXT*1..3 {step: 2}]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", {}, walks_sql(f"{NEXT}, f AS (SELECT * FROM e WHERE step = 2)", "f", 1, 3)),
    "varlen_cycle": ("MATCH (a:Customer)-[:CYCLE*4..6]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", {}, walks_sql(CYCLE, "c", 4, 6)),
    "varlen_keeps_vars": ("MATCH (n:Nation)<-[:LIVES_IN]-(a:Customer)-[:NEXT*1..2]->(b:Customer) RETURN n.n_name AS nation, count(*) AS n", {}, f"SELECT n_name AS nation, CAST(sum(n) AS BIGINT) AS n FROM ({walks_sql(NEXT, 'e', 1, 2)}) JOIN customer ON c_custkey = a JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"),
    "varlen_one": ("MATCH (a:Customer)-[:NEXT*1..1]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", {}, f"WITH {NEXT} SELECT src AS a, dst AS b FROM e"),
    "varlen_filtered_start": ("MATCH (a:Customer)-[:NEXT*1..6]->(b:Customer) WHERE a.c_custkey = 7 AND b.c_acctbal > 0 RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", {}, f"SELECT a, b, n FROM ({walks_sql(NEXT, 'e', 1, 6, 'src = 7')}) JOIN customer ON c_custkey = b WHERE c_acctbal > 0"),
    "varlen_target_props": ("MATCH (a:Customer)-[:NEXT*1..3]->(b:Customer {c_mktsegment: 'BUILDING'}) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", {}, f"SELECT a, b, n FROM ({walks_sql(NEXT, 'e', 1, 3)}) JOIN customer ON c_custkey = b WHERE c_mktsegment = 'BUILDING'"),
    "varlen_bound_target": ("MATCH (a:Customer)-[:NEXT]->(b:Customer), (a)-[:NEXT*2..3]->(b) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", {}, f"SELECT a, b, CAST(sum(w.n) AS BIGINT) AS n FROM ({walks_sql(NEXT, 'e', 2, 3)}) w JOIN (WITH {NEXT} SELECT src, dst FROM e) x ON x.src = a AND x.dst = b GROUP BY a, b"),
    "reuse_target_props": ("MATCH (a:Customer)-[:NEXT]->(b:Customer)-[:NEXT]->(c:Customer), (a)-[:NEXT]->(c {c_mktsegment: 'BUILDING'}) RETURN a.c_custkey AS a, b.c_custkey AS b, c.c_custkey AS c", {}, f"WITH {NEXT} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst JOIN customer ON c_custkey = y.dst WHERE c_mktsegment = 'BUILDING'"),
    "bound_node_again": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) MATCH (c {c_nationkey: 3})-[:LIVES_IN]->(n:Nation) RETURN n.n_name AS nation, count(*) AS n", {}, "SELECT n_name AS nation, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = 3 GROUP BY n_name"),
    "agg_count_expr": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_nationkey AS k, count(o.o_totalprice) AS n, count(*) AS m", {}, "SELECT c_nationkey AS k, count(o_totalprice) AS n, count(*) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey"),
    "string_right_side": ("MATCH (a:Nation)-[:IN_REGION]->(r:Region) WHERE a.n_name CONTAINS toUpper('a') AND NOT a.n_name ENDS WITH r.r_name RETURN a.n_name AS name", {}, "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, 'A') AND NOT ends_with(n_name, r_name)"),
    "agg_count_star": ("MATCH (o:Orders) RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM orders"),
    "agg_count_var": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN count(o) AS n, count(c) AS m", {}, "SELECT count(*) AS n, count(*) AS m FROM customer JOIN orders ON o_custkey = c_custkey"),
    "agg_count_distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN count(DISTINCT c.c_custkey) AS n", {}, "SELECT count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey"),
    "agg_sum_avg_min_max": ("MATCH (p:Part) RETURN sum(p.p_size) AS s, min(p.p_size) AS lo, max(p.p_size) AS hi, avg(p.p_size) AS a", {}, "SELECT CAST(sum(p_size) AS BIGINT) AS s, min(p_size) AS lo, max(p_size) AS hi, avg(p_size) AS a FROM part"),
    "agg_group": ("MATCH (p:Part) RETURN p.p_brand AS brand, count(*) AS n, max(p.p_size) AS hi", {}, "SELECT p_brand AS brand, count(*) AS n, max(p_size) AS hi FROM part GROUP BY p_brand"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c.c_custkey AS k, count(*) AS n WHERE n > 12 RETURN k, n", {}, "SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey HAVING count(*) > 12"),
    "with_order_limit_where": ("MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal AS bal ORDER BY bal DESC, k LIMIT 50 WHERE k % 2 = 0 RETURN k, bal", {}, "SELECT k, bal FROM (SELECT c_custkey AS k, c_acctbal AS bal FROM customer ORDER BY bal DESC NULLS FIRST, k LIMIT 50) WHERE k % 2 = 0"),
    "with_then_match": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(*) AS n MATCH (c)-[:LIVES_IN]->(x:Nation) RETURN x.n_name AS nation, sum(n) AS orders", {}, "SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"),
    "with_chain": ("MATCH (o:Orders) WITH o.o_custkey AS c, count(*) AS n WITH n, count(*) AS m ORDER BY n SKIP 1 RETURN n, m", {}, "SELECT n, m FROM (SELECT n, count(*) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n ORDER BY n OFFSET 1)"),
    "unwind_list": ("UNWIND [3, 1, 2] AS x RETURN x, x * 10 AS y", {}, "SELECT CAST(x AS INTEGER) AS x, CAST(x * 10 AS INTEGER) AS y FROM (SELECT unnest([3, 1, 2]) AS x)"),
    "unwind_match": ("UNWIND [1, 2, 2] AS x MATCH (n:Nation) WHERE n.n_regionkey = x RETURN x, n.n_name AS nation", {}, "SELECT CAST(x AS INTEGER) AS x, n_name AS nation FROM (SELECT unnest([1, 2, 2]) AS x) JOIN nation ON n_regionkey = x"),
    "distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s, c.c_nationkey AS n", {}, "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n FROM customer"),
    "order_nulls_first": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WITH c.c_custkey AS k, max(o.o_totalprice) AS top ORDER BY top DESC, k LIMIT 40 RETURN k, top", {}, "SELECT c_custkey AS k, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY top DESC NULLS FIRST, k LIMIT 40"),
    "order_hidden_key": ("MATCH (c:Customer) RETURN c.c_name AS name ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 15", {}, "SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 15"),
    "skip_limit": ("MATCH (o:Orders) RETURN o.o_orderkey AS k ORDER BY k SKIP 20 LIMIT 10", {}, "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 10 OFFSET 20"),
}

SQL: dict[str, tuple[str, str]] = {
    "sql_join_group": ("SELECT n_name, count(*) AS n, sum(o_totalprice) > 0 AS some FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",) * 2,
    "sql_window": ("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders",) * 2,
    "sql_setops": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION SELECT r_regionkey FROM region EXCEPT SELECT 3",) * 2,
    "sql_grouping_sets": ("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())",) * 2,
    "sql_semi_anti": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 2000)",) * 2,
    "sql_cte": ("WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), u AS (SELECT n, count(*) AS m FROM t GROUP BY n) SELECT n, m FROM u WHERE m > 1",) * 2,
    "sql_full_outer": ("SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey",) * 2,
    "sql_right_join": ("SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_acctbal > 9000) AS c RIGHT JOIN nation ON c_nationkey = n_nationkey",) * 2,
    "sql_scalar_subquery": ("SELECT p_partkey, p_size - (SELECT min(p_size) FROM part) AS above FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",) * 2,
    "sql_rollup": ("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)",) * 2,
    "sql_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",) * 2,
    "sql_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, coalesce(nullif(p_brand, 'Brand#11'), 'own') AS brand FROM part",) * 2,
    "sql_strings": ("SELECT n_nationkey, upper(n_name) AS u, substring(n_name, 2, 3) AS s, replace(n_name, 'A', 'x') AS r, CAST(length(n_name) AS BIGINT) AS n, concat(n_name, '-', n_regionkey) AS c, lpad(n_name, 12, '*') AS l, reverse(n_name) AS b FROM nation",) * 2,
    "sql_math": ("SELECT p_partkey, round(sqrt(p_size), 6) AS r, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, sign(p_size - 25.0) > 0 AS s FROM part",) * 2,
    "sql_dates": ("SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders",) * 2,
    "sql_frames": ("SELECT o_orderkey, count(*) OVER w AS n, min(o_orderkey) OVER w AS lo, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",) * 2,
    "sql_regexp": ("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_extract(c_name, '([0-9]+)$', 1) AS d FROM customer",) * 2,
    "sql_nested": ("SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS one, exists(embedding, x -> x > 0.3) AS big FROM embeddings", "SELECT vec_id, len(embedding) AS n, embedding[1] AS one, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS big FROM embeddings"),
    "sql_values_in": ("SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT s_nationkey, 'BUILDING' FROM supplier) ORDER BY c_custkey LIMIT 20 OFFSET 5",) * 2,
}


#: Graph queries whose SQL text is run too.
TO_SQL = ("filter_cmp", "two_hop", "three_hop", "optional_match", "with_having", "agg_group", "order_hidden_key")


def _graph(text: str, params: dict, **options) -> Callable:
    return lambda spark, sf_dir: CypherQuery(text).with_config(config(**options)).with_parameters(params).compile(Tables(spark, sf_dir).get, spark)


def _sql(text: str) -> Callable:
    def run(spark, sf_dir):
        words = set(text.replace("(", " ").replace(")", " ").split())
        return SqlQuery(text).execute({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words}, spark)

    return run


def _rounded(fn: Callable, column: str = "d", digits: int = 3) -> Callable:
    return lambda spark, sf_dir: (lambda df: df.withColumn(column, F.round(F.col(column).cast("double"), digits)))(fn(spark, sf_dir))


def _topk(spark, sf_dir):
    near = VectorSearch("embedding").query_vector(QUERY_VECTOR).metric("l2").top_k(10).tie_break("vec_id")
    return near.search(Tables(spark, sf_dir).get("embeddings")).select("vec_id")


def _ivf_topk(spark, sf_dir):
    """All cells of an index, so the same rows as without one."""
    path = scratch_path(spark, "ivf")
    index = VectorIndex.build(Tables(spark, sf_dir).get("embeddings"), "embedding", path, cells=8)
    near = VectorSearch("embedding").query_vector(QUERY_VECTOR).metric("l2").top_k(10).tie_break("vec_id")
    return index.search(near, probes=8).select("vec_id")


def _rerank(spark, sf_dir):
    q = CypherQuery("MATCH (e:Embedding) WHERE e.label < 5 RETURN e.vec_id AS id, e.embedding AS v").with_config(config())
    near = VectorSearch("v").query_vector(QUERY_VECTOR).metric("dot").top_k(7).tie_break("id").include_distance(False)
    return q.execute_with_vector_rerank({"embeddings": Tables(spark, sf_dir).get("embeddings")}, near, spark=spark).select("id")


def _index(spark, sf_dir) -> AdjacencyIndex:
    return AdjacencyIndex(Tables(spark, sf_dir).get("next").select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id")))


def _first(spark, sf_dir) -> int:
    return Tables(spark, sf_dir).get("customer").agg(F.min("c_custkey")).first()[0]


def _bfs(spark, sf_dir):
    return _index(spark, sf_dir).bfs(_first(spark, sf_dir), 4)


def _shortest(spark, sf_dir):
    index, start = _index(spark, sf_dir), _first(spark, sf_dir)
    far = index.bfs(start, 5).filter("level = 5").agg(F.min("vertex_id")).first()[0]
    path = index.shortest_path(start, far) if far is not None else None
    return spark.createDataFrame([(start, far, len(path) - 1 if path else None)], "source long, target long, hops int")


def _upsert(spark, sf_dir):
    orders = Tables(spark, sf_dir).get("orders")
    old = orders.select(F.col("o_custkey").cast("string").alias("entity_id"), F.lit("Customer").alias("name"), F.lit("OLD").alias("entity_type"))
    new = orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("entity_id"), F.lit("CUSTOMER").alias("name"), F.lit("NEW").alias("entity_type"))
    return KnowledgeGraphService.merged_entities(old, new).select("entity_id", "entity_type", "name_lower")


def _neighbors(spark, sf_dir):
    edges = Tables(spark, sf_dir).get("next").select(F.col("src").cast("string").alias("source_entity_id"), F.col("dst").cast("string").alias("target_entity_id"), F.lit("NEXT").alias("relationship_type"))
    seeds = Tables(spark, sf_dir).get("customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return seed_neighbors(edges, seeds).select("seed_id", "neighbor_id", "direction")


def _namespace(spark, sf_dir):
    text = "MATCH (c:customer) WHERE c.c_acctbal > 0 RETURN count(*) AS n"
    c = GraphConfig.builder().with_node_label("customer", "c_custkey").build()
    return CypherQuery(text).with_config(c).execute_with_namespace(DirNamespace(sf_dir), spark)


def _order_by_vector(spark, sf_dir):
    q = f"MATCH (e:Embedding) RETURN e.vec_id AS id ORDER BY vector_distance(e.embedding, [{', '.join(map(str, QUERY_VECTOR))}], l2), e.vec_id LIMIT 10"
    return _graph(q, {})(spark, sf_dir)


def _path(spark, sf_dir):
    """The vertices of a shortest path, by place."""
    index, start = _index(spark, sf_dir), _first(spark, sf_dir)
    far = index.bfs(start, 5).filter("level = 5").agg(F.min("vertex_id")).first()[0]
    return spark.createDataFrame(list(enumerate(index.shortest_path(start, far) or [] if far is not None else [])), "place int, vertex_id long")


def _csr_counts(spark, sf_dir):
    own, back = AdjacencyIndexBuilder(spark).add_edges(Tables(spark, sf_dir).get("next"), "src", "dst").build_bidirectional()
    first = _first(spark, sf_dir)
    return spark.createDataFrame([(own.num_vertices(), own.num_edges(), own.degree(first), back.degree(first))], "vertices long, edges long, outgoing long, incoming long")


def _csr_neighbors(spark, sf_dir):
    return _index(spark, sf_dir).neighbors(_first(spark, sf_dir))


def _upsert_relationships(spark, sf_dir):
    items = Tables(spark, sf_dir).get("lineitem")
    row = lambda df, kind, text: df.select(F.col("l_suppkey").cast("string").alias("source_entity_id"), F.col("l_partkey").cast("string").alias("target_entity_id"), F.lit(kind).alias("relationship_type"), F.lit(text).alias("description"), F.lit(text == "new").alias("fresh"))
    old, new = row(items, None, ""), row(items.filter("l_linenumber = 1"), "RELATED_TO", "").withColumn("fresh", F.lit(True))
    return KnowledgeGraphService.merged_relationships(old, new).select("source_entity_id", "target_entity_id", "relationship_type", "fresh")


def _seeds(spark, sf_dir):
    vectors = Tables(spark, sf_dir).get("embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), "embedding")
    return find_seed_entities(vectors, QUERY_VECTOR, 6).select("entity_id", F.round("score", 3).alias("score"))


def _session_tables(spark, sf_dir):
    """Tables that the session has under the names of the graph, here as views for a moment."""
    names = {"veldt_shop": "customer", "veldt_sale": "orders"}
    c = GraphConfig.builder().with_node_label("Shop", "c_custkey", table="veldt_shop").with_node_label("Sale", "o_orderkey", table="veldt_sale").with_relationship("SOLD", "o_custkey", "o_orderkey", table="veldt_sale").build()
    for view, table in names.items():
        Tables(spark, sf_dir).get(table).createOrReplaceTempView(view)
    try:
        return CypherQuery("MATCH (s:Shop)-[:SOLD]->(t:Sale) WHERE t.o_totalprice > 100000 RETURN s.c_nationkey AS k, count(*) AS n").with_config(c).execute_with_context(spark)
    finally:
        for view in names:
            spark.catalog.dropTempView(view)


def _reader(fmt: str):
    """A table written in another format and read by that format's reader."""

    def run(spark, sf_dir):
        path = scratch_path(spark, f"nation-{fmt}")
        Tables(spark, sf_dir).get("nation").write.format(fmt).options(header="true").save(path)
        nation = default_table_readers()[fmt].read(spark, path)
        text = "MATCH (n:Nation) WHERE n.n_regionkey > 1 RETURN n.n_nationkey AS k, n.n_name AS name"
        return CypherQuery(text).with_config(config()).execute({"nation": nation}, spark).select(F.col("k").cast("int").alias("k"), "name")

    return run


def _arrow(spark, sf_dir):
    region = Tables(spark, sf_dir).get("region").toArrow()  # a handful of rows
    return CypherQuery("MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name").with_config(config()).execute({"region": region}, spark)


def _through_sql(name: str):
    """A graph query's SQL text, run as SQL."""

    def run(spark, sf_dir):
        text, params, _ = CYPHER[name]
        tables = {t: Tables(spark, sf_dir).get(t) for t in ("customer", "nation", "region", "orders", "lineitem", "part")}
        q = CypherQuery(text).with_config(config()).with_parameters(params)
        return SqlQuery(q.to_sql(tables, SqlDialect.Spark, spark)).execute(tables, spark)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _graph(t, p) for k, (t, p, _) in CYPHER.items()}
    out["expand_undirected_both"] = _graph("MATCH (a:Customer)-[:NEXT]-(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", {}, undirected="both")
    out["return_node_expand"] = lambda s, d: _graph("MATCH (r:Region) RETURN r", {}, expand=True)(s, d).toDF("k", "name")
    out["agg_collect_sorted"] = lambda s, d: _graph("MATCH (n:Nation) RETURN n.n_regionkey AS r, collect(n.n_nationkey) AS ks", {})(s, d).withColumn("ks", F.array_join(F.sort_array(F.col("ks")), ","))
    for kind in ("distance", "similarity"):
        for metric in ("l2", "cosine", "dot"):
            out[f"vec_{'sim_' if kind == 'similarity' else ''}{metric}"] = _rounded(_graph(_vector(kind, metric)[0], {}))
    out |= {k: _sql(t) for k, (t, _) in SQL.items()}
    out |= {
        "vec_topk": _topk, "vec_index_topk": _ivf_topk, "vec_rerank_after_match": _rerank,
        "csr_offsets": lambda s, d: _index(s, d).offsets(), "csr_bfs_levels": _bfs, "csr_shortest_len": _shortest,
        "kg_upsert_dedupe": _upsert, "kg_seed_neighbors": _neighbors, "namespace_parquet": _namespace,
        "kg_extract_terms": lambda s, d: extract_entities(Tables(s, d).get("documents"), "doc_id", "text").groupBy("name").count(),
        "order_by_vector": _order_by_vector, "csr_shortest_path": _path, "csr_counts": _csr_counts, "csr_neighbors": _csr_neighbors,
        "kg_upsert_relationships": _upsert_relationships, "kg_seed_entities": _seeds, "session_tables": _session_tables, "in_memory_arrow": _arrow,
        "return_relationship": lambda s, d: _graph("MATCH (a:Customer)-[r:NEXT]->(b:Customer) RETURN r", {})(s, d).toDF("src", "dst", "step"),
        **{f"reader_{fmt}": _reader(fmt) for fmt in ("csv", "json", "orc")},
        **{f"to_sql_{name}": _through_sql(name) for name in TO_SQL},
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {k: q for k, (_, _, q) in CYPHER.items()}
    out["expand_undirected_both"] = f"WITH {NEXT} SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst"
    out["return_node_expand"] = "SELECT r_regionkey AS k, r_name AS name FROM region"
    out["agg_collect_sorted"] = "SELECT n_regionkey AS r, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS ks FROM nation GROUP BY n_regionkey"
    for kind in ("distance", "similarity"):
        for metric in ("l2", "cosine", "dot"):
            out[f"vec_{'sim_' if kind == 'similarity' else ''}{metric}"] = f"SELECT vec_id AS id, round(CAST(CAST({_vector(kind, metric)[1]} AS FLOAT) AS DOUBLE), 3) AS d FROM embeddings"
    out |= {k: q for k, (_, q) in SQL.items()}
    out["vec_topk"] = f"SELECT vec_id FROM (SELECT vec_id, CAST({_vector('distance', 'l2')[1]} AS FLOAT) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10)"
    out["vec_rerank_after_match"] = f"SELECT vec_id AS id FROM (SELECT vec_id, CAST({_vector('distance', 'dot')[1]} AS FLOAT) AS d FROM embeddings WHERE label < 5 ORDER BY d, vec_id LIMIT 7)"
    out["csr_offsets"] = f"WITH {NEXT}, v AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM e))) AS vertex_id), d AS (SELECT vertex_id, count(src) AS degree FROM v LEFT JOIN e ON src = vertex_id GROUP BY vertex_id) SELECT vertex_id, CAST(coalesce(sum(degree) OVER (ORDER BY vertex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, degree FROM d"
    walk = f"WITH RECURSIVE {NEXT}, w AS (SELECT min(c_custkey) AS v, 0 AS n FROM customer UNION SELECT dst, n + 1 FROM w JOIN e ON src = v WHERE n < {{}}), l AS (SELECT v, min(n) AS n FROM w GROUP BY v)"
    out["csr_bfs_levels"] = walk.format(4) + " SELECT v AS vertex_id, CAST(n AS INTEGER) AS level FROM l"
    out["csr_shortest_len"] = walk.format(5) + " SELECT (SELECT min(c_custkey) FROM customer) AS source, min(v) AS target, CASE WHEN min(v) IS NOT NULL THEN CAST(5 AS INTEGER) END AS hops FROM l WHERE n = 5"
    out["kg_upsert_dedupe"] = "SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CASE WHEN max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) = 1 THEN 'NEW' ELSE 'OLD' END AS entity_type, 'customer' AS name_lower FROM orders GROUP BY o_custkey"
    out["kg_seed_neighbors"] = f"WITH {NEXT} SELECT CAST(src AS VARCHAR) AS seed_id, CAST(dst AS VARCHAR) AS neighbor_id, 'outgoing' AS direction FROM e WHERE src % 50 = 0 UNION ALL SELECT CAST(dst AS VARCHAR), CAST(src AS VARCHAR), 'incoming' FROM e WHERE dst % 50 = 0"
    out["vec_index_topk"] = out["vec_topk"]
    out["order_by_vector"] = out["vec_topk"].replace("SELECT vec_id FROM", "SELECT vec_id AS id FROM", 1)
    out["csr_shortest_path"] = walk.format(5) + ", p AS (SELECT min(v) AS v, 5 AS n FROM l WHERE n = 5 UNION ALL SELECT (SELECT min(src) FROM e JOIN l ON l.v = e.src AND l.n = p.n - 1 WHERE e.dst = p.v), n - 1 FROM p WHERE n > 0 AND v IS NOT NULL) SELECT CAST(n AS INTEGER) AS place, v AS vertex_id FROM p WHERE v IS NOT NULL"
    out["csr_counts"] = f"WITH {NEXT}, s AS (SELECT min(c_custkey) AS s FROM customer) SELECT max(greatest(src, dst)) + 1 AS vertices, count(*) AS edges, count(*) FILTER (src = s) AS outgoing, count(*) FILTER (dst = s) AS incoming FROM e, s"
    out["csr_neighbors"] = f"WITH {NEXT} SELECT dst AS dst_id FROM e WHERE src = (SELECT min(c_custkey) FROM customer) ORDER BY dst"
    out["kg_upsert_relationships"] = "SELECT CAST(l_suppkey AS VARCHAR) AS source_entity_id, CAST(l_partkey AS VARCHAR) AS target_entity_id, 'RELATED_TO' AS relationship_type, max(l_linenumber = 1) AS fresh FROM lineitem GROUP BY l_suppkey, l_partkey"
    out["kg_seed_entities"] = f"SELECT CAST(vec_id AS VARCHAR) AS entity_id, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 3) AS score FROM (SELECT vec_id, {_vector('similarity', 'cosine')[1]} AS s FROM embeddings) ORDER BY CAST(s AS FLOAT) DESC, CAST(vec_id AS VARCHAR) LIMIT 6"
    out["session_tables"] = "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_nationkey"
    out["in_memory_arrow"] = "SELECT r_regionkey AS k, r_name AS name FROM region"
    out["return_relationship"] = f"WITH {NEXT} SELECT src, dst, step FROM e"
    out |= {f"reader_{fmt}": "SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name FROM nation WHERE n_regionkey > 1" for fmt in ("csv", "json", "orc")}
    out |= {f"to_sql_{name}": CYPHER[name][2] for name in TO_SQL}
    out["kg_extract_terms"] = r"SELECT name, count(*) AS count FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{Nd}_]+'), lambda t: regexp_full_match(t, '[A-Z][a-zA-Z0-9_]+') AND length(t) > 2 AND t <> upper(t)))) AS name FROM documents) GROUP BY name"
    out["namespace_parquet"] = "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0"
    return out


FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[l:CONTAINS]->(p:Part) WHERE c.c_acctbal > 0 AND p.p_size > 10 RETURN p.p_brand AS brand, count(*) AS n, sum(l.l_extendedprice) AS revenue ORDER BY revenue DESC"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(FLAGSHIP, {})(spark, sf_dir)
