import pytest

from veldt import GraphConfig
from veldt.errors import InvalidPatternError, ParseError, PlanError, UnsupportedFeatureError
from veldt.plans import ast as A
from veldt.plans import logical, semantic
from veldt.plans.parser import parse

CONFIG = GraphConfig.builder().with_node_label("Person", "id", property_fields=["name", "age"]).with_node_label("City", "id").with_relationship("KNOWS", "src", "dst").with_relationship("LIVES", "p", "c").build()


def clause(text, i=0):
    return parse(text).clauses[i]


def where(text):
    return clause(f"MATCH (n:Person) WHERE {text} RETURN n.name", 1).predicate


def test_patterns():
    (path,) = clause("MATCH (a:Person {name: 'x', age: 3})<-[r:KNOWS|LIVES*2..4 {w: $p}]-(b)-[:A:B]-(:City) RETURN a.name").paths
    assert [n.var for n in path.nodes] == ["a", "b", None]
    assert path.nodes[0].props == (("name", A.Literal("x")), ("age", A.Literal(3)))
    r, s = path.rels
    assert (r.direction, r.types, r.hops, r.props) == ("in", ("KNOWS", "LIVES"), (2, 4), (("w", A.Param("p")),))
    assert (s.direction, s.types) == ("both", ("A", "B"))


@pytest.mark.parametrize("text,hops", [("*", (None, None)), ("*3", (3, 3)), ("*..4", (None, 4)), ("*2..", (2, None)), ("*1..2", (1, 2))])
def test_hops(text, hops):
    assert clause(f"MATCH (a)-[:K{text}]->(b) RETURN a.x").paths[0].rels[0].hops == hops


def test_precedence():
    assert where("n.a = 1 OR n.b = 2 AND NOT n.c = 3") == A.Binary("or", A.Binary("=", A.Prop("n", "a"), A.Literal(1)), A.Binary("and", A.Binary("=", A.Prop("n", "b"), A.Literal(2)), A.Not(A.Binary("=", A.Prop("n", "c"), A.Literal(3)))))
    assert where("n.a + 2 * 3 > -1") == A.Binary(">", A.Binary("+", A.Prop("n", "a"), A.Binary("*", A.Literal(2), A.Literal(3))), A.Literal(-1))


def test_operators():
    assert where("n.a IN [1, 'x', null]") == A.InList(A.Prop("n", "a"), (A.Literal(1), A.Literal("x"), A.Literal(None)))
    assert where("n.a IS NOT NULL") == A.IsNull(A.Prop("n", "a"), True) and where("n.a is null") == A.IsNull(A.Prop("n", "a"))
    for text, op in (("LIKE", "like"), ("ILIKE", "ilike"), ("CONTAINS", "contains"), ("STARTS WITH", "starts"), ("ends with", "ends"), ("<>", "<>"), ("!=", "<>"), ("<=", "<=")):
        assert where(f"n.a {text} 'q'") == A.Binary(op, A.Prop("n", "a"), A.Literal("q"))


def test_literals():
    for text, value in (("''", ""), ("'it\\'s'", "it's"), ('"d"', "d"), ("1.5e-3", 0.0015), ("TRUE", True), ("null", None), ("-7", -7), ("'a\\nb'", "a\nb")):
        assert where(f"n.a = {text}").right == A.Literal(value)
    assert where("trueness.x = nullable.y").left == A.Prop("trueness", "x")
    with pytest.raises(ParseError):
        where("n.a = 99999999999999999999")


def test_projection():
    p = clause("MATCH (n) RETURN DISTINCT n.a AS x, count(*), count(DISTINCT n.b) ORDER BY x DESC, n.c LIMIT 3 SKIP 2", 1)
    assert p.distinct and p.limit == 3 and p.skip == 2 and p.items[0].alias == "x" and p.items[1].expr.star and p.items[2].expr.distinct
    assert [k.descending for k in p.order] == [True, False]
    q = parse("MATCH (n) WITH n, n.a AS a ORDER BY a LIMIT 2 WHERE a > 1 MATCH (n)-[:K]->(m) UNWIND [1, 2] AS i WITH m, i RETURN m.x, i")
    assert [type(c).__name__ for c in q.clauses] == ["Match", "Projection", "Where", "Match", "Unwind", "Projection", "Projection"]
    v = clause("MATCH (n) RETURN vector_distance(n.e, [0.1, -2, 1e-3], COSINE) AS d", 1).items[0].expr
    assert v.metric == "cosine" and [x.value for x in v.right.items] == [0.1, -2, 0.001]
    assert parse("// a comment\nMATCH (`odd name`:`A B`) /* more */ RETURN `odd name`.x").clauses[0].paths[0].nodes[0].labels == ("A B",)


@pytest.mark.parametrize("text", ["", "RETURN 1", "MATCH (n)", "MATCH (n RETURN n", "MATCH (n)-->(m) RETURN n", "MATCH (n) RETURN", "MATCH (n) RETURN n.a LIMIT -1", "MATCH (n) WHERE n.a IN [] RETURN n", "MATCH (n) RETURN n.a extra", "MATCH (a)<-[:K]->(b) RETURN a", "MATCH (n) RETURN n.a LIMIT x", "WHERE 1 = 1 RETURN 1", "MATCH (n) RETURN vector_distance(n.e, [1.0], far)", "MATCH (n) RETURN n.a ?"])
def test_errors(text):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert isinstance(e.value, ValueError) and "position" in str(e.value)


@pytest.mark.parametrize(
    "text,words",
    [
        ("MATCH (n:Person) RETURN m.name", "Undefined variable: 'm'"),
        ("MATCH (n:Person) RETURN foo(n.name)", "Unsupported function 'foo'"),
        ("MATCH (n:Person) RETURN sum(DISTINCT n.age)", "DISTINCT is only supported"),
        ("MATCH (n:Person) RETURN count(DISTINCT *)", "COUNT(DISTINCT *)"),
        ("MATCH (n:Person) RETURN sum(n)", "needs a property"),
        ("MATCH (n:Person) RETURN avg(n.age, 1)", "exactly 1 argument"),
        ("MATCH (n:Person) RETURN toLower()", "exactly 1 argument"),
        ("MATCH (n:Person {nope: 1}) RETURN n.name", "Property 'nope'"),
        ("MATCH (n:Person)-[:KNOWS*3..2]->(m:Person) RETURN n.name", "Invalid path length"),
        ("MATCH (n:Person)-[n:KNOWS]->(m:Person) RETURN m.name", "redefined"),
        ("MATCH (n:Person) WITH n.name AS x RETURN n.age", "Undefined variable: 'n'"),
        ("MATCH (n:Person) WITH n.age + 1 RETURN 1", "needs an alias"),
        ("MATCH (n:Person) RETURN n.name AS a, n.age AS A", "Duplicate alias"),
        ("MATCH (n:Person) WHERE count(*) > 1 RETURN n.name", "not allowed in WHERE"),
        ("MATCH (n:Person) RETURN vector_distance([1.0], [2.0], l2)", "needs a property reference"),
        ("MATCH (n:Person) WHERE n.age > $low RETURN n.name", "Missing parameter: $low"),
        ("MATCH (n:Person) RETURN sum(count(n.age))", "inside another aggregate"),
    ],
)
def test_semantics(text, words):
    with pytest.raises(PlanError) as e:
        semantic.analyze(parse(text), CONFIG)
    assert words in str(e.value)


def test_warnings_and_parameters():
    a = semantic.analyze(parse("MATCH (n:Ghost)-[:HAUNTS]->(m:City) RETURN n.x"), CONFIG)
    assert len(a.warnings) == 2 and a.variables == {"n": "node", "m": "node"}
    q = semantic.bind(parse("MATCH (n:Person {name: $N}) WHERE n.age IN $ages RETURN n.name"), {"n": "x", "ages": [1, 2]})
    assert q.clauses[0].paths[0].nodes[0].props[0][1] == A.Literal("x") and q.clauses[1].predicate.options == (A.Literal(1), A.Literal(2))
    with pytest.raises(PlanError):
        semantic.bind(parse("MATCH (n) WHERE n.a = $p RETURN n.a"), {})
    with pytest.raises(ValueError):
        semantic.bind(parse("MATCH (n) WHERE n.a = $p RETURN n.a"), {"p": {"a": 1}})


def plan(text):
    return logical.build(parse(text), CONFIG)


def test_plans():
    p = plan("MATCH (a:Person)-[:KNOWS*1..1]->(b:Person) RETURN a.name")
    assert isinstance(p, logical.Project) and isinstance(p.input, logical.Expand)
    p = plan("MATCH (a:Person)-[:KNOWS]->(b:Person)-[:KNOWS]->(c:Person), (a)-[:KNOWS]->(c) RETURN a.name").input
    assert p.target_bound and p.show().count("ScanByLabel") == 1
    p = plan("MATCH (a:Person)-[:KNOWS*]->(b:City) RETURN a.name").input
    assert (p.low, p.high, p.target_label) == (1, 20, "City")
    assert plan("MATCH (a:Person)-[:KNOWS*0..2]->(b:Person) RETURN a.name").input.low == 1
    assert plan("MATCH (a:Person), (b:City) RETURN a.name").input.how == "cross"
    assert plan("MATCH (a:Person:City) RETURN a.name").input.label == "Person"
    for text, kind in (("MATCH (a:Person)-[:KNOWS*1..21]->(b:Person) RETURN a.name", UnsupportedFeatureError), ("MATCH (a:Person)-[:KNOWS]->(a:City) RETURN a.id", PlanError), ("MATCH (a:Person)-[r:KNOWS]->(b:Person), (b)-[r:KNOWS]->(c:Person) RETURN a.name", InvalidPatternError)):
        with pytest.raises(kind):
            plan(text)
    assert issubclass(UnsupportedFeatureError, NotImplementedError)
