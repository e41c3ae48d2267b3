import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import routes, symbols

#: A rule for skeletons, and a route for each of its parts: case, slashes, constraints, holes inside a segment, what follows ? or #.
SKELETONS = [
    ("/Garden/BEDS", "garden/beds"), ("garden//beds/", "garden/beds"), ("//", ""), ("/beds/{bed:guid}/rows/{row}", "beds/{x}/rows/{x}"), ("/{plot}", "{x}"), ("/img/{name}.png", "img/{x}.png"),
    ("/beds?sort=name&dir=up", "beds"), ("/beds/{bed}#north", "beds/{x}"), ("/beds/{bed}?a=1#b", "beds/{x}"), ("\t ", ""), (None, ""),
]
MATCHES = [
    ("/beds/{bed}", "/beds/7", True), ("/beds/shady", "/BEDS/{x}", True), ("/{a}/rows", "/beds/{b}", True), ("/beds/{bed}", "/beds/7/rows", False), ("/beds/{bed}", "/pots/7", False), ("/beds", "/pots", False), ("//", "/", True),
]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_skeletons(spark):
    df = spark.createDataFrame(SKELETONS, "a string, want string")
    for r in df.withColumn("got", routes.skeleton(F.col("a"))).collect():
        assert r.got == r.want, r.a


def test_matches(spark):
    df = spark.createDataFrame(MATCHES, "a string, b string, want boolean")
    for r in df.withColumn("got", routes.matches(routes.skeleton(F.col("a")), routes.skeleton(F.col("b")))).collect():
        assert r.got == r.want, (r.a, r.b)


@pytest.mark.parametrize(("prefix", "pattern", "want"), [("api", "x/", "/api/x"), ("", "", "/"), (None, "/a//b", "/a/b"), ("/v1/", "/", "/v1")])
def test_compose(spark, prefix, pattern, want):
    assert one(spark, routes.compose(F.lit(prefix).cast("string"), F.lit(pattern))) == want


def test_tokens(spark):
    fill = lambda t, area=None: one(spark, routes.fill_tokens(F.lit(t), F.lit("HomeController"), F.lit("GetAsync"), F.lit(area).cast("string")))
    assert fill("[Controller]/[action]") == "Home/Get"
    assert fill("[area]/[controller]", "Admin") == "Admin/Home"
    assert fill("[area]/x") is None
    assert fill("[page]") is None


def test_verbs(spark):
    assert one(spark, routes.fetch_verb(F.lit(None).cast("string"), F.lit(True))) == "GET"
    assert one(spark, routes.fetch_verb(F.lit("post"), F.lit(True))) == "POST"
    assert one(spark, routes.fetch_verb(F.lit("m"), F.lit(False))) == "UNKNOWN"
    assert one(spark, routes.client_verb(F.lit("del"))) == "DELETE"
    assert one(spark, routes.client_verb(F.lit("head"))) is None


def test_node_ids_and_spans(spark):
    assert one(spark, schema.node_id(F.lit("Method"), F.lit("A.é()"))) == hashlib.sha256("9:A.é()".encode()).hexdigest()[:32]
    assert one(spark, schema.known(F.lit("Hologram"), schema.NODE_KINDS)) == "Unknown"
    assert one(spark, schema.span_text(F.lit(3), F.lit(9))) == "3-9"
    assert one(spark, schema.span_text(F.lit(9), F.lit(3))) is None
    assert tuple(one(spark, schema.parse_span(F.lit("3-9")))) == (3, 9)
    for bad in ("9-3", "a-b", "-1-2", "3", "99999999999-1", ""):
        assert one(spark, schema.parse_span(F.lit(bad))) is None


def test_names_and_paths(spark):
    assert one(spark, symbols.last_segment(F.lit("A.B.C(x.Y, z)"))) == "C"
    assert one(spark, symbols.member_suffix(F.lit("A.B.M()"), F.lit("A.B"))) == ".M()"
    assert one(spark, symbols.dotted_prefixes(F.lit("A.B.C"))) == ["A", "A.B", "A.B.C"]
    assert one(spark, symbols.directory(F.lit("C:\\r\\a.cs"))) == "C:/r/"
    assert one(spark, symbols.project_of_path(F.lit("C:\\r\\My.App.csproj"))) == "My.App"
    assert one(spark, symbols.project_of_path(F.lit("/r/.hidden"))) == ".hidden"
    assert one(spark, symbols.truncated(F.lit("x" * 61))) == "x" * 60 + "…"
    assert one(spark, symbols.location(F.lit("a.cs"), F.lit(None).cast("int"))) == "a.cs:?"


def test_lines(spark):
    line = lambda at: one(spark, symbols.line_of(F.lit("ab\nc\n"), F.lit(at)))
    assert [line(k) for k in (0, 2, 3, 5, 6, -1)] == [1, 1, 2, 3, None, None]
