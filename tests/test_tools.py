import json
from datetime import UTC, datetime

import pytest
from graphs import Builder, kitchen, millers, node, orchard
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.plans import jobs
from loomgraph.plans.failures import Failure, is_failure
from loomgraph.plans.render import BUDGET, friendly_time, render
from loomgraph.plans.tools import NOT_BUILT, PARAMETERS, Result, Tools
from loomgraph.schema import Graph
from loomgraph.sources.store import GraphStore


def stored(spark, tmp_path, graph, **meta):
    s = GraphStore(spark, f"file://{tmp_path}/g")
    s.save(graph, spark.createDataFrame([], schema.FILES), {"last_analyzed": "2024", **meta})
    return s


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    b = orchard()
    for other in (millers(), kitchen()):
        b.nodes |= other.nodes
        b.edges |= other.edges
    b.nodes["e"] = (*node("Endpoint", "GET /api/x/{id}")[:2], "/api/x/{id}", "GET /api/x/{id}", "C:/land/Grove/p.cs", 0, 1)
    b.nodes["c"] = (*node("FrontendCallSite", "GET a.ts:1:1")[:2], "/x/{*}", "GET a.ts:1:1", None, None, None)
    b.nodes["d"] = (*node("FrontendCallSite", "POST b.ts:1:1")[:2], "/x/1", "POST b.ts:1:1", None, None, None)
    b.link(("Method", "Kitchen.Soup.Stir(int)"), "Calls", ("Method", "Grove.Trees.Apple.Prune(int)"))
    store = stored(spark, tmp_path_factory.mktemp("tools"), b.graph(spark), conventional_controllers="2")
    sources = spark.createDataFrame([("C:/land/Grove/Apple.cs", "one\ntwo\nthree\n")], schema.SOURCES)
    return Tools(store, sources)


def rows(result, name=None):
    assert isinstance(result, Result), result
    return (result.frames[name] if name else result.rows).collect()


def test_symbols(tools):
    assert {r.fqn for r in rows(tools.call("find_symbol", {"query": "apple"}))} == {"Grove.Trees.Apple", "Grove.Trees.Apple.Prune(int)"}
    assert [r.fqn for r in rows(tools.call("find_symbol", {"query": "APPLE", "kind": "class"}))] == ["Grove.Trees.Apple"]
    assert tools.call("find_symbol", {"query": "x", "kind": "nope"}).code == "invalid_parameter"


def test_dependencies_and_usages(tools):
    got = rows(tools.call("get_dependencies", {"fqn": "Grove.Trees.Apple.Prune(int)", "direction": "dependents", "depth": 3}))
    assert {(r.fqn, r.depth) for r in got} == {("Kitchen.Soup.Stir(int)", 1), ("KitchenTests.SoupChecks.StirsSlowly()", 2)}
    assert [(r.fqn, r.line) for r in rows(tools.call("find_usages", {"fqn": "Grove.Trees.Apple.Prune(int)"}))] == [("Kitchen.Soup.Stir(int)", None)]
    assert tools.call("get_dependencies", {"fqn": "x", "direction": "sideways"}).code == "invalid_parameter"


def test_not_found_gives_suggestions(tools):
    got = tools.call("find_usages", {"fqn": "Wrong.Apple"})
    assert "No symbol" in got.text
    assert {r.fqn for r in rows(got)} == {"Grove.Trees.Apple", "Grove.Trees.Apple.Prune(int)"}


def test_types(tools):
    got = rows(tools.call("find_implementations", {"fqn": "Grove.Trees.IPlant.Prune(int)"}))
    assert {(r.project, r.fqn) for r in got} == {("Grove", f"Grove.Trees.{x}.Prune(int)") for x in ("Apple", "Hedge", "Tree")}
    assert [r.line for r in got if "Apple" in r.fqn] == [2]
    tree = tools.call("get_type_hierarchy", {"fqn": "Grove.Trees.Tree"})
    assert [r.name for r in rows(tree, "down")] == ["Apple"]
    assert [r.name for r in rows(tree, "up")] == ["IPlant"]


def test_impact_and_tests(tools):
    got = tools.call("impact_analysis", {"fqn": "Grove.Trees.IPlant"})
    assert {r.fqn: r.depth for r in rows(got)}["Kitchen.Soup.Stir(int)"] == 1
    assert {(r.project, r.n) for r in rows(got, "by_project")} == {("Grove", 6), ("Kitchen", 1), ("KitchenTests", 1)}
    assert [(r.project, r.fqn) for r in rows(tools.call("find_tests_for_symbol", {"fqn": "Grove.Trees.Apple.Prune(int)"}))] == [("KitchenTests", "KitchenTests.SoupChecks.StirsSlowly()")]


def test_structure(tools):
    got = tools.call("get_architecture_overview")
    assert [r.name for r in rows(got, "projects")] == ["Bakery", "Grove", "Kitchen", "KitchenTests", "Mill"]
    assert [(r["from"], r["to"], r.n) for r in rows(tools.call("get_project_dependencies", {"project": "kitchen"}))] == [("Kitchen", "Grove", 1), ("KitchenTests", "Kitchen", 1)]
    assert "No project named" in tools.call("get_project_dependencies", {"project": "zzz"}).text
    assert [r.path for r in rows(tools.call("find_circular_dependencies"))] == [["Bakery", "Mill", "Bakery"]]
    assert tools.call("find_circular_dependencies", {"scope": "file"}).code == "invalid_parameter"


def test_endpoints_and_call_sites(tools):
    got = tools.call("list_endpoints", {"verb": " get ", "prefix": "/api"})
    assert [(r.project, r.name, r.handlers) for r in rows(got)] == [("Grove", "/api/x/{id}", None)]
    assert got.counts == {"conventional_controllers": 2}
    assert [r.fqn for r in rows(tools.call("find_endpoint", {"route": "/api/x/9"}))] == ["GET /api/x/{id}"]
    assert [r.fqn for r in rows(tools.call("find_endpoint", {"route": "/other/x/9/9/x"}))] == ["GET /api/x/{id}"]
    assert tools.call("find_endpoint", {"route": "/x", "verb": "LINK"}).code == "invalid_parameter"
    assert [(r.outcome, r.fqn, r.conflicts) for r in rows(tools.call("find_orphan_calls"))] == [("VerbMismatch", "POST b.ts:1:1", ["GET /api/x/{id}"])]
    assert [(r.outcome, r.endpoints) for r in rows(tools.call("list_frontend_callsites", {"verb": "GET"}))] == [("Unique", ["GET /api/x/{id}"])]
    assert tools.call("find_orphan_calls", {"category": "nope"}).code == "invalid_parameter"


def test_source(tools):
    got = rows(tools.call("get_symbol_source", {"fqn": "Grove.Trees.Apple.Prune(int)", "context_lines": 1}))
    assert [(r.line_no, r.text) for r in got] == [(1, "one"), (2, "two"), (3, "three")]
    assert "can't be read" in tools.call("get_symbol_source", {"fqn": "Grove.Trees.Hedge"}).text


def test_failures_have_one_shape(tools):
    for tool, parameters in PARAMETERS.items():
        wrong = tools.call(tool, {"nonsense": 1})
        payload = json.loads(wrong.payload())
        assert (payload["status"], payload["code"], payload["invalid_parameter"], payload["hint"]) == ("error", "invalid_parameter", "nonsense", "fix_call")
        assert payload["valid_parameters"] == [p.name for p in parameters]
        for p in parameters:
            if p.required:
                for given in ({}, {p.name: None}, {p.name: "  "}):
                    assert json.loads(tools.call(tool, given).payload())["missing_parameter"] == p.name
                assert tools.call(tool, {p.name: 7}).code == "invalid_parameter"
    assert tools.call("nothing").code == "invalid_parameter"
    assert is_failure(tools.call("nothing").payload())
    assert not is_failure(render(tools.call("get_architecture_overview")))


def test_inner_errors_are_not_shown(tools, monkeypatch):
    monkeypatch.setattr(Tools, "graph", lambda self: 1 / 0)
    got = tools.call("find_symbol", {"query": "x"})
    assert isinstance(got, Failure)
    assert (got.code, got.hint) == ("internal_error", "retry")
    assert "zero" not in got.payload()


def test_caps_and_budget(spark, tmp_path):
    b = Builder()
    b.add("Project", "Town")
    b.add("Class", "Town.Well")
    b.add("Method", "Town.Well.Draw()", inside=("Class", "Town.Well"))
    for k in range(400):
        b.add("Method", f"Town.House{k}.Fetch()")
        b.link(("Method", f"Town.House{k}.Fetch()"), "Calls", ("Method", "Town.Well.Draw()"))
    t = Tools(stored(spark, tmp_path, b.graph(spark)))
    for tool, arguments, cap in (("find_symbol", {"query": "Town"}, 20), ("get_dependencies", {"fqn": "Town.Well.Draw()", "direction": "in"}, 50), ("find_usages", {"fqn": "Town.Well.Draw()"}, 50), ("impact_analysis", {"fqn": "Town.Well.Draw()"}, 100)):
        got = t.call(tool, arguments)
        assert got.more
        assert got.rows.count() == cap
        assert len(render(got)) <= BUDGET


def test_friendly_times():
    now = datetime(2031, 3, 5, 20, 15, tzinfo=UTC)
    assert friendly_time("2031-03-05T15:15:00Z", now) == "05 Mar 2031, 15:15 UTC — 5h ago"
    assert friendly_time("2031-03-05T20:14:40+00:00", now).endswith("just now")
    assert friendly_time("2031-02-24T20:15:00Z", now).endswith("9d ago")
    assert friendly_time("2029-12-31T20:15:00Z", now).endswith("31 Dec 2029")
    assert friendly_time("never", now) == "never"


def test_without_a_graph(spark, tmp_path):
    assert Tools(GraphStore(spark, f"file://{tmp_path}/none")).call("find_symbol", {"query": "x"}).text == NOT_BUILT


def test_jobs(spark, tmp_path):
    g = orchard().graph(spark)
    s = GraphStore(spark, f"file://{tmp_path}/g")
    files = g.nodes.filter("file is not null").select(F.col("file").alias("path")).distinct().withColumn("content_hash", F.lit("1"))
    asked = []

    def extract(paths):
        asked.append(sorted(r.path for r in paths.collect()))
        own = g.nodes.join(paths.withColumnRenamed("path", "file"), "file", "left_semi").select(*schema.NODES.names)
        rest = g.nodes.filter("file is null")
        return Graph(own.unionByName(rest), g.edges)

    first = jobs.build(s, extract, files)
    assert (first.files, first.analysed, first.skipped, first.saved) == (5, 5, 0, True)
    version = s.version()
    again = jobs.build(s, extract, files)
    assert (again.analysed, again.saved) == (0, False)
    assert s.version() == version
    changed = files.withColumn("content_hash", F.when(F.col("path").endswith("Tree.cs"), "2").otherwise("1"))
    third = jobs.build(s, extract, changed)
    # Apple derives from what is in the file; nothing else refers to it.
    assert asked[-1] == [f"C:/land/Grove/{x}.cs" for x in ("Apple", "Tree")]
    assert not third.saved  # the same nodes and edges
    text = '{"schemaVersion":2,"producer":"p","project":{"root":"C:/w"},"callSites":[{"kind":"FrontendCallSite","verb":"GET","template":"/x","file":"a.ts","line":1,"column":2}]}'
    from loomgraph.sources import artifact

    with pytest.raises(ValueError, match="no Endpoint"):
        jobs.link(s)
    assert jobs.ingest_call_sites(s, artifact.parse(spark.createDataFrame([(text,)], "json string")), "p") == 1
    assert jobs.ingest_call_sites(s, artifact.parse(spark.createDataFrame([(text,)], "json string")), "p") == 1
    now = s.load()
    end = spark.createDataFrame([(*node("Endpoint", "GET /api/x")[:2], "/api/x", "GET /api/x", None, None, None)], schema.NODES)
    s.save(Graph(now.nodes.unionByName(end), now.edges), s.files(), s.meta())
    assert jobs.link(s)["Unique"] == 1
    assert jobs.link(s)["Unique"] == 1
    found = jobs.status(s)
    assert (found["edge_kinds"]["CallsEndpoint"], found["node_kinds"]["FrontendCallSite"]) == (1, 1)
    assert {"linker_last_run", "frontend_last_analyzed", "last_analyzed"} <= set(found["meta"])
    payload, large = jobs.export_tree(s)
    assert not large
    assert len(json.loads(payload)["nodes"]) == 13


def test_watch_job(spark, tmp_path):
    g = orchard().graph(spark)
    s = GraphStore(spark, f"file://{tmp_path}/g")
    files = g.nodes.filter("file is not null").select(F.col("file").alias("path")).distinct().withColumn("content_hash", F.lit("1"))
    spark.createDataFrame([("C:/land/Grove/Apple.cs",)], "path string").write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("path string").json(str(tmp_path / "in"))
    q = jobs.watch(s, events, lambda: files, lambda paths: g, str(tmp_path / "cp"), once=True)
    q.awaitTermination(90)
    assert s.load().nodes.count() == 10
