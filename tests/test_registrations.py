"""Registrations, base chains and client facts on small tables."""

import random

import pytest
from graphs import node
from pyspark.sql import functions as F

from loomgraph.operators import containers, export, registrations, traverse
from loomgraph.plans import jobs
from loomgraph.sources import artifact, files
from loomgraph.sources.store import GraphStore


def test_base_chains_of_every_length(spark):
    bases = {k: k + 1 for k in range(1, 12)} | {30: 31, 31: 32, 32: 30, 50: None}
    got = {(r.type, r.base): r.depth for r in registrations.base_chains(spark.createDataFrame([*bases.items()], "type int, base int")).collect()}
    want = {(a, b): b - a for a in range(1, 12) for b in range(a + 1, 13)} | {(30, 31): 1, (31, 32): 1, (32, 30): 1, (30, 32): 2, (31, 30): 2, (32, 31): 2}
    assert got == want


def test_nearest_declaration_wins(spark):
    chains = registrations.base_chains(spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "C")], "type string, base string"))
    types = spark.createDataFrame([(t,) for t in "ABCXZ"], "type string")
    declared = spark.createDataFrame([("B", "b1"), ("B", "b2"), ("C", "c")], "type string, value string")
    got = {r.type: (r.depth, r["values"]) for r in registrations.nearest_declared(types, chains, declared).collect()}
    assert got == {"A": (1, ["b1", "b2"]), "B": (0, ["b1", "b2"]), "C": (0, ["c"]), "X": (1, ["c"])}


def test_leaves_are_told_by_their_own_assembly(spark):
    chains = registrations.base_chains(spark.createDataFrame([("Low", "Mid"), ("Mid", "Top")], "type string, base string"))
    types = spark.createDataFrame([("Low", "one", False), ("Mid", "two", False), ("Top", "one", False), ("Shut", "one", True)], "type string, assembly string, is_sealed boolean")
    assert sorted(r.type for r in registrations.leaf_types(types, chains).collect()) == ["Low", "Mid", "Shut"]


CALL = "method string, declared string, callee string, pattern string, pattern_of string, receiver string, file string, span_start int, span_end int, registrar_kind string, registrar_fqn string, handler_kind string, handler_fqn string"


def test_registrations(spark):
    def call(method, declared, pattern, callee=None, pattern_of=None, receiver=None, file="a.cs", handler=None):
        return (method, declared, callee, pattern, pattern_of, receiver, file, 1, 2, "Class", "Sluice.Gate", "Method" if handler else None, handler)

    rows = [
        call("MapGet", "framework", "locks/{lock}", handler="Sluice.Read()"),
        call("MapGet", "framework", "/locks/{lock}/", file="b.cs", handler="Sluice.Peek()"),
        call("MapDelete", "source", "weirs", callee="Canal.MapDelete"),
        call("MapPut", "source", "weirs", callee="Canal.MapPut"),
        call("MapPost", "library", "weirs"),
        call("MapPost", "framework", None),
        call("MapPatch", "framework", None, pattern_of="Canal.MapDelete"),
        call("MapPatch", "framework", None, pattern_of="Canal.Route"),
        call("MapGet", "framework", "a", receiver="upper"),
        call("MapGet", "framework", "a", receiver="lost"),
        call("Render", "framework", "a"),
    ]
    bodies = spark.createDataFrame(
        [("Canal.MapDelete", "MapDelete", "MapPost", True, "Canal.MapDelete", "Canal.MapDelete"), ("Canal.MapPut", "MapPut", "MapPut", True, "Canal.MapPut", None), ("Canal.Route", "Route", "MapPatch", True, "Canal.Route", "Canal.Route")],
        "method string, name string, inner string, inner_is_framework boolean, pattern_of string, handler_of string",
    )
    prefixes = spark.createDataFrame([("upper", "reach/two"), ("lost", None)], "name string, prefix string")
    found = registrations.registrations(spark.createDataFrame(rows, CALL), registrations.forwarders(bodies), prefixes)
    g = registrations.endpoint_graph(found)
    ends = {r.fqn: (r.id, r.name, r.file) for r in g.nodes.collect()}
    want = ("GET /locks/{lock}", "POST /weirs", "GET /reach/two/a")
    assert ends == {fqn: (node("Endpoint", fqn)[0], fqn.split(" ")[1], "a.cs") for fqn in want}
    edges = {(r.source_id, r.target_id, r.kind) for r in g.edges.collect()}
    gate = node("Class", "Sluice.Gate")[0]
    assert edges == {(gate, ends[f][0], "Contains") for f in want} | {(ends[want[0]][0], node("Method", m)[0], "HandledBy") for m in ("Sluice.Read()", "Sluice.Peek()")}
    assert sorted((r.reason, r.n) for r in registrations.unresolved(found).collect()) == [("the pattern is handed in by Canal.Route", 1), ("the pattern is no constant", 1), ("the prefix of group lost isn't known", 1)]


def test_clients_and_imports(spark):
    names = spark.createDataFrame([("api", "http"), ("http", "base"), ("base", None), ("x", "y"), ("y", "x"), *((f"n{k}", f"n{k + 1}") for k in range(36)), ("n36", None), ("away", "elsewhere")], "name string, alias string")
    ends = {r.name: r.original for r in registrations.originals(names).collect()}
    assert (ends["api"], ends["base"], ends["x"], ends["away"]) == ("base", "base", "x", "elsewhere")
    assert [ends[f"n{k}"] for k in range(37)] == [f"n{min(36, k + 32)}" for k in range(37)]  # 32 hops and no more
    assert {r.name: r.original for r in registrations.originals(names, 5).collect()}["n3"] == "n8"
    declared = spark.createDataFrame([("base", "axios.create"), ("n36", "axios.create")], "name string, initializer string")
    assert {r.name for r in registrations.http_clients(names, declared).collect()} == {"api", "base", "http", *(f"n{k}" for k in range(4, 37))}
    rows = [(1, "import", None), (2, "property", 1), (3, "property", 2), (4, "identifier", 1), (5, "property", 4), (6, "identifier", 5), (7, "call", 1), (8, "binding", 9), (9, "require", None)]
    rows += [(20 + k, "property", 19 + k) for k in range(1, 10)] + [(20, "import", None)]
    got = {r.id for r in registrations.dynamic_imports(spark.createDataFrame(rows, "id int, shape string, of int")).collect()}
    assert got == {1, 2, 3, 4, 5, 8, 9} | set(range(20, 28))


def test_paths_in_a_project(spark):
    inside = lambda p: spark.range(1).select(registrations.in_project(F.lit(p), "C:/w/app/").alias("x")).first().x
    assert [inside(p) for p in ("C:\\w\\app\\x.ts", "C:/w/app", "C:/w/apple/x.ts", "C:/w/app/node_modules/x.ts")] == [True, False, False, False]


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_cycles_are_the_same_on_the_driver_and_by_joins(spark, monkeypatch, seed):
    """Random graphs with dead ends, so that the search has to go back."""
    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(14):02}", f"n{r.randrange(14):02}") for _ in range(26)} | {(f"m{a}", f"m{b}") for a, b in ((0, 1), (1, 2), (2, 1), (1, 3), (3, 0))})
    edges = spark.createDataFrame([(a, b, k + 1) for k, (a, b) in enumerate(pairs) if a != b], "from string, to string, n long")
    one = [tuple(x) for x in containers.cycles(edges).collect()]
    monkeypatch.setattr(containers, "DRIVER_EDGES", 0)
    assert [tuple(x) for x in containers.cycles(edges).collect()] == one
    assert any(x[0] == ["m0", "m1", "m3", "m0"] for x in one)


def test_nearest_two_seeds_give_least_depths(spark):
    r = random.Random(3)
    edges = spark.createDataFrame(sorted({(f"n{r.randrange(60)}", f"n{r.randrange(60)}", "Calls") for _ in range(110)}), "source_id string, target_id string, kind string")
    seeds = spark.createDataFrame([(f"n{k}",) for k in range(12)], "id string")
    least = lambda df: {x.id: x.depth for x in df.filter("id <> seed").groupBy("id").agg(F.min("depth").alias("depth")).collect()}
    assert least(traverse.two_nearest(edges, seeds, "incoming", 4)) == least(traverse.levels(edges, seeds, "incoming", 4))


def test_roots_of_nested_types(spark):
    rows = [("P", "Project", None), ("P|A", "Namespace", "P"), ("P|A.B", "Namespace", "P|A"), ("t", "Class", "P|A.B"), ("m", "Method", "t"), ("in", "Class", "t"), ("im", "Method", "in"), ("bare", "Class", "P"), ("lost", "Method", "nowhere"), ("deeper", "Method", "lost")]
    tree = spark.createDataFrame([(k, kind, k, k, None, None, parent) for k, kind, parent in rows], "key string, kind string, name string, fqn string, file string, span_start int, parent string")
    assert {r.key: r.up for r in export.roots(tree).collect()} == {k: "P" for k, _, parent in rows if parent} | {"lost": "nowhere", "deeper": "nowhere"}


def test_usable_artifacts_of_a_folder(spark, tmp_path):
    site = spark.createDataFrame([("C:/w", "FrontendCallSite", "GET", "/x", "literal", None, None, "a.ts", 3, 1, 5, 9)], "root string, kind string, verb string, template string, resolutionTier string, category string, reason string, file string, line int, column int, spanStart int, spanEnd int")
    text = artifact.render(site, "maker").first().json
    for name, content in (("good", text), ("torn", text[:40]), ("old", text.replace('"schemaVersion" : 2', '"schemaVersion" : 1')), ("verbless", text.replace('"GET"', '" "'))):
        (tmp_path / f"{name}.json").write_text(content)
    good, bad = artifact.read_usable(spark, f"file://{tmp_path}")
    assert [r.file.rsplit("/", 1)[1] for r in good.collect()] == ["good.json"]
    assert sorted((r.file.rsplit("/", 1)[1], r.fault.split(";")[0]) for r in bad.collect()) == [("old.json", "the artifact has schema version 1, which an older extractor wrote"), ("torn.json", "the file can't be read"), ("verbless.json", "a call site has no verb")]
    assert [r.fqn for r in artifact.nodes(good).collect()] == ["GET a.ts:3:1"]


def test_pins_and_doctor(spark, tmp_path):
    paths = spark.createDataFrame([("/w/a/x.cs",), ("/w/b/c/x.cs",), ("/v/x.cs",)], "path string")
    pins = spark.createDataFrame([("/w/global.json", '{"sdk":{"version":"8.0.100","rollForward":"disable"}}'), ("/w/b/global.json", "{}")], "path string, json string")
    assert {r.path: r.version for r in files.nearest_pins(paths, pins).collect()} == {"/w/a/x.cs": "8.0.100", "/w/b/c/x.cs": None, "/v/x.cs": None}
    told = {r.check: r.ok for r in jobs.doctor(GraphStore(spark, f"file://{tmp_path}/g"), paths, pins, [(9, 0, 100)]).collect()}
    assert told == {"shared folder": True, "store": True, "SDK of /w/global.json": False}


@pytest.mark.parametrize("n", [1, 5])
def test_chased_pointers(spark, n):
    pointers = spark.createDataFrame([(f"k{j}", f"k{j + 1}") for j in range(n)], "key string, up string")
    assert {r.key: r.up for r in export.chased(pointers).collect()} == {f"k{j}": f"k{n}" for j in range(n)}


def test_whole_texts_of_files(spark, tmp_path):
    (tmp_path / "a.cs").write_text("one\ntwo\n")
    (tmp_path / "b.cs").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_sources(spark, f"file://{tmp_path}").collect()}
    assert got.get("a.cs") == "one\ntwo\n"
    assert got.get("b.cs", "") == ""
