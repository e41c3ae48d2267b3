import pytest
from graphs import Builder, kitchen, millers, node, orchard, stairs
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import attribute, containers, endpoints, export, incremental, linker, report, scan, source_text, traverse
from loomgraph.schema import Graph
from loomgraph.sources import artifact, files, store
from loomgraph.streaming import watch


def fqns(df):
    return sorted(r.fqn for r in df.select("fqn").collect())


def test_traversal_contract(spark):
    g = stairs(8).graph(spark)
    top, bottom = node("Method", "Tower.Step0(bool)")[0], node("Method", "Tower.Step7(bool)")[0]
    got = traverse.traverse(g, bottom, "incoming").collect()
    assert [(r.fqn, r.depth) for r in got] == [(f"Tower.Step{7 - d}(bool)", d) for d in range(1, 6)]  # no further than the default, and no container
    assert [r.depth for r in traverse.traverse(g, bottom, "incoming", 5, 2).collect()] == [1, 2]
    assert fqns(traverse.traverse(g, top, "outgoing", 3)) == [f"Tower.Step{d}(bool)" for d in range(1, 4)]
    assert traverse.traverse(g, top, "incoming").count() == 0
    for bad in (dict(direction="both"), dict(direction="incoming", depth=0), dict(direction="incoming", max_results=0)):
        with pytest.raises(ValueError, match="incoming or outgoing|positive"):
            traverse.traverse(g, "x", **bad)


def test_traversal_on_a_cycle_and_without_nodes(spark):
    b = Builder()
    for x in "ABC":
        b.add("Method", x)
    for x, y in ("AB", "BC", "CA", "AA"):
        b.link(("Method", x), "Calls", ("Method", y))
    b.link(("Method", "C"), "Calls", ("Method", "ghost"))
    b.link(("Method", "ghost"), "Calls", ("Method", "far"))
    b.add("Method", "far")
    got = {r.fqn: r.depth for r in traverse.traverse(b.graph(spark), node("Method", "A")[0], "outgoing", 5).collect()}
    assert got == {"B": 1, "C": 2, "far": 4}


def test_one_hop(spark):
    b = Builder()
    for k, x in (("Class", "A"), ("Class", "B"), ("Interface", "I")):
        b.add(k, x)
    b.link(("Class", "A"), "Calls", ("Class", "B"))
    b.link(("Class", "A"), "Implements", ("Interface", "I"))
    b.link(("Class", "B"), "Calls", ("Class", "A"))
    b.link(("Class", "A"), "Calls", ("Class", "A"))
    g, a = b.graph(spark), node("Class", "A")[0]
    assert [scan.edges_of(g, a, d).count() for d in ("outgoing", "incoming", "both")] == [3, 2, 4]
    assert scan.edges_of(g, a, "outgoing", "Calls").count() == 2


def test_implementations_and_hierarchy(spark):
    g = orchard().graph(spark)
    assert fqns(traverse.implementations(g, "Grove.Trees.IPlant")) == ["Grove.Trees.Apple", "Grove.Trees.Hedge", "Grove.Trees.Tree"]
    assert fqns(traverse.implementations(g, "Grove.Trees.IPlant.Prune(int)")) == ["Grove.Trees.Apple.Prune(int)", "Grove.Trees.Hedge.Prune(int)", "Grove.Trees.Tree.Prune(int)"]
    up = traverse.hierarchy(g, node("Class", "Grove.Trees.Apple")[0], "up").filter("level > 0").orderBy("level").collect()
    assert [r.path[-1].fqn for r in up] == ["Grove.Trees.Tree", "Grove.Trees.IPlant"]


def test_diamond_is_shown_once(spark):
    b = Builder()
    for x in ("Root", "L", "R", "Low", "Deep"):
        b.add("Class", x)
    for x, y in (("L", "Root"), ("R", "Root"), ("Low", "L"), ("Low", "R"), ("Deep", "Low")):
        b.link(("Class", x), "Inherits", ("Class", y))
    rows = traverse.hierarchy(b.graph(spark), node("Class", "Root")[0], "down").collect()
    shown = sorted(("/".join(p.fqn for p in r.path), r.already_shown) for r in rows)
    assert shown == [("Root", False), ("Root/L", False), ("Root/L/Low", False), ("Root/L/Low/Deep", False), ("Root/R", False), ("Root/R/Low", True)]


def test_impact_of_an_interface(spark):
    b = orchard()
    b.add("Method", "App.Use()", "C:/land/Grove/Use.cs")
    b.link(("Method", "App.Use()"), "Calls", ("Method", "Grove.Trees.Apple.Prune(int)"))
    got = {r.fqn: (r.depth, r.is_implementer) for r in traverse.impact(b.graph(spark), "Grove.Trees.IPlant").collect()}
    assert got["App.Use()"] == (1, False)
    assert got["Grove.Trees.Hedge.Prune(int)"] == (1, True)
    assert "Grove.Trees.IPlant" not in got
    assert "Grove.Trees.IPlant.Prune(int)" not in got
    assert got["Grove.Trees.Tree"][1]


def test_type_on_a_cycle_is_in_its_closure(spark):
    b = Builder()
    for x, y in (("A", "B"), ("B", "A")):
        b.add("Class", x)
        b.link(("Class", x), "Inherits", ("Class", y))
    g = b.graph(spark)
    assert {r.id for r in traverse.closure(g, g.nodes.filter("fqn = 'A'").select("id")).collect()} == {node("Class", x)[0] for x in "AB"}


def test_attribution(spark):
    nodes = spark.createDataFrame(
        [node("Project", "Web", "C:/repo/Web/Web.csproj"), node("Project", "Web.Api", "C:/repo/Web/Api/Api.csproj"), node("Class", "a", "c:\\REPO\\web\\api\\x.cs"), node("Class", "b", "C:/repo/Web/y.cs"), node("Class", "c", "C:/repo/WebOther/y.cs"), node("Class", "d")],
        schema.NODES,
    )
    got = {r.fqn: r.project for r in attribute.with_project(nodes, nodes).collect()}
    assert got == {"Web": "Web", "Web.Api": "Api", "a": "Api", "b": "Web", "c": None, "d": None}


def test_millers_projects_are_one_cycle(spark):
    edges = containers.container_edges(millers().graph(spark))
    (row,) = containers.cycles(edges).collect()
    assert (row.path, row.hops, row.weight) == (["Bakery", "Mill", "Bakery"], 2, 2)
    for f in (containers.components, containers.components_by_colour):
        assert sorted(map(tuple, f(edges).collect())) == [("Bakery", "Bakery"), ("Mill", "Bakery")]


def test_no_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "from string, to string, n long")
    assert containers.cycles(edges).collect() == []
    assert containers.components_by_colour(edges).collect() == []


def test_components_agree(spark):
    import random

    r = random.Random(3)
    pairs = sorted({(f"n{r.randrange(30):02}", f"n{r.randrange(30):02}") for _ in range(40)})
    edges = spark.createDataFrame(pairs, "from string, to string")
    assert sorted(map(tuple, containers.components(edges).collect())) == sorted(map(tuple, containers.components_by_colour(edges).collect()))


#: For each outcome: the endpoints there are, the verb and template of a call, and how many endpoints it is linked with.
LINKS = [
    ("Unique", ["PUT /api/beds/{bed}/water"], "PUT", "/beds/9/water", 1),
    ("Unique", ["GET /api/beds", "POST /api/beds"], "GET", "/beds?shade=half", 1),
    ("PrecedenceResolved", ["GET /api/beds/{bed}", "GET /api/beds/shady"], "GET", "/beds/shady", 1),
    ("PrecedenceResolved", ["GET /api/{plot}/rows/{row}", "GET /api/beds/{bed}/{row}"], "GET", "/beds/rows/3", 1),
    ("SetEdge", ["DELETE /api/pots/clay", "DELETE /api/pots/{pot}", "GET /api/pots/{pot}"], "DELETE", "/pots/{*}", 2),
    ("SetEdge", ["GET /api/pots/{pot}/soil", "GET /api/pots/{number:int}/soil"], "GET", "/pots/3/soil", 2),
    ("VerbMismatch", ["GET /api/pots/{pot}", "POST /api/pots"], "PATCH", "/pots/7", 0),
    ("NoSkeletonMatch", ["GET /api/pots/{pot}"], "GET", "/pots/7/soil/acid", 0),
    ("UnknownVerb", ["GET /api/pots"], "UNKNOWN", "/pots", 0),
]


def test_linker_matrix(spark):
    assert {x[0] for x in LINKS} == set(linker.OUTCOMES)
    for outcome, ends, verb, template, n in LINKS:
        rows = [(*node("Endpoint", e)[:2], e.split(" ", 1)[1], e, None, None, None) for e in ends]
        rows.append((*node("FrontendCallSite", f"{verb} a.ts:1:1")[:2], template, f"{verb} a.ts:1:1", None, None, None))
        g = Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame([], schema.EDGES))
        (got,) = linker.link(g.nodes).collect()
        assert (got.outcome, len(got.endpoints)) == (outcome, n), template
        again, _ = linker.relinked(linker.relinked(g)[0])
        assert again.edges.count() == n
    assert {r.outcome for r in linker.outcome_counts(linker.link(g.nodes)).collect()} == set(linker.OUTCOMES)


def test_endpoints_with_handlers_and_callers(spark):
    b = Builder()
    b.add("Project", "Api", "C:/r/Api/Api.csproj")
    b.add("Method", "H.A()")
    b.add("Method", "H.B()")
    b.nodes["e"] = (*node("Endpoint", "GET /api/x/{id}")[:2], "/api/x/{id}", "GET /api/x/{id}", "C:/r/Api/p.cs", 0, 1)
    b.nodes["c"] = (*node("FrontendCallSite", "GET a.ts:1:1")[:2], "/x/{*}", "GET a.ts:1:1", None, None, None)
    for h in ("H.B()", "H.A()"):
        b.link(("Endpoint", "GET /api/x/{id}"), "HandledBy", ("Method", h))
    g, _ = linker.relinked(b.graph(spark))
    (row,) = endpoints.find_endpoints(g, "/API/x/7").collect()
    assert (row.project, row.handlers, row.callers) == ("Api", "H.A() | H.B()", "GET a.ts:1:1")
    assert endpoints.find_endpoints(g, "/api/y/7").count() == 0
    assert endpoints.near_misses(g.nodes, "/foo/x/{id}").count() == 1
    assert endpoints.near_misses(g.nodes, "/{id}").count() == 0


def sources_of(graph):
    return graph.nodes.filter("file is not null").select(F.col("file").alias("path")).distinct().withColumn("content_hash", F.lit("1"))


def test_incremental_equals_full(spark):
    old = orchard().graph(spark)
    files1 = sources_of(old)
    new = orchard()
    del new.nodes["Method", "Grove.Trees.Hedge.Prune(int)"]
    new.edges = {e for e in new.edges if node("Method", "Grove.Trees.Hedge.Prune(int)")[0] not in e[:2]}
    full = new.graph(spark)
    files2 = files1.withColumn("content_hash", F.when(F.col("path").endswith("Hedge.cs"), "2").otherwise("1"))
    todo = incremental.plan(old, files2, files1)
    actions = {r.path: r.action for r in todo.collect()}
    assert actions["C:/land/Grove/Hedge.cs"] == "analyze"
    paths = todo.select("path")
    own = full.nodes.join(paths.withColumnRenamed("path", "file"), "file", "left_semi")
    fresh = Graph(own.select(*schema.NODES.names), full.edges.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(full.edges.filter("kind = 'Contains'")).select(*schema.EDGES.names))
    made = incremental.update(old, fresh, paths)
    assert store.graphs_equal(made, full)


def test_eviction_keeps_nodes_without_file(spark):
    g = orchard().graph(spark)
    left = incremental.evict(g, spark.createDataFrame([("C:/land/Grove/Apple.cs",)], "path string"))
    assert left.nodes.count() == 8
    circle = node("Class", "Grove.Trees.Apple")[0]
    assert left.edges.filter(F.col("source_id") == circle).count() == 0
    assert left.edges.filter(F.col("target_id") == circle).count() == 1  # from the namespace
    assert scan.without_dangling(left).edges.filter(F.col("target_id") == circle).count() == 0


def test_orphan_namespaces_go_however_deep(spark):
    b = Builder()
    b.add("Namespace", "A")
    b.add("Namespace", "A.B", inside=("Namespace", "A"))
    b.add("Namespace", "C")
    b.add("Class", "C.X", inside=("Namespace", "C"))
    b.add("Project", "P", "C:/p/P.csproj")
    b.link(("Project", "P"), "Contains", ("Namespace", "A"))
    left = incremental.without_orphan_namespaces(b.graph(spark))
    assert fqns(left.nodes) == ["C", "C.X", "P"]
    assert left.edges.count() == 1


def test_store_round_trip(spark, tmp_path):
    s = store.GraphStore(spark, f"file://{tmp_path}/g")
    assert s.version() is None
    assert s.load().nodes.count() == 0
    g = orchard().graph(spark)
    files1 = files.hash_texts(spark.createDataFrame([("a", "x"), ("b", None)], schema.SOURCES))
    first = s.save(g, files1, {"last_analyzed": "now"})
    assert store.graphs_equal(s.load(), g)
    assert s.files().count() == 1
    assert s.meta() == {"schema_version": "1", "last_analyzed": "now"}
    assert not s.save_if_changed(Graph(g.nodes.repartition(2), g.edges), files1, {})
    assert s.version() == first
    odd = Graph(g.nodes.unionByName(spark.createDataFrame([("1", "HologramProjector", "n", "n", None, None, None)], schema.NODES)), g.edges.unionByName(spark.createDataFrame([("1", "2", "Teleports")], schema.EDGES)))
    assert s.save_if_changed(odd, files1, {})
    assert s.load().nodes.filter("kind = 'Unknown'").count() == 1
    assert sorted((r.table, r.kind, r.n) for r in s.unknown_kinds().collect()) == [("edges", "Teleports", 1), ("nodes", "HologramProjector", 1)]
    assert s.vacuum() == 1


def test_failed_save_leaves_the_old_graph(spark, tmp_path):
    s = store.GraphStore(spark, f"file://{tmp_path}/g")
    g = orchard().graph(spark)
    none = spark.createDataFrame([], schema.FILES)
    first = s.save(g, none, {})
    with pytest.raises(Exception, match="boom"):
        s.save(Graph(g.nodes.withColumn("name", F.raise_error(F.lit("boom")).cast("string")), g.edges), none, {})
    assert s.version() == first
    assert [p.name for p in (tmp_path / "g").iterdir() if p.name.startswith("v-")] == [first]


def test_artifacts(spark):
    site = '{"kind":"FrontendCallSite","verb":"GET","template":"/x","resolutionTier":"literal","file":"a.ts","line":1,"column":2,"spanStart":0,"spanEnd":4}'
    bad = '{"kind":"UnresolvedCallSite","verb":"GET","category":"c","reason":"r","file":"b.ts","line":3,"column":1}'
    text = lambda sites, version=2, producer="p": f'{{"schemaVersion":{version},"producer":"{producer}","project":{{"root":"C:\\\\w"}},"callSites":{sites}}}'
    parse = lambda t: artifact.parse(spark.createDataFrame([(t,)], "json string"))
    good = parse(text(f"[{site},{bad}]"))
    artifact.validate(good, "p")
    rows = {r.fqn: r for r in artifact.nodes(good).collect()}
    assert rows["GET a.ts:1:2"].file == "C:/w/a.ts"
    assert rows["GET c b.ts:3:1"].name == "c: r"
    for t, message in (
        (text("[]", 1), "version 1"), (text("[]", 3), "another schema"), (text("[]", 2, "q"), "another producer"), (text("null"), "no callSites"),
        (text(f'[{site.replace("a.ts", " ")}]'), "no file"), (text(f'[{site.replace("GET", "")}]'), "no verb"), (text(f'[{site.replace("/x", "")}]'), "no template"),
        (text(f'[{bad.replace(chr(34) + "c" + chr(34), "null")}]'), "no category"), (text(f'[{bad.replace(chr(34) + "r" + chr(34), "null")}]'), "no reason"), (text(f'[{site.replace("Frontend", "Odd")}]'), "unknown call site kind"),
    ):
        with pytest.raises(artifact.ArtifactError, match=message):
            artifact.validate(parse(t), "p")
    stats = artifact.statistics(spark.createDataFrame([("FrontendCallSite", None)] * 5 + [("UnresolvedCallSite", f"c{k}") for k in range(6)], "kind string, category string")).first()
    assert (stats.resolved, stats.unresolved, stats.coverage, len(stats.by_category)) == (5, 6, 45.5, 6)
    assert artifact.statistics(spark.createDataFrame([], "kind string, category string")).first().coverage == 100


def test_warnings(spark):
    form = "Msbuild failed when processing the file 'C:\\repo\\{p}\\{p}.csproj' with message: Package 'N' 1.0 has a known {s} severity vulnerability, {u}"
    rows = [(form.format(p=p, s=s, u=u),) for p, s, u in (("Api", "moderate", "https://a"), ("Web", "high", "https://b"))] + [("odd",), ("odd",)]
    entries = report.parse(spark.createDataFrame(rows, "raw string"))
    (g,) = report.audit_groups(entries).collect()
    assert (g.advisories, g.severities, g.projects) == (2, "high, moderate", "Api, Web")
    assert tuple(report.summary(entries).first()) == (4, 3)
    (o,) = report.other_groups(entries).collect()
    assert (o.body, o.n) == ("odd", 2)


def test_source_lines(spark):
    src = spark.createDataFrame([("f", "a\nb\nc\nd\ne")], schema.SOURCES)
    one = spark.createDataFrame([("x", "f", 4, 5)], "id string, file string, span_start int, span_end int")
    assert [(r.line_no, r.text) for r in source_text.symbol_source(one, src, 1).orderBy("line_no").collect()] == [(2, "b"), (3, "c"), (4, "d")]


def shared_space() -> Builder:
    b = Builder()
    for p in ("App", "Lib"):
        b.add("Project", p, f"C:/r/{p}/{p}.csproj")
    b.add("Namespace", "N", inside=("Project", "App"))
    b.link(("Project", "Lib"), "Contains", ("Namespace", "N"))
    b.add("Namespace", "N.Deep", inside=("Namespace", "N"))
    b.add("Class", "N.Deep.A", "C:/r/App/A.cs", inside=("Namespace", "N.Deep"))
    b.add("Method", "N.Deep.A.M()", "C:/r/App/A.cs", inside=("Class", "N.Deep.A"))
    b.add("Class", "N.Deep.B", "C:/r/Lib/B.cs", inside=("Namespace", "N.Deep"))
    b.add("Method", "N.Deep.B.F()", "C:/r/Lib/B.cs", inside=("Class", "N.Deep.B"))
    b.add("Class", "N.Pair<T> \"a & b\" </script>", "C:/r/App/X.cs")
    b.link(("Method", "N.Deep.A.M()"), "Calls", ("Method", "N.Deep.B.F()"))
    for k in ("References", "Inherits", "Implements"):
        b.link(("Class", "N.Deep.A"), k, ("Class", "N.Deep.B"))
    return b


def test_containment_tree(spark):
    g = shared_space().graph(spark)
    tree = export.containment_tree(g)
    rows = {r.key: r for r in tree.collect()}
    assert sorted(r.fqn for r in rows.values() if r.parent is None) == ["App", "Lib"]
    spaces = [r for r in rows.values() if r.kind == "Namespace"]
    assert [r.name for r in spaces] == ["N.Deep", "N.Deep"]
    orphan = next(r for r in rows.values() if "Pair" in r.fqn)
    assert rows[orphan.parent].fqn == "App"
    edges = export.tree_edges(g, tree)
    rolled = export.rolled_up(edges, export.roots(tree)).collect()
    assert sorted((rows[r.source].fqn, rows[r.target].fqn, r.kind, r.n) for r in rolled) == [("App", "Lib", k, 1) for k in ("Calls", "Implements", "Inherits", "References")]
    kept, stubs = export.only_project(tree, edges, "app")
    assert kept.filter("kind = 'Project'").count() == 2
    assert {rows[r.target].fqn for r in stubs.collect()} == {"Lib"}
    with pytest.raises(ValueError, match="Valid projects: App, Lib"):
        export.only_project(tree, edges, "nope")
    text = export.payload(tree, edges, "C:/r")
    assert "</script" not in text
    assert "</script> " not in export.html(text)


def test_verdicts(spark):
    cases = [("C:/r/x.db", "Ignore"), ("C:/r/a/bin/x.cs", "Ignore"), ("C:\\r\\OBJ\\x.cs", "Ignore"), ("/r/.git/x.cs", "Ignore"), ("/r/README.md", "Ignore"), ("/r/X.CS", "Content"), ("/r/a.csproj", "Structural"), ("/r/Directory.Build.props", "Structural"), ("/r/Global.json", "Structural"), ("/r/appsettings.json", "Ignore"), ("/r/store/x.cs", "Ignore"), ("/r/a.slnx", "Structural")]
    df = spark.createDataFrame(cases, "path string, want string").withColumn("got", watch.verdict(F.col("path"), "/r/store"))
    for r in df.collect():
        assert r.got == r.want, r.path


def test_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("/r/a.cs",), ("/r/A.CS",), ("/r/readme.md",)], "path string").coalesce(1).write.json(str(src))
    seen = []

    def apply(paths, structural):
        seen.append((sorted(r.path.lower() for r in paths.collect()), structural))
        raise RuntimeError("still watching")

    events = spark.readStream.schema("path string").json(str(src))
    q = watch.watch(events, apply, str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert q.exception() is None
    assert seen == [(["/r/a.cs"], False)]


def test_tests_of_a_symbol(spark):
    from loomgraph.queries import tests_of

    assert fqns(tests_of(kitchen().graph(spark), "Kitchen.Soup.Stir(int)")) == ["KitchenTests.SoupChecks.StirsSlowly()"]
