"""What is shuffled or sent to the driver where tables are large: with broadcasts by estimated size off, or on where they mislead."""

import re
import time
from contextlib import contextmanager

import pytest
from graphs import Builder, orchard
from pyspark.sql import functions as F

from loomgraph import queries, schema, testgraphs
from loomgraph.operators import containers, export, incremental, linker, scan, traverse
from loomgraph.schema import Graph
from loomgraph.sources.store import GraphStore, packed, unpacked

MANY = 3000


@contextmanager
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(spark, job) -> int:
    """The rows that a job shuffles, with broadcasts by estimated size off."""

    def stages():
        time.sleep(1)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    with without_broadcasts(spark):
        job()
    return sum(n for key, n in stages().items() if key not in before)


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A stored graph of many pairs of types with a method each, all in one project; three of them are of interest."""
    b = Builder()
    b.add("Project", "P", "C:/p/P.csproj")
    of = lambda k: ("Class" if k else "Interface", f"N.T{k}")
    go = lambda k: ("Method", f"N.T{k}.Go()")
    for k in range(MANY):
        b.add(*of(k), f"C:/p/T{k}.cs", inside=("Project", "P"))
        b.add(*go(k), f"C:/p/T{k}.cs", inside=of(k))
        b.link(go(k), "Calls", go(k - k % 2))
        if k:
            b.link(of(k), "Implements" if k == 1 else "Inherits", of(k - 1 if k < 3 else k))
    b.link(of(1), "Inherits", of(0))
    store = GraphStore(spark, str(tmp_path_factory.mktemp("crowd") / "g"))
    store.save(b.graph(spark), spark.createDataFrame([], schema.FILES), {}, both=False)
    return store.load()


def id_of(g: Graph, fqn: str) -> str:
    return scan.by_fqn(g.nodes, fqn).first().id


def test_ids_as_bytes(spark):
    """16 bytes for 32 lower-case digits; any other text comes back as it was."""
    ids = ["0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "0123456789abcdef", "", "x" * 15, "x" * 16, "p|ä.é", "0" * 32, "g" * 32]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select(F.col("id").alias("was"), packed("id")).select("was", F.octet_length("id").alias("n"), unpacked("id")).collect()
    assert [r.id for r in rows] == [r.was for r in rows] == ids
    assert [r.n == 16 for r in rows] == [i in ("0123456789abcdef" * 2, "0" * 32) for i in ids]


def test_edges_are_made_distinct_by_the_save(spark, small):
    """The view of edges has no shuffle to drop equal ones, as the save's has; the store holds each once."""
    plan = testgraphs.projected(spark, small).edges._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate")
    edges = testgraphs.graph(spark, small).edges
    assert edges.count() == edges.distinct().count() > 0


def test_neighbours_of_a_node(spark, crowd):
    got = []
    n = shuffled(spark, lambda: got.extend(scan.neighbours(crowd, scan.by_fqn(crowd.nodes, "N.T0.Go()").select("id"), "incoming").collect()))
    assert sorted((r.rel_kind, r.neighbour_fqn) for r in got) == [("Calls", "N.T0.Go()"), ("Calls", "N.T1.Go()")]
    assert n < MANY // 10


def test_a_small_hierarchy(spark, crowd):
    """Types below one that are bound by edges of two kinds are shown once; other types aren't shuffled."""
    got = []
    n = shuffled(spark, lambda: got.extend(traverse.hierarchy(crowd, id_of(crowd, "N.T0"), "down").collect()))
    assert sorted((r.level, r.path[-1].fqn, r.already_shown) for r in got) == [(0, "N.T0", False), (1, "N.T1", False), (2, "N.T2", False)]
    assert n < MANY // 10


def test_few_implementations(spark, crowd):
    for fqn, want in (("N.T0", ["N.T1", "N.T2"]), ("N.T0.Go()", ["N.T1.Go()", "N.T2.Go()"])):
        got = []
        # What contains a member, or is named after it, is looked up among all edges.
        n = shuffled(spark, lambda fqn=fqn, got=got: got.extend(traverse.implementations(crowd, fqn).collect()))
        assert sorted(r.fqn for r in got) == want
        assert fqn != "N.T0" or n < 3 * MANY


def test_edges_are_shuffled_once_for_each_end(spark, crowd):
    tree = export.containment_tree(crowd)
    above = export.roots(tree).localCheckpoint()
    n = shuffled(spark, lambda: export.placed_edges(crowd, tree, above).write.format("noop").mode("overwrite").save())
    edges, keys = scan.dependency_edges(crowd.edges).count(), tree.count()
    assert n <= 2 * edges + 4 * keys


def test_rolled_as_by_its_parts(spark):
    g = orchard().graph(spark)
    tree = export.containment_tree(g)
    edges, above = export.tree_edges(g, tree), export.roots(tree)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(export.rolled_tree(g, tree, above)) == key(export.rolled_up(edges, above))
    project = tree.filter("kind = 'Project'").orderBy("name").first().name
    assert key(export.only_project(tree, g, project)[1]) == key(export.only_project(tree, edges, project)[1])


def test_cycles_by_joins_send_nothing_to_the_driver(spark, monkeypatch):
    plans, plain = [], containers.stored

    def seen(df, *args, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *args, **more)

    monkeypatch.setattr(containers, "stored", seen)
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("b", "c", 4)], "from string, to string, n long")
    assert sorted(map(tuple, containers.components_by_colour(edges).collect())) == [("a", "a"), ("b", "a")]
    inside = edges.filter("to <> 'c'").select(F.lit("a").alias("c1"), "from", "to", "n")
    assert [(r.path, r.weight) for r in containers.stepped(inside).collect()] == [(["a", "b", "a"], 3)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_the_build_joins_ids_not_names(spark):
    """What orders and items are joined with is a key and 16 bytes; the edges are those of the views as they stand."""
    sf_dir, dialect = "/root/testdata/sf0.001", testgraphs.Dialect(spark=True)
    views = testgraphs.by_keys(testgraphs.ctes(dialect, lambda name: "{" + name + "}"), dialect)
    for piece in views["edges"].split("UNION ALL")[:2]:
        assert "fqn" not in piece and "sha2" not in piece
    plain = testgraphs.ctes(dialect, lambda name: f"parquet.`{sf_dir}/{name}.parquet`")
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in plain.items())
    want = spark.sql(f"WITH {head}\nSELECT * FROM edges")
    made = testgraphs.projected(spark, sf_dir).edges.distinct()
    assert made.count() == want.count() > 6000 and not made.exceptAll(want.select(made.columns)).take(1)


def test_eviction_shuffles_ids_as_bytes(spark):
    g = Graph(spark.createDataFrame([("0" * 31 + "a", "Class", "A", "A", "a.cs", None, None), ("odd", "Class", "B", "B", "b.cs", None, None)], schema.NODES), spark.createDataFrame([("0" * 31 + "a", "odd", "Calls"), ("odd", "0" * 31 + "a", "Calls"), ("lost", "odd", "Calls")], schema.EDGES))
    left = incremental.evict(g, spark.createDataFrame([("a.cs",)], "path string")).edges
    assert sorted(map(tuple, left.collect())) == [("lost", "odd", "Calls"), ("odd", "0" * 31 + "a", "Calls")]
    assert "unhex" in left._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_that_lead_nowhere_do_not_shuffle_edges(spark, monkeypatch):
    """2,000 callers that nobody calls: the second level is no join with all edges."""
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", 0)
    edges = spark.createDataFrame([(f"c{k}", "t", "Calls") for k in range(2000)], schema.EDGES)
    seeds, got = spark.createDataFrame([("t",)], "id string"), []
    one, two = (shuffled(spark, lambda d=d: got.append(sorted(map(tuple, traverse.two_nearest(edges, seeds, "incoming", d).collect())))) for d in (1, 2))
    assert got[0] == got[1] and len(got[0]) == 2001
    assert two - one < 3000


def compiled_rows(spark, df) -> list[str]:
    """The steps of a plan that make rows of arrays in a compiled loop, which holds all of them before the first is passed on."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.filter("true")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "Generate explode" in plan
    return re.findall(r"\*\(\d+\) Generate explode.*", plan)


def test_pairs_are_made_one_by_one(spark):
    """Blocks of 4,096 calls and endpoints give 16 million pairs; no task holds them at once."""
    calls, ends = (spark.range(300).select(F.concat(F.lit(x), "id").alias(f"{name}_id"), F.lit("r").alias("route")) for x, name in (("c", "call"), ("e", "endpoint")))
    pairs = linker.expanded(calls, ends)
    assert not compiled_rows(spark, pairs)
    assert pairs.distinct().count() == pairs.count() == 90_000
    left = spark.createDataFrame([(f"c{k}", ["a", "{x}"]) for k in range(30)], "call_id string, segs array<string>")
    right = spark.createDataFrame([(f"e{k}", ["{x}", str(k)]) for k in range(20)], "endpoint_id string, endpoint_segs array<string>")
    pairs = linker.unfolded(left, right, ["n"])
    assert not compiled_rows(spark, pairs)
    assert pairs.distinct().count() == pairs.count() == 600


def test_rows_with_long_texts_are_made_one_by_one(spark):
    """100 calls of one route whose conflicts are one long text: a task holds the text once, not once for each call of a block."""
    nodes = spark.createDataFrame([(f"e{k}", f"GET /{k:04}") for k in range(200)], "id string, fqn string")
    targets = nodes.select(F.lit("r").alias("route"), F.col("id").alias("endpoint_id"))
    sites = spark.range(100).select(F.when(F.col("id") < 99, "r").otherwise("alone").alias("route"), F.concat(F.lit("POST c"), "id").alias("fqn"))
    got = queries.with_names(sites, targets, nodes, "conflicts")
    assert not compiled_rows(spark, got)
    text = " | ".join(f"GET /{k:04}" for k in range(200))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((f"POST c{k}", text if k < 99 else None) for k in range(100)), key=str)


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_pruning_shuffles_ids_as_bytes(spark):
    ids = {k: f"{k:032x}" for k in range(4)}
    nodes = spark.createDataFrame([(i, "Class", "A", "A", None, None, None) for i in (ids[0], ids[1], "odd")], schema.NODES)
    edges = spark.createDataFrame([(ids[0], ids[1], "Calls"), (ids[0], "odd", "Calls"), ("odd", ids[0], "Calls"), (ids[0], ids[2], "Calls"), (ids[3], ids[0], "Calls"), ("lost", "odd", "Calls")], schema.EDGES)
    left = scan.without_dangling(Graph(nodes, edges)).edges
    assert sorted(map(tuple, left.collect())) == [(ids[0], ids[1], "Calls"), (ids[0], "odd", "Calls"), ("odd", ids[0], "Calls")]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("unhex") >= 4


def test_a_save_leaves_no_shuffle_files(spark, tmp_path):
    g = orchard().graph(spark)
    before = shuffle_files(spark)
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(g, spark.createDataFrame([], schema.FILES), {})
    store.derived("kinds", lambda graph: scan.kind_counts(graph.edges))
    for _ in range(20):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.5)
    assert not shuffle_files(spark) - before


def test_rolled_up_edges_are_not_shuffled_for_names(spark, small):
    """Names come before edges are counted, by nodes; afterwards nothing is joined."""
    plan = queries.rollup_to_types(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")


def site(kind: str, k: int, name: str, verb: str = "GET") -> tuple:
    fqn = f"{verb} {name}" if kind == "Endpoint" else f"{verb} {k}.ts:1:1"
    return (f"{kind[0]}{k}" if k % 2 else f"{k:032x}", kind, name, fqn, None, None, None)


def test_link_edges_are_made_one_by_one(spark):
    rows = [site("Endpoint", k, f"/api/x/{k}") for k in range(10)] + [site("FrontendCallSite", k, "/x/{*}") for k in range(10, 30)]
    nodes = spark.createDataFrame(rows, schema.NODES)
    edges = linker.link_edges(linker.links(nodes))
    assert not compiled_rows(spark, edges)
    assert sorted(map(tuple, edges.collect())) == sorted((c[0], e[0], "CallsEndpoint") for c in rows[10:] for e in rows[:10])


def test_a_linked_graph_is_saved_from_bytes(spark, tmp_path):
    """Ids become bytes before pairs are made, not once for each pair, and come back as they were."""
    rows = [site("Endpoint", k, f"/api/x/{k}") for k in range(10)] + [site("FrontendCallSite", k, "/x/{*}") for k in range(10, 30)]
    g = Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame([(rows[0][0], "odd", "HandledBy"), (rows[12][0], rows[1][0], "CallsEndpoint")], schema.EDGES))
    made, _ = linker.relinked(g, as_bytes=True)
    assert {t for c, t in made.edges.dtypes if c != "kind"} == {"binary"} and not compiled_rows(spark, made.edges)
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(made, spark.createDataFrame([], schema.FILES), {})
    want = sorted([(c[0], e[0], "CallsEndpoint") for c in rows[10:] for e in rows[:10]] + [(rows[0][0], "odd", "HandledBy")])
    assert sorted(map(tuple, store.load().edges.collect())) == sorted(map(tuple, store.load().incoming.collect())) == want
