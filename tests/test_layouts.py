"""Intervals of the containment tree, tables kept beside a graph, edges by what they lead to, and scopes of scratch tables."""

import os
import random
import threading

from graphs import orchard, stairs
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import export, incremental, scan
from loomgraph.plans import jobs
from loomgraph.schema import Graph
from loomgraph.sources import scratch
from loomgraph.sources.store import GraphStore


def test_labels_of_a_random_tree(spark):
    """A broad, a deep and a random part, two roots, and rows that hang below themselves or below nothing."""
    r = random.Random(9)
    parent = {"a": None, "z": None, **{f"b{k:03}": "a" for k in range(150)}, **{f"d{k:02}": f"d{k - 1:02}" if k else "z" for k in range(25)}}
    for k in range(200):
        parent[f"r{k:03}"] = r.choice(list(parent))
    kind = {k: "Project" if p is None else r.choice(["Namespace", "Class", "Method"]) for k, p in parent.items()}
    rows = [(k, kind[k], p) for k, p in parent.items()] + [("loop1", "Class", "loop2"), ("loop2", "Class", "loop1"), ("lost", "Class", "nowhere")]
    labels = export.labelled(spark.createDataFrame(rows, "key string, kind string, parent string").repartition(5))
    got = {x.key: x for x in labels.collect()}
    assert set(got) == set(parent)

    def path(k):
        return [*path(parent[k]), k] if parent[k] else [k]

    assert {k: list(x.path) for k, x in got.items()} == {k: path(k) for k in parent}
    assert sorted(x["first"] for x in got.values()) == list(range(len(parent)))
    for k, x in got.items():
        below = {y for y in parent if k in path(y)}
        assert {y for y, v in got.items() if x["first"] <= v["first"] <= x["last"]} == below
    assert {x.key for x in export.subtree(labels, "d05").collect()} == {y for y in parent if "d05" in path(y)}
    assert export.subtree(labels, "nobody").count() == 0
    assert {x.key: x.up for x in export.above(labels, 2).collect()} == {k: path(k)[:2][-1] for k in parent}
    nearest = {k: next((y for y in reversed(path(k)) if kind[y] == "Class"), path(k)[0]) for k in parent}
    assert {x.key: x.up for x in export.above(labels, ("Class",)).collect()} == nearest


def test_no_tree(spark):
    assert export.labelled(spark.createDataFrame([], "key string, kind string, parent string")).collect() == []


def test_a_derived_table_is_made_once_a_version(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    made = []

    def count(graph):
        made.append(1)
        return graph.nodes.agg(F.count("*").alias("n"))

    assert store.derived("size", count).first().n == 0  # no graph yet: nothing to keep it beside
    g = orchard().graph(spark)
    files = spark.createDataFrame([], schema.FILES)
    store.save(g, files, {})
    assert [store.derived("size", count).first().n for _ in range(3)] == [g.nodes.count()] * 3 and len(made) == 2
    old = store.version()
    store.save(stairs(4).graph(spark), files, {})
    assert store.derived("size", count).first().n == 5 and len(made) == 3
    assert store.vacuum() == 1 and not os.path.exists(f"{store.root}/{old}")
    tree, labels = jobs.containment(store)
    assert tree.count() == labels.count() > 0


def test_edges_are_laid_out_both_ways(spark, tmp_path):
    """A lookup of what leads to a node reads the edges that are sorted so; both tables hold the same edges."""
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(stairs(60).graph(spark), spark.createDataFrame([], schema.FILES), {})
    g = store.load()
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, g.incoming.collect()))
    one = g.nodes.filter("fqn = 'Tower.Step7(bool)'").first().id
    found = scan.edges_of(g, one, "incoming")
    plan = found._jdf.queryExecution().toString()
    assert "/incoming" in "".join(found.inputFiles()) and "EqualTo(target_id" in plan
    assert [x.kind for x in found.collect()] == ["Calls"]
    ends = [x.target_id for x in spark.read.parquet(sorted(f for f in found.inputFiles() if "kind=Calls" in f)[0]).collect()]
    assert ends == sorted(ends)
    assert Graph(g.nodes, g.edges).towards("incoming") is g.edges


def test_of_several_rows_with_one_id_the_least_stays(spark):
    rows = [("i", "Class", n, "N.A", f, 1, 2) for n, f in (("b", "y"), ("a", "z"), ("a", "x"))]
    second = Graph(spark.createDataFrame(rows, schema.NODES).repartition(3), spark.createDataFrame([], schema.EDGES))
    first = Graph(second.nodes.limit(0), second.edges)
    assert [(x.name, x.file) for x in incremental.merge(first, second).nodes.collect()] == [("a", "x")]


def test_threads_have_scopes_of_their_own(spark):
    """What a thread stores while another has a scope open stays when that scope ends."""
    kept, ready, go = [], threading.Event(), threading.Event()

    def job():
        ready.wait(60)
        with scratch.temporaries(spark):
            kept.append(scratch.stored(spark.range(5).toDF("id"), "thread", keep=True))
        go.set()

    other = threading.Thread(target=job)
    other.start()
    with scratch.temporaries(spark):
        own = scratch.stored(spark.range(3).toDF("id"), "own")
        ready.set()
        go.wait(60)
        path = own.inputFiles()[0]
    other.join()
    assert kept[0].count() == 5 and not os.path.exists(path.removeprefix("file://"))


def test_a_graph_saved_with_one_layout(spark, tmp_path):
    """Repeated edges are a set, which takes one shuffle of theirs; lookups by target read the edges by source."""
    g, store = orchard().graph(spark), GraphStore(spark, str(tmp_path / "g"))
    twice = Graph(g.nodes, g.edges.unionByName(g.edges).repartition(5))
    store.save(twice, spark.createDataFrame([], schema.FILES), {}, both=False)
    assert not os.path.exists(f"{store.root}/{store.version()}/incoming")
    kept, rows = store.load(), sorted(map(tuple, g.edges.collect()))
    assert sorted(map(tuple, kept.edges.collect())) == sorted(map(tuple, kept.towards("incoming").collect())) == rows
    assert store.fingerprint()[1][0] == len(rows)
