"""Search of names through their runs of characters, lines through blocks of texts, and fingerprints kept with a graph."""

import random

import pytest
from graphs import orchard, stairs
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import names, scan, source_text
from loomgraph.plans import jobs
from loomgraph.plans.tools import Tools
from loomgraph.schema import Graph
from loomgraph.sources import store as stores
from loomgraph.sources.store import GraphStore


@pytest.fixture(scope="module")
def town(spark, tmp_path_factory):
    """A store with 1,200 names that share many runs, and some odd ones."""
    r = random.Random(4)
    words = ["Order", "order", "Line", "Cart", "Ship", "a_b", "100%", "İs", "ΟΔΟΣ", "x\\y", "𝒳y", ""]
    texts = {"".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(400)} | {f"Order{k}Line" for k in range(800)}
    rows = [(f"{k:04}", r.choice(["Class", "Method"]), t[-12:], f"N.{t}", None, None, None) for k, t in enumerate(sorted(texts))]
    store = GraphStore(spark, str(tmp_path_factory.mktemp("town") / "g"))
    store.save(Graph(spark.createDataFrame(rows, schema.NODES).repartition(3), spark.createDataFrame([], schema.EDGES)), spark.createDataFrame([], schema.FILES), {"last_analyzed": "x"})
    return store


QUERIES = ("order", "a_b", "rd%ine", "or", "%", "", "100%", "İs", "ΟΔΟΣ", "οδοσ", "x\\y", "𝒳y", "nowhere", "ordership%cart")


def test_the_index_finds_what_a_scan_finds(town):
    index, nodes = names.keep_index(town), town.load().nodes
    for query in QUERIES:
        for kind, limit in ((None, 21), ("Class", 3)):
            want = [r.id for r in scan.find_symbols(nodes, query, limit, kind).collect()]
            assert [r.id for r in names.find_symbols(index, query, limit, kind).collect()] == want, (query, kind)


def test_candidates_beyond_the_first(town, monkeypatch):
    """Few are read at first, and most don't pass the test, so the others are joined."""
    monkeypatch.setattr(names, "FIRST", 5)
    index, nodes = names.keep_index(town), town.load().nodes
    for query in ("order_9%line", "line_", "order%7%line"):
        want = [r.id for r in scan.find_symbols(nodes, query, 21).collect()]
        assert [r.id for r in names.find_symbols(index, query, 21).collect()] == want and want


def test_candidates_are_read_by_number(town):
    found = names.find_symbols(names.keep_index(town), "order799", 21)
    plan = found._jdf.queryExecution().toString()
    assert "/names" in "".join(found.inputFiles()) and "slot" in plan.split("PushedFilters")[1].split("]")[0]
    assert [r.fqn for r in found.collect()] == ["N.Order799Line"]


def test_slots_follow_the_order_of_answers(town):
    index = names.keep_index(town)
    rows = [(len(r.fqn), r.fqn, r.id) for r in index.names.orderBy("slot").collect()]
    assert rows == sorted(rows, key=lambda x: (x[0], x[1].encode(), x[2])) and len(rows) == town.load().nodes.count()
    posted = index.postings.collect()
    assert len(posted) == len(set(posted)) == sum(r.n for r in index.counts.collect())


def test_tools_use_the_index_of_the_current_version(spark, tmp_path, monkeypatch):
    store, files = GraphStore(spark, str(tmp_path / "g")), spark.createDataFrame([], schema.FILES)
    store.save(orchard().graph(spark), files, {"last_analyzed": "x"})
    assert names.kept_index(store) is None
    want = Tools(store).call("find_symbol", {"query": "apple"}).rows.collect()
    assert jobs.index_names(store) == store.load().nodes.count()
    monkeypatch.setattr(scan, "find_symbols", lambda *_: pytest.fail("scanned"))
    assert Tools(store).call("find_symbol", {"query": "apple"}).rows.collect() == want and len(want) == 2
    assert [r.fqn for r in Tools(store).call("find_usages", {"fqn": "Lost.Hedge"}).rows.collect()] == ["Grove.Trees.Hedge", "Grove.Trees.Hedge.Prune(int)"]
    monkeypatch.undo()
    store.save(stairs(3).graph(spark), files, {"last_analyzed": "x"})
    assert names.kept_index(store) is None
    assert Tools(store).call("find_symbol", {"query": "step"}).rows.count() == 3


def test_no_names(spark):
    empty = names.numbered(spark.createDataFrame([], schema.NODES))
    index = names.Index(empty, names.posted(empty), names.counted(names.posted(empty)))
    for query in ("order", "o", ""):
        assert names.find_symbols(index, query, 5).collect() == []


# ---------------------------------------------------------------- lines


def test_lines_of_places_in_texts_of_all_lengths(spark):
    """Around the ends of blocks and of texts, with characters beyond the basic plane; nulls and files without a text have no line."""
    r, size = random.Random(7), source_text.BLOCK
    texts = {"none": None, "empty": "", "breaks": "\n" * (2 * size)}
    for n in (1, size - 1, size, size + 1, 2 * size, 3 * size + 17):
        texts[f"t{n}"] = "".join(r.choice("ab𝒳\r\n") for _ in range(n))
    places = [(f, at) for f in (*texts, "missing", None) for at in (None, -1, 0, 1, size - 1, size, size + 1, 2 * size - 1, 2 * size, 2 * size + 1, 3 * size + 17, 3 * size + 18, 9 * size)]
    rows = spark.createDataFrame([(k, f, at) for k, (f, at) in enumerate(places)], "k int, file string, span_start int")
    got = {x.k: x.line for x in source_text.with_lines(rows, spark.createDataFrame(list(texts.items()), schema.SOURCES)).collect()}
    assert len(got) == len(places)
    for k, (f, at) in enumerate(places):
        text = texts.get(f)
        inside = text is not None and at is not None and 0 <= at <= len(text)
        assert got[k] == (text[:at].count("\n") + 1 if inside else None), (f, at)


def test_blocks_make_up_the_text(spark):
    text = "".join(random.Random(1).choice("xyz\n") for _ in range(5 * source_text.BLOCK + 3))
    rows = source_text.blocks(spark.createDataFrame([("f", text), ("n", None)], schema.SOURCES)).orderBy("block").collect()
    assert "".join(x.chunk for x in rows) == text and {x.path for x in rows} == {"f"} and len(rows) == 6


def test_texts_are_not_joined_to_symbols(spark):
    """The side of the join that holds texts holds blocks."""
    rows = spark.createDataFrame([("f", 3)], "file string, span_start int")
    plan = source_text.with_lines(rows, spark.createDataFrame([("f", "a\nb\n")], schema.SOURCES))._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan.split("Join LeftOuter")[1].splitlines()[0]


def test_tools_show_rows_in_order_with_lines(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(orchard().graph(spark), spark.createDataFrame([], schema.FILES), {"last_analyzed": "x"})
    sources = spark.createDataFrame([(f"C:/land/Grove/{n}.cs", "a\nb\nc\nd") for n in ("Apple", "Tree")], schema.SOURCES)
    rows = Tools(store, sources).call("find_implementations", {"fqn": "Grove.Trees.IPlant"}).rows.collect()
    assert [(x.fqn.removeprefix("Grove.Trees."), x.line) for x in rows] == [("Apple", 1), ("Hedge", None), ("Tree", 1)]


# ---------------------------------------------------------------- fingerprints


def test_the_kept_fingerprint_is_that_of_the_rows(spark, tmp_path):
    store, files = GraphStore(spark, str(tmp_path / "g")), spark.createDataFrame([], schema.FILES)
    for g in (orchard().graph(spark), stairs(0).graph(spark), Graph(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES))):
        twice = Graph(g.nodes.union(g.nodes).repartition(3), g.edges.union(g.edges).repartition(3))
        store.save(twice, files, {})
        assert store.fingerprint() == stores.fingerprint(g) == stores.fingerprint(store.load(tolerant=False))
        assert not store.save_if_changed(twice, files, {})


def test_other_graphs_are_told_apart_without_reading_the_stored_one(spark, tmp_path, monkeypatch):
    store, files = GraphStore(spark, str(tmp_path / "g")), spark.createDataFrame([], schema.FILES)
    g = orchard().graph(spark)
    store.save(g, files, {})
    assert store.has("fingerprint")
    monkeypatch.setattr(store, "load", lambda **_: pytest.fail("read"))
    renamed = Graph(g.nodes.withColumn("name", F.when(F.col("name") == "Apple", "Pear").otherwise(F.col("name"))), g.edges)
    assert store.save_if_changed(renamed, files, {})
    assert store.save_if_changed(Graph(renamed.nodes, g.edges.filter("kind <> 'Inherits'")), files, {})
    monkeypatch.undo()
    assert not store.save_if_changed(Graph(renamed.nodes, g.edges.filter("kind <> 'Inherits'")), files, {})


def test_a_version_without_fingerprint(spark, tmp_path):
    store, files = GraphStore(spark, str(tmp_path / "g")), spark.createDataFrame([], schema.FILES)
    g = orchard().graph(spark)
    store.save(g, files, {})
    store._fs.delete(store._path(f"{store.version()}/fingerprint"), True)
    assert not store.has("fingerprint") and not store.save_if_changed(g, files, {})
