"""Routes with many patterns of holes: the walk down the trie against comparing all pairs, and against the join by patterns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from graphs import node
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import routes
from loomgraph.operators import linker
from loomgraph.sources.scratch import blocks


def frames(spark, calls, ends):
    c = spark.createDataFrame([(f"c{k}", v, "/".join(s), list(s)) for k, (v, s) in enumerate(calls)], "call_id string, verb string, skeleton string, segs array<string>")
    e = spark.createDataFrame([(f"e{k}", v, list(s)) for k, (v, s) in enumerate(ends)], "endpoint_id string, endpoint_verb string, endpoint_segs array<string>")
    return c, e


def matching(calls, ends, same_verb):
    def fit(a, b):
        return len(a) == len(b) and all(x == y or routes.HOLE in (x, y) for x, y in zip(a, b))

    return sorted((f"c{i}", f"e{j}") for i, (v, a) in enumerate(calls) for j, (w, b) in enumerate(ends) if fit(a, b) and (v == w or not same_verb))


def routes_of(r, many, sizes, holes, words="ab"):
    return [(r.choice(["GET", "PUT"]), tuple(routes.HOLE if r.random() < holes else r.choice(words) for _ in range(r.choice(sizes)))) for _ in range(many)]


@pytest.mark.parametrize("same_verb", [True, False])
def test_the_walk_finds_all_pairs(spark, monkeypatch, same_verb):
    """Routes of several lengths, repeated ones, all holes, blank ones, and segments that look like the walk's own keys."""
    r = random.Random(11)
    odd = [("GET", ("",)), ("GET", (routes.HOLE,)), ("PUT", (routes.HOLE,) * 4), ("GET", ("any", "=a")), ("GET", ("=any", "a")), ("GET", (routes.HOLE, "a"))]
    calls, ends = routes_of(r, 60, (1, 2, 4), 0.2) + odd * 2, routes_of(r, 60, (1, 2, 4, 5), 0.4) + odd * 2
    c, e = frames(spark, calls, ends)
    by_patterns = linker.meets(c, e, same_verb)
    monkeypatch.setattr(linker, "PATTERNS", 0)
    by_walk = linker.meets(c, e, same_verb)
    assert sorted(by_walk.columns) == sorted(by_patterns.columns)
    for found in (by_patterns, by_walk):
        assert sorted((x.call_id, x.endpoint_id) for x in found.collect()) == matching(calls, ends, same_verb)


def test_rows_of_a_walk_grow_with_routes_not_with_patterns(spark, monkeypatch):
    """Of ten segments any may be a hole: of 1,024 patterns there are hundreds, which the join by patterns would make rows of."""
    r = random.Random(5)
    calls, ends = routes_of(r, 300, (10,), 0.1, "abcdefgh"), routes_of(r, 400, (10,), 0.5, "abcdefgh")
    assert len({tuple(s == routes.HOLE for s in e) for _, e in ends}) > linker.PATTERNS
    sizes, store = [], linker.stored

    def counting(df, label):
        out = store(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(linker, "stored", counting)
    found = linker.meets(*frames(spark, calls, ends), same_verb=False)
    assert sorted((x.call_id, x.endpoint_id) for x in found.collect()) == matching(calls, ends, False)
    assert max(sizes) <= 2 * 10 * 400  # the trie itself; 300 calls by patterns would be some 100,000 rows


def test_no_endpoints_and_no_calls(spark, monkeypatch):
    monkeypatch.setattr(linker, "PATTERNS", -1)
    some = [("GET", ("a", "b"))]
    for calls, ends in ((some, []), ([], some), ([], [])):
        assert linker.meets(*frames(spark, calls, ends), same_verb=True).count() == 0


def test_outcomes_are_the_same(spark, monkeypatch):
    r = random.Random(2)
    ends = {f"{v} /api/{'/'.join(s).replace(routes.HOLE, '{id}')}" for v, s in routes_of(r, 25, (2, 3), 0.3, "abcd")}
    rows = [(*node("Endpoint", e)[:2], e.split(" ")[1], e, None, None, None) for e in sorted(ends)]
    for k, (v, s) in enumerate(routes_of(r, 60, (2, 3), 0.2, "abcd")):
        fqn = f"{v} f{k}.ts:1:1"
        rows.append((*node("FrontendCallSite", fqn)[:2], "/" + "/".join(s), fqn, None, None, None))
    nodes = spark.createDataFrame(rows, schema.NODES)
    columns = ["call_id", "outcome", F.array_sort("endpoints").alias("endpoints"), F.array_sort("conflicts").alias("conflicts")]
    want = sorted(map(tuple, linker.link(nodes).select(*columns).collect()))
    monkeypatch.setattr(linker, "PATTERNS", 0)
    assert sorted(map(tuple, linker.link(nodes).select(*columns).collect())) == want and len({x[1] for x in want}) >= 4


def test_what_links_store_grows_with_routes_not_with_pairs(spark, monkeypatch):
    """Calls of one route share their endpoints: 120 calls with a hole and 120 endpoints are 14,400 edges, of which none is stored."""
    rows = [(*node("Endpoint", f"GET /api/en/{k}")[:2], f"/api/en/{k}", f"GET /api/en/{k}", None, None, None) for k in range(120)]
    rows += [(*node("FrontendCallSite", f"{v} p{k}.ts:1:1")[:2], "/en/{*}", f"{v} p{k}.ts:1:1", None, None, None) for v in ("GET", "PUT") for k in range(120)]
    nodes = spark.createDataFrame(rows, schema.NODES)
    sizes, store = [], linker.stored

    def counting(df, label):
        out = store(df, label)
        values = sum((F.size(c) if t.startswith("array") else F.lit(1) for c, t in out.dtypes), F.lit(0))
        sizes.append(out.agg(F.sum(values)).first()[0] or 0)
        return out

    monkeypatch.setattr(linker, "stored", counting)
    graph, sites = linker.relinked(schema.Graph(nodes, spark.createDataFrame([], schema.EDGES)))
    assert graph.edges.count() == graph.edges.distinct().count() == 120 * 120
    assert {(r.outcome, r.n) for r in linker.outcome_counts(sites).collect() if r.n} == {("SetEdge", 120), ("VerbMismatch", 120)}
    assert max(sizes) <= 10 * len(rows)


def test_blocks_hold_all_values_of_a_key(spark):
    rows = spark.createDataFrame([("many", k) for k in range(500)] + [("few", k) for k in range(3)], "key string, value int")
    found = blocks(rows, "key", "value", 50).collect()
    assert sorted(v for r in found if r.key == "many" for v in r.value) == list(range(500))
    assert [sorted(r.value) for r in found if r.key == "few"] == [[0, 1, 2]] and max(len(r.value) for r in found) < 120


def test_pairs_of_many_patterns_are_not_stored(spark, monkeypatch):
    """Most segments are holes, so most of 90,000 pairs match: calls and endpoints meet in chunks, each route's many ids too, and no pair is stored."""
    r = random.Random(3)
    calls, ends = routes_of(r, 250, (8,), 0.8, "abc") + [("GET", ("a",) * 8)] * 50, routes_of(r, 250, (8,), 0.8, "abc") + [("GET", (routes.HOLE,) * 8)] * 50
    sizes, store = [], linker.stored

    def counting(df, label):
        out = store(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(linker, "stored", counting)
    for name, value in (("CHUNK", 64), ("BITS", 1000), ("PAIRS", 500)):
        monkeypatch.setattr(linker, name, value)
    c, e = frames(spark, calls, ends)
    for same_verb in (True, False):
        found, want = linker.meets(c, e, same_verb), matching(calls, ends, same_verb)
        assert sorted((x.call_id, x.endpoint_id) for x in found.collect()) == want and len(want) > 20_000
    assert max(sizes) <= 1000


def test_bits_of_routes():
    """Holes meet all; null, and what the other side doesn't spell, only holes; more endpoints than a byte holds."""
    r, values = random.Random(7), {routes.HOLE: 0}
    texts = [[r.choice([routes.HOLE, "a", "b", None]) for _ in range(3)] for _ in range(21)] + [["only"] * 3]
    calls, ends = (linker.codes(pa.array(x), values, 3) for x in (texts, texts[:19]))
    got = np.unpackbits(linker.led_to(calls, ends), axis=1, count=19).astype(bool)
    fit = lambda a, b: all(x == routes.HOLE or y == routes.HOLE or (x is not None and x == y) for x, y in zip(a, b))
    assert got.tolist() == [[fit(a, b) for b in texts[:19]] for a in texts]


def test_a_walk_finds_the_pairs_of_routes(spark, monkeypatch):
    monkeypatch.setattr(linker, "PATTERNS", 0)
    r = random.Random(13)
    calls, ends = routes_of(r, 80, (2, 4), 0.3), routes_of(r, 80, (2, 4), 0.3)
    c, e = frames(spark, calls, ends)
    found = linker.route_pairs(linker.different(c, "verb", "segs", "route"), linker.different(e, "endpoint_verb", "endpoint_segs", "end"), True)
    text = lambda x: f"{x[0]} {'/'.join(x[1])}"
    want = {(text(calls[int(a[1:])]), text(ends[int(b[1:])])) for a, b in matching(calls, ends, True)}
    rows = [(x.route, x.end) for x in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
