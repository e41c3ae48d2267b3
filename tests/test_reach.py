"""Impact where seeds have more dependents than count."""

import random
from collections import defaultdict

import pytest
from graphs import Builder
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.operators import traverse
from loomgraph.operators.scan import dependency_edges


def town(seed, n=160):
    """Members of many types of one name, some of which a crowd calls through others."""
    r, b = random.Random(seed), Builder()
    names = [("Method", f"Town.M{k:03}()") for k in range(n)]
    for kind, fqn in names:
        b.add(kind, fqn)
    crowd = names[20:]
    for k, x in enumerate(crowd):
        b.link(x, "Calls", names[r.choice([0, 1, r.randrange(20), r.randrange(n)])])
        if k % 3 == 0:
            b.link(x, "Calls", names[r.randrange(n)])
    b.add("Interface", "Town.IBell")
    for k in range(20):
        b.link(names[k], "Calls", ("Method", "Town.M000()")) if k % 4 == 3 else None
        b.link(("Class", "Away.Unknown"), "Calls", names[k])
    for k in range(6):
        b.add("Class", f"Town.Bell{k}")
        b.link(("Class", f"Town.Bell{k}"), "Implements", ("Interface", "Town.IBell"))
        b.link(names[k], "References", ("Class", f"Town.Bell{k}"))
    return b


def plain(b, seeds, depth, cap):
    """Each seed's nearest `cap` dependents by depth, name and id; whether any has so many."""
    fqn = {n[0]: n[3] for n in b.nodes.values()}
    into = defaultdict(set)
    for s, t, kind in b.edges:
        if kind != "Contains":
            into[t].add(s)
    least, cut = {}, False
    for seed in seeds:
        seen, level = {seed: 0}, {seed}
        for d in range(1, depth + 1):
            level = {s for t in level for s in into[t]} - set(seen)
            seen |= dict.fromkeys(level, d)
        rows = sorted((d, fqn[i], i) for i, d in seen.items() if i != seed and i in fqn)
        cut |= len(rows) >= cap
        for d, _, i in rows[:cap]:
            least[i] = min(d, least.get(i, d))
    return least, cut


@pytest.mark.parametrize("seed, cap", [(1, 12), (2, 40), (3, 90), (3, 10_000)])
def test_impact_equals_following_each_seed(spark, seed, cap):
    b = town(seed)
    g = b.graph(spark)
    target = b.nodes["Interface", "Town.IBell"][0]
    implementers = [b.nodes["Class", f"Town.Bell{k}"][0] for k in range(6)]
    want, cut = plain(b, [target, *implementers], 5, cap)
    want = {i: (want.get(i, 1), i in implementers) for i in {*want, *implementers} - {target}}
    found, was_cut = traverse.capped_impact(g, "Town.IBell", cap=cap)
    assert {r.id: (r.depth, r.is_implementer) for r in found.collect()} == want
    assert was_cut == cut == (cap < 100)


@pytest.fixture(scope="module")
def plaza(spark):
    """A method of a type that 10,050 others call, which is more than the tool counts."""
    b = Builder()
    b.add("Project", "Plaza", "C:/plaza/Plaza.csproj")
    b.add("Class", "Plaza.T10", "C:/plaza/T10.cs")
    b.add("Method", "Plaza.T10.Ring()", "C:/plaza/T10.cs", inside=("Class", "Plaza.T10"))
    for k in range(10_050):
        b.add("Method", f"Plaza.M{k}()", f"C:/plaza/M{k}.cs")
        b.link(("Method", f"Plaza.M{k}()"), "Calls", ("Method", "Plaza.T10.Ring()"))
        b.link(("Method", f"Plaza.M{k}()"), "Calls", ("Class", "Plaza.T10"))
    return b.graph(spark)


def test_impact_counts_all_dependents(plaza):
    found = traverse.impact(plaza, "Plaza.T10.Ring()")
    assert found.groupBy("kind", "depth", "is_implementer").count().collect() == [("Method", 1, False, 10_050)]
    assert traverse.capped_impact(plaza, "Plaza.T10.Ring()", cap=traverse.IMPACT_CAP)[1]


def test_impact_by_project_counts_all_dependents(spark, plaza, monkeypatch):
    monkeypatch.setattr(queries.testgraphs, "graph", lambda *_: plaza)
    assert sorted(map(tuple, queries.impact_by_project(spark, "").collect()), key=str) == [("Plaza", None, 10_050), (None, "Method", 10_050)]


def test_estimates_are_near_for_all_seeds(spark):
    b = town(4)
    g = b.graph(spark)
    edges = dependency_edges(g.edges)
    seeds = g.nodes.select("id")
    got = {r.id: r.n for r in traverse.reach_estimates(edges, seeds, "incoming", 3, seeds.unionByName(edges.select(F.col("source_id").alias("id")))).collect()}
    real = {r.seed: r.n for r in traverse.levels(edges, seeds, "incoming", 3).groupBy("seed").agg(F.count("*").alias("n")).collect()}
    assert all(abs(n - real.get(i, 0) - 1) <= 1 + 0.1 * n for i, n in got.items()) and max(got.values()) > 50
