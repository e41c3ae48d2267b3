"""The weighted graph of containers (projects or namespaces): coupling, components and cycles."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from ..sources.scratch import rows_of, stored, temporaries
from .attribute import namespace_of_nodes, project_of_nodes
from .scan import dependency_edges

#: Container edges up to which cycles are searched on the driver; they are counted first.
DRIVER_EDGES = 200_000


def container_edges(graph: Graph, scope: str = "project") -> DataFrame:
    """(from, to, n): dependency edges between different containers."""
    if scope not in ("project", "namespace"):
        raise ValueError("scope is project or namespace")
    of = project_of_nodes(graph.nodes) if scope == "project" else namespace_of_nodes(graph.nodes)
    left = of.select(F.col("id").alias("source_id"), F.col("container").alias("from"))
    right = of.select(F.col("id").alias("target_id"), F.col("container").alias("to"))
    joined = dependency_edges(graph.edges).join(left, "source_id").join(right, "target_id")
    return crossing(joined)


def crossing(rows: DataFrame) -> DataFrame:
    """(from, to, n) of rows with from and to that are known and differ."""
    return rows.filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of more than one node of edges (from, to), named by their least node."""
    edges = stored(edges.select("from", "to").filter(F.col("from") != F.col("to")).distinct(), "containers")
    if rows_of(edges) > DRIVER_EDGES:
        return components_by_colour(edges)
    pairs = [(r["from"], r["to"]) for r in edges.collect()]
    rows = [(node, min(group)) for group in strong_groups(pairs) if len(group) > 1 for node in group]
    return edges.sparkSession.createDataFrame(rows, "node string, component string")


def strong_groups(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected groups, by path-based depth-first search without recursion."""
    after = defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
        after.setdefault(b, [])
    order: dict[str, int] = {}
    group: dict[str, int] = {}
    out: list[list[str]] = []
    open_nodes: list[str] = []
    bounds: list[str] = []
    for root in sorted(after):
        if root in order:
            continue
        work = [(root, iter(after[root]))]
        order[root] = len(order)
        open_nodes.append(root)
        bounds.append(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = len(order)
                    open_nodes.append(nxt)
                    bounds.append(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt not in group:
                    while order[bounds[-1]] > order[nxt]:
                        bounds.pop()
            else:
                work.pop()
                if bounds[-1] == node:
                    bounds.pop()
                    own = []
                    while True:
                        x = open_nodes.pop()
                        group[x] = len(out)
                        own.append(x)
                        if x == node:
                            break
                    out.append(own)
    return out


def components_by_colour(edges: DataFrame) -> DataFrame:
    """components() without the driver: colours spread forwards, and what reaches a colour's root backwards within it is its component."""
    with temporaries(edges.sparkSession):
        return stored(coloured(edges), "components", keep=True)


def coloured(edges: DataFrame) -> DataFrame:
    """The rows of components_by_colour(). Joins are by shuffling: the tables may look small, as names compress well, and broadcasts of all rounds would add up on the driver."""
    edges = stored(edges.select("from", "to").filter(F.col("from") != F.col("to")).distinct(), "edges")
    left, found = edges, None
    while rows_of(left):
        nodes = left.select(F.col("from").alias("node")).unionByName(left.select(F.col("to").alias("node"))).distinct()
        colours = stored(nodes.withColumn("colour", F.col("node")), "colours")
        while True:  # each node takes the least colour that leads to it
            spread = left.join(colours.withColumnRenamed("node", "from").hint("merge"), "from").groupBy(F.col("to").alias("node")).agg(F.min("colour").alias("new"))
            now = stored(colours.join(spread.hint("merge"), "node", "left").select("node", F.least("colour", "new").alias("colour")), "colours")
            changed = now.join(colours.withColumnRenamed("colour", "before").hint("merge"), "node").filter(F.col("colour") != F.col("before")).take(1)
            colours = now
            if not changed:
                break
        own = left.join(colours.withColumnRenamed("node", "from").withColumnRenamed("colour", "c1").hint("merge"), "from").join(colours.withColumnRenamed("node", "to").withColumnRenamed("colour", "c2").hint("merge"), "to").filter("c1 = c2").select("from", "to")
        inside = stored(own, "own")
        reached = stored(colours.filter(F.col("node") == F.col("colour")), "reached")
        frontier = reached
        while rows_of(frontier):
            back = inside.join(frontier.withColumnRenamed("node", "to").hint("merge"), "to").select(F.col("from").alias("node"), "colour").distinct()
            frontier = stored(back.join(reached.hint("merge"), ["node", "colour"], "left_anti"), "frontier")
            reached = stored(reached.unionByName(frontier), "reached")
        found = reached if found is None else stored(found.unionByName(reached), "found")
        done = reached.select("node")
        left = stored(left.join(done.withColumnRenamed("node", "from").hint("merge"), "from", "left_anti").join(done.withColumnRenamed("node", "to").hint("merge"), "to", "left_anti"), "left")
    if found is None:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    sizes = found.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).filter("n > 1")
    return found.join(sizes.hint("merge"), "colour").select("node", "component")


def witness(members: set[str], after: dict[str, list[str]]) -> list[str]:
    """One cycle through the least member: depth first, neighbours in order, closed as soon as it can be."""
    start = min(members)
    path, seen, work = [start], {start}, [iter(sorted(after[start]))]
    while work:
        for nxt in work[-1]:
            if nxt not in members:
                continue
            if nxt == start:
                return [*path, start]
            if nxt not in seen:
                # A node that failed once can't lead back by another way that the search hasn't tried.
                seen.add(nxt)
                path.append(nxt)
                work.append(iter(sorted(after[nxt])))
                break
        else:
            work.pop()
            path.pop()
    return []


def stepped(inside: DataFrame) -> DataFrame:
    """(path, hops, weight) as witness() gives them, of edges inside components (c1, from, to, n), a step of all components a join.

    A component's row is its path and what was seen; a step goes to the least neighbour that wasn't, or back where there is none.
    Joins are by shuffling, as in coloured().
    """
    edges = inside.select("c1", F.col("from").alias("end"), "to", "n")
    ways = F.array(F.struct(F.col("c1").alias("to"), F.lit(0).cast("long").alias("n")))
    now = stored(inside.select("c1").distinct().select("c1", ways.alias("path"), F.array("c1").alias("seen")), "ways")
    found = None
    while rows_of(now):
        open_ = now.withColumn("end", F.element_at("path", -1)["to"])
        tried = open_.join(edges.hint("merge"), ["c1", "end"]).filter((F.col("to") == F.col("c1")) | ~F.array_contains("seen", F.col("to")))
        chosen = stored(tried.groupBy("c1").agg(F.min(F.struct("to", "n")).alias("step")), "steps")
        moved = stored(open_.drop("end").join(chosen.hint("merge"), "c1", "left"), "moves")
        closed = moved.filter(F.col("step.to") == F.col("c1")).select(F.array_append("path", F.col("step")).alias("path"))
        found = closed if found is None else found.unionByName(closed)
        on = moved.filter("step is not null and step.to <> c1").select("c1", F.array_append("path", F.col("step")).alias("path"), F.array_append("seen", F.col("step.to")).alias("seen"))
        back = moved.filter("step is null").select("c1", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), "seen")
        now = stored(on.unionByName(back), "ways")
    names = F.transform("path", lambda x: x["to"])
    weight = F.aggregate("path", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return found.select(names.alias("path"), (F.size("path") - 1).alias("hops"), weight.alias("weight"))


def cycles(edges: DataFrame) -> DataFrame:
    """(path, hops, weight): one cycle for each component of edges (from, to, n), heaviest first.

    Only edges inside components come to the driver, and no more than DRIVER_EDGES of them, which are counted; where there are
    more, the same cycles are found by joins.
    """
    edges = stored(edges, "weighted")
    order = F.desc("weight"), F.desc("hops"), "path"
    named = components(edges)
    c1, c2 = (named.select(F.col("node").alias(end), F.col("component").alias(c)).hint("merge") for end, c in (("from", "c1"), ("to", "c2")))
    inside = edges.join(c1, "from").join(c2, "to").filter("c1 = c2")
    inside = stored(inside.select("c1", "from", "to", "n"), "inside")
    if rows_of(inside) > DRIVER_EDGES:
        return stepped(inside).orderBy(*order)
    after, weight, members = defaultdict(list), {}, defaultdict(set)
    for r in inside.collect():
        after[r["from"]].append(r["to"])
        weight[r["from"], r["to"]] = r["n"]
        members[r["c1"]] |= {r["from"], r["to"]}
    found = []
    for group in members.values():
        path = witness(group, after)
        found.append((path, len(path) - 1, sum(weight[x] for x in zip(path, path[1:], strict=False))))
    return edges.sparkSession.createDataFrame(found, "path array<string>, hops int, weight long").orderBy(*order)
