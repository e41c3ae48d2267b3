"""Breadth-first traversal, closures, hierarchies and impact.

Each level is one join of a frontier with the edges, made distinct and freed of nodes seen before; it is
stored, so a level is computed once and plans don't grow. A frontier whose rows, which are counted, are
few is broadcast, so the edges aren't shuffled; a larger one is joined by shuffling both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import symbols
from ..schema import Graph
from ..sources.scratch import BROADCAST_ROWS, among, rows_of, sized, stored, temporaries
from ..sources.store import packed, unpacked
from .scan import by_kind, dependency_edges

MAX_DEPTH, MAX_RESULTS = 5, 500
#: Of one seed's dependents the tool for impact analysis counts so many, and says so; impact() counts all.
IMPACT_CAP = 10_000
#: Sketches of 2 ** SKETCH_BITS registers are off by 2 % or so; seeds that seem to reach so much of the cap are counted.
SKETCH_BITS, NEAR_CAP = 12, 0.8


def levels(edges: DataFrame, seeds: DataFrame, direction: str, depth: int | None, keep_seeds: bool = False) -> DataFrame:
    """(seed, id, depth): nodes that seeds (column id) lead to, at their least distance; edges are already chosen.

    A seed is never its own result, unless keep_seeds: then it is one if it lies on a cycle.
    """
    if direction not in ("incoming", "outgoing"):
        raise ValueError("a traversal is incoming or outgoing")
    if depth is not None and depth <= 0:
        raise ValueError("depth must be positive")
    near, far = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    steps = edges.select(F.col(near).alias("at"), F.col(far).alias("next"))
    start = stored(seeds.select(F.col("id").alias("seed"), F.col("id"), F.lit(0).alias("depth")).distinct(), "frontier")
    found, frontier, level, size = [start], start, 0, rows_of(start)
    while (depth is None or level < depth) and size:
        level += 1
        near_rows = frontier.select("seed", F.col("id").alias("at"))
        after = (F.broadcast(near_rows) if size <= BROADCAST_ROWS else near_rows).join(steps, "at").select("seed", F.col("next").alias("id")).distinct()
        if seen := found[1:] if keep_seeds else found:
            after = after.join(reduce(DataFrame.unionByName, seen).select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = stored(after.withColumn("depth", F.lit(level)), "frontier")
        found.append(frontier)
        size = rows_of(frontier)
    return reduce(DataFrame.unionByName, found[1:]) if len(found) > 1 else start.limit(0)


def packed_steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next) of edges: the ends that a step in the direction begins and ends at, as bytes, which take half the room of texts where they are shuffled."""
    near, far = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    return edges.select(packed(near).alias("at"), packed(far).alias("next"))


def two_nearest(edges: DataFrame, seeds: DataFrame, direction: str, depth: int) -> DataFrame:
    """(id, seed, depth): of each node that seeds (column id) lead to within a depth, two of the nearest seeds; a seed is its own at 0.

    Two are enough to know how far each node, seeds too, is from the nearest other seed; a level holds at most two rows a node,
    however many seeds lead there.
    """
    steps = packed_steps(edges, direction)
    frontier = stored(seeds.select("id").distinct().select(packed("id"), packed("id").alias("seed"), F.lit(0).alias("depth")), "nearest")
    led = None
    found, size = frontier, rows_of(frontier)
    for level in range(1, depth + 1):
        rows = frontier.select(F.col("id").alias("at"), "seed")
        if size > BROADCAST_ROWS:
            # Before all edges are shuffled for them, those that lead nowhere go, as most of the far nodes do.
            led = stored(steps.select("at").distinct(), "led") if led is None else led
            rows = stored(rows.join(led, "at", "left_semi"), "nearest")
            size = rows_of(rows)
            if not size:
                break
        after = (F.broadcast(rows) if size <= BROADCAST_ROWS else rows).join(steps, "at").select(F.col("next").alias("id"), "seed").distinct()
        named = found.groupBy("id").agg(F.collect_set("seed").alias("own"))
        new = after.join(named, "id", "left").filter(F.col("own").isNull() | ((F.size("own") < 2) & ~F.array_contains("own", F.col("seed"))))
        both = new.groupBy("id").agg(F.min("seed").alias("a"), F.max("seed").alias("b"), F.first("own").alias("own"))
        taken = F.when(F.col("own").isNull(), F.array_distinct(F.array("a", "b"))).otherwise(F.array("a"))
        frontier = stored(both.select("id", F.explode(taken).alias("seed"), F.lit(level).alias("depth")), "nearest")
        size = rows_of(frontier)
        if not size:
            break
        found = found.unionByName(frontier)
    return found.select(unpacked("id"), unpacked("seed"), "depth")


def reach_estimates(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, ids: DataFrame) -> DataFrame:
    """(id, n) of seeds (column id): about how many nodes each leads to within a depth, itself included, for all seeds at once.

    ids: all nodes (column id) that any of the seeds leads to, and the seeds. Each has a sketch of the set of nodes within 0, 1, 2, ...
    steps of it; a step unites the sketches of a node's neighbours with its own. Sketches have a fixed size and unite
    before they are shuffled, so a level moves no more than one for each edge, whatever the seeds lead to.
    """
    ids = ids.select(packed("id")).distinct()
    steps = packed_steps(edges, direction).select("at", F.col("next").alias("id"))
    steps = stored(steps.join(ids.select(F.col("id").alias("at")), "at", "left_semi").join(ids, "id", "left_semi").distinct(), "steps")
    now = stored(ids.groupBy("id").agg(F.hll_sketch_agg("id", SKETCH_BITS).alias("sketch")), "sketches")
    for _ in range(depth):
        after = steps.join(now, "id").select(F.col("at").alias("id"), "sketch").unionByName(now)
        now = stored(after.groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch")), "sketches")
    return now.join(seeds.select(packed("id")).distinct(), "id", "left_semi").select(unpacked("id"), F.hll_sketch_estimate("sketch").alias("n"))


def nearest_within(graph: Graph, edges: DataFrame, seeds: DataFrame, direction: str, depth: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """(seed, id, depth): of the nodes that each seed leads to the nearest `cap`, by depth, name and id; and (seed) of those that have so many.

    A seed that has its nodes isn't followed further, so its rows are the cap and one level more.
    """
    near, far = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    steps = edges.select(F.col(near).alias("at"), F.col(far).alias("next"))
    there = graph.nodes.select("id")
    seen = frontier = stored(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct(), "frontier")
    found, full = None, None
    for level in range(1, depth + 1):
        after = frontier.select("seed", F.col("id").alias("at")).join(steps, "at").select("seed", F.col("next").alias("id")).distinct()
        after = stored(after.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(level)), "frontier")
        seen = seen.unionByName(after)
        rows = after.join(there, "id", "left_semi")
        found = rows if found is None else found.unionByName(rows)
        full = stored(found.groupBy("seed").count().filter(F.col("count") >= cap).select("seed"), "full")
        frontier = after.join(full, "seed", "left_anti")
        if not frontier.take(1):
            break
    # Only the last level of a seed with enough is more than it needs.
    nearest = Window.partitionBy("seed").orderBy("depth", "fqn", "id")
    named = found.join(full, "seed", "left_semi").join(graph.nodes.select("id", "fqn"), "id").withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= cap)
    return found.join(full, "seed", "left_anti").unionByName(named.select(found.columns)), full


def traverse(graph: Graph, start_id: str, direction: str, depth: int = MAX_DEPTH, max_results: int | None = MAX_RESULTS) -> DataFrame:
    """The nodes within a distance by all edges but containment, with their depth, nearest first; all of them if max_results is None.

    Ids without a node lead on, but aren't results.
    """
    if max_results is not None and max_results <= 0:
        raise ValueError("max_results must be positive")
    seeds = graph.nodes.sparkSession.createDataFrame([(start_id,)], "id string")
    reached = levels(dependency_edges(graph.towards(direction)), seeds, direction, depth).select("id", "depth")
    found = graph.nodes.join(sized(reached), "id")
    return found if max_results is None else found.orderBy("depth", "fqn", "id").limit(max_results)


def closure(graph: Graph, types: DataFrame, kinds: tuple[str, ...] = schema.HIERARCHY_KINDS) -> DataFrame:
    """(seed, id, depth): what leads to types (column id) by edges of the kinds, whatever the distance; a type on a cycle is its own result."""
    return levels(graph.towards("incoming").filter(F.col("kind").isin(*kinds)), types, "incoming", None, keep_seeds=True)


def containers(graph: Graph, members: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, type_id, type_fqn): the first containing type (by id) of the kinds, of members (id, fqn) that are named after it."""
    edges = by_kind(graph.edges, "Contains").select(F.col("source_id").alias("type_id"), F.col("target_id").alias("id"))
    types = graph.nodes.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("type_id"), F.col("fqn").alias("type_fqn"))
    held = stored(members.select("id", "fqn").join(among(edges, stored(members.select("id"), "held"), "id"), "id"), "held")
    found = held.join(among(types, held, "type_id"), "type_id").groupBy("id", "fqn").agg(F.min(F.struct("type_id", "type_fqn")).alias("t"))
    return found.filter(F.col("fqn").startswith(F.col("t.type_fqn"))).select("id", "t.type_id", "t.type_fqn")


def held_members(graph: Graph, members: DataFrame, container_kinds: tuple[str, ...]) -> DataFrame:
    """(member_id, kind, type_id, suffix) of members (rows of nodes) that lie in a type of the kinds and are named after it."""
    held = containers(graph, members, container_kinds).withColumnRenamed("id", "member_id")
    named = held.join(members.select(F.col("id").alias("member_id"), F.col("fqn"), F.col("kind")), "member_id")
    return stored(named.select("member_id", "kind", "type_id", symbols.member_suffix(F.col("fqn"), F.col("type_fqn")).alias("suffix")), "members")


def overriding(graph: Graph, held: DataFrame, derived: DataFrame) -> DataFrame:
    """(member_id, id): members of the same kind and suffix on the types (seed, id) that derive from the types of held_members()."""
    if not rows_of(held):
        return held.select("member_id", F.col("member_id").alias("id")).limit(0)
    below = derived.select(F.col("seed").alias("type_id"), F.col("id").alias("derived_id"))
    below = stored(below.join(sized(held), "type_id").select("derived_id", "member_id", "kind", "suffix"), "below")
    names = among(graph.nodes.select("id", "fqn"), below, "id", "derived_id").select(F.col("id").alias("derived_id"), F.col("fqn").alias("derived_fqn"))
    wanted = stored(below.join(names, "derived_id").select("member_id", "kind", F.concat("derived_fqn", "suffix").alias("fqn")).distinct(), "wanted")
    return stored(graph.nodes.select("id", "kind", "fqn").join(sized(wanted), ["kind", "fqn"]).select("member_id", "id").distinct(), "overriding")


def member_implementations(graph: Graph, members: DataFrame, container_kinds: tuple[str, ...] = ("Interface", "Class")) -> DataFrame:
    """(member_id, id): members of the same kind and suffix on the types that derive from the member's type.

    members: rows of nodes.
    """
    held = held_members(graph, members, container_kinds)
    return overriding(graph, held, closure(graph, held.select(F.col("type_id").alias("id"))))


def implementations(graph: Graph, fqn: str) -> DataFrame:
    """Nodes that implement, derive from or override what has this name."""
    targets = stored(graph.nodes.filter(F.col("fqn") == fqn), "targets")
    types = targets.filter(F.col("kind").isin(*schema.TYPE_KINDS)).select("id")
    held = held_members(graph, targets.filter(F.col("kind").isin(*schema.MEMBER_KINDS)), ("Interface", "Class"))
    derived = closure(graph, types.unionByName(held.select(F.col("type_id").alias("id"))))
    of_types = derived.join(types.withColumnRenamed("id", "seed"), "seed", "left_semi").select("id")
    found = stored(of_types.unionByName(overriding(graph, held, derived).select("id")).distinct(), "implementations")
    return among(graph.nodes, found, "id")


def impact(graph: Graph, fqn: str, depth: int = MAX_DEPTH, cap: int | None = None) -> DataFrame:
    """Nodes that a change of what has this name reaches: columns of nodes, depth and is_implementer.

    An interface changes with its members, and reaches the types and members that implement it, as an
    interface's member does; these are dependents themselves (depth 1 unless they are nearer) and seeds of
    further ones. What changes is no result. cap: of each seed's dependents the nearest so many count, if it is given, else all.
    """
    return capped_impact(graph, fqn, depth, cap)[0]


def capped_impact(graph: Graph, fqn: str, depth: int = MAX_DEPTH, cap: int | None = None) -> tuple[DataFrame, bool]:
    """impact(), and whether a seed has so many dependents that they were cut, so that there may be more."""
    with temporaries(graph.nodes.sparkSession):
        marked, cut = impacted(graph, fqn, depth, cap)
        marked = stored(marked, "impacted", keep=True)
    return graph.nodes.join(sized(marked), "id"), cut


def impacted(graph: Graph, fqn: str, depth: int, cap: int | None) -> tuple[DataFrame, bool]:
    """(id, depth, is_implementer) for impact(), and whether the cap, if there is one, cut anything off."""
    targets = stored(graph.nodes.filter(F.col("fqn") == fqn), "targets")
    interfaces = targets.filter(F.col("kind") == "Interface").select("id")
    inside = by_kind(graph.edges, "Contains").join(interfaces.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    own_members = graph.nodes.join(inside.distinct(), "id", "left_semi")
    changing = stored(targets.select("id").unionByName(own_members.select("id")).distinct(), "changing")
    members = targets.filter(F.col("kind") != "Interface").unionByName(own_members).filter(F.col("kind").isin(*schema.MEMBER_KINDS, "Field")).dropDuplicates(["id"])
    held = held_members(graph, members, ("Interface",))
    derived = closure(graph, interfaces.unionByName(held.select(F.col("type_id").alias("id"))))
    member_ids = overriding(graph, held, derived).select("id")
    type_ids = derived.join(interfaces.withColumnRenamed("id", "seed"), "seed", "left_semi").select("id")
    implementers = stored(member_ids.unionByName(type_ids).distinct().join(changing, "id", "left_anti"), "implementers")
    seeds = changing.unionByName(implementers)
    edges = dependency_edges(graph.towards("incoming"))
    found = two_nearest(edges, seeds, "incoming", depth)
    cut = False
    if cap is not None and found.select("id").distinct().count() > cap:
        # Only then can one seed have as many dependents as count. Those that seem to are followed for themselves, the others still together.
        reach = reach_estimates(edges, seeds, "incoming", depth, found)
        large = stored(reach.filter(F.col("n") > NEAR_CAP * cap).select("id"), "large")
        if rows_of(large):
            own, full = nearest_within(graph, edges, large, "incoming", depth, cap)
            cut = bool(full.take(1))
            rest = seeds.join(large, "id", "left_anti")
            found = two_nearest(edges, rest, "incoming", depth).select("seed", "id", "depth").unionByName(own.select("seed", "id", "depth"))
    near = found.filter(F.col("id") != F.col("seed")).groupBy("id").agg(F.min("depth").alias("depth"))
    marked = near.join(implementers.withColumn("is_implementer", F.lit(True)), "id", "full").join(changing, "id", "left_anti")
    return marked.select("id", F.coalesce("depth", F.lit(1)).alias("depth"), F.coalesce("is_implementer", F.lit(False)).alias("is_implementer")), cut


def hierarchy(graph: Graph, type_id: str, direction: str, depth: int = MAX_DEPTH) -> DataFrame:
    """The tree of types above or below a type: level, path (names from the root on), id, already_shown.

    Children come in order of name; a node that the tree has shown before, in that order, is shown again
    but not expanded. A round expands what is shown for the first time, as far as is known, and shows anew, so
    of the places of a node few are ever expanded, however many paths lead to it.
    """
    with temporaries(graph.nodes.sparkSession):
        return stored(grown(graph, type_id, direction, depth), "hierarchy", keep=True)


def grown(graph: Graph, type_id: str, direction: str, depth: int) -> DataFrame:
    """The rows of hierarchy()."""
    if direction not in ("up", "down"):
        raise ValueError("a hierarchy goes up or down")
    near, far = ("source_id", "target_id") if direction == "up" else ("target_id", "source_id")
    names = graph.nodes.filter(F.col("kind").isin(*schema.TYPE_KINDS)).select(F.col("id").alias("next"), F.col("fqn").alias("next_fqn"))
    steps = graph.edges.filter(F.col("kind").isin(*schema.HIERARCHY_KINDS)).select(F.col(near).alias("id"), F.col(far).alias("next"))
    rows = stored(graph.nodes.filter(F.col("id") == type_id).select(F.lit(0).alias("level"), "id", F.array(F.struct("fqn", "id")).alias("path")), "tree")
    shown, expanded, most = rows.withColumn("already_shown", F.lit(False)), None, max(1, min(depth, 10))
    while True:
        todo = shown.filter(~F.col("already_shown") & (F.col("level") < most)).drop("already_shown")
        todo = stored(todo if expanded is None else todo.join(expanded, "path", "left_anti"), "todo")
        # Of the edges and names only those that a round needs meet its paths, which may be long.
        led = stored(among(steps, todo, "id").distinct(), "led")
        below = todo.join(led.join(among(names, led, "next"), "next"), "id").drop("id")
        below = stored(below.select((F.col("level") + 1).alias("level"), F.col("next").alias("id"), F.concat("path", F.array(F.struct(F.col("next_fqn").alias("fqn"), F.col("next").alias("id")))).alias("path")), "tree")
        if not rows_of(below):
            return shown
        expanded = todo.select("path") if expanded is None else expanded.unionByName(todo.select("path"))
        rows = rows.unionByName(below)
        shown = first_shown(rows)


def first_shown(rows: DataFrame) -> DataFrame:
    """Rows (level, id, path) in the order of paths: nodes that come again are marked, and what stands below them is dropped.

    Dropping a subtree can make another occurrence the first, so this is repeated until nothing changes.
    """
    order = Window.partitionBy("id").orderBy("path")
    while True:
        marked = stored(rows.withColumn("already_shown", F.row_number().over(order) > 1), "shown")
        again = marked.filter("already_shown").select(F.col("path").alias("_above"))
        if not again.take(1):
            return marked
        above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
        below = stored(marked.filter("size(path) > 1").select("path", F.explode(above).alias("_above")).join(again, "_above").select("path").distinct(), "below")
        if not rows_of(below):
            return marked
        rows = marked.join(below, "path", "left_anti").drop("already_shown")
