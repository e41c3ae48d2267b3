"""Keeping a graph up to date: what changed, what is analysed again, what is evicted, what is pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..schema import Graph
from ..sources.scratch import rows_of, stored
from ..sources.store import first_of_each, packed, unpacked
from .scan import without_dangling


def file_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status) of files (path, content_hash): added, changed, removed or unchanged."""
    now = current.select("path", F.col("content_hash").alias("now"))
    before = previous.select("path", F.col("content_hash").alias("before"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed").otherwise("unchanged")
    return now.join(before, "path", "full").select("path", status.alias("status"))


def plan(graph: Graph, current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, action): files to analyze (added, changed, or holding a node that refers to one in a file that isn't unchanged) and removed ones to evict."""
    diff = stored(file_diff(current, previous), "diff")
    moved = diff.filter("status <> 'unchanged'").select(F.col("path").alias("file"))
    # Of the edges both ends are shuffled, as bytes.
    affected = graph.nodes.join(moved, "file", "left_semi").select(packed("id").alias("target_id"))
    sources = graph.edges.select(packed("source_id"), packed("target_id")).join(affected, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    dependents = graph.nodes.select(packed("id"), "file").filter(F.col("file").isNotNull()).join(sources, "id", "left_semi").select(F.col("file").alias("path")).distinct()
    dependents = dependents.join(diff.filter("status <> 'removed'"), "path", "left_semi")
    again = diff.filter("status in ('added', 'changed')").select("path").unionByName(dependents).distinct()
    gone = diff.filter("status = 'removed'").select("path", F.lit("evict").alias("action"))
    return again.withColumn("action", F.lit("analyze")).unionByName(gone)


def evict(graph: Graph, paths: DataFrame) -> Graph:
    """The graph without the nodes of files (path), and without the edges whose source lies in one; edges of sources without file or node stay."""
    out = paths.select(F.col("path").alias("file")).distinct()
    nodes = graph.nodes.join(out, "file", "left_anti").select(*schema.NODES.names)
    gone = graph.nodes.join(out, "file", "left_semi").select(packed("id").alias("source_id"))
    edges = graph.edges.select(packed("source_id"), packed("target_id"), "kind").join(gone, "source_id", "left_anti")
    return Graph(nodes, edges.select(unpacked("source_id"), unpacked("target_id"), "kind"))


def merge(first: Graph, second: Graph) -> Graph:
    """The union of two graphs; of nodes with one id the first graph's stays, and of several in the second the least row."""
    new = first_of_each(second.nodes.join(first.nodes.select("id"), "id", "left_anti").select(*schema.NODES.names), ["id"])
    nodes = first.nodes.select(*schema.NODES.names).unionByName(new)
    edges = first.edges.select(*schema.EDGES.names).unionByName(second.edges.select(*schema.EDGES.names)).distinct()
    return Graph(nodes, edges)


def without_orphan_namespaces(graph: Graph) -> Graph:
    """The graph without namespaces that contain nothing, however deep, and without their edges."""
    holds = graph.edges.filter(F.col("kind") == "Contains").select(F.col("source_id").alias("id"), F.col("target_id").alias("child")).distinct()
    spaces = graph.nodes.filter(F.col("kind") == "Namespace").select("id")
    others = graph.nodes.filter(F.col("kind") != "Namespace").select(F.col("id").alias("child"))
    inside = stored(holds.join(spaces, "id", "left_semi"), "inside")
    # Live are the namespaces with a child that is none; then, going up, those with a live one.
    live = stored(inside.join(others, "child", "left_semi").select("id").distinct(), "live")
    frontier = live
    while rows_of(frontier):
        above = inside.join(frontier.withColumnRenamed("id", "child"), "child", "left_semi").select("id").distinct()
        frontier = stored(above.join(live, "id", "left_anti"), "live")
        live = stored(live.unionByName(frontier), "live")
    dead = stored(spaces.join(live, "id", "left_anti"), "dead")
    nodes = graph.nodes.join(dead, "id", "left_anti").select(*schema.NODES.names)
    edges = graph.edges.join(dead.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(dead.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return Graph(nodes, edges.select(*schema.EDGES.names))


def update(graph: Graph, fresh: Graph, paths: DataFrame) -> Graph:
    """Evict files, merge what was derived from them anew, then drop dangling edges and empty namespaces, in this order."""
    merged = merge(evict(graph, paths), fresh)
    return without_orphan_namespaces(without_dangling(merged))


def replace_kinds(graph: Graph, nodes: DataFrame, kinds: tuple[str, ...] = schema.FRONTEND_KINDS) -> Graph:
    """The graph with the nodes of some kinds replaced by new ones; edges that lose an end go."""
    kept = graph.nodes.filter(~F.col("kind").isin(*kinds)).select(*schema.NODES.names)
    return without_dangling(merge(Graph(kept, graph.edges), Graph(nodes, graph.edges.limit(0))))
