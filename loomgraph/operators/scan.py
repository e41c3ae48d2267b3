"""Lookups and scans of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from ..sources.scratch import among, stored
from ..sources.store import packed, unpacked


def dependency_edges(edges: DataFrame) -> DataFrame:
    """All edges but containment."""
    return edges.filter(F.col("kind") != "Contains")


def by_fqn(nodes: DataFrame, fqn: str) -> DataFrame:
    return nodes.filter(F.col("fqn") == fqn)


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes whose ids are in a frame with a column id; ids without a node give none."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def shortest_first(nodes: DataFrame, limit: int) -> DataFrame:
    """The first nodes by length of name, name and id."""
    return nodes.orderBy(F.length("fqn"), "fqn", "id").limit(limit)


def name_test(query: str, kind: str | None = None) -> Column:
    """Whether the name or full name of a node, of the kind if one is given, holds the query, in any case.

    Without a kind, % and _ in the query stand for any text and any character; with one, for themselves.
    """
    if kind is None:
        pattern = "%" + query.replace("\\", "\\\\") + "%"
        return F.col("name").ilike(pattern) | F.col("fqn").ilike(pattern)
    wanted = query.lower()
    return (F.col("kind") == kind) & (F.lower("name").contains(wanted) | F.lower("fqn").contains(wanted))


def find_symbols(nodes: DataFrame, query: str, limit: int, kind: str | None = None) -> DataFrame:
    """The first nodes that name_test() finds. All names are scanned; names.find_symbols() reads an index."""
    return shortest_first(nodes.filter(name_test(query, kind)), limit)


def edges_of(graph: Graph, node_id: str, direction: str, kind: str | None = None) -> DataFrame:
    """The edges at a node: outgoing, incoming or both; a loop is one edge."""
    out, into = F.col("source_id") == node_id, F.col("target_id") == node_id
    leaving, coming = graph.edges.filter(out), graph.towards("incoming").filter(into)
    found = {"outgoing": leaving, "incoming": coming, "both": leaving.unionByName(coming.filter(~out))}[direction]
    return found if kind is None else found.filter(F.col("kind") == kind)


def neighbours(graph: Graph, ids: DataFrame, direction: str) -> DataFrame:
    """For nodes (column id): id, rel_kind and neighbour_id of each dependency edge, with the neighbour's columns, null where there is no such node."""
    near, far = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    edges = among(dependency_edges(graph.towards(direction)), stored(ids.select("id").distinct(), "starts"), near, "id")
    named = stored(edges.select(F.col(near).alias("id"), F.col("kind").alias("rel_kind"), F.col(far).alias("neighbour_id")), "neighbours")
    other = among(graph.nodes, named, "id", "neighbour_id").select(F.col("id").alias("neighbour_id"), F.col("kind").alias("neighbour_kind"), F.col("fqn").alias("neighbour_fqn"), F.col("file").alias("neighbour_file"))
    return named.join(other, "neighbour_id", "left")


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def without_dangling(graph: Graph) -> Graph:
    """The graph without edges whose ends don't both exist. Edges are shuffled once for each end, with ids as bytes."""
    ids = graph.nodes.select(packed("id"))
    edges = graph.edges.select(packed("source_id"), packed("target_id"), "kind")
    edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return Graph(graph.nodes, edges.select(unpacked("source_id"), unpacked("target_id"), "kind"))
