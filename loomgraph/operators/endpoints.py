"""Endpoints by verb and route, with their handlers and callers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routes
from ..schema import Graph
from .attribute import with_project

SEPARATOR = " | "


def endpoint_nodes(nodes: DataFrame, verb: str | None = None) -> DataFrame:
    """Endpoints with verb and skeleton."""
    own = nodes.filter(F.col("kind") == "Endpoint").withColumn("verb", routes.verb(F.col("fqn"))).withColumn("skeleton", routes.skeleton(F.col("name")))
    return own if verb is None else own.filter(F.col("verb") == verb)


def joined_names(graph: Graph, endpoints: DataFrame, edge_kind: str, near: str, far: str, column: str) -> DataFrame:
    """For endpoints (id) the sorted names at the other ends of their edges of a kind."""
    edges = graph.edges.filter(F.col("kind") == edge_kind).select(F.col(near).alias("id"), F.col(far).alias("other"))
    names = graph.nodes.select(F.col("id").alias("other"), F.col("fqn").alias("other_fqn"))
    found = edges.join(endpoints.select("id"), "id", "left_semi").join(names, "other")
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other_fqn")), SEPARATOR).alias(column))


def described(graph: Graph, endpoints: DataFrame, callers: bool = False) -> DataFrame:
    """Endpoints with project and handlers, and with callers if asked for; null where there are none."""
    out = with_project(endpoints, graph.nodes).join(joined_names(graph, endpoints, "HandledBy", "source_id", "target_id", "handlers"), "id", "left")
    return out.join(joined_names(graph, endpoints, "CallsEndpoint", "target_id", "source_id", "callers"), "id", "left") if callers else out


def list_endpoints(graph: Graph, verb: str | None = None, prefix: str | None = None, limit: int = 100) -> DataFrame:
    own = endpoint_nodes(graph.nodes, verb)
    if prefix:
        own = own.filter(F.col("skeleton").startswith(routes.skeleton(F.lit(prefix))))
    return described(graph, own.orderBy("name", "verb", "id").limit(limit))


def matching(nodes: DataFrame, route: str, verb: str | None = None, limit: int = 25) -> DataFrame:
    """The first endpoints, by name, that a route can name."""
    return endpoint_nodes(nodes, verb).filter(routes.matches(F.col("skeleton"), routes.skeleton(F.lit(route)))).orderBy("fqn", "id").limit(limit)


def find_endpoints(graph: Graph, route: str, verb: str | None = None, limit: int = 25) -> DataFrame:
    return described(graph, matching(graph.nodes, route, verb, limit), callers=True)


def near_misses(nodes: DataFrame, route: str, limit: int = 5) -> DataFrame:
    """Endpoints that share the last literal segment of a route that none matches."""
    segments = F.filter(routes.segments(routes.skeleton(F.lit(route))), lambda s: (s != "") & (s != routes.HOLE))
    last = F.try_element_at(segments, F.lit(-1))
    own = endpoint_nodes(nodes).filter(F.coalesce(F.col("skeleton").contains(last), F.lit(False)))
    return own.orderBy(F.length("name"), "fqn", "id").limit(limit)
