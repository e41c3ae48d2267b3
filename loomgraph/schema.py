"""The typed property graph: tables, kinds and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names in the order of their ordinals, which node ids are hashed from.
NODE_KINDS = (
    "Unknown", "Project", "Namespace", "Class", "Interface", "Struct", "Record", "Enum", "Delegate",
    "Method", "Constructor", "Property", "Field", "Event", "Endpoint", "EnumMember", "FrontendCallSite", "UnresolvedCallSite",
)
EDGE_KINDS = ("Calls", "Implements", "Inherits", "References", "Contains", "HandledBy", "Unknown", "CallsEndpoint")
USAGE_KINDS = ("Calls", "References", "HandledBy", "CallsEndpoint")
HIERARCHY_KINDS = ("Inherits", "Implements")
TYPE_KINDS = ("Interface", "Class", "Struct", "Record")
MEMBER_KINDS = ("Method", "Property", "Event")
TEST_KINDS = ("Method", "Constructor", "Property")
FRONTEND_KINDS = ("FrontendCallSite", "UnresolvedCallSite")
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
META_KEYS = (
    "schema_version", "last_analyzed", "solution_path", "tool_version", "unresolved_endpoints", "conventional_controllers",
    "frontend_last_analyzed", "frontend_unresolved_call_sites", "linker_last_run",
)
SCHEMA_VERSION = "1"

NODES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("fqn", T.StringType(), False),
    T.StructField("file", T.StringType()),
    T.StructField("span_start", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()),
])
EDGES = T.StructType([T.StructField(c, T.StringType(), False) for c in ("source_id", "target_id", "kind")])
FILES = T.StructType([T.StructField(c, T.StringType(), False) for c in ("path", "content_hash")])
META = T.StructType([T.StructField(c, T.StringType(), False) for c in ("key", "value")])
SOURCES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("text", T.StringType())])


@dataclass(frozen=True)
class Graph:
    """Nodes and edges; edges are a set, and their ends need not exist. A stored graph has its edges a second time, laid out by what they lead to."""

    nodes: DataFrame
    edges: DataFrame
    incoming: DataFrame | None = None

    def towards(self, direction: str) -> DataFrame:
        """The edges, laid out by the end that a step in the direction begins at, if there are such."""
        return self.edges if direction == "outgoing" or self.incoming is None else self.incoming

    def select(self) -> Graph:
        return Graph(self.nodes.select(*NODES.names), self.edges.select(*EDGES.names))


def ordinal(kind: Column) -> Column:
    """The ordinal of a kind's name; null for a name that isn't known."""
    pairs = [x for k, name in enumerate(NODE_KINDS) for x in (F.lit(name), F.lit(k))]
    return F.try_element_at(F.create_map(*pairs), kind)


def node_id(kind: Column, fqn: Column) -> Column:
    """32 hexadecimal digits of the SHA-256 of "ordinal:fqn"."""
    return F.substring(F.sha2(F.concat_ws(":", ordinal(kind).cast("string"), fqn), 256), 1, 32)


def known(kind: Column, names: tuple[str, ...]) -> Column:
    """The kind itself if it is one of the names, which are case-sensitive, else Unknown."""
    return F.when(kind.isin(*names), kind).otherwise(F.lit("Unknown"))


def span_text(start: Column, end: Column) -> Column:
    """start-end, null if either is null, negative or out of order."""
    return F.when((start >= 0) & (end >= start), F.concat_ws("-", start.cast("string"), end.cast("string")))


def parse_span(text: Column) -> Column:
    """struct(span_start, span_end) of text of the form start-end, null of anything else."""
    start, end = (F.regexp_extract(text, r"^(\d+)-(\d+)$", k).try_cast("int") for k in (1, 2))
    return F.when(end >= start, F.struct(start.alias("span_start"), end.alias("span_end")))
