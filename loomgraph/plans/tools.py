"""The fifteen questions that a code graph answers, as DataFrames.

A result holds one frame or several by name. Caps are part of a tool: a frame that is cut has one row more
than its cap fetched, which `more` tells of. Nothing but small lookups comes to the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import routes, symbols
from ..operators import attribute, containers, endpoints, linker, names, scan, source_text, traverse
from ..schema import Graph
from ..sources.scratch import stored
from ..sources.store import GraphStore
from .failures import Failure, Parameter, check, internal, invalid

FIND, DEPENDENCIES, IMPACT, USAGES, SUGGESTIONS, NAMESPACES, PAIRS, IMPLEMENTATIONS, TESTS, HIERARCHY, CYCLES, ENDPOINTS, FOUND_ENDPOINTS, CALL_SITES = 20, 50, 100, 50, 5, 15, 40, 100, 60, 200, 25, 100, 25, 100
DIRECTIONS = {"outgoing": "outgoing", "out": "outgoing", "dependencies": "outgoing", "incoming": "incoming", "in": "incoming", "dependents": "incoming"}
WAYS = {"both": ("up", "down"), "up": ("up",), "down": ("down",)}
#: Projects of an overview, and names of a cycle, that are shown.
PROJECTS = 1000
PATH = 12
NOT_BUILT = "There is no graph here yet. Build it from its source files, then ask again."
UNKNOWN_PROJECT = "~unknown"


@dataclass
class Result:
    """What a tool found: frames by name, counts, whether rows (more) or counts (lower_bound) were cut, and a text where there is nothing to show."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    more: bool = False
    text: str = ""
    lower_bound: bool = False

    @property
    def rows(self) -> DataFrame:
        return next(iter(self.frames.values()))


def capped(df: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """The first rows of an ordered frame, and whether there are more; no more than the cap and one are computed."""
    found = stored(df.limit(cap + 1).withColumn("_at", F.monotonically_increasing_id()), "rows")
    return found.orderBy("_at").limit(cap).drop("_at"), found.count() > cap


class Tools:
    """The tools over a stored graph; each call reads the version that is current then."""

    def __init__(self, store: GraphStore, sources: DataFrame | None = None):
        self.store = store
        self.sources = sources if sources is not None else store.spark.createDataFrame([], schema.SOURCES)

    # ------------------------------------------------------------ the call

    def call(self, tool: str, arguments: dict[str, Any] | None = None) -> Result | Failure:
        """Run a tool by name with arguments that are checked first; failures are returned, not raised."""
        if tool not in PARAMETERS:
            return invalid(None, PARAMETERS, f"Unknown tool '{tool}'.")
        try:
            given = check(PARAMETERS[tool], arguments or {})
            if "last_analyzed" not in self.store.meta():
                return Result(text=NOT_BUILT)
            return getattr(self, tool)(**given)
        except Failure as failure:
            return failure
        except Exception:
            logging.getLogger(__name__).exception("%s failed", tool)
            return internal()

    def graph(self) -> Graph:
        return self.store.load()

    def resolve(self, g: Graph, fqn: str) -> DataFrame | Result:
        """The nodes with this name, or suggestions."""
        found = stored(scan.by_fqn(g.nodes, fqn), "matches")
        if found.take(1):
            return found
        like = self.like(g, g.nodes.sparkSession.range(1).select(symbols.last_segment(F.lit(fqn)).alias("x")).first().x or fqn, SUGGESTIONS)
        return Result({"suggestions": like.select("kind", "fqn", "file")}, text=f"No symbol named '{fqn}'.")

    def like(self, g: Graph, query: str, limit: int, kind: str | None = None) -> DataFrame:
        """The first symbols like a query, through the index of names if the graph has one."""
        index = names.kept_index(self.store)
        return names.find_symbols(index, query, limit, kind) if index else scan.find_symbols(g.nodes, query, limit, kind)

    def placed(self, nodes: DataFrame) -> DataFrame:
        """The few nodes that a tool shows, in their order, with line."""
        rows = nodes.withColumn("_at", F.monotonically_increasing_id())
        near = self.sources.join(F.broadcast(rows.select(F.col("file").alias("path")).distinct()), "path", "left_semi")
        return source_text.with_lines(rows, near).orderBy("_at").drop("_at")

    # ------------------------------------------------------------ symbols

    def find_symbol(self, query: str, kind: str | None = None) -> Result:
        if kind is not None and kind.strip():
            by_lower = {k.lower(): k for k in schema.NODE_KINDS}
            if kind.lower() not in by_lower:
                raise invalid("kind", ("query", "kind"), f"Unknown kind '{kind}'. Valid kinds: {', '.join(schema.NODE_KINDS)}.")
            kind = by_lower[kind.lower()]
        found = self.like(self.graph(), query, FIND + 1, kind or None)
        rows, more = capped(found.select("kind", "fqn", "file"), FIND)
        return Result({"symbols": rows}, more=more)

    def get_dependencies(self, fqn: str, direction: str = "outgoing", depth: int = 1) -> Result:
        way = DIRECTIONS.get(direction.strip().lower())
        if way is None:
            raise invalid("direction", ("fqn", "direction", "depth"), f"Unknown direction '{direction}'. Valid directions: {', '.join(DIRECTIONS)}.")
        g = self.graph()
        start = self.resolve(g, fqn)
        if isinstance(start, Result):
            return start
        one = start.orderBy("kind", "id").limit(1)
        direct = scan.neighbours(g, one, way)
        label = F.coalesce("neighbour_fqn", "neighbour_id")
        rows = direct.select("rel_kind", "neighbour_kind", label.alias("fqn"), F.lit(1).alias("depth"))
        depth = max(1, min(depth, 3))
        if depth > 1:
            far = traverse.traverse(g, one.first().id, way, depth, None).filter("depth >= 2")
            rows = rows.unionByName(far.select(F.lit(None).cast("string").alias("rel_kind"), F.col("kind").alias("neighbour_kind"), "fqn", "depth"))
        shown, more = capped(rows.orderBy("depth", "rel_kind", "fqn"), DEPENDENCIES)
        return Result({"dependencies": shown, "by_kind": direct.groupBy("rel_kind").agg(F.count("*").alias("n"))}, more=more)

    def find_usages(self, fqn: str) -> Result:
        g = self.graph()
        targets = self.resolve(g, fqn)
        if isinstance(targets, Result):
            return targets
        users = g.edges.filter(F.col("kind").isin(*schema.USAGE_KINDS)).join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))
        rows, more = capped(scan.by_ids(g.nodes, users).orderBy(F.coalesce("file", F.lit("")), "fqn", "id"), USAGES)
        return Result({"usages": self.placed(rows).select("kind", "fqn", "file", "line")}, more=more)

    def grouped_by_project(self, g: Graph, nodes: DataFrame, cap: int) -> tuple[DataFrame, bool]:
        named = attribute.with_project(nodes, g.nodes)
        rows, more = capped(named.orderBy(F.coalesce("project", F.lit(UNKNOWN_PROJECT)), "fqn", "id"), cap)
        return self.placed(rows).select("project", "kind", "fqn", "file", "line"), more

    def find_implementations(self, fqn: str) -> Result:
        g = self.graph()
        targets = self.resolve(g, fqn)
        if isinstance(targets, Result):
            return targets
        rows, more = self.grouped_by_project(g, traverse.implementations(g, fqn), IMPLEMENTATIONS)
        return Result({"implementations": rows}, more=more)

    def get_type_hierarchy(self, fqn: str, direction: str = "both", depth: int = 5) -> Result:
        ways = WAYS.get(direction.strip().lower())
        if ways is None:
            raise invalid("direction", ("fqn", "direction", "depth"), f"Unknown direction '{direction}'. Valid directions: {', '.join(WAYS)}.")
        g = self.graph()
        targets = self.resolve(g, fqn)
        if isinstance(targets, Result):
            return targets
        start = targets.filter(F.col("kind").isin(*schema.TYPE_KINDS)).orderBy("id").take(1)
        if not start:
            return Result(text=f"'{fqn}' is not a type.")
        frames, more = {}, False
        for way in ways:
            tree = traverse.hierarchy(g, start[0].id, way, max(1, min(depth, 10))).filter("level > 0")
            named, cut = capped(tree.join(g.nodes.select("id", "name", "file"), "id").orderBy("path"), HIERARCHY)
            more |= cut
            frames[way] = named.select("level", F.transform("path", lambda p: p["fqn"]).alias("path"), "name", "file", "already_shown")
        return Result(frames, more=more)

    def impact_analysis(self, fqn: str) -> Result:
        g = self.graph()
        targets = self.resolve(g, fqn)
        if isinstance(targets, Result):
            return targets
        reached, cut = traverse.capped_impact(g, fqn, cap=traverse.IMPACT_CAP)
        found = stored(attribute.with_project(reached, g.nodes).withColumn("project", F.coalesce("project", F.lit("(unknown)"))), "impact")
        rows, more = capped(found.select("kind", "fqn", "depth", "project", "is_implementer").orderBy("depth", "fqn"), IMPACT)
        by = {f"by_{c}": found.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c) for c in ("project", "kind")}
        return Result({"dependents": rows, **by}, {"dependents": found.count()}, more, lower_bound=cut)

    def find_tests_for_symbol(self, fqn: str) -> Result:
        g = self.graph()
        targets = self.resolve(g, fqn)
        if isinstance(targets, Result):
            return targets
        if not scan.by_kind(g.nodes, "Project").filter(symbols.is_test_project(F.col("name"))).take(1):
            return Result(text="The graph holds no test projects (projects with Test in their name).")
        reached = traverse.levels(scan.dependency_edges(g.edges), targets.select("id"), "incoming", traverse.MAX_DEPTH).select("id")
        members = scan.by_ids(g.nodes, reached).filter(F.col("kind").isin(*schema.TEST_KINDS))
        tests = stored(attribute.with_project(members, g.nodes).filter(symbols.is_test_project(F.col("project"))), "tests")
        rows, more = capped(tests.orderBy("project", "fqn", "id"), TESTS)
        return Result({"tests": self.placed(rows).select("project", "kind", "fqn", "file", "line")}, {"projects": tests.select("project").distinct().count()}, more)

    # ------------------------------------------------------------ structure

    def get_architecture_overview(self) -> Result:
        g = self.graph()
        pairs, more = capped(containers.container_edges(g).orderBy(F.desc("n"), "from", "to"), PAIRS)
        kinds = {name: scan.kind_counts(df).orderBy(F.desc("n"), "kind") for name, df in (("node_kinds", g.nodes), ("edge_kinds", g.edges))}
        projects, cut = capped(scan.by_kind(g.nodes, "Project").select("name").orderBy("name"), PROJECTS)
        spaces = scan.shortest_first(scan.by_kind(g.nodes, "Namespace"), NAMESPACES).select("name", "fqn")
        return Result({"projects": projects, "dependencies": pairs, **kinds, "namespaces": spaces}, {"nodes": g.nodes.count(), "edges": g.edges.count()}, more or cut)

    def get_project_dependencies(self, project: str | None = None) -> Result:
        g = self.graph()
        pairs = containers.container_edges(g)
        if project and project.strip():
            names = scan.by_kind(g.nodes, "Project").filter(F.lower("name") == project.lower()).take(1)
            if not names:
                valid = [r.name for r in scan.by_kind(g.nodes, "Project").select("name").orderBy("name").limit(100).collect()]
                return Result(text=f"No project named '{project}'. Projects: {', '.join(valid)}.")
            pairs = pairs.filter((F.lower("from") == project.lower()) | (F.lower("to") == project.lower()))
        rows, more = capped(pairs.orderBy(F.desc("n"), "from", "to"), PAIRS)
        return Result({"dependencies": rows, "hotspot": rows.limit(1)}, more=more)

    def find_circular_dependencies(self, scope: str = "project") -> Result:
        if scope.strip().lower() not in ("project", "namespace"):
            raise invalid("scope", ("scope",), "scope must be 'project' or 'namespace'.")
        rows, more = capped(containers.cycles(containers.container_edges(self.graph(), scope.strip().lower())), CYCLES)
        left = F.concat(F.lit("… and "), (F.size("path") - PATH).cast("string"), F.lit(" more"))
        shown = F.when(F.size("path") > PATH, F.concat(F.slice("path", 1, PATH), F.array(left))).otherwise(F.col("path"))
        return Result({"cycles": rows.withColumn("path", shown)}, more=more)

    # ------------------------------------------------------------ endpoints and call sites

    def verb(self, verb: str | None, names: tuple[str, ...]) -> str | None:
        if verb is None or not verb.strip():
            return None
        if verb.strip().upper() not in schema.VERBS:
            raise invalid("verb", names, f"Unknown verb '{verb}'. Valid verbs: {', '.join(schema.VERBS)}.")
        return verb.strip().upper()

    def disclosed(self) -> dict[str, int]:
        """How many registrations and controllers the graph leaves out."""
        meta = self.store.meta()
        return {k: int(meta[k]) for k in ("unresolved_endpoints", "conventional_controllers") if meta.get(k, "").isdigit()}

    def list_endpoints(self, verb: str | None = None, prefix: str | None = None) -> Result:
        g = self.graph()
        own = endpoints.list_endpoints(g, self.verb(verb, ("verb", "prefix")), prefix, ENDPOINTS + 1)
        if not scan.by_kind(g.nodes, "Endpoint").take(1):
            return Result(counts=self.disclosed(), text="The graph contains no endpoints.")
        rows, more = capped(own.orderBy("name", "verb", "id"), ENDPOINTS)
        return Result({"endpoints": self.placed(rows).select("project", "verb", "name", "handlers", "file", "line")}, self.disclosed(), more)

    def find_endpoint(self, route: str, verb: str | None = None) -> Result:
        g = self.graph()
        rows, more = capped(endpoints.find_endpoints(g, route, self.verb(verb, ("route", "verb")), FOUND_ENDPOINTS + 1).orderBy("fqn", "id"), FOUND_ENDPOINTS)
        if rows.take(1):
            return Result({"endpoints": self.placed(rows).select("project", "fqn", "handlers", "callers", "file", "line")}, more=more)
        return Result({"near_misses": endpoints.near_misses(g.nodes, route, SUGGESTIONS).select("fqn", "name")}, text=f"No endpoint matches '{route}'.")

    def sites(self, nodes: DataFrame) -> tuple[DataFrame, linker.Links]:
        """Call sites (call_id, route, outcome, fqn, name) with the outcome of linking them now, and the links."""
        found = linker.links(nodes)
        return linker.call_outcomes(found).join(nodes.select(F.col("id").alias("call_id"), "fqn", "name"), "call_id"), found

    def named(self, sites: DataFrame, targets: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
        """A few sites with the names of their routes' targets."""
        names = linker.listed(sites, targets, nodes).withColumnRenamed("names", column)
        return sites.join(names, "route", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))

    def stale_note(self) -> str:
        """A note if the stored links are older than what they link."""
        meta = self.store.meta()
        newest = max(meta.get("last_analyzed", ""), meta.get("frontend_last_analyzed", ""))
        linked = meta.get("linker_last_run")
        return "The stored links are older than the graph; run link again." if linked and linked < newest else ""

    def find_orphan_calls(self, category: str | None = None) -> Result:
        orphans = ("NoSkeletonMatch", "VerbMismatch", "UnknownVerb")
        if category is not None and category.strip():
            by_lower = {c.lower(): c for c in orphans}
            if category.strip().lower() not in by_lower:
                raise invalid("category", ("category",), f"Unknown category '{category}'. Valid categories: {', '.join(orphans)}.")
            orphans = (by_lower[category.strip().lower()],)
        g = self.graph()
        sites, found = self.sites(g.nodes)
        sites = stored(sites.filter(F.col("outcome").isin(*orphans)), "orphans")
        from pyspark.sql import Window

        rows = sites.withColumn("_k", F.row_number().over(Window.partitionBy("outcome").orderBy("fqn", "call_id"))).filter(F.col("_k") <= CALL_SITES)
        rows = self.named(stored(rows, "rows"), found.conflicts, g.nodes, "conflicts")
        counts = {r.outcome: r.n for r in sites.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        unresolved = scan.by_kind(g.nodes, "UnresolvedCallSite").count()
        return Result({"orphans": rows.select("outcome", "fqn", "name", "conflicts").orderBy("outcome", "fqn")}, counts | {"unresolved_call_sites": unresolved}, any(n > CALL_SITES for n in counts.values()), self.stale_note())

    def list_frontend_callsites(self, verb: str | None = None, prefix: str | None = None) -> Result:
        wanted = None if verb is not None and verb.strip().upper() == "UNKNOWN" else self.verb(verb, ("verb", "prefix"))
        nodes = self.graph().nodes
        sites, found = self.sites(nodes)
        if verb and verb.strip():
            sites = sites.filter(routes.verb(F.col("fqn")) == (wanted or "UNKNOWN"))
        if prefix:
            sites = sites.filter(routes.skeleton(F.col("name")).startswith(routes.skeleton(F.lit(prefix))))
        rows, more = capped(sites.select("route", "fqn", "name", "outcome").orderBy("fqn"), CALL_SITES)
        rows = self.named(rows, found.endpoints, nodes, "endpoints").select("fqn", "name", "outcome", "endpoints").orderBy("fqn")
        return Result({"call_sites": rows}, more=more, text=self.stale_note())

    # ------------------------------------------------------------ source

    def get_symbol_source(self, fqn: str, context_lines: int = 5) -> Result:
        g = self.graph()
        targets = self.resolve(g, fqn)
        if isinstance(targets, Result):
            return targets
        one = targets.filter("file is not null and span_start is not null").orderBy("id").limit(1)
        lines = stored(source_text.symbol_source(one, self.sources, context_lines), "lines")
        if not lines.take(1):
            return Result(text=f"The source of '{fqn}' can't be read.")
        return Result({"source": lines.select("line_no", "text").orderBy("line_no")})


_FQN = Parameter("fqn", str, required=True)
_VERB, _PREFIX = Parameter("verb", str), Parameter("prefix", str)
PARAMETERS: dict[str, tuple[Parameter, ...]] = {
    "find_symbol": (Parameter("query", str, required=True), Parameter("kind", str)),
    "get_dependencies": (_FQN, Parameter("direction", str, default="outgoing"), Parameter("depth", int, default=1)),
    "get_architecture_overview": (),
    "find_usages": (_FQN,),
    "find_implementations": (_FQN,),
    "get_type_hierarchy": (_FQN, Parameter("direction", str, default="both"), Parameter("depth", int, default=5)),
    "impact_analysis": (_FQN,),
    "find_tests_for_symbol": (_FQN,),
    "get_project_dependencies": (Parameter("project", str),),
    "find_circular_dependencies": (Parameter("scope", str, default="project"),),
    "list_endpoints": (_VERB, _PREFIX),
    "find_endpoint": (Parameter("route", str, required=True), _VERB),
    "find_orphan_calls": (Parameter("category", str),),
    "list_frontend_callsites": (_VERB, _PREFIX),
    "get_symbol_source": (_FQN, Parameter("context_lines", int, default=5)),
}
TOOLS: dict[str, Callable] = {name: getattr(Tools, name) for name in PARAMETERS}
