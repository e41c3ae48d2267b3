"""Every operator as a query over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema, testgraphs
from .functions import routes
from .operators import attribute, containers, endpoints, export, extraction, incremental, linker, report, scan, source_text, traverse
from .plans import jobs
from .schema import Graph
from .sources import artifact, files, store
from .sources.scratch import blocks, dealt, one_by_one, stored
from .streaming import watch

DUCK = testgraphs.Dialect(spark=False)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name; views: those of the test graph that the SQL needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = testgraphs.oracle(sql, *views) if views else sql.strip()
        return f

    return add


def named(graph: Graph, name: str) -> DataFrame:
    """The types of the catalogue with this name."""
    return graph.nodes.filter((F.col("name") == name) & F.col("kind").isin(*schema.TYPE_KINDS))


def fqn_of(graph: Graph, name: str, suffix: str = "") -> str:
    """The full name of a catalogue type; one row comes to the driver."""
    return named(graph, name).select("fqn").first().fqn + suffix


def id_of(graph: Graph, fqn: str) -> str:
    return scan.by_fqn(graph.nodes, fqn).select("id").first().id


# ---------------------------------------------------------------- lookups


@query("SELECT kind, name, fqn FROM nodes WHERE name ILIKE '%T1_.Ship%' OR fqn ILIKE '%T1_.Ship%' ORDER BY length(fqn), fqn, id LIMIT 21", "nodes")
def find_symbol(spark, sf_dir):
    return scan.find_symbols(testgraphs.graph(spark, sf_dir).nodes, "T1_.Ship", 21).select("kind", "name", "fqn")


@query("SELECT kind, name, fqn FROM nodes WHERE kind = 'Class' AND (contains(lower(name), 'customer#0000000') OR contains(lower(fqn), 'customer#0000000')) ORDER BY length(fqn), fqn, id LIMIT 21", "nodes")
def find_symbol_by_kind(spark, sf_dir):
    return scan.find_symbols(testgraphs.graph(spark, sf_dir).nodes, "CUSTOMER#0000000", 21, "Class").select("kind", "name", "fqn")


@query("SELECT e.* FROM edges e JOIN nodes n ON n.name = 'Ship' AND n.fqn LIKE '%.T5.Ship()' AND (e.source_id = n.id OR e.target_id = n.id)", "nodes", "edges")
def edges_by_direction(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return scan.edges_of(g, id_of(g, fqn_of(g, "T5", ".Ship()")), "both").select("source_id", "target_id", "kind")


@query("SELECT e.kind AS rel_kind, s.kind AS neighbour_kind, s.fqn AS neighbour_fqn FROM edges e JOIN nodes n ON n.id = e.target_id AND n.fqn LIKE '%.T5.Ship()' LEFT JOIN nodes s ON s.id = e.source_id WHERE e.kind <> 'Contains'", "nodes", "edges")
def dependencies_direct(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    start = scan.by_fqn(g.nodes, fqn_of(g, "T5", ".Ship()")).select("id")
    return scan.neighbours(g, start, "incoming").select("rel_kind", "neighbour_kind", "neighbour_fqn")


@query("SELECT n.id, n.kind, n.fqn FROM nodes n WHERE n.id IN (SELECT target_id FROM edges WHERE kind = 'HandledBy')", "nodes", "edges")
def nodes_by_ids(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return scan.by_ids(g.nodes, scan.by_kind(g.edges, "HandledBy").select(F.col("target_id").alias("id"))).select("id", "kind", "fqn")


@query("SELECT kind, fqn, name FROM nodes WHERE kind = 'Interface'", "nodes")
def nodes_by_kind(spark, sf_dir):
    return scan.by_kind(testgraphs.graph(spark, sf_dir).nodes, "Interface").select("kind", "fqn", "name")


def usages_of(g: Graph, fqn: str) -> DataFrame:
    targets = scan.by_fqn(g.nodes, fqn).select(F.col("id").alias("target_id"))
    ids = g.edges.filter(F.col("kind").isin(*schema.USAGE_KINDS)).join(targets, "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return scan.by_ids(g.nodes, ids)


@query(f"SELECT DISTINCT s.kind, s.fqn, s.file FROM edges e JOIN nodes n ON n.id = e.target_id AND n.fqn LIKE '%.T5.Ship()' JOIN nodes s ON s.id = e.source_id WHERE e.kind IN {schema.USAGE_KINDS} ORDER BY coalesce(s.file, ''), s.fqn, s.kind LIMIT 50", "nodes", "edges")
def find_usages(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return usages_of(g, fqn_of(g, "T5", ".Ship()")).select("kind", "fqn", "file").orderBy(F.coalesce("file", F.lit("")), "fqn", "kind").limit(50)


# ---------------------------------------------------------------- traversal

WALK = """
WITH RECURSIVE walk(id, depth) AS (
  SELECT {start}
  UNION
  SELECT e.{far}, w.depth + 1 FROM walk w JOIN edges e ON e.{near} = w.id AND e.kind <> 'Contains' WHERE w.depth < {depth}
),
near AS (SELECT id, min(depth) AS depth FROM walk WHERE id NOT IN (SELECT id FROM walk WHERE depth = 0) GROUP BY id)
"""
SUPPLIER_1 = "id, 0 FROM nodes WHERE kind = 'Class' AND name = 'Supplier#000000001'"
CUSTOMER_1 = "id, 0 FROM nodes WHERE kind = 'Class' AND name = 'Customer#000000001'"
REACHED = "SELECT n.kind, n.fqn, CAST(depth AS INTEGER) AS depth FROM near JOIN nodes n USING (id) ORDER BY depth, n.fqn, n.id LIMIT {limit}"


def node_named(g: Graph, name: str) -> str:
    return g.nodes.filter((F.col("kind") == "Class") & (F.col("name") == name)).select("id").first().id


@query(WALK.format(start=SUPPLIER_1, near="target_id", far="source_id", depth=5) + REACHED.format(limit=500), "nodes", "edges")
def traverse_incoming(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return traverse.traverse(g, node_named(g, "Supplier#000000001"), "incoming").select("kind", "fqn", "depth")


@query(WALK.format(start=CUSTOMER_1, near="source_id", far="target_id", depth=2) + REACHED.format(limit=500), "nodes", "edges")
def traverse_outgoing(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return traverse.traverse(g, node_named(g, "Customer#000000001"), "outgoing", 2).select("kind", "fqn", "depth")


@query(WALK.format(start=CUSTOMER_1, near="source_id", far="target_id", depth=3) + "SELECT n.kind, n.fqn, CAST(depth AS INTEGER) AS depth FROM near JOIN nodes n USING (id) WHERE depth >= 2", "nodes", "edges")
def dependencies_transitive(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return traverse.traverse(g, node_named(g, "Customer#000000001"), "outgoing", 3, None).filter("depth >= 2").select("kind", "fqn", "depth")


DERIVED = """
WITH RECURSIVE down(seed, id) AS (
  SELECT t.id, e.source_id FROM nodes t JOIN edges e ON e.target_id = t.id AND e.kind IN ('Inherits', 'Implements') WHERE {seed}
  UNION
  SELECT d.seed, e.source_id FROM down d JOIN edges e ON e.target_id = d.id AND e.kind IN ('Inherits', 'Implements')
)
"""


@query(DERIVED.format(seed="t.name = 'T1'") + "SELECT n.kind, n.fqn FROM down JOIN nodes n USING (id)", "nodes", "edges")
def closure_implementers(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return scan.by_ids(g.nodes, traverse.closure(g, named(g, "T1").select("id"))).select("kind", "fqn")


@query(
    DERIVED.format(seed="t.name = 'T1'")
    + """, dirs AS (SELECT name, lower(regexp_replace(file, '[^/]*$', '')) AS dir FROM nodes WHERE kind = 'Project'),
found AS (SELECT n.kind, n.fqn, (SELECT max_by(d.name, length(d.dir)) FROM dirs d WHERE starts_with(lower(n.file), d.dir)) AS project FROM (SELECT DISTINCT id FROM down) JOIN nodes n USING (id))
SELECT * FROM found ORDER BY coalesce(project, '~unknown'), fqn, kind LIMIT 100""",
    "nodes",
    "edges",
)
def find_implementations(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    found = attribute.with_project(traverse.implementations(g, fqn_of(g, "T1")), g.nodes)
    return found.select("kind", "fqn", "project").orderBy(F.coalesce("project", F.lit("~unknown")), "fqn", "kind").limit(100)


@query(
    DERIVED.format(seed="t.name = 'T10'")
    + "SELECT m.kind, m.fqn FROM (SELECT DISTINCT id FROM down) JOIN nodes t USING (id) JOIN nodes m ON m.kind = 'Method' AND m.fqn = concat(t.fqn, '.Ship()')",
    "nodes",
    "edges",
)
def member_implementations(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    found = traverse.member_implementations(g, scan.by_fqn(g.nodes, fqn_of(g, "T10", ".Ship()")))
    return scan.by_ids(g.nodes, found.select("id")).select("kind", "fqn")


IMPACT = (
    DERIVED.format(seed="t.name = 'T10'").replace("down(", "down(", 1)
    + """, changing AS (SELECT id FROM nodes WHERE name = 'T10' UNION SELECT e.target_id FROM edges e JOIN nodes t ON t.id = e.source_id AND t.name = 'T10' WHERE e.kind = 'Contains'),
implementers AS (
  SELECT id FROM down WHERE id NOT IN (SELECT id FROM changing)
  UNION SELECT m.id FROM down JOIN nodes t ON t.id = down.id JOIN nodes m ON m.kind = 'Method' AND m.fqn = concat(t.fqn, '.Ship()')
),
seeds AS (SELECT id FROM changing UNION SELECT id FROM implementers),
walk(seed, id, depth) AS (
  SELECT id, id, 0 FROM seeds
  UNION
  SELECT w.seed, e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.id AND e.kind <> 'Contains' WHERE w.depth < 5
),
reached AS (SELECT id, min(depth) AS depth FROM walk WHERE id <> seed GROUP BY id),
impacted AS (
  SELECT n.kind, n.fqn, n.file, CAST(coalesce(r.depth, 1) AS INTEGER) AS depth, i.id IS NOT NULL AS is_implementer
  FROM reached r FULL JOIN implementers i USING (id) JOIN nodes n ON n.id = coalesce(r.id, i.id) WHERE coalesce(r.id, i.id) NOT IN (SELECT id FROM changing)
)
"""
)


@query(IMPACT + "SELECT kind, fqn, depth, is_implementer FROM impacted", "nodes", "edges")
def impact_analysis(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return traverse.impact(g, fqn_of(g, "T10")).select("kind", "fqn", "depth", "is_implementer")


@query(
    IMPACT
    + """, dirs AS (SELECT name, lower(regexp_replace(file, '[^/]*$', '')) AS dir FROM nodes WHERE kind = 'Project')
SELECT coalesce(project, '(unknown)') AS project, kind, CAST(count(*) AS BIGINT) AS n
FROM (SELECT kind, (SELECT max_by(d.name, length(d.dir)) FROM dirs d WHERE starts_with(lower(i.file), d.dir)) AS project FROM impacted i) AS x
GROUP BY GROUPING SETS ((coalesce(project, '(unknown)')), (kind))""",
    "nodes",
    "edges",
)
def impact_by_project(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    found = attribute.with_project(traverse.impact(g, fqn_of(g, "T10")), g.nodes).withColumn("project", F.coalesce("project", F.lit("(unknown)")))
    return found.groupingSets([["project"], ["kind"]], "project", "kind").agg(F.count("*").alias("n"))


@query(
    """
WITH RECURSIVE tree(direction, level, id, path) AS (
  SELECT d, 0, id, fqn FROM nodes, (VALUES ('down'), ('up')) AS x(d) WHERE name = 'T4' AND kind <> 'Method'
  UNION ALL
  SELECT t.direction, t.level + 1, n.id, concat(t.path, ' > ', n.fqn) FROM tree t
  JOIN edges e ON e.kind IN ('Inherits', 'Implements') AND CASE t.direction WHEN 'down' THEN e.target_id ELSE e.source_id END = t.id
  JOIN nodes n ON n.id = CASE t.direction WHEN 'down' THEN e.source_id ELSE e.target_id END WHERE t.level < 5
)
SELECT direction, CAST(level AS INTEGER) AS level, path, false AS already_shown FROM tree""",
    "nodes",
    "edges",
)
def type_hierarchy(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    start = named(g, "T4").select("id").first().id
    both = [traverse.hierarchy(g, start, d).withColumn("direction", F.lit(d)) for d in ("down", "up")]
    path = F.array_join(F.transform("path", lambda p: p["fqn"]), " > ")
    return both[0].unionByName(both[1]).select("direction", "level", path.alias("path"), "already_shown")


@query("""
WITH RECURSIVE steps AS (SELECT s_suppkey // 2 AS up, s_suppkey AS k FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey // 3, s_suppkey FROM supplier WHERE s_suppkey > 2),
kids AS (SELECT up, list(k ORDER BY concat('S', k)) AS ks FROM steps GROUP BY up),
walk(stack, seen, path, already_shown) AS (
  SELECT [[CAST(1 AS BIGINT)]], CAST([] AS BIGINT[]), CAST(NULL AS BIGINT[]), CAST(NULL AS BOOLEAN)
  UNION ALL
  SELECT CASE WHEN list_contains(seen, id) OR len(p) > 5 THEN stack[2:] ELSE list_concat(list_transform(coalesce(ks, []), lambda k: list_append(p, k)), stack[2:]) END, list_append(seen, id), p, list_contains(seen, id)
  FROM (SELECT *, stack[1] AS p, stack[1][-1] AS id FROM walk WHERE len(stack) > 0) AS w LEFT JOIN kids ON up = id)
SELECT CAST(len(path) - 1 AS INTEGER) AS level, array_to_string(list_transform(path, lambda k: concat('S', k)), ' > ') AS path, already_shown FROM walk WHERE path IS NOT NULL""")
def type_hierarchy_diamonds(spark, sf_dir):
    """Type k derives from types k // 2 and k // 3, so most are reached by several ways; the SQL walks the tree node by node."""
    k = testgraphs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    none = F.lit(None)
    nodes = k.select(name(F.col("k")).alias("id"), F.lit("Class").alias("kind"), name(F.col("k")).alias("name"), name(F.col("k")).alias("fqn"), none.cast("string").alias("file"), *(none.cast("int").alias(c) for c in ("span_start", "span_end")))
    edge = lambda n: k.filter(F.col("k") >= n).select(name(F.col("k")).alias("source_id"), name(F.floor(F.col("k") / n)).alias("target_id"), F.lit("Inherits").alias("kind"))
    rows = traverse.hierarchy(Graph(nodes, edge(2).unionByName(edge(3))), "S1", "down")
    return rows.select("level", F.array_join(F.transform("path", lambda p: p["fqn"]), " > ").alias("path"), "already_shown")


@query(
    WALK.format(start="id, 0 FROM nodes WHERE fqn LIKE '%.T5.Ship()'", near="target_id", far="source_id", depth=5)
    + "SELECT split_part(n.file, '/', 3) AS project, n.kind, n.fqn FROM near JOIN nodes n USING (id) WHERE n.kind IN ('Method', 'Constructor', 'Property') AND contains(lower(split_part(n.file, '/', 3)), 'test') ORDER BY project, n.fqn LIMIT 60",
    "nodes",
    "edges",
)
def tests_for_symbol(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return tests_of(g, fqn_of(g, "T5", ".Ship()")).select("project", "kind", "fqn").orderBy("project", "fqn").limit(60)


def tests_of(g: Graph, fqn: str) -> DataFrame:
    """Members of test projects that reach what has this name within five steps."""
    from .functions.symbols import is_test_project

    seeds = scan.by_fqn(g.nodes, fqn).select("id")
    reached = traverse.levels(scan.dependency_edges(g.edges), seeds, "incoming", traverse.MAX_DEPTH).select("id")
    members = scan.by_ids(g.nodes, reached).filter(F.col("kind").isin(*schema.TEST_KINDS))
    return attribute.with_project(members, g.nodes).filter(is_test_project(F.col("project")))


# ---------------------------------------------------------------- containers

PROJECTS = """
WITH dirs AS (SELECT name, lower(regexp_replace(file, '[^/]*$', '')) AS dir FROM nodes WHERE kind = 'Project'),
files AS (SELECT DISTINCT file FROM nodes WHERE file IS NOT NULL),
of_file AS (SELECT f.file, max_by(d.name, length(d.dir)) AS project FROM files f JOIN dirs d ON starts_with(lower(f.file), d.dir) GROUP BY f.file),
of_node AS (SELECT id, kind, fqn, project FROM nodes LEFT JOIN of_file USING (file)),
pairs AS (SELECT a.project AS "from", b.project AS "to", CAST(count(*) AS BIGINT) AS n FROM edges e JOIN of_node a ON a.id = e.source_id JOIN of_node b ON b.id = e.target_id
  WHERE e.kind <> 'Contains' AND a.project <> b.project GROUP BY 1, 2)
"""


@query(PROJECTS + "SELECT * FROM pairs", "nodes", "edges")
def project_dependencies(spark, sf_dir):
    return containers.container_edges(testgraphs.graph(spark, sf_dir))


@query(PROJECTS + """SELECT * FROM pairs WHERE "from" = 'ASIA' OR "to" = 'ASIA' ORDER BY n DESC, "from", "to" LIMIT 40""", "nodes", "edges")
def project_dependencies_scoped(spark, sf_dir):
    pairs = containers.container_edges(testgraphs.graph(spark, sf_dir))
    return pairs.filter((F.col("from") == "ASIA") | (F.col("to") == "ASIA")).orderBy(F.desc("n"), "from", "to").limit(40)


@query(PROJECTS + """SELECT * FROM pairs ORDER BY n DESC, "from", "to" LIMIT 1""", "nodes", "edges")
def hotspot(spark, sf_dir):
    return containers.container_edges(testgraphs.graph(spark, sf_dir)).orderBy(F.desc("n"), "from", "to").limit(1)


@query(PROJECTS + "SELECT fqn, project FROM of_node", "nodes", "edges")
def project_attribution(spark, sf_dir):
    nodes = testgraphs.graph(spark, sf_dir).nodes
    return attribute.with_project(nodes, nodes).select("fqn", "project")


@query(
    """
WITH spaces AS (SELECT fqn AS container FROM nodes WHERE kind = 'Namespace')
SELECT n.id, max_by(s.container, length(s.container)) AS container FROM nodes n JOIN spaces s ON n.fqn = s.container OR starts_with(n.fqn, concat(s.container, '.')) GROUP BY n.id""",
    "nodes",
)
def namespace_attribution(spark, sf_dir):
    return attribute.namespace_of_nodes(testgraphs.graph(spark, sf_dir).nodes)


@query(
    """
WITH spaces AS (SELECT fqn AS container FROM nodes WHERE kind = 'Namespace'),
own AS (SELECT n.id, max_by(s.container, length(s.container)) AS container FROM nodes n JOIN spaces s ON n.fqn = s.container OR starts_with(n.fqn, concat(s.container, '.')) GROUP BY n.id)
SELECT a.container AS "from", b.container AS "to", CAST(count(*) AS BIGINT) AS n FROM edges e JOIN own a ON a.id = e.source_id JOIN own b ON b.id = e.target_id
WHERE e.kind <> 'Contains' AND a.container <> b.container GROUP BY 1, 2""",
    "nodes",
    "edges",
)
def namespace_dependencies(spark, sf_dir):
    return containers.container_edges(testgraphs.graph(spark, sf_dir), "namespace")


TRADE = """
trade AS (
  SELECT DISTINCT concat('N', CAST(c_nationkey AS VARCHAR(9))) AS "from", concat('N', CAST(s_nationkey AS VARCHAR(9))) AS "to"
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE c_nationkey <> s_nationkey
)"""


@query(f"""
WITH RECURSIVE {TRADE}, reach(a, b) AS (SELECT "from", "to" FROM trade UNION SELECT r.a, t."to" FROM reach r JOIN trade t ON t."from" = r.b)
SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1""")
def container_scc(spark, sf_dir):
    return containers.components(trade_edges(spark, sf_dir))


@query(SQL["container_scc"])
def container_scc_by_colour(spark, sf_dir):
    return containers.components_by_colour(trade_edges(spark, sf_dir))


def trade_edges(spark, sf_dir) -> DataFrame:
    t = lambda name: testgraphs.table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    return joined.filter("c_nationkey <> s_nationkey").select(name("c_nationkey").alias("from"), name("s_nationkey").alias("to")).distinct()


@query("""
WITH RECURSIVE steps AS (SELECT event_type AS "from", lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "to" FROM events),
pairs AS (SELECT "from", "to", count(*) AS n FROM steps WHERE "from" <> "to" GROUP BY 1, 2),
paths(node, path) AS (
  SELECT "to", ["from", "to"] FROM pairs WHERE "from" = (SELECT min("from") FROM pairs)
  UNION ALL
  SELECT p."to", list_append(path, p."to") FROM paths JOIN pairs p ON p."from" = node WHERE node <> path[1] AND (p."to" = path[1] OR NOT list_contains(path, p."to"))
),
best AS (SELECT min(path) AS path FROM paths WHERE node = path[1])
SELECT array_to_string(path, ' -> ') AS path, CAST(len(path) - 1 AS INTEGER) AS hops,
  CAST((SELECT sum(n) FROM pairs p, (SELECT unnest(range(1, len(path))) AS i FROM best) AS x WHERE p."from" = path[i] AND p."to" = path[i + 1]) AS BIGINT) AS weight FROM best""")
def cycle_weights(spark, sf_dir):
    from pyspark.sql import Window

    events = testgraphs.table(spark, sf_dir, "events")
    steps = events.select(F.col("event_type").alias("from"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("to"))
    found = containers.cycles(containers.crossing(steps))
    return found.select(F.array_join("path", " -> ").alias("path"), "hops", "weight")


# ---------------------------------------------------------------- statistics


@query(PROJECTS + """, rows AS (
  SELECT 'dependency' AS part, concat("from", ' -> ', "to") AS name, n FROM (SELECT * FROM pairs ORDER BY n DESC, "from", "to" LIMIT 40)
  UNION ALL SELECT 'node kind', kind, count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'edge kind', kind, count(*) FROM edges GROUP BY kind
  UNION ALL SELECT 'project', name, 1 FROM nodes WHERE kind = 'Project' UNION ALL SELECT 'namespace', fqn, 1 FROM (SELECT fqn FROM nodes WHERE kind = 'Namespace' ORDER BY length(fqn), fqn LIMIT 15)
  UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges)
SELECT part, name, CAST(n AS BIGINT) AS n FROM rows""", "nodes", "edges")
def architecture_overview(spark, sf_dir):
    """What the tool of that name shows, as rows."""
    g = testgraphs.graph(spark, sf_dir)
    pairs = containers.container_edges(g).orderBy(F.desc("n"), "from", "to").limit(40)
    one = F.lit(1).cast("long")
    part = lambda label, df, name, n: df.select(F.lit(label).alias("part"), name.alias("name"), n.alias("n"))
    kinds = [part(label, scan.kind_counts(df), F.col("kind"), F.col("n")) for label, df in (("node kind", g.nodes), ("edge kind", g.edges))]
    totals = [part("total", df.agg(F.count("*").alias("n")), F.lit(name), F.col("n")) for name, df in (("nodes", g.nodes), ("edges", g.edges))]
    projects = part("project", scan.by_kind(g.nodes, "Project"), F.col("name"), one)
    spaces = part("namespace", scan.shortest_first(scan.by_kind(g.nodes, "Namespace"), 15), F.col("fqn"), one)
    return reduce(DataFrame.unionByName, [part("dependency", pairs, F.concat_ws(" -> ", "from", "to"), F.col("n")), *kinds, *totals, projects, spaces])


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY kind", "nodes")
def node_kind_counts(spark, sf_dir):
    return scan.kind_counts(testgraphs.graph(spark, sf_dir).nodes)


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY kind", "edges")
def edge_kind_counts(spark, sf_dir):
    return scan.kind_counts(testgraphs.graph(spark, sf_dir).edges)


@query("SELECT name, fqn FROM nodes WHERE kind = 'Namespace' ORDER BY length(fqn), fqn LIMIT 15", "nodes")
def architecture_namespaces(spark, sf_dir):
    nodes = testgraphs.graph(spark, sf_dir).nodes
    return scan.shortest_first(scan.by_kind(nodes, "Namespace"), 15).select("name", "fqn")


@query("SELECT id, kind, fqn, id AS computed FROM nodes", "nodes")
def node_ids(spark, sf_dir):
    return testgraphs.graph(spark, sf_dir).nodes.select("id", "kind", "fqn", schema.node_id(F.col("kind"), F.col("fqn")).alias("computed"))


# ---------------------------------------------------------------- routes and links


def duck_skeleton(x: str) -> str:
    cut = f"split_part(split_part({x}, '?', 1), '#', 1)"
    return f"CASE WHEN trim({x}) = '' THEN '' ELSE trim(regexp_replace(regexp_replace(lower({cut}), '\\{{[^}}]*\\}}', '{{x}}', 'g'), '/{{2,}}', '/', 'g'), '/') END"


ROUTES = f"""
WITH calls AS (SELECT id AS call_id, fqn, name, split_part(fqn, ' ', 1) AS verb, string_split({duck_skeleton("concat('/api', name)")}, '/') AS segs FROM nodes WHERE kind = 'FrontendCallSite'),
ends AS (SELECT id AS endpoint_id, fqn AS endpoint_fqn, split_part(fqn, ' ', 1) AS endpoint_verb, string_split({duck_skeleton("name")}, '/') AS endpoint_segs FROM nodes WHERE kind = 'Endpoint'),
meets AS (SELECT * FROM calls JOIN ends ON len(segs) = len(endpoint_segs) WHERE len(list_filter(list_zip(segs, endpoint_segs), lambda p: p[1] <> p[2] AND p[1] <> '{{x}}' AND p[2] <> '{{x}}')) = 0)
"""
LINKED = (
    ROUTES
    + """, same AS (SELECT * FROM meets WHERE verb = endpoint_verb),
cands AS (SELECT call_id, any_value(segs) AS segs, count(*) AS n, list(endpoint_segs) AS all_segs FROM same GROUP BY call_id),
diffs AS (SELECT call_id, n, segs, list_filter(range(1, len(segs) + 1), lambda i: len(list_distinct(list_transform(all_segs, lambda s: s[i]))) > 1) AS diff FROM cands),
scored AS (SELECT s.call_id, s.endpoint_id, d.n, d.diff, len(list_filter(d.diff, lambda i: d.segs[i] = '{x}')) = 0 AS literal,
  array_to_string(list_transform(d.diff, lambda i: CASE WHEN s.endpoint_segs[i] = '{x}' THEN '1' ELSE '0' END), '') AS score FROM same s JOIN diffs d USING (call_id)),
ranked AS (SELECT *, score = min(score) OVER (PARTITION BY call_id) AS least FROM scored),
winners AS (SELECT call_id, any_value(n) AS n, any_value(literal) AND len(any_value(diff)) > 0 AND count(*) FILTER (least) = 1 AS resolved, any_value(endpoint_id) FILTER (least) AS winner FROM ranked GROUP BY call_id),
outcomes AS (
  SELECT c.call_id, c.fqn, c.name, c.verb, w.winner, w.n,
    CASE WHEN c.verb = 'UNKNOWN' THEN 'UnknownVerb' WHEN w.n = 1 THEN 'Unique' WHEN w.resolved THEN 'PrecedenceResolved' WHEN w.n > 1 THEN 'SetEdge'
      WHEN c.call_id IN (SELECT call_id FROM meets) THEN 'VerbMismatch' ELSE 'NoSkeletonMatch' END AS outcome
  FROM calls c LEFT JOIN winners w ON w.call_id = c.call_id AND c.verb <> 'UNKNOWN'),
linked AS (SELECT o.call_id, o.outcome, s.endpoint_id, s.endpoint_fqn FROM outcomes o JOIN same s USING (call_id) WHERE o.outcome IN ('Unique', 'SetEdge') OR (o.outcome = 'PrecedenceResolved' AND s.endpoint_id = o.winner))
"""
)


@query(f"SELECT url, {duck_skeleton('url')} AS skeleton FROM pages")
def route_normalize(spark, sf_dir):
    return testgraphs.table(spark, sf_dir, "pages").select("url", routes.skeleton(F.col("url")).alias("skeleton"))


@query(ROUTES + "SELECT call_id, endpoint_id FROM meets", "nodes")
def route_match(spark, sf_dir):
    nodes = testgraphs.graph(spark, sf_dir).nodes
    return linker.meets(linker.call_routes(nodes), linker.endpoint_routes(nodes), same_verb=False).select("call_id", "endpoint_id")


@query(LINKED + "SELECT call_id, outcome FROM outcomes", "nodes")
def link_outcomes(spark, sf_dir):
    return linker.call_outcomes(linker.links(testgraphs.graph(spark, sf_dir).nodes)).select("call_id", "outcome")


@query(LINKED + f"SELECT o.outcome, CAST(count(c.call_id) AS BIGINT) AS n FROM (SELECT unnest({list(linker.OUTCOMES)}) AS outcome) o LEFT JOIN outcomes c USING (outcome) GROUP BY 1", "nodes")
def link_outcome_counts(spark, sf_dir):
    return linker.outcome_counts(linker.call_outcomes(linker.links(testgraphs.graph(spark, sf_dir).nodes)))


@query(LINKED + "SELECT call_id AS source_id, endpoint_id AS target_id, 'CallsEndpoint' AS kind FROM linked", "nodes")
def link_edges(spark, sf_dir):
    return linker.link_edges(linker.links(testgraphs.graph(spark, sf_dir).nodes))


def with_names(rows: DataFrame, targets: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Rows (route, ...) with the sorted full names of their routes' targets in one text, null where there are none; a text is shuffled once for 64 rows."""
    texts = linker.listed(rows, targets, nodes).select("route", F.array_join("names", " | ").alias(column))
    others = [c for c in rows.columns if c != "route"]
    met = blocks(rows.select("route", F.struct(*others).alias("row")), "route", "row", 64).join(texts, "route", "left").select("row", column)
    return dealt(met).select(one_by_one("row").alias("row"), column).select("row.*", column)


def call_sites(nodes: DataFrame, found: linker.Links) -> DataFrame:
    return linker.call_outcomes(found).join(nodes.select(F.col("id").alias("call_id"), "fqn", "name"), "call_id")


@query(
    LINKED
    + """SELECT o.outcome, o.fqn, o.name, (SELECT string_agg(m.endpoint_fqn, ' | ' ORDER BY m.endpoint_fqn) FROM meets m WHERE m.call_id = o.call_id AND o.outcome = 'VerbMismatch') AS conflicts
FROM outcomes o WHERE o.outcome IN ('NoSkeletonMatch', 'VerbMismatch', 'UnknownVerb')""",
    "nodes",
)
def orphan_calls(spark, sf_dir):
    nodes = testgraphs.graph(spark, sf_dir).nodes
    found = linker.links(nodes)
    sites = call_sites(nodes, found).filter(F.col("outcome").isin("NoSkeletonMatch", "VerbMismatch", "UnknownVerb"))
    return with_names(sites.select("route", "outcome", "fqn", "name"), found.conflicts, nodes, "conflicts")


@query(
    LINKED
    + f"""SELECT o.fqn, o.name, o.outcome, (SELECT string_agg(l.endpoint_fqn, ' | ' ORDER BY l.endpoint_fqn) FROM linked l WHERE l.call_id = o.call_id) AS endpoints
FROM outcomes o WHERE o.verb = 'GET' AND starts_with({duck_skeleton("o.name")}, 'en') ORDER BY o.fqn LIMIT 100""",
    "nodes",
)
def frontend_callsites(spark, sf_dir):
    nodes = testgraphs.graph(spark, sf_dir).nodes
    found = linker.links(nodes)
    rows = stored(call_sites(nodes, found).filter((routes.verb(F.col("fqn")) == "GET") & routes.skeleton(F.col("name")).startswith("en")).orderBy("fqn").limit(100), "sites")
    return with_names(rows.select("route", "fqn", "name", "outcome"), found.endpoints, nodes, "endpoints")


HANDLERS = """(SELECT string_agg(h.fqn, ' | ' ORDER BY h.fqn) FROM edges e JOIN nodes h ON h.id = e.target_id WHERE e.source_id = n.id AND e.kind = 'HandledBy') AS handlers"""


@query(f"SELECT split_part(n.file, '/', 3) AS project, split_part(fqn, ' ', 1) AS verb, name, {HANDLERS} FROM nodes n WHERE kind = 'Endpoint' AND split_part(fqn, ' ', 1) = 'GET' AND starts_with({duck_skeleton('name')}, 'api/en') ORDER BY name, verb LIMIT 100", "nodes", "edges")
def list_endpoints(spark, sf_dir):
    return endpoints.list_endpoints(testgraphs.graph(spark, sf_dir), "GET", "/API/en/").select("project", "verb", "name", "handlers")


@query(
    LINKED
    + f""", matched AS (SELECT e.endpoint_id, e.endpoint_fqn FROM ends e WHERE len(endpoint_segs) = 3 AND endpoint_segs[1] IN ('api', '{{x}}') AND endpoint_segs[2] IN ('en', '{{x}}') ORDER BY endpoint_fqn LIMIT 25)
SELECT split_part(n.file, '/', 3) AS project, n.fqn, {HANDLERS}, (SELECT string_agg(c.fqn, ' | ' ORDER BY c.fqn) FROM linked l JOIN nodes c ON c.id = l.call_id WHERE l.endpoint_id = n.id) AS callers
FROM matched JOIN nodes n ON n.id = endpoint_id""",
    "nodes",
    "edges",
)
def find_endpoint(spark, sf_dir):
    g, route = testgraphs.graph(spark, sf_dir), "/api/en/{key}/"
    g, _ = linker.relinked(g, towards=endpoints.matching(g.nodes, route))
    return endpoints.find_endpoints(g, route).select("project", "fqn", "handlers", "callers")


@query(f"SELECT fqn, name FROM nodes WHERE kind = 'Endpoint' AND contains({duck_skeleton('name')}, '25') ORDER BY length(name), fqn LIMIT 5", "nodes")
def near_miss_endpoints(spark, sf_dir):
    return endpoints.near_misses(testgraphs.graph(spark, sf_dir).nodes, "/nowhere/at/25/{id}").select("fqn", "name")


# ---------------------------------------------------------------- maintenance


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents as files: some altered, removed and added."""
    docs = testgraphs.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    current = docs.filter("doc_id % 13 <> 5").withColumn("text", F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return files.hash_texts(current), files.hash_texts(docs.filter("doc_id % 10 <> 1"))


@query("""
WITH docs AS (SELECT doc_id, concat(source, '/', doc_id) AS path, text FROM documents),
now AS (SELECT path, sha256(CASE WHEN doc_id % 7 = 3 THEN concat(text, '!') ELSE text END) AS h FROM docs WHERE doc_id % 13 <> 5),
before AS (SELECT path, sha256(text) AS h FROM docs WHERE doc_id % 10 <> 1)
SELECT path, CASE WHEN before.h IS NULL THEN 'added' WHEN now.h IS NULL THEN 'removed' WHEN now.h <> before.h THEN 'changed' ELSE 'unchanged' END AS status FROM now FULL JOIN before USING (path)""")
def file_diff(spark, sf_dir):
    return incremental.file_diff(*snapshots(spark, sf_dir))


def graph_snapshots(spark, sf_dir) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph and two states of its files: types T...7 changed, T...9 removed, T...5 added."""
    g = testgraphs.graph(spark, sf_dir)
    paths = g.nodes.filter("file is not null").select(F.col("file").alias("path")).distinct()
    changed = F.when(F.col("path").rlike(r"/T\d*7\.cs$"), "2").otherwise("1")
    current = paths.filter(~F.col("path").rlike(r"/T\d*9\.cs$")).withColumn("content_hash", changed)
    return g, current, paths.filter(~F.col("path").rlike(r"/T\d*5\.cs$")).withColumn("content_hash", F.lit("1"))


PLAN = r"""
WITH paths AS (SELECT DISTINCT file AS path FROM nodes WHERE file IS NOT NULL),
diff AS (SELECT path, CASE WHEN regexp_matches(path, '/T\d*9\.cs$') THEN 'removed' WHEN regexp_matches(path, '/T\d*5\.cs$') THEN 'added' WHEN regexp_matches(path, '/T\d*7\.cs$') THEN 'changed' ELSE 'unchanged' END AS status FROM paths),
affected AS (SELECT id FROM nodes JOIN diff ON path = file AND status <> 'unchanged'),
dependents AS (SELECT DISTINCT s.file AS path FROM edges e JOIN affected a ON a.id = e.target_id JOIN nodes s ON s.id = e.source_id JOIN diff d ON d.path = s.file AND d.status <> 'removed'),
plan AS (SELECT path, 'analyze' AS action FROM diff WHERE status IN ('added', 'changed') UNION SELECT path, 'analyze' FROM dependents UNION SELECT path, 'evict' FROM diff WHERE status = 'removed')
"""


@query(PLAN + "SELECT * FROM plan", "nodes", "edges")
def incremental_plan(spark, sf_dir):
    return incremental.plan(*graph_snapshots(spark, sf_dir))


@query(PLAN + "SELECT e.* FROM edges e JOIN nodes s ON s.id = e.source_id WHERE s.file IS NULL OR s.file NOT IN (SELECT path FROM plan)", "nodes", "edges")
def evicted_edges(spark, sf_dir):
    g, current, previous = graph_snapshots(spark, sf_dir)
    return incremental.evict(g, incremental.plan(g, current, previous)).edges


@query("SELECT e.* FROM edges e JOIN nodes s ON s.id = e.source_id AND s.kind <> 'Interface' JOIN nodes t ON t.id = e.target_id AND t.kind <> 'Interface'", "nodes", "edges")
def prune_dangling(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return scan.without_dangling(Graph(g.nodes.filter("kind <> 'Interface'"), g.edges)).edges


@query(
    """
WITH kept AS (SELECT * FROM nodes WHERE NOT (fqn LIKE 'Parts.%.T%' OR fqn LIKE 'Geo.NATION_3.%')),
live AS (SELECT DISTINCT e.source_id AS id FROM edges e JOIN kept c ON c.id = e.target_id AND c.kind <> 'Namespace' WHERE e.kind = 'Contains'),
live2 AS (SELECT id FROM live UNION SELECT e.source_id FROM edges e JOIN live ON live.id = e.target_id WHERE e.kind = 'Contains')
SELECT kind, fqn FROM kept WHERE kind <> 'Namespace' OR id IN (SELECT id FROM live2)""",
    "nodes",
    "edges",
)
def prune_orphan_namespaces(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    kept = g.nodes.filter(~(F.col("fqn").like("Parts.%.T%") | F.col("fqn").like("Geo.NATION_3.%")))
    return incremental.without_orphan_namespaces(scan.without_dangling(Graph(kept, g.edges))).nodes.select("kind", "fqn")


@query("SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS n_nodes, CAST((SELECT count(*) FROM edges) AS BIGINT) AS n_edges, true AS same, false AS less", "nodes", "edges")
def graph_equality(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    counts = store.fingerprint(g)
    less = store.graphs_equal(g, Graph(g.nodes.filter("name <> 'T5'"), g.edges))
    same = store.graphs_equal(g, Graph(g.nodes.repartition(3), g.edges.unionByName(g.edges.limit(5))))
    return spark.createDataFrame([(counts[0][0], counts[1][0], same, less)], "n_nodes long, n_edges long, same boolean, less boolean")


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE kind <> 'FrontendCallSite' GROUP BY kind UNION ALL SELECT 'FrontendCallSite', CAST(count(*) AS BIGINT) FROM pages", "nodes")
def replace_call_sites(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    new = testgraphs.table(spark, sf_dir, "pages").select(F.lit("FrontendCallSite").alias("kind"), F.lit("/x").alias("name"), F.concat(F.lit("GET new"), "page_id").alias("fqn"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end"))
    new = new.withColumn("id", schema.node_id(F.col("kind"), F.col("fqn")))
    return scan.kind_counts(incremental.replace_kinds(g, new.select(*schema.NODES.names)).nodes)


# ---------------------------------------------------------------- source text


@query("SELECT doc_id, CAST(length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1 AS INTEGER) AS line FROM documents WHERE text IS NOT NULL")
def line_of_offset(spark, sf_dir):
    docs = testgraphs.table(spark, sf_dir, "documents").filter("text is not null")
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("file"), F.floor(F.length("text") / 2).cast("int").alias("span_start"))
    return source_text.with_lines(rows, docs.select(F.col("doc_id").cast("string").alias("path"), "text")).select("doc_id", "line")


@query("""
WITH docs AS (SELECT doc_id, text, length(text) // 3 AS s, length(text) // 2 AS e, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
spans AS (SELECT *, length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1 AS l1, length(substr(text, 1, e)) - length(replace(substr(text, 1, e), chr(10), '')) + 1 AS l2 FROM docs)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, rtrim(lines[i], chr(13)) AS text
FROM (SELECT doc_id, lines, greatest(l1 - 2, 1) AS a, least(l2 + 2, len(lines), greatest(l1 - 2, 1) + 119) AS b FROM spans) AS x, LATERAL (SELECT unnest(range(a, b + 1)) AS i) AS y""")
def symbol_source(spark, sf_dir):
    docs = testgraphs.table(spark, sf_dir, "documents").filter("text is not null")
    spans = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file"), F.floor(F.length("text") / 3).cast("int").alias("span_start"), F.floor(F.length("text") / 2).cast("int").alias("span_end"))
    return source_text.symbol_source(spans, docs.select(F.col("doc_id").cast("string").alias("path"), "text"), 2).select(F.col("id").alias("doc_id"), "line_no", "text")


# ---------------------------------------------------------------- reports

RAW = """
SELECT CASE WHEN s_suppkey % 4 = 3 THEN concat('Note ', CAST(s_nationkey % 5 AS VARCHAR(9)))
  ELSE concat('Msbuild failed when processing the file ', chr(39), 'C:', chr(92), 'repo', chr(92), 'P', CAST(s_nationkey AS VARCHAR(9)), '.Core.csproj', chr(39), ' with message: Package ', chr(39), 'Pkg', CAST(s_suppkey % 6 AS VARCHAR(9)), chr(39), ' 1.', CAST(s_suppkey % 2 AS VARCHAR(9)),
    ' has a known ', CASE s_suppkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'odd' END, ' severity vulnerability', CASE WHEN s_suppkey % 7 = 0 THEN substr(s_name, 1, 0) ELSE concat(', https://adv/', CAST(s_suppkey % 9 AS VARCHAR(9))) END) END AS raw
FROM {supplier}"""
PARSED = f"""
WITH raws AS ({RAW.format(supplier='supplier')}),
parts AS (SELECT raw, CASE WHEN starts_with(raw, 'Msbuild') THEN regexp_extract(raw, 'with message: (.+)$', 1) ELSE raw END AS body, CASE WHEN starts_with(raw, 'Msbuild') THEN regexp_extract(raw, '([^\\\\]+)\\.csproj', 1) END AS project FROM raws),
parsed AS (SELECT body, project, nullif(regexp_extract(body, '^Package ''([^'']+)''', 1), '') AS package, nullif(regexp_extract(body, '^Package ''[^'']+'' (\\S+)', 1), '') AS version,
  nullif(regexp_extract(body, 'has a known (\\w+) severity', 1), '') AS severity, nullif(regexp_extract(body, 'vulnerability, (\\S+)$', 1), '') AS url FROM parts)
"""


def diagnostics(spark, sf_dir) -> DataFrame:
    raw = spark.sql(RAW, supplier=testgraphs.table(spark, sf_dir, "supplier"))
    return report.parse(raw)


@query(PARSED + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT body) AS BIGINT) AS unique_bodies FROM parsed")
def warning_summary(spark, sf_dir):
    return report.summary(diagnostics(spark, sf_dir))


@query(
    PARSED
    + """, ranks AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM parsed WHERE package IS NOT NULL)
SELECT r.package, r.version, CAST(count(DISTINCT coalesce('url:' || url, 'sev:' || severity)) AS BIGINT) AS advisories,
  (SELECT string_agg(severity, ', ' ORDER BY rank DESC, severity) FROM (SELECT DISTINCT severity, rank FROM ranks x WHERE x.package = r.package AND x.version = r.version)) AS severities,
  coalesce(string_agg(DISTINCT url, ', ' ORDER BY url), '') AS urls, coalesce(string_agg(DISTINCT project, ', ' ORDER BY project), '') AS projects
FROM ranks r GROUP BY r.package, r.version"""
)
def warning_audit_groups(spark, sf_dir):
    return report.audit_groups(diagnostics(spark, sf_dir))


@query(PARSED + "SELECT body, CAST(count(*) AS BIGINT) AS n, coalesce(string_agg(DISTINCT project, ', ' ORDER BY project), '') AS projects FROM parsed WHERE package IS NULL GROUP BY body")
def warning_other_groups(spark, sf_dir):
    return report.other_groups(diagnostics(spark, sf_dir))


@query("""
WITH sites AS (SELECT CASE WHEN page_id % 9 < 5 THEN 'FrontendCallSite' ELSE 'UnresolvedCallSite' END AS kind, CASE WHEN page_id % 9 >= 5 THEN concat('c', page_id % 3) END AS category FROM pages),
cats AS (SELECT category, count(*) AS n FROM sites WHERE kind = 'UnresolvedCallSite' GROUP BY 1)
SELECT CAST(count(*) FILTER (kind = 'FrontendCallSite') AS BIGINT) AS resolved, CAST(count(*) FILTER (kind = 'UnresolvedCallSite') AS BIGINT) AS unresolved,
  floor(count(*) FILTER (kind = 'FrontendCallSite') * 1000.0 / count(*) + 0.5) / 10 AS coverage, (SELECT string_agg(concat(category, '=', n), ',' ORDER BY category) FROM cats) AS by_category FROM sites""")
def artifact_stats(spark, sf_dir):
    pages = testgraphs.table(spark, sf_dir, "pages")
    sites = pages.select(F.when(F.col("page_id") % 9 < 5, artifact.RESOLVED).otherwise(artifact.UNRESOLVED).alias("kind"), F.when(F.col("page_id") % 9 >= 5, F.concat(F.lit("c"), F.col("page_id") % 3)).alias("category"))
    text = F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return artifact.statistics(sites).withColumn("by_category", text)


# ---------------------------------------------------------------- extraction


@query(
    f"""
WITH types AS (SELECT kind, fqn, 'Catalog' AS project FROM part_types UNION ALL SELECT kind, fqn, split_part(file, '/', 3) FROM parties WHERE kind <> 'Method'),
spaced AS (SELECT *, regexp_replace(fqn, '\\.[^.]*$', '') AS space FROM types),
pairs AS (SELECT 'Namespace' AS sk, space AS sf, kind AS tk, fqn AS tf FROM spaced UNION SELECT 'Namespace', split_part(space, '.', 1), 'Namespace', space FROM spaced UNION SELECT 'Project', project, 'Namespace', split_part(space, '.', 1) FROM spaced)
SELECT {DUCK.id("sk", "sf")} AS source_id, {DUCK.id("tk", "tf")} AS target_id, 'Contains' AS kind FROM pairs""",
    "part_types",
    "parties",
)
def containment_edges(spark, sf_dir):
    own = testgraphs.graph(spark, sf_dir).nodes.filter(F.col("kind").isin(*schema.TYPE_KINDS))
    none = F.lit(None).cast("string")
    project = F.when(F.col("fqn").startswith("Parts."), "Catalog").otherwise(F.split_part("file", F.lit("/"), F.lit(3)))
    return extraction.containment(own.select("kind", "fqn", F.regexp_replace("fqn", r"\.[^.]*$", "").alias("namespace"), project.alias("project"), none.alias("outer_kind"), none.alias("outer_fqn")))


@query("""
WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS file FROM documents),
members AS (
  SELECT file, 0 AS s, 1000 AS e, 'all' AS id FROM docs
  UNION ALL SELECT file, 100 * j, 100 * j + 90, concat('a', j) FROM docs, unnest(range(0, 10)) AS r(j)
  UNION ALL SELECT file, 100 * j + 20, 100 * j + 60, concat('b', j) FROM docs, unnest(range(0, 10)) AS r(j)),
uses AS (SELECT CAST(doc_id AS VARCHAR) AS file, CAST(u * 37 % 1100 AS INTEGER) AS at_place FROM documents, unnest(range(0, 40)) AS r(u))
SELECT u.file, u.at_place AS place, arg_min(m.id, m.e - m.s) AS member_id FROM uses u LEFT JOIN members m ON m.file = u.file AND m.s <= u.at_place AND u.at_place < m.e GROUP BY ALL""")
def enclosing_members(spark, sf_dir):
    docs = testgraphs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"))
    parts = docs.select("file", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    span = lambda df, a, b, name: df.select("file", a.cast("int").alias("span_start"), b.cast("int").alias("span_end"), name.alias("id"))
    j = F.col("j")
    members = span(docs, F.lit(0), F.lit(1000), F.lit("all")).unionByName(span(parts, 100 * j, 100 * j + 90, F.concat(F.lit("a"), j))).unionByName(span(parts, 100 * j + 20, 100 * j + 60, F.concat(F.lit("b"), j)))
    uses = docs.select("file", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("u")).select("file", (F.col("u") * 37 % 1100).cast("int").alias("at"))
    return extraction.enclosing_members(uses, members).select("file", F.col("at").alias("place"), "member_id")


@query("""
WITH RECURSIVE paths(k, prefix) AS (
  SELECT n_nationkey, concat('s', n_nationkey) FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT n.n_nationkey, concat(p.prefix, '/s', n.n_nationkey) FROM nation n JOIN paths p ON n.n_nationkey > 0 AND p.k = n.n_nationkey // 2)
SELECT n_name AS name, prefix FROM nation LEFT JOIN paths ON k = n_nationkey""")
def group_prefixes(spark, sf_dir):
    nation = testgraphs.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    above = F.when(key > 0, F.concat(F.lit("NATION_"), F.floor(key / 2).cast("string")))
    return extraction.group_prefixes(nation.select(F.col("n_name").alias("name"), above.alias("receiver"), F.concat(F.lit("s"), key.cast("string")).alias("segment")))


@query("""
WITH calls AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'fetch' ELSE 'client' END AS callee, CASE page_id % 5 WHEN 0 THEN 'get' WHEN 1 THEN 'del' WHEN 2 THEN 'head' WHEN 3 THEN NULL ELSE 'post' END AS method, page_id % 4 = 1 AS failed, regexp_extract(url, '^https?:/(/[^?#]*)', 1) AS path FROM pages),
verbs AS (SELECT *, CASE WHEN callee = 'fetch' THEN coalesce(upper(method), 'GET') ELSE CASE method WHEN 'get' THEN 'GET' WHEN 'del' THEN 'DELETE' WHEN 'post' THEN 'POST' END END AS verb FROM calls)
SELECT concat('p', page_id) AS file, CASE WHEN failed THEN 'UnresolvedCallSite' ELSE 'FrontendCallSite' END AS kind, verb, CASE WHEN NOT failed THEN concat(path, '/{*}') END AS template, CASE WHEN failed THEN 'dynamic' END AS category FROM verbs WHERE verb IS NOT NULL""")
def classified_calls(spark, sf_dir):
    pages = testgraphs.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    part = lambda text, hole, failure: F.struct(text.cast("string").alias("text"), F.lit(hole).alias("is_hole"), failure.cast("string").alias("failure"))
    none = F.lit(None)
    failed = F.when(k % 4 == 1, "dynamic")
    parts = F.array(part(F.concat(F.regexp_extract("url", "^https?:/(/[^?#]*)", 1), F.lit("/")), False, none), part(none, True, failed))
    method = F.when(k % 5 == 0, "get").when(k % 5 == 1, "del").when(k % 5 == 2, "head").when(k % 5 == 3, none.cast("string")).otherwise("post")
    calls = pages.select(F.when(k % 3 == 0, "fetch").otherwise("client").alias("callee"), method.alias("method"), F.lit(True).alias("method_is_literal"), parts.alias("parts"), F.concat(F.lit("p"), k.cast("string")).alias("file"), *[F.lit(1).alias(c) for c in ("line", "column", "span_start", "span_end")])
    return extraction.classified_calls(calls).select("file", "kind", "verb", "template", "category")


# ---------------------------------------------------------------- export

ROOTS = PROJECTS + """, roots AS (SELECT id, kind, coalesce(project, '(unattributed)') AS root FROM of_node WHERE kind <> 'Namespace'),
links AS (SELECT e.kind, s.id AS a, t.id AS b, s.root AS ra, t.root AS rb FROM edges e JOIN roots s ON s.id = e.source_id JOIN roots t ON t.id = e.target_id WHERE e.kind <> 'Contains')
"""


def tree_of(g: Graph) -> tuple[DataFrame, DataFrame]:
    tree = export.containment_tree(g)
    return tree, export.tree_edges(g, tree)


def labels_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, Graph]:
    """The stored tree, its labels, and the graph."""
    kept = testgraphs.graph_store(spark, sf_dir)
    tree, labels = jobs.containment(kept)
    return tree, labels, kept.load()


def named_ends(rolled: DataFrame, names: DataFrame) -> DataFrame:
    """Rolled-up edges with the names of their ends (key, name)."""
    return rolled.join(names.select(F.col("key").alias("source"), F.col("name").alias("a")), "source").join(names.select(F.col("key").alias("target"), F.col("name").alias("b")), "target").select("a", "b", "kind", "n")


@query(ROOTS + "SELECT ra AS a, rb AS b, kind, CAST(count(*) AS BIGINT) AS n FROM links WHERE ra <> rb GROUP BY ALL", "nodes", "edges")
def containment_rollup(spark, sf_dir):
    tree, labels, g = labels_of(spark, sf_dir)
    return named_ends(export.rolled_tree(g, tree, export.above(labels, 1)), tree)


SPACES = ROOTS + """, seen AS (SELECT id, CASE WHEN kind IN ('Endpoint', 'FrontendCallSite', 'UnresolvedCallSite', 'Project') THEN root
  ELSE concat(root, '|', regexp_replace(regexp_replace(fqn, '\\.Ship\\(\\)$', ''), '\\.[^.]*$', '')) END AS space FROM of_node JOIN roots USING (id, kind)),
types AS (SELECT id, CASE WHEN of_node.kind IN ('Class', 'Struct', 'Record', 'Interface', 'Enum') THEN fqn WHEN fqn LIKE '%.Ship()' THEN regexp_replace(fqn, '\\.Ship\\(\\)$', '') ELSE root END AS type FROM of_node JOIN roots USING (id, kind))
"""


@query(SPACES + "SELECT a.space AS a, b.space AS b, e.kind, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN seen a ON a.id = e.source_id JOIN seen b ON b.id = e.target_id WHERE e.kind <> 'Contains' AND a.space <> b.space GROUP BY ALL", "nodes", "edges")
def rollup_to_namespaces(spark, sf_dir):
    """Edges between namespaces, each in its project; what has none stands for its project."""
    tree, labels, g = labels_of(spark, sf_dir)
    projects = tree.filter("kind = 'Project'").select(F.col("key").alias("root"), F.col("name").alias("project"))
    rooted = labels.select("key", F.element_at("path", 1).alias("root")).join(projects, "root").join(tree.select("key", "kind", "fqn"), "key")
    names = rooted.select("key", F.when(F.col("kind") == "Namespace", F.concat_ws("|", "project", "fqn")).otherwise(F.col("project")).alias("name"))
    return named_ends(export.rolled_tree(g, tree, export.above(labels, ("Namespace",))), names)


@query(SPACES + "SELECT a.type AS a, b.type AS b, e.kind, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN types a ON a.id = e.source_id JOIN types b ON b.id = e.target_id WHERE e.kind <> 'Contains' AND a.type <> b.type GROUP BY ALL", "nodes", "edges")
def rollup_to_types(spark, sf_dir):
    """Edges between types; what lies in none stands for its project."""
    tree, labels, g = labels_of(spark, sf_dir)
    names = tree.select(F.col("key").alias("up"), F.when(F.col("kind") == "Project", F.col("name")).otherwise(F.col("fqn")).alias("name"))
    # There are nearly as many rolled-up edges as edges, so nodes get the names, which edges then carry instead of keys.
    named = export.above(labels, schema.TYPE_KINDS).join(names, "up").select("key", F.col("name").alias("up"))
    return export.rolled_tree(g, tree, named).select(F.col("source").alias("a"), F.col("target").alias("b"), "kind", "n")


@query(ROOTS + "SELECT root AS project, CAST(count(*) AS BIGINT) AS n FROM roots WHERE root = 'ASIA' AND kind <> 'Project' GROUP BY root", "nodes", "edges")
def subtree_sizes(spark, sf_dir):
    """What hangs below a project, but namespaces, by its interval."""
    tree, labels, _ = labels_of(spark, sf_dir)
    top = tree.filter("kind = 'Project' and name = 'ASIA'").select("key").first()
    below = export.subtree(labels, top.key).filter("kind not in ('Namespace', 'Project')")
    return below.agg(F.lit("ASIA").alias("project"), F.count("*").alias("n"))


@query(
    ROOTS
    + """, own AS (SELECT DISTINCT kind, CASE WHEN ra = 'ASIA' THEN a ELSE ra END AS s, CASE WHEN rb = 'ASIA' THEN b ELSE rb END AS t, ra <> 'ASIA' AS from_stub, rb <> 'ASIA' AS to_stub FROM links WHERE ra = 'ASIA' OR rb = 'ASIA')
SELECT kind, from_stub, to_stub, CAST(count(*) AS BIGINT) AS n FROM own GROUP BY ALL""",
    "nodes",
    "edges",
)
def project_filter_stubs(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    tree = export.containment_tree(g)
    _, stubs = export.only_project(tree, g, "asia")
    projects = F.broadcast(tree.filter("kind = 'Project'").select("key", F.lit(True).alias("is_project")))
    marked = stubs.join(projects.select(F.col("key").alias("source"), F.col("is_project").alias("f")), "source", "left").join(projects.select(F.col("key").alias("target"), F.col("is_project").alias("t")), "target", "left")
    return marked.groupBy("kind", F.coalesce("f", F.lit(False)).alias("from_stub"), F.coalesce("t", F.lit(False)).alias("to_stub")).agg(F.count("*").alias("n"))


@query(
    """
WITH RECURSIVE tops AS (
  SELECT DISTINCT split_part(n.file, '/', 3) AS project, regexp_replace(n.fqn, '\\.[^.]*$', '') AS space FROM nodes n WHERE n.kind NOT IN ('Project', 'Namespace', 'Endpoint', 'FrontendCallSite') AND n.fqn NOT LIKE '%.Ship()'),
spaces AS (SELECT project, space AS fqn FROM tops UNION SELECT project, split_part(space, '.', 1) FROM tops),
kids AS (SELECT s.project, s.fqn, (SELECT count(*) FROM spaces c WHERE c.project = s.project AND regexp_replace(c.fqn, '\\.[^.]*$', '') = s.fqn AND c.fqn <> s.fqn) AS n_spaces, (SELECT count(*) FROM tops t WHERE t.project = s.project AND t.space = s.fqn) AS n_types FROM spaces s)
SELECT project, fqn FROM kids WHERE NOT (n_spaces = 1 AND n_types = 0)""",
    "nodes",
)
def namespace_instances(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    tree = export.containment_tree(g)
    own = tree.filter("kind = 'Namespace'").join(export.roots(tree), "key")
    return own.join(tree.select(F.col("key").alias("up"), F.col("name").alias("project")), "up").select("project", "fqn")


# ---------------------------------------------------------------- streaming, on tables


@query("""
WITH marked AS (SELECT user_id, ts, event_type, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
bursts AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM marked)
SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 6 HOURS AS last, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths, CAST(count(*) AS BIGINT) AS events FROM bursts GROUP BY user_id, burst""")
def debounce_batches(spark, sf_dir):
    events = testgraphs.table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("path"))
    return watch.debounced(events, ["user_id"], "6 hours").withColumn("paths", F.array_join("paths", ","))


@query("""
WITH paths AS (SELECT page_id, concat('C:/repo/', CASE page_id % 6 WHEN 0 THEN 'src/A' WHEN 1 THEN 'bin/B' WHEN 2 THEN 'Node_Modules/C' WHEN 3 THEN '.store/graph/x' ELSE 'D' END, page_id, CASE page_id % 7 WHEN 0 THEN '.CS' WHEN 1 THEN '.csproj' WHEN 2 THEN '/global.json' WHEN 3 THEN '.md' WHEN 4 THEN '.targets' ELSE '.cs' END) AS path FROM pages)
SELECT page_id, CASE WHEN contains(lower(path), '/bin/') OR contains(lower(path), '/node_modules/') OR starts_with(lower(path), 'c:/repo/.store/graph') THEN 'Ignore' WHEN lower(path) LIKE '%.cs' THEN 'Content'
  WHEN lower(path) LIKE '%.csproj' OR lower(path) LIKE '%.targets' OR lower(path) LIKE '%/global.json' THEN 'Structural' ELSE 'Ignore' END AS verdict FROM paths""")
def watch_filter(spark, sf_dir):
    pages = testgraphs.table(spark, sf_dir, "pages")
    where = reduce(lambda c, x: c.when(F.col("page_id") % 6 == x[0], x[1]), [(1, "bin/B"), (2, "Node_Modules/C"), (3, ".store/graph/x")], F.when(F.col("page_id") % 6 == 0, "src/A")).otherwise("D")
    what = reduce(lambda c, x: c.when(F.col("page_id") % 7 == x[0], x[1]), [(1, ".csproj"), (2, "/global.json"), (3, ".md"), (4, ".targets")], F.when(F.col("page_id") % 7 == 0, ".CS")).otherwise(".cs")
    path = F.concat(F.lit("C:/repo/"), where, F.col("page_id").cast("string"), what)
    return pages.select("page_id", watch.verdict(path, "C:/repo/.store/graph").alias("verdict"))


# These register more queries; they need query() from here.
from . import chain_queries, fact_queries, tool_queries  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
