"""The tools and jobs, which read and write stored graphs, as queries over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema
from .operators import export, incremental, linker, names
from .plans import jobs
from .plans.tools import Tools
from .queries import DERIVED, IMPACT, ROOTS, SQL, fqn_of, query, testgraphs
from .schema import Graph
from .sources.scratch import shared_dir
from .sources.store import GraphStore


def answer(spark, sf_dir, tool: str, **arguments):
    return Tools(testgraphs.graph_store(spark, sf_dir)).call(tool, arguments)


def empty_store(spark) -> GraphStore:
    """A store of its own for a query that writes; it lies in the shared folder and goes with it."""
    return GraphStore(spark, f"{shared_dir(spark)}/written-{uuid.uuid4().hex}")


def counted(graph: Graph) -> DataFrame:
    """Rows by table and kind."""
    each = [df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(name).alias("rows"), "kind", "n") for name, df in (("nodes", graph.nodes), ("edges", graph.edges))]
    return each[0].unionByName(each[1])


# ---------------------------------------------------------------- tools


@query("SELECT kind, fqn, file FROM nodes WHERE kind = 'Class' AND (contains(lower(name), 'customer#00') OR contains(lower(fqn), 'customer#00')) ORDER BY length(fqn), fqn, id LIMIT 20", "nodes")
def symbols_of_a_kind(spark, sf_dir):
    """A kind is given in any case."""
    return answer(spark, sf_dir, "find_symbol", query="Customer#00", kind="cLASS").rows


@query("SELECT kind, fqn, file FROM nodes WHERE contains(lower(name), 'supplier') OR contains(lower(fqn), 'supplier') ORDER BY length(fqn), fqn, id LIMIT 5", "nodes")
def suggested_symbols(spark, sf_dir):
    """What is like the last part of a name that isn't there."""
    return answer(spark, sf_dir, "find_usages", fqn="Nowhere.Supplier").frames["suggestions"]


@query("SELECT e.kind AS rel_kind, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN nodes n ON n.id = e.target_id AND n.fqn LIKE '%.T5.Ship()' WHERE e.kind <> 'Contains' GROUP BY e.kind", "nodes", "edges")
def dependents_by_kind(spark, sf_dir):
    g = testgraphs.graph(spark, sf_dir)
    return answer(spark, sf_dir, "get_dependencies", fqn=fqn_of(g, "T5", ".Ship()"), direction="incoming").frames["by_kind"]


@query(
    IMPACT
    + """, dirs AS (SELECT name, lower(regexp_replace(file, '[^/]*$', '')) AS dir FROM nodes WHERE kind = 'Project')
SELECT kind, fqn, depth, coalesce((SELECT max_by(d.name, length(d.dir)) FROM dirs d WHERE starts_with(lower(i.file), d.dir)), '(unknown)') AS project, is_implementer FROM impacted i ORDER BY depth, fqn LIMIT 100""",
    "nodes",
    "edges",
)
def impact_listed(spark, sf_dir):
    """The nearest hundred dependents with their projects."""
    return answer(spark, sf_dir, "impact_analysis", fqn=fqn_of(testgraphs.graph(spark, sf_dir), "T10")).rows


@query(
    """
WITH RECURSIVE tree(level, id, path) AS (
  SELECT 0, id, [fqn] FROM nodes WHERE name = 'T1' AND kind <> 'Method'
  UNION ALL
  SELECT t.level + 1, n.id, list_append(t.path, n.fqn) FROM tree t JOIN edges e ON e.kind IN ('Inherits', 'Implements') AND e.target_id = t.id JOIN nodes n ON n.id = e.source_id WHERE t.level < 10
)
SELECT CAST(level AS INTEGER) AS level, array_to_string(path, ' > ') AS path, n.name, n.file FROM tree t JOIN nodes n USING (id) WHERE level > 0 ORDER BY t.path LIMIT 200""",
    "nodes",
    "edges",
)
def hierarchy_listed(spark, sf_dir):
    """The first two hundred types below one, each after the one above it."""
    found = answer(spark, sf_dir, "get_type_hierarchy", fqn=fqn_of(testgraphs.graph(spark, sf_dir), "T1"), direction="down", depth=10)
    return found.rows.select("level", F.array_join("path", " > ").alias("path"), "name", "file")


@query(
    DERIVED.format(seed="t.name = 'T1'")
    + """, dirs AS (SELECT name, lower(regexp_replace(file, '[^/]*$', '')) AS dir FROM nodes WHERE kind = 'Project'),
found AS (SELECT n.kind, n.fqn, n.file, (SELECT max_by(d.name, length(d.dir)) FROM dirs d WHERE starts_with(lower(n.file), d.dir)) AS project FROM (SELECT DISTINCT id FROM down) JOIN nodes n USING (id))
SELECT coalesce(project, '') AS project, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM found ORDER BY coalesce(project, '~unknown'), fqn LIMIT 100) GROUP BY ALL""",
    "nodes",
    "edges",
)
def implementations_by_project(spark, sf_dir):
    """The hundred implementations that the tool lists, by project."""
    found = answer(spark, sf_dir, "find_implementations", fqn=fqn_of(testgraphs.graph(spark, sf_dir), "T1")).rows
    return found.groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- the index of names

#: Asked of the index: rare and common names, wildcards, too short for the index, and nothing; the last two with a kind.
ASKED = (("T1_.Ship", None), ("customer", None), ("c%supplier#%7", None), ("t9", None), ("no such name", None), ("#00000", "Class"), ("ship", "Method"))


def asked(text: str, kind: str | None) -> str:
    test = f"kind = '{kind}' AND (contains(lower(name), '{text}') OR contains(lower(fqn), '{text}'))" if kind else f"name ILIKE '%{text}%' OR fqn ILIKE '%{text}%'"
    return f"(SELECT '{text}' AS query, kind, name, fqn FROM nodes WHERE {test} ORDER BY length(fqn), fqn, id LIMIT 21)"


@query(" UNION ALL ".join(asked(*pair) for pair in ASKED), "nodes")
def indexed_symbols(spark, sf_dir):
    """The first symbols like each of some queries, by way of the index."""
    index = names.keep_index(testgraphs.graph_store(spark, sf_dir))
    found = [names.find_symbols(index, text, 21, kind).select(F.lit(text).alias("query"), "kind", "name", "fqn") for text, kind in ASKED]
    return reduce(DataFrame.unionByName, found)


@query(
    """
WITH texts AS (SELECT id, lower(name) AS t FROM nodes UNION SELECT id, lower(fqn) FROM nodes),
runs AS (SELECT DISTINCT id, substr(t, CAST(p AS INTEGER), 3) AS gram FROM texts, unnest(range(1, greatest(length(t) - 1, 1))) AS u(p))
SELECT gram, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY gram""",
    "nodes",
)
def indexed_runs(spark, sf_dir):
    """How many names each run of three characters posts."""
    return names.keep_index(testgraphs.graph_store(spark, sf_dir)).counts


# ---------------------------------------------------------------- routes with many holes

SEGMENTS = 10


def segment(key: str, k: int, every: int, factor: int) -> str:
    """A segment as SQL: a hole if digit k of the key times a factor, to the base 2, is the last of so many, else one of four words."""
    return f"CASE WHEN CAST(floor({key} * {factor} / {2**k}) AS BIGINT) % {every} = {every - 1} THEN '{{x}}' ELSE concat('w', CAST(CAST(floor({key} / {k + 1}) AS BIGINT) % 4 AS VARCHAR(9))) END"


def segmented(key: str, every: int, factor: int) -> list[str]:
    return [segment(key, k, every, factor) for k in range(SEGMENTS)]


def listed(segments: list[str], prefix: str) -> str:
    return ", ".join(f"{s} AS {prefix}{k}" for k, s in enumerate(segments))


FITS = " AND ".join(f"(c{k} = e{k} OR c{k} = '{{x}}' OR e{k} = '{{x}}')" for k in range(SEGMENTS))


@query(
    f"""
WITH calls AS (SELECT c_custkey AS call_id, {listed(segmented('c_custkey', 8, 11), 'c')} FROM customer),
ends AS (SELECT p_partkey AS endpoint_id, {listed(segmented('p_partkey', 2, 37), 'e')} FROM part)
SELECT call_id, endpoint_id FROM calls JOIN ends ON {FITS}"""
)
def many_hole_routes(spark, sf_dir):
    """Routes of ten segments, any of which may be a hole, of customers and parts."""
    calls = testgraphs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.lit("GET").alias("verb"), F.array(*map(F.expr, segmented("c_custkey", 8, 11))).alias("segs"))
    ends = testgraphs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("endpoint_id"), F.lit("GET").alias("endpoint_verb"), F.array(*map(F.expr, segmented("p_partkey", 2, 37))).alias("endpoint_segs"))
    return linker.meets(calls, ends, same_verb=True).select("call_id", "endpoint_id")


# ---------------------------------------------------------------- graphs that are written


@query("SELECT 'nodes' AS rows, kind, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, CAST(count(*) AS BIGINT) FROM edges GROUP BY kind", "nodes", "edges")
def saved_graph(spark, sf_dir):
    """A graph saved anew and read again, with its edges as they are laid out by what they lead to."""
    g, store = testgraphs.graph(spark, sf_dir), empty_store(spark)
    store.save(g, spark.createDataFrame([], schema.FILES), {})
    again = store.load()
    return counted(Graph(again.nodes, again.incoming))


@query("SELECT kind, CASE WHEN kind IN ('Class', 'Method') THEN name ELSE upper(name) END AS name, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY ALL", "nodes")
def merged_graphs(spark, sf_dir):
    """Two graphs put together; where both have a node, that of the first stays."""
    g = testgraphs.graph(spark, sf_dir)
    first = Graph(g.nodes.filter("kind in ('Class', 'Method')"), g.edges)
    second = Graph(g.nodes.withColumn("name", F.upper("name")), g.edges)
    return incremental.merge(first, second.select()).nodes.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query(
    """
WITH own AS (SELECT id, kind FROM nodes WHERE file IS NOT NULL),
links AS (SELECT e.kind FROM edges e JOIN own a ON a.id = e.source_id JOIN own b ON b.id = e.target_id)
SELECT 'nodes' AS rows, kind, CAST(count(*) AS BIGINT) AS n FROM own GROUP BY kind UNION ALL SELECT 'edges', kind, CAST(count(*) AS BIGINT) FROM links GROUP BY kind""",
    "nodes",
    "edges",
)
def built_graph(spark, sf_dir):
    """A build from files, of which each gives the nodes that lie in it and what leads from them."""
    g, store = testgraphs.graph(spark, sf_dir), empty_store(spark)

    def extract(paths: DataFrame) -> Graph:
        nodes = g.nodes.join(paths.select(F.col("path").alias("file")), "file", "left_semi")
        return Graph(nodes, g.edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi"))

    files = g.nodes.filter("file is not null").select(F.col("file").alias("path"), F.sha2("file", 256).alias("content_hash")).distinct()
    jobs.build(store, extract, files)
    return counted(store.load())


@query(SQL["link_outcome_counts"])
def linked_graph(spark, sf_dir):
    """How many call sites had each outcome, told by the job that links a stored graph."""
    g, store = testgraphs.graph(spark, sf_dir), empty_store(spark)
    store.save(g, spark.createDataFrame([], schema.FILES), {})
    return spark.createDataFrame(sorted(jobs.link(store).items()), "outcome string, n long")


@query(ROOTS + "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM roots GROUP BY kind", "nodes", "edges")
def exported_tree(spark, sf_dir):
    """The tree written as lines of JSON and read again; without namespaces, which have an instance in each project, and the root of what has none."""
    kept = testgraphs.graph_store(spark, sf_dir)
    tree, _ = jobs.containment(kept)
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export.write(tree, export.tree_edges(kept.load(), tree), path)
    return spark.read.json(f"{path}/nodes").filter(f"kind <> 'Namespace' and key <> '{export.UNATTRIBUTED}'").groupBy("kind").agg(F.count("*").alias("n"))
