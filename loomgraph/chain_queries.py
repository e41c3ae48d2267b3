"""Operators that follow chains, and version ranges, as queries over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fact_queries import text
from .operators import containers, extraction, folding, registrations
from .queries import query, testgraphs

# ---------------------------------------------------------------- folding

#: Chains of forty expressions, of which so many steps are followed.
CHAIN, STEPS = 40, 24
#: The op of an expression by its key, and that of the part which stands beside the rest of the chain.
LEAF = "CASE k % 101 WHEN 0 THEN 'number' WHEN 1 THEN 'other' WHEN 2 THEN 'env' WHEN 3 THEN 'name' WHEN 4 THEN 'import' ELSE 'string' END"


def expressions(spark, sf_dir):
    """Expression k leads to k + 1, as a constant's value, a property's or the other part of a sum, as far as its chain goes; -k - 1 is a sum's part."""
    k = F.col("p_partkey").cast("long")
    part = testgraphs.table(spark, sf_dir, "part").select(k.alias("k"))
    part = part.withColumn("r", F.when((F.col("k") % CHAIN == CHAIN - 1), 9).otherwise(F.col("k") * 7 % 5))
    before = part.select((F.col("k") + 1).alias("k"), F.when(F.col("r") < 2, F.col("k")).alias("parent"), F.when(F.col("r") < 2, 1 - F.col("r")).alias("position"))
    chain = part.join(before, "k", "left").select(
        F.col("k").alias("id"), F.when(F.col("r") == 9, "string").when(F.col("r") < 2, "plus").when(F.col("r") == 4, "property").otherwise("name").alias("op"),
        F.when(F.col("r") == 9, F.concat(F.lit("s"), text("k"))).alias("text"), "parent", "position", F.lit(None).cast("string").alias("after"),
        F.when(F.col("r").between(2, 3), "variable").when(F.col("r") == 4, "property").alias("declared"), F.when(F.col("r").between(2, 4), F.col("k") + 1).alias("of"), F.lit(True).alias("is_const"),
    )
    leaf = F.expr(LEAF)
    leaves = part.filter("r < 2").select(
        (-F.col("k") - 1).alias("id"), leaf.alias("op"), F.concat(F.lit("x"), text("k")).alias("text"), F.col("k").alias("parent"), F.col("r").alias("position"), F.lit(None).cast("string").alias("after"),
        F.when(leaf == "name", "variable").alias("declared"), F.when(leaf == "name", F.col("k")).alias("of"), F.lit(False).alias("is_const"),
    )
    return chain.unionByName(leaves)


WALK = f"""
WITH RECURSIVE part_keys AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part),
kinds AS (SELECT k, CASE WHEN k % {CHAIN} = {CHAIN - 1} THEN 9 ELSE k * 7 % 5 END AS r, {LEAF} AS leaf, concat('x', k) AS x,
  CASE {LEAF} WHEN 'other' THEN 'runtime-computed-segment' WHEN 'env' THEN 'dynamic-base-url' WHEN 'name' THEN 'non-constant-identifier' WHEN 'import' THEN 'dynamic-import-or-indirection' END AS bad FROM part_keys),
walk(root, steps, cur, d, pre, post, late, late_at, category, cause, done) AS (
  SELECT k, d, k, d, '', '', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), false FROM part_keys, (VALUES ({STEPS}), ({STEPS - 1})) AS left_over(d)
  UNION ALL
  SELECT root, steps, CASE WHEN r < 9 THEN cur + 1 ELSE cur END, d - 1,
    CASE WHEN r = 0 THEN concat(pre, x) WHEN r = 9 THEN concat(pre, 's', cur) ELSE pre END, CASE WHEN r = 1 THEN concat(x, post) ELSE post END,
    CASE WHEN r = 1 THEN coalesce(bad, late) ELSE late END, CASE WHEN r = 1 AND bad IS NOT NULL THEN -cur - 1 ELSE late_at END,
    CASE WHEN d = 0 OR (r = 0 AND d = 1) THEN 'resolution-depth-exceeded' WHEN k IS NULL THEN 'runtime-computed-segment' WHEN r = 0 THEN bad WHEN r = 9 THEN late END,
    CASE WHEN d = 0 OR k IS NULL THEN cur WHEN r = 0 AND (d = 1 OR bad IS NOT NULL) THEN -cur - 1 WHEN r = 9 THEN late_at END,
    d = 0 OR k IS NULL OR r = 9 OR (r = 0 AND (d = 1 OR bad IS NOT NULL))
  FROM walk LEFT JOIN kinds ON k = cur WHERE NOT done),
ends AS (SELECT root, steps, CASE WHEN category IS NULL THEN concat(pre, post) END AS value, category, coalesce(cause, root) AS cause FROM walk WHERE done)
"""


@query(WALK + f"SELECT root AS id, value, category, cause FROM ends WHERE steps = {STEPS}")
def folded_expressions(spark, sf_dir):
    """Chains with sums on either side, constants and properties, some of them longer than is followed."""
    return folding.resolved(expressions(spark, sf_dir), STEPS).filter("id >= 0")


@query(WALK + f"""
, calls AS (SELECT CAST(c_custkey AS BIGINT) AS c FROM customer),
holes AS (SELECT c, h, 1 + (c * 3 + h * 7) % 1500 AS k FROM calls, (VALUES (0), (1)) AS two(h) WHERE c % 3 > 0),
valued AS (SELECT c, h, value, coalesce(category, CASE WHEN value IS NULL THEN 'runtime-computed-segment' END) AS category, coalesce(cause, k) AS cause FROM holes LEFT JOIN ends ON root = k AND steps = {STEPS - 1}),
templates AS (SELECT c, arg_min(category, h) FILTER (WHERE category <> 'runtime-computed-segment') AS category, arg_min(cause, h) FILTER (WHERE category <> 'runtime-computed-segment') AS cause,
  concat('/t', string_agg(concat(coalesce(value, '{{*}}'), CASE h WHEN 0 THEN '/' ELSE '' END), '' ORDER BY h)) AS template, bool_or(value IS NULL) AS holed FROM valued GROUP BY c)
SELECT c AS call, CASE WHEN category IS NULL THEN template END AS template, CASE WHEN category IS NULL THEN CASE WHEN holed THEN 'template-param-holes' ELSE 'template-folded' END END AS tier, category, cause FROM templates
UNION ALL SELECT c, value, CASE WHEN value IS NULL THEN NULL WHEN c % {CHAIN} = {CHAIN - 1} THEN 'literal' ELSE 'const-resolved' END,
  CASE WHEN value IS NULL THEN coalesce(category, 'runtime-computed-segment') END, CASE WHEN value IS NULL THEN coalesce(cause, c) END FROM calls LEFT JOIN ends ON root = c AND steps = {STEPS} WHERE c % 3 = 0""")
def folded_urls(spark, sf_dir):
    """A third of the calls have a chain as their argument, the others a template of two constants."""
    calls = testgraphs.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c"))
    templates = calls.filter("c % 3 > 0")
    head = templates.selectExpr("1000000000 + c as id", "'template' as op", "'/t' as text", "cast(null as long) as parent", "cast(null as long) as position", "cast(null as string) as after", "cast(null as string) as declared", "cast(null as long) as of", "false as is_const")
    holes = templates.selectExpr("c", "explode(array(0L, 1L)) as h").selectExpr("2000000000 + 2 * c + h as id", "'name' as op", "cast(null as string) as text", "1000000000 + c as parent", "h as position", "if(h = 0, '/', null) as after", "'variable' as declared", "1 + (c * 3 + h * 7) % 1500 as of", "true as is_const")
    arguments = calls.selectExpr("c as call", "if(c % 3 = 0, c, 1000000000 + c) as id")
    return folding.folded(arguments, expressions(spark, sf_dir).unionByName(head).unionByName(holes), STEPS)


# ---------------------------------------------------------------- aliases, versions, cycles


@query("SELECT concat('n', p_partkey) AS name, concat('n', greatest(p_partkey - p_partkey % 40, p_partkey - 32)) AS original FROM part")
def alias_chains(spark, sf_dir):
    """Chains of up to 39 aliases, of which 32 hops are followed."""
    k = F.col("p_partkey")
    names = testgraphs.table(spark, sf_dir, "part").select(F.concat(F.lit("n"), text(k)).alias("name"), F.when(k % 40 != 0, F.concat(F.lit("n"), text(k - 1))).alias("alias"))
    return registrations.originals(names)


@query("SELECT concat('n', p_partkey) AS name FROM part WHERE p_partkey % 40 <= 32 AND (p_partkey - p_partkey % 40) % 3 = 0 AND p_partkey >= 40")
def http_clients_far(spark, sf_dir):
    """Clients behind up to 39 aliases: 31 and 32 hops lead to the declaration, 33 don't."""
    k = F.col("p_partkey")
    part = testgraphs.table(spark, sf_dir, "part").filter("p_partkey >= 40")
    names = part.select(F.concat(F.lit("n"), text(k)).alias("name"), F.when(k % 40 != 0, F.concat(F.lit("n"), text(k - 1))).alias("alias"))
    declared = part.filter(k % 40 == 0).select(F.concat(F.lit("n"), text(k)).alias("name"), F.when(k % 3 == 0, "axios.create").otherwise("make").alias("initializer"))
    return registrations.http_clients(names, declared)


POLICIES = ("disable", "patch", "feature", "latestFeature", "minor", "latestMinor", "major", "latestMajor", "latestPatch", None)
POLICY = "CASE k % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(POLICIES) if p) + " END"


@query(f"""
WITH pins AS (SELECT CAST(p_partkey AS BIGINT) AS k, {POLICY} AS policy, k % 4 + 6 AS a, k % 3 AS b, k % 7 * 50 + k % 11 AS c FROM (SELECT *, CAST(p_partkey AS BIGINT) AS k FROM part)),
there AS (SELECT DISTINCT CAST(s_suppkey % 3 + 7 AS BIGINT) AS x, CAST(s_suppkey % 2 AS BIGINT) AS y, CAST(s_suppkey % 5 * 60 + s_suppkey % 13 AS BIGINT) AS z FROM supplier),
met AS (SELECT k, x, y, z FROM pins JOIN there ON CASE lower(coalesce(policy, '')) WHEN 'disable' THEN (x, y, z) = (a, b, c) WHEN 'patch' THEN x = a AND y = b AND z // 100 = c // 100 AND z >= c
  WHEN 'feature' THEN x = a AND y = b AND z // 100 >= c // 100 WHEN 'latestfeature' THEN x = a AND y = b AND z // 100 >= c // 100 WHEN 'minor' THEN x = a AND (y, z // 100) >= (b, c // 100) WHEN 'latestminor' THEN x = a AND (y, z // 100) >= (b, c // 100)
  WHEN 'major' THEN (x, y, z // 100) >= (a, b, c // 100) WHEN 'latestmajor' THEN (x, y, z // 100) >= (a, b, c // 100) ELSE x = a AND y = b AND z // 100 = c // 100 END),
best AS (SELECT k, max((x * 1000 + y) * 1000 + z) AS v FROM met GROUP BY k)
SELECT k, concat(a, '.', b, '.', c) AS version, policy, CASE WHEN v IS NOT NULL THEN concat(v // 1000000, '.', v // 1000 % 1000, '.', v % 1000) END AS found FROM pins LEFT JOIN best USING (k)""")
def rolled_forward(spark, sf_dir):
    """Pinned versions under every policy against installed ones."""
    k = F.col("k")
    pins = testgraphs.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    pins = pins.select("k", F.concat_ws(".", text(k % 4 + 6), text(k % 3), text(k % 7 * 50 + k % 11)).alias("version"), F.expr(POLICY).alias("policy"))
    s = F.col("s_suppkey")
    installed = testgraphs.table(spark, sf_dir, "supplier").select(F.concat_ws(".", text(s % 3 + 7), text(s % 2), text(s % 5 * 60 + s % 13)).alias("version"))
    return extraction.rolled_forward(pins, installed)


@query("""
SELECT list_transform([0, 1, 2, 3, 0], lambda x: concat('c', lpad(CAST(g AS VARCHAR), 6, '0'), '_', x)) AS path, 4 AS hops, CAST(sum(n) AS BIGINT) AS weight
FROM (SELECT p_partkey // 4 AS g, p_partkey % 4 + 1 AS n FROM part) GROUP BY g HAVING count(*) = 4""")
def stepped_cycles(spark, sf_dir):
    """Rings of four containers, with a chord that leads astray; found by joins, as those of graphs too large for the driver are."""
    k = F.col("p_partkey")
    part = testgraphs.table(spark, sf_dir, "part")
    name = lambda at: F.concat(F.lit("c"), F.lpad(text(F.floor(k / 4)), 6, "0"), F.lit("_"), text(at))
    ring = part.select(name(k % 4).alias("from"), name((k + 1) % 4).alias("to"), (k % 4 + 1).cast("long").alias("n"))
    chords = part.filter(k % 4 == 1).select(name(k % 4).alias("from"), F.concat(name(F.lit(1)), F.lit("x")).alias("to"), F.lit(5).cast("long").alias("n"))
    edges = ring.unionByName(chords).unionByName(chords.select(F.col("to").alias("from"), F.col("from").alias("to"), "n"))
    named = containers.components(edges)
    c1, c2 = (named.select(F.col("node").alias(end), F.col("component").alias(c)).hint("merge") for end, c in (("from", "c1"), ("to", "c2")))
    whole = part.groupBy(F.floor(k / 4).alias("g")).count().filter("count = 4").select(F.concat(F.lit("c"), F.lpad(text("g"), 6, "0"), F.lit("_0")).alias("c1"))
    inside = edges.join(c1, "from").join(c2, "to").filter("c1 = c2").select("c1", "from", "to", "n").join(whole.hint("merge"), "c1", "left_semi")
    return containers.stepped(inside)
