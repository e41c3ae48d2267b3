"""Operators on facts of front ends, files and artifacts as queries over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import schema
from .functions import routes, symbols
from .operators import extraction, registrations, report
from .queries import query, testgraphs
from .sources import artifact, files


def duck_id(kind: str, fqn: str) -> str:
    return f"substr(sha256(concat('{schema.NODE_KINDS.index(kind)}:', {fqn})), 1, 32)"


def text(x) -> F.Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


# ---------------------------------------------------------------- files and artifacts


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def file_hashes(spark, sf_dir):
    return files.hash_texts(testgraphs.table(spark, sf_dir, "documents").select(text("doc_id").alias("path"), "text"))


@query("""
WITH entries AS (SELECT concat('p', page_id // 3) AS path, CAST(page_id % 3 AS INTEGER) AS target, url FROM pages)
SELECT path, CAST(0 AS INTEGER) + min(target) AS target, arg_min(url, target) AS url FROM entries GROUP BY path""")
def one_entry_a_path(spark, sf_dir):
    pages = testgraphs.table(spark, sf_dir, "pages")
    entries = pages.select(F.concat(F.lit("p"), text(F.floor(F.col("page_id") / 3))).alias("path"), (F.col("page_id") % 3).cast("int").alias("target"), "url")
    return files.one_per_path(entries, "target").select("path", "target", "url")


def call_site_rows(spark, sf_dir):
    """Call sites of pages, in seven projects; every third is unresolved."""
    k = F.col("page_id")
    lost = k % 3 == 2
    return testgraphs.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("C:\\w"), text(k % 7), F.lit("\\")).alias("root"),
        F.when(lost, artifact.UNRESOLVED).otherwise(artifact.RESOLVED).alias("kind"),
        F.lit("GET").alias("verb"), F.when(~lost, F.concat(F.lit("/t/"), text("page_id"))).alias("template"), F.when(~lost, "literal").alias("resolutionTier"),
        F.when(lost, F.concat(F.lit("c"), text(k % 5))).alias("category"), F.when(lost, "r").alias("reason"), F.concat(F.lit("f"), text(k % 50), F.lit(".ts")).alias("file"),
        k.cast("int").alias("line"), (k % 80).cast("int").alias("column"), (k * 2).cast("int").alias("spanStart"), (k * 2 + 9).cast("int").alias("spanEnd"),
    )


PLACE = "concat('f', page_id % 50, '.ts:', page_id, ':', page_id % 80)"


@query(f"""
WITH sites AS (SELECT page_id, page_id % 3 = 2 AS lost, {PLACE} AS place FROM pages),
made AS (SELECT CASE WHEN lost THEN 'UnresolvedCallSite' ELSE 'FrontendCallSite' END AS kind, CASE WHEN lost THEN concat('c', page_id % 5, ': r') ELSE concat('/t/', page_id) END AS name,
  CASE WHEN lost THEN concat('GET c', page_id % 5, ' ', place) ELSE concat('GET ', place) END AS fqn, concat('C:/w', page_id % 7, '/f', page_id % 50, '.ts') AS file, CAST(page_id * 2 AS INTEGER) AS span_start, CAST(page_id * 2 + 9 AS INTEGER) AS span_end FROM sites)
SELECT CASE WHEN kind = 'FrontendCallSite' THEN {duck_id("FrontendCallSite", "fqn")} ELSE {duck_id("UnresolvedCallSite", "fqn")} END AS id, * FROM made""")
def artifact_round_trip(spark, sf_dir):
    """Artifacts are written for each project, parsed, validated and read as nodes."""
    parsed = artifact.parse(artifact.render(call_site_rows(spark, sf_dir), "maker"))
    artifact.validate(parsed, "maker")
    return artifact.nodes(parsed)


@query("""
WITH found AS (SELECT CASE page_id % 11 WHEN 0 THEN 'the artifact has schema version 1, which an older extractor wrote; extract again' WHEN 1 THEN 'the artifact has another schema version' WHEN 2 THEN 'the artifact has another producer'
  WHEN 3 THEN 'the artifact has no callSites' WHEN 4 THEN 'a call site has no file' WHEN 5 THEN 'a call site has no verb' WHEN 6 THEN 'a resolved call site has no template' WHEN 7 THEN 'an unresolved call site has no category'
  WHEN 8 THEN 'an unresolved call site has no reason' WHEN 9 THEN 'unknown call site kind Odd' END AS fault FROM pages)
SELECT fault, CAST(count(*) AS BIGINT) AS n FROM found WHERE fault IS NOT NULL GROUP BY fault""")
def artifact_faults(spark, sf_dir):
    """One artifact a page, ten in eleven with a fault."""
    k = F.col("page_id") % 11
    site = F.struct(
        F.when(k.isin(7, 8), artifact.UNRESOLVED).when(k == 9, "Odd").otherwise(artifact.RESOLVED).alias("kind"), F.when(k != 5, "GET").alias("verb"), F.when(k != 6, "/x").alias("template"),
        F.when(k != 7, "c").alias("category"), F.when(k != 8, "r").alias("reason"), F.when(k == 4, " ").otherwise("a.ts").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"),
    )
    whole = F.struct(F.when(k == 0, 1).when(k == 1, 3).otherwise(2).alias("schemaVersion"), F.when(k == 2, "other").otherwise("maker").alias("producer"), F.when(k != 3, F.array(site)).alias("callSites"))
    texts = testgraphs.table(spark, sf_dir, "pages").select(F.to_json(whole).alias("json"))
    return artifact.faults(artifact.parse(texts), "maker").groupBy("fault").agg(F.count("*").alias("n"))


@query("""
WITH asked AS (SELECT page_id, page_id % 4 AS a, page_id % 6 AS b FROM pages),
pins AS (SELECT * FROM (VALUES ('C:/r/', '8.0.100', 'minor'), ('C:/r/a1/', NULL, NULL), ('C:/r/a2/b3/', '9.0.200', NULL), ('C:/q/', '7.0.1', 'patch')) AS t(folder, version, policy)),
near AS (SELECT page_id, arg_max(p, length(p.folder)) AS p FROM asked JOIN pins p ON starts_with(concat('C:/r/a', a, '/b', b, '/f', page_id, '.cs'), folder) GROUP BY page_id)
SELECT concat('C:\\r\\a', a, '\\b', b, '\\f', page_id, '.cs') AS path, CASE WHEN p.version IS NOT NULL THEN concat(p.folder, 'global.json') END AS pin_path, p.version AS version, CASE WHEN p.version IS NOT NULL THEN p.policy END AS policy FROM asked JOIN near USING (page_id)""")
def nearest_sdk_pins(spark, sf_dir):
    k = F.col("page_id")
    paths = testgraphs.table(spark, sf_dir, "pages").select(F.concat(F.lit("C:\\r\\a"), text(k % 4), F.lit("\\b"), text(k % 6), F.lit("\\f"), text(k), F.lit(".cs")).alias("path"))
    pins = spark.createDataFrame(
        [("C:/r/global.json", '{"sdk": {"version": "8.0.100", "rollForward": "minor"}}'), ("C:/r/a1/global.json", '{"tools": {}}'), ("C:/r/a2/b3/global.json", '{"sdk": {"version": "9.0.200"}}'), ("C:/q/global.json", '{"sdk": {"version": "7.0.1", "rollForward": "patch"}}')],
        "path string, json string",
    )
    return files.nearest_pins(paths, pins)


# ---------------------------------------------------------------- functions


@query("""
WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'api' ELSE '/v1/' END AS prefix, regexp_extract(url, '^https?:/(/[^?#]*)', 1) AS pattern, page_id % 3 = 0 AS has_area FROM pages),
joined AS (SELECT *, '/' || array_to_string(list_filter(string_split(concat(coalesce(prefix, ''), '/', pattern), '/'), lambda x: x <> ''), '/') AS composed FROM r)
SELECT page_id, composed, CASE WHEN coalesce(prefix, '') = '' THEN pattern ELSE concat(prefix, '/', pattern) END AS combined,
  CASE WHEN has_area THEN concat('A/Page', page_id, '/Get', pattern) END AS filled, starts_with(pattern, '/') AS is_absolute FROM joined""")
def route_parts(spark, sf_dir):
    k, pattern = F.col("page_id"), F.regexp_extract("url", "^https?:/(/[^?#]*)", 1)
    prefix = F.when(k % 4 == 1, "").when(k % 4 == 2, "api").when(k % 4 == 3, "/v1/")
    filled = routes.fill_tokens(F.concat(F.lit("[area]/[Controller]/[action]"), pattern), F.concat(F.lit("Page"), text(k), F.lit("Controller")), F.lit("GetAsync"), F.when(k % 3 == 0, "A"))
    return testgraphs.table(spark, sf_dir, "pages").select("page_id", routes.compose(prefix, pattern).alias("composed"), routes.combine_prefix(prefix, pattern).alias("combined"), filled.alias("filled"), routes.is_absolute(pattern).alias("is_absolute"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 60 THEN concat(substr(text, 1, 60), '…') ELSE text END AS short, CASE WHEN doc_id % 5 <> 0 THEN concat(doc_id % 9, '-', doc_id % 9 + doc_id % 4) END AS span,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 9 AS INTEGER) END AS parsed_start, concat('[Class] D', doc_id, CASE WHEN source IS NULL THEN '' ELSE concat(' — ', source) END) AS shown,
  CASE doc_id % 3 WHEN 0 THEN 'Class' WHEN 1 THEN 'Unknown' ELSE 'Method' END AS kind FROM documents""")
def symbol_texts(spark, sf_dir):
    k = F.col("doc_id")
    start, end = (k % 9).cast("int"), F.when(k % 5 == 0, -1).otherwise(k % 9 + k % 4).cast("int")
    span = schema.span_text(start, end)
    kind = schema.known(F.when(k % 3 == 0, "Class").when(k % 3 == 1, "Hologram").otherwise("Method"), schema.NODE_KINDS)
    return testgraphs.table(spark, sf_dir, "documents").select(
        "doc_id", symbols.truncated(F.col("text")).alias("short"), span.alias("span"), schema.parse_span(span)["span_start"].alias("parsed_start"),
        symbols.display(F.lit("Class"), F.concat(F.lit("D"), text("doc_id")), F.col("source")).alias("shown"), kind.alias("kind"),
    )


@query("SELECT page_id, starts_with(path, 'C:/w/app/') AND NOT contains(path, '/node_modules/') AS inside FROM (SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'C:/w/app/' WHEN 1 THEN 'C:/w/app/node_modules/' ELSE 'C:/w/apple/' END, page_id, '.ts') AS path FROM pages)")
def project_files(spark, sf_dir):
    k = F.col("page_id")
    path = F.concat(F.when(k % 3 == 0, "C:\\w\\app\\").when(k % 3 == 1, "C:\\w\\app\\node_modules\\").otherwise("C:\\w\\apple\\"), text(k), F.lit(".ts"))
    return testgraphs.table(spark, sf_dir, "pages").select("page_id", registrations.in_project(path, "C:\\w\\app").alias("inside"))


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT s_nationkey) AS BIGINT) AS unique_bodies FROM supplier WHERE s_suppkey % 4 <> 1")
def language_diagnostics(spark, sf_dir):
    """Diagnostics of projects without a language, a quarter of these, don't count."""
    raw = testgraphs.table(spark, sf_dir, "supplier").select(F.concat(F.lit("note "), text("s_nationkey"), F.when(F.col("s_suppkey") % 4 == 1, " is not associated with a language").otherwise("")).alias("raw"))
    return report.summary(report.parse(raw))


# ---------------------------------------------------------------- symbols and their edges


SYMBOLS = """
WITH rows AS (SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'Class' WHEN 1 THEN 'Record' WHEN 2 THEN 'Struct' WHEN 3 THEN 'Interface' WHEN 4 THEN 'Method' WHEN 5 THEN 'Property' WHEN 6 THEN 'EnumMember' WHEN 7 THEN 'Field' END AS kind,
  concat('N', p_size, '.S', p_partkey // 2) AS fqn, p_size FROM part)
"""


@query(SYMBOLS + "SELECT kind, fqn, arg_min(concat('s', k), k) AS name, concat('f', lpad(CAST(min(k) AS VARCHAR), 9, '0')) AS file FROM rows WHERE kind IS NOT NULL AND p_size % 10 <> 0 GROUP BY kind, fqn")
def symbol_nodes(spark, sf_dir):
    k = F.col("p_partkey")
    m = k % 9
    symbol = F.when(m.isin(0, 1, 2, 3), "type").when(m == 4, "method").when(m == 5, "property").when(m.isin(6, 7), "field").otherwise("local")
    rows = testgraphs.table(spark, sf_dir, "part").select(
        symbol.alias("symbol"), F.when(m.isin(0, 1), "class").when(m == 2, "struct").when(m == 3, "interface").alias("type_kind"), (m == 1).alias("is_record"), F.when(m == 6, "enum").otherwise("class").alias("container_kind"),
        F.concat(F.lit("s"), text(k)).alias("name"), F.concat(F.lit("N"), text("p_size"), F.lit(".S"), text(F.floor(k / 2))).alias("fqn"), F.lit("A").alias("assembly"), (F.col("p_size") % 10 != 0).alias("in_source"), F.lit(None).cast("boolean").alias("unnamed"),
        F.concat(F.lit("f"), F.lpad(text(k), 9, "0")).alias("file"), F.lit(1).alias("span_start"), F.lit(2).alias("span_end"),
    )
    return extraction.nodes_of(rows).select("kind", "fqn", "name", "file")


@query(f"""
WITH rows AS (SELECT DISTINCT concat('T', l_suppkey) AS fqn, CASE WHEN l_linenumber = 1 THEN 'System.Object' WHEN l_linenumber % 2 = 0 THEN concat('I', l_partkey) ELSE concat('T', l_partkey) END AS base, l_linenumber % 2 = 0 AS contract FROM lineitem)
SELECT {duck_id("Class", "fqn")} AS source_id, CASE WHEN contract THEN {duck_id("Interface", "base")} ELSE {duck_id("Class", "base")} END AS target_id, CASE WHEN contract THEN 'Implements' ELSE 'Inherits' END AS kind FROM rows WHERE base <> 'System.Object'""")
def base_edges(spark, sf_dir):
    contract = F.col("l_linenumber") % 2 == 0
    base = F.when(F.col("l_linenumber") == 1, "System.Object").when(contract, F.concat(F.lit("I"), text("l_partkey"))).otherwise(F.concat(F.lit("T"), text("l_partkey")))
    rows = testgraphs.table(spark, sf_dir, "lineitem").select(F.lit("Class").alias("kind"), F.concat(F.lit("T"), text("l_suppkey")).alias("fqn"), F.when(contract, "Interface").otherwise("Class").alias("base_kind"), base.alias("base_fqn"), contract.alias("is_contract"))
    return extraction.type_edges(rows)


@query("""
SELECT DISTINCT concat('m', l_suppkey) AS source_id, concat('m', l_partkey) AS target_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Calls' ELSE 'References' END AS kind FROM lineitem
WHERE l_linenumber <> 5 AND l_linenumber <> 6 AND (l_linenumber % 2 = 0 OR l_suppkey <> l_partkey)""")
def member_uses(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = testgraphs.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), text("l_suppkey")).alias("source_id"), F.concat(F.lit("m"), text("l_partkey")).alias("target_id"), (n % 2 == 0).alias("is_call"), (n == 6).alias("is_delegate_call"), (n == 5).alias("in_declaration"))
    return extraction.use_edges(rows)


@query("""
WITH RECURSIVE named AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey - 1 END AS alias, CASE WHEN p_partkey % 5 = 0 THEN concat('v', p_partkey) END AS value FROM part),
walk(k, value, alias) AS (SELECT k, value, alias FROM named UNION ALL SELECT w.k, n.value, n.alias FROM walk w JOIN named n ON w.value IS NULL AND n.k = w.alias)
SELECT concat('n', n.k) AS name, w.value FROM named n LEFT JOIN walk w ON w.k = n.k AND w.value IS NOT NULL""")
def constant_chains(spark, sf_dir):
    k = F.col("p_partkey")
    rows = testgraphs.table(spark, sf_dir, "part").select(F.concat(F.lit("n"), text(k)).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("v"), text(k))).alias("value"), F.when(k % 5 != 0, F.concat(F.lit("n"), text(k - 1))).alias("alias"))
    return extraction.constants(rows)


# ---------------------------------------------------------------- endpoints


def part_types(spark, sf_dir):
    """Types in trees: type k derives from type k // 3."""
    k = F.col("p_partkey")
    above = F.floor(k / 3)
    return testgraphs.table(spark, sf_dir, "part").select(k.alias("type"), F.when(above > 0, above).alias("base"))


BASES = """
WITH RECURSIVE chain(type, base, depth) AS (
  SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey // 3 > 0
  UNION ALL SELECT type, base // 3, depth + 1 FROM chain WHERE base // 3 > 0),
self AS (SELECT p_partkey AS type, p_partkey AS base, 0 AS depth FROM part UNION ALL SELECT * FROM chain)
"""


@query(BASES + "SELECT type, base, CAST(depth AS INTEGER) AS depth FROM chain")
def base_chains(spark, sf_dir):
    return registrations.base_chains(part_types(spark, sf_dir))


@query(BASES + """, met AS (SELECT type, depth, concat('r', base) AS value FROM self WHERE base % 4 = 1 UNION ALL SELECT type, depth, concat('q', base) FROM self WHERE base % 8 = 1),
near AS (SELECT type, min(depth) AS depth FROM met GROUP BY type)
SELECT type, CAST(depth AS INTEGER) AS depth, string_agg(DISTINCT value, ',' ORDER BY value) AS "values" FROM met JOIN near USING (type, depth) GROUP BY type, depth""")
def nearest_class_routes(spark, sf_dir):
    types = part_types(spark, sf_dir)
    declared = types.filter("type % 4 = 1").select("type", F.concat(F.lit("r"), text("type")).alias("value")).unionByName(types.filter("type % 8 = 1").select("type", F.concat(F.lit("q"), text("type")).alias("value")))
    return registrations.nearest_declared(types, registrations.base_chains(types), declared).withColumn("values", F.array_join("values", ","))


@query(BASES + "SELECT DISTINCT type FROM chain WHERE base = 2 AND type % 5 <> 0")
def controller_types(spark, sf_dir):
    types = part_types(spark, sf_dir)
    names = types.select("type", F.when(F.col("type").isin(2, 4), "ControllerBase").otherwise("T").alias("name"), (F.col("type") == 2).alias("is_framework"))
    marked = types.filter("type % 5 = 0").select("type", F.lit("NonController").alias("name"))
    return registrations.controllers(registrations.base_chains(types), names, marked)


@query(BASES + "SELECT p_partkey AS type FROM part WHERE p_partkey % 13 = 0 OR NOT EXISTS (SELECT 1 FROM chain WHERE base = p_partkey AND type % 2 = p_partkey % 2)")
def leaf_types(spark, sf_dir):
    types = part_types(spark, sf_dir)
    told = types.select("type", (F.col("type") % 2).alias("assembly"), (F.col("type") % 13 == 0).alias("is_sealed"))
    return registrations.leaf_types(told, registrations.base_chains(types))


CALLS = f"""
WITH calls AS (SELECT page_id AS k, CASE page_id % 6 WHEN 4 THEN 'source' WHEN 5 THEN 'library' ELSE 'framework' END AS declared, CASE page_id % 8 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'PATCH' END AS own, page_id % 12 < 6 AS good,
  page_id % 9 = 3 AS wrapped, page_id % 18 = 3 AS inside, page_id % 10 = 7 AS open, page_id % 4 AS g FROM pages),
found AS (SELECT k, g, CASE WHEN declared = 'source' THEN 'GET' ELSE own END AS verb, CASE WHEN declared = 'framework' AND wrapped THEN 'the pattern is handed in by W' WHEN open THEN 'the pattern is no constant' WHEN g = 3 THEN 'the prefix of group g3 isn''t known' END AS reason FROM calls
  WHERE own IS NOT NULL AND ((declared = 'framework' AND NOT inside) OR (declared = 'source' AND good))),
resolved AS (SELECT verb, concat(CASE g WHEN 1 THEN '/a' WHEN 2 THEN '/b/c' ELSE '' END, '/p', k % 40) AS template, k FROM found WHERE reason IS NULL),
ends AS (SELECT concat(verb, ' ', template) AS fqn, k FROM resolved)
"""


def registered(spark, sf_dir):
    k = F.col("page_id")
    method = F.when(k % 8 == 0, "MapGet").when(k % 8 == 1, "MapPost").when(k % 8 == 2, "MapPut").when(k % 8 == 3, "MapDelete").when(k % 8 == 4, "MapPatch").otherwise("Map")
    calls = testgraphs.table(spark, sf_dir, "pages").select(
        method.alias("method"), F.when(k % 6 == 4, "source").when(k % 6 == 5, "library").otherwise("framework").alias("declared"), F.when(k % 12 < 6, "F").otherwise("Other").alias("callee"),
        F.when(k % 10 != 7, F.concat(F.lit("p"), text(k % 40), F.lit("/"))).alias("pattern"), F.when(k % 18 == 3, "F").when(k % 9 == 3, "W").alias("pattern_of"), F.when(k % 4 > 0, F.concat(F.lit("g"), text(k % 4))).alias("receiver"),
        F.lpad(text(k), 9, "0").alias("file"), F.lit(1).alias("span_start"), F.lit(2).alias("span_end"), F.lit("Class").alias("registrar_kind"), F.concat(F.lit("R"), text(k % 5)).alias("registrar_fqn"),
        F.when(k % 3 > 0, "Method").alias("handler_kind"), F.when(k % 3 > 0, F.concat(F.lit("H"), text(k % 7))).alias("handler_fqn"),
    )
    bodies = spark.createDataFrame([("F", "MapGet", "MapGet", True, "F", "F"), ("Other", "MapGet", "MapGet", True, "Other", None), ("W", "Wire", "MapGet", True, "W", "W")], "method string, name string, inner string, inner_is_framework boolean, pattern_of string, handler_of string")
    prefixes = spark.createDataFrame([("g1", "a"), ("g2", "b/c"), ("g3", None)], "name string, prefix string")
    return registrations.registrations(calls, registrations.forwarders(bodies), prefixes)


@query(CALLS + f"SELECT {duck_id('Endpoint', 'fqn')} AS id, fqn, lpad(CAST(min(k) AS VARCHAR), 9, '0') AS file FROM ends GROUP BY fqn")
def registered_endpoints(spark, sf_dir):
    return registrations.endpoint_graph(registered(spark, sf_dir)).nodes.select("id", "fqn", "file")


@query(CALLS + f"""SELECT DISTINCT {duck_id("Class", "concat('R', k % 5)")} AS source_id, {duck_id("Endpoint", "fqn")} AS target_id, 'Contains' AS kind FROM ends
UNION SELECT {duck_id("Endpoint", "fqn")}, {duck_id("Method", "concat('H', k % 7)")}, 'HandledBy' FROM ends WHERE k % 3 > 0""")
def registered_edges(spark, sf_dir):
    return registrations.endpoint_graph(registered(spark, sf_dir)).edges


@query(CALLS + "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM found WHERE reason IS NOT NULL GROUP BY reason")
def unresolved_registrations(spark, sf_dir):
    return registrations.unresolved(registered(spark, sf_dir))


@query(f"""
WITH actions AS (SELECT p_partkey AS k, p_size FROM part),
paths AS (SELECT k, CASE k % 3 WHEN 0 THEN 'GET' ELSE 'POST' END AS verb, concat('/api/C', p_size, CASE WHEN k % 3 = 1 THEN '' ELSE concat('/i', k) END) AS template, p_size FROM actions WHERE k % 4 <> 3)
SELECT {duck_id("Endpoint", "concat(verb, ' ', template)")} AS target_id, {duck_id("Class", "concat('C', p_size, 'Controller')")} AS source_id FROM paths GROUP BY ALL""")
def controller_endpoints(spark, sf_dir):
    """Attribute-routed actions as endpoints below their controllers; a quarter of the actions are abstract ones."""
    k, size = F.col("p_partkey"), text("p_size")
    part = testgraphs.table(spark, sf_dir, "part")
    controller = F.concat(F.lit("C"), size, F.lit("Controller"))
    actions = part.select(k.alias("action_id"), controller.alias("controller"), F.lit("Get").alias("action"), F.lit(None).cast("string").alias("area"), (k % 4 == 3).alias("is_abstract"))
    attributes = part.select(k.alias("action_id"), F.when(k % 3 == 0, "HttpGet").otherwise("HttpPost").alias("name"), F.when(k % 3 != 1, F.concat(F.lit("i"), text(k))).alias("template"))
    above = part.select(k.alias("action_id"), F.lit("api/[controller]").alias("template"))
    places = part.select(k.alias("action_id"), controller.alias("controller_fqn"), F.concat(controller, F.lit(".Get()")).alias("action_fqn"), F.lit("c.cs").alias("file"), F.lit(1).alias("span_start"), F.lit(2).alias("span_end"))
    rows = registrations.controller_endpoints(extraction.controller_routes(actions, attributes, above), places)
    return registrations.endpoint_graph(rows).edges.filter("kind = 'Contains'").select("source_id", "target_id")


# ---------------------------------------------------------------- clients


@query("""
SELECT concat('n', p_partkey) AS name FROM part WHERE (p_partkey - p_partkey % 7) % 3 = 0""")
def http_clients(spark, sf_dir):
    """Aliases in chains of up to six hops to every seventh name, a third of which are made by the factory."""
    k = F.col("p_partkey")
    part = testgraphs.table(spark, sf_dir, "part")
    names = part.select(F.concat(F.lit("n"), text(k)).alias("name"), F.when(k % 7 != 0, F.concat(F.lit("n"), text(k - 1))).alias("alias"))
    declared = part.filter(k % 7 == 0).select(F.concat(F.lit("n"), text(k)).alias("name"), F.when(k % 3 == 0, "axios.create").otherwise("make").alias("initializer"))
    return registrations.http_clients(names, declared)


@query("SELECT p_partkey AS use FROM part WHERE p_size % 2 = 0")
def ambient_fetches(spark, sf_dir):
    part = testgraphs.table(spark, sf_dir, "part")
    declared = part.select("p_size").distinct().select(F.concat(F.lit("s"), text("p_size")).alias("symbol"), F.when(F.col("p_size") % 2 == 0, "C:\\ts\\lib.dom.d.ts").otherwise("C:/w/fetch.ts").alias("file"))
    return registrations.ambient_fetches(part.select(F.concat(F.lit("s"), text("p_size")).alias("symbol"), F.col("p_partkey").alias("use")), declared).select("use")


@query("SELECT p_partkey AS id FROM part WHERE (p_partkey - p_partkey % 5) % 15 <> 10 AND ((p_partkey - p_partkey % 5) % 15 <> 5 OR (p_partkey - p_partkey % 5) % 4 = 0) UNION ALL SELECT -p_partkey FROM part WHERE p_partkey % 15 = 5 AND p_partkey % 4 = 0")
def dynamic_imports(spark, sf_dir):
    """Every fifth expression is an import, an identifier or another; those between are properties of the one before."""
    k = F.col("p_partkey")
    part = testgraphs.table(spark, sf_dir, "part")
    shape = F.when(k % 5 != 0, "property").when(k % 15 == 0, "import").when(k % 15 == 5, "identifier").otherwise("other")
    initializers = part.filter(k % 15 == 5).select((-k).alias("id"), F.when(k % 4 == 0, "require").otherwise("other").alias("shape"), F.lit(None).cast("bigint").alias("of"))
    rows = part.select(k.alias("id"), shape.alias("shape"), F.when(k % 5 != 0, k - 1).when(k % 15 == 5, -k).alias("of"))
    return registrations.dynamic_imports(rows.unionByName(initializers))
