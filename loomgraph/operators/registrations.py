"""Endpoints from registrations and controllers, types from their bases, and client facts from declarations.

Facts come as tables of what a front end saw; what is left is joins. Chains (bases, aliases, property bases) are
followed by pointer jumping, so a chain of n hops takes about log2(n) joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import routes
from ..schema import Graph
from ..sources.scratch import rows_of, stored

# The framework's registration methods and their verbs, its controller base class, the client's factory, and a browser's own declarations.
MAP_METHODS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
CONTROLLER_BASE, NO_CONTROLLER = "ControllerBase", "NonController"
CLIENT_FACTORY, AMBIENT = "axios.create", "/lib.dom"
DYNAMIC = ("import", "require")
#: Hops that a trace of an expression follows, and hops from alias to alias.
MAX_HOPS, ALIAS_HOPS = 8, 32


def map_verb(method: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in MAP_METHODS.items() for x in p)), method)


# ---------------------------------------------------------------- registrations


def forwarders(bodies: DataFrame) -> DataFrame:
    """(callee, verb) of methods that only pass their own pattern and handler on to the framework.

    bodies: calls inside methods: method (its full name), name (of the method), inner (name of what it calls), inner_is_framework,
    and the methods whose parameters the pattern and the handler are (pattern_of, handler_of). The first such call, by inner, counts.
    """
    own = map_verb(F.col("name")).isNotNull() & F.col("inner_is_framework") & (F.col("pattern_of") == F.col("method")) & (F.col("handler_of") == F.col("method"))
    found = bodies.filter(own).withColumn("verb", map_verb(F.col("inner"))).filter("verb is not null")
    return found.groupBy(F.col("method").alias("callee")).agg(F.min("verb").alias("verb"))


def registrations(calls: DataFrame, through: DataFrame, prefixes: DataFrame) -> DataFrame:
    """calls of methods that are named like registrations, with verb, and a template or a reason why there is none.

    calls: method (name), declared (framework, source, or another word), callee (full name), pattern (null if it isn't a constant),
    pattern_of (method whose parameter the pattern is, or null), receiver (route group, or null), and any other columns.
    through: forwarders(); prefixes: (name, prefix) of route groups, prefix null where it isn't known.
    A call inside a forwarder is none, as the calls of the forwarder are; so is a method of the sources that forwards nothing,
    and one of another library.
    """
    named = calls.filter(map_verb(F.col("method")).isNotNull())
    rows = named.join(through.withColumnRenamed("verb", "_verb"), "callee", "left")
    rows = rows.join(through.select(F.col("callee").alias("pattern_of"), F.lit(True).alias("_inside")), "pattern_of", "left")
    rows = rows.join(prefixes.select(F.col("name").alias("receiver"), "prefix", F.lit(True).alias("_group")), "receiver", "left")
    framework, source = F.col("declared") == "framework", F.col("declared") == "source"
    rows = rows.filter((framework & F.col("_inside").isNull()) | (source & F.col("_verb").isNotNull()))
    wrapped = framework & F.col("pattern_of").isNotNull()
    lost = F.col("receiver").isNotNull() & F.col("prefix").isNull()
    reason = (
        F.when(wrapped, F.concat(F.lit("the pattern is handed in by "), "pattern_of"))
        .when(F.col("pattern").isNull(), "the pattern is no constant")
        .when(lost, F.concat(F.lit("the prefix of group "), "receiver", F.lit(" isn't known")))
    )
    template = routes.compose(F.coalesce("prefix", F.lit("")), F.col("pattern"))
    out = rows.withColumn("verb", F.when(framework, map_verb(F.col("method"))).otherwise(F.col("_verb"))).withColumn("reason", reason)
    return out.withColumn("template", F.when(F.col("reason").isNull(), template)).select(*calls.columns, "verb", "template", "reason")


def endpoint_graph(rows: DataFrame) -> Graph:
    """Endpoint nodes, with Contains edges from what registers them and HandledBy edges to their handlers.

    rows: verb, template (rows without one give nothing), file, span_start, span_end, registrar_kind and registrar_fqn, handler_kind and
    handler_fqn (null: not known). Registrations of one verb and template are one endpoint, placed where the first, by file and place, is.
    """
    fqn = F.concat_ws(" ", "verb", "template")
    own = rows.filter("template is not null and verb is not null").withColumn("fqn", fqn).withColumn("id", schema.node_id(F.lit("Endpoint"), fqn))
    place = F.struct(F.col("file").isNull().alias("nowhere"), "file", "span_start", "span_end")
    first = own.groupBy("id", "fqn", "template").agg(F.min(place).alias("p"))
    nodes = first.select("id", F.lit("Endpoint").alias("kind"), F.col("template").alias("name"), "fqn", "p.file", "p.span_start", "p.span_end")
    at = lambda who: schema.node_id(F.col(f"{who}_kind"), F.col(f"{who}_fqn"))
    held = own.filter("registrar_kind is not null and registrar_fqn is not null").select(at("registrar").alias("source_id"), F.col("id").alias("target_id"), F.lit("Contains").alias("kind"))
    handled = own.filter("handler_kind is not null and handler_fqn is not null").select(F.col("id").alias("source_id"), at("handler").alias("target_id"), F.lit("HandledBy").alias("kind"))
    return Graph(nodes, held.unionByName(handled).distinct())


def unresolved(rows: DataFrame) -> DataFrame:
    """(reason, n) of registrations() without a template."""
    return rows.filter("template is null").groupBy("reason").agg(F.count("*").alias("n"))


def controller_endpoints(routed: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows for endpoint_graph() of the routes ("VERB /template") of controller_routes().

    actions: action_id, controller_fqn, action_fqn, file, span_start, span_end.
    """
    each = routed.select("action_id", F.explode("routes").alias("route")).join(actions, "action_id")
    return each.select(
        F.substring_index("route", " ", 1).alias("verb"), F.regexp_replace("route", r"^\S+ ", "").alias("template"), "file", "span_start", "span_end",
        F.lit("Class").alias("registrar_kind"), F.col("controller_fqn").alias("registrar_fqn"), F.lit("Method").alias("handler_kind"), F.col("action_fqn").alias("handler_fqn"),
    )


# ---------------------------------------------------------------- types and their bases


def base_chains(bases: DataFrame) -> DataFrame:
    """(type, base, depth): all types above a type, the nearest at depth 1. bases: (type, base), one base a type."""
    reached = stored(bases.filter("base is not null and base <> type").groupBy("type").agg(F.min("base").alias("base")).select("type", "base", F.lit(1).alias("depth")), "bases")
    reach = 1
    while True:
        # Those at the full reach go on from where they are; a chain that comes back to its type ends there.
        last = reached.filter(F.col("depth") == reach).select("type", F.col("base").alias("_at"))
        more = last.join(reached.select(F.col("type").alias("_at"), "base", F.col("depth").alias("_d")), "_at").filter("base <> type")
        more = more.groupBy("type", "base").agg((F.min("_d") + reach).alias("depth")).join(reached, ["type", "base"], "left_anti")
        more = stored(more, "bases")
        if not rows_of(more):
            return reached
        reached = stored(reached.unionByName(more), "bases")
        reach *= 2


def nearest_declared(types: DataFrame, chains: DataFrame, declared: DataFrame) -> DataFrame:
    """(type, depth, values): what the nearest of a type and its bases declares; types none of which declares anything are left out.

    types: (type); chains: base_chains(); declared: (type, value), such as the templates of route attributes or the area of a class.
    """
    at = types.select("type", F.col("type").alias("base"), F.lit(0).alias("depth")).unionByName(chains.join(types.select("type"), "type", "left_semi"))
    met = at.join(declared.select(F.col("type").alias("base"), "value"), "base").groupBy("type", "depth").agg(F.array_sort(F.collect_set("value")).alias("values"))
    near = met.groupBy("type").agg(F.min(F.struct("depth", "values")).alias("n"))
    return near.select("type", "n.depth", "n.values")


def controllers(chains: DataFrame, names: DataFrame, attributes: DataFrame) -> DataFrame:
    """(type) of controllers: what derives from the framework's base class and isn't marked as none.

    names: (type, name, is_framework); attributes: (type, name).
    """
    roots = names.filter((F.col("name") == CONTROLLER_BASE) & F.col("is_framework")).select(F.col("type").alias("base"))
    refused = attributes.filter(F.col("name") == NO_CONTROLLER).select("type")
    return chains.join(roots, "base", "left_semi").select("type").distinct().join(refused, "type", "left_anti")


def leaf_types(types: DataFrame, chains: DataFrame) -> DataFrame:
    """(type) of types (type, assembly, is_sealed) that are sealed, or that nothing in their own assembly derives from."""
    below = chains.join(types.select("type", F.col("assembly").alias("_a")), "type").select(F.col("base").alias("type"), F.col("_a").alias("assembly")).distinct()
    return types.join(below.withColumn("_derived", F.lit(True)), ["type", "assembly"], "left").filter("is_sealed or _derived is null").select("type")


# ---------------------------------------------------------------- clients and dynamic imports


def originals(names: DataFrame, hops: int = ALIAS_HOPS) -> DataFrame:
    """(name, original): where a chain of aliases (name, alias; alias null for a declaration) has come to after so many hops, or ends.

    A name that isn't in the table ends a chain. Pointer doubling: jumps of 1, 2, 4, ... hops, put together to the number of hops.
    """
    jump = stored(names.select("name", F.coalesce("alias", "name").alias("to")), "jumps")
    now, left = jump.select("name", F.col("name").alias("at")), hops

    def after(rows: DataFrame, at: str) -> DataFrame:
        further = jump.select(F.col("name").alias(at), F.col("to").alias("_to"))
        return stored(rows.join(further, at, "left").select("name", F.coalesce("_to", at).alias(at)), "jumps")

    while left:
        if left & 1:
            now = after(now, "at")
        left >>= 1
        if left:
            jump = after(jump, "to")
    return now.select("name", F.col("at").alias("original"))


def http_clients(names: DataFrame, declarations: DataFrame) -> DataFrame:
    """(name) of HTTP clients: names whose original declaration's initializer calls the client factory.

    names: (name, alias); declarations: (name, initializer), the function that the initializer calls.
    """
    made = declarations.filter(F.col("initializer") == CLIENT_FACTORY).select(F.col("name").alias("original"))
    return originals(names).join(made, "original", "left_semi").select("name")


def ambient_fetches(uses: DataFrame, declarations: DataFrame) -> DataFrame:
    """The uses (symbol, ...) of a fetch that a browser itself declares; declarations: (symbol, file). A local one of that name is none."""
    own = declarations.filter(F.contains(F.translate("file", "\\", "/"), F.lit(AMBIENT))).select("symbol")
    return uses.join(own, "symbol", "left_semi")


def dynamic_imports(expressions: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(id) of expressions that come from a dynamic import or require.

    expressions: id, shape (import, require, property, identifier, binding or another), and of: the expression that a property is
    taken from, or the initializer of an identifier's or binding's declaration, which is looked at itself but not followed.
    """
    now = stored(expressions.select("id", F.col("id").alias("at"), F.lit(0).alias("n")), "traces")
    below = expressions.select(F.col("id").alias("at"), "shape", "of")
    for _ in range(hops - 1):
        step = now.join(below.filter("shape = 'property' and of is not null"), "at").select("id", F.col("of").alias("at"), (F.col("n") + 1).alias("n"))
        seen = now.join(step.select("id"), "id", "left_anti")
        if not step.take(1):
            break
        now = stored(seen.unionByName(step), "traces")
    ends = now.join(below, "at")
    source = expressions.select(F.col("id").alias("of"), F.col("shape").alias("_shape"))
    told = ends.join(source, "of", "left")
    direct = F.col("shape").isin(*DYNAMIC)
    declared = F.col("shape").isin("identifier", "binding") & F.coalesce(F.col("_shape").isin(*DYNAMIC), F.lit(False))
    return told.filter(direct | declared).select("id").distinct()


def in_project(path: Column, root: str | Column) -> Column:
    """Whether a file lies below a project's root and in no folder of installed packages."""
    slashes = lambda x: F.translate(x, "\\", "/")
    root = F.lit(root) if isinstance(root, str) else root
    below = F.startswith(slashes(path), F.concat(F.regexp_replace(slashes(root), "/+$", ""), F.lit("/")))
    return below & ~F.contains(slashes(path), F.lit("/node_modules/"))
