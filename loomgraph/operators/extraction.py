"""From tables of what a compiler front end saw to nodes, edges, endpoints and call sites.

Parsing source code is out of scope. These operators take its facts as tables and do what is left: kinds,
identities, containment, edges, attribution of uses to members, routes of controllers and of grouped
registrations, and classification of call sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import routes, symbols
from ..sources.scratch import stored

# Base classes that every type of a kind has.
IMPLIED_BASES = ("System.Object", "System.ValueType", "System.Enum", "System.Delegate", "System.MulticastDelegate")
ENTRY_POINT, PROGRAM = "<top-level-statements-entry-point>", "Program"
VERB_ATTRIBUTES = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}
UNSUPPORTED_ATTRIBUTES = ("HttpHead", "HttpOptions", "AcceptVerbs")
MAX_GROUP_HOPS, MAX_CONSTANT_HOPS = 16, 8


def kind_of(symbol: str = "symbol", type_kind: str = "type_kind", record: str = "is_record", container: str = "container_kind") -> Column:
    """A node kind from a symbol's own kind (type, method, constructor, property, field, event, namespace); null for what is no node."""
    s, t = F.col(symbol), F.col(type_kind)
    rec = F.coalesce(F.col(record), F.lit(False))
    of_type = F.when(t == "class", F.when(rec, "Record").otherwise("Class")).when(t == "struct", F.when(rec, "Record").otherwise("Struct")).when(t == "interface", "Interface").when(t == "enum", "Enum").when(t == "delegate", "Delegate")
    return (
        F.when(s == "type", of_type)
        .when(s == "method", "Method")
        .when(s == "constructor", "Constructor")
        .when(s == "property", "Property")
        .when((s == "field") & (F.col(container) == "enum"), "EnumMember")
        .when(s == "field", "Field")
        .when(s == "event", "Event")
        .when(s == "namespace", "Namespace")
    )


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes of symbols (symbol, type_kind, is_record, container_kind, name, fqn, assembly, in_source, unnamed, file, span_start, span_end).

    What isn't declared in source or can't be named (anonymous types, tuple elements) gives none; entry
    points and the Program class without namespace are named after their assembly; namespaces have no file.
    Of several declarations the first by file and place counts.
    """
    kind = kind_of()
    own = rows.filter(F.col("in_source") & ~F.coalesce(F.col("unnamed"), F.lit(False))).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    bare = F.col("fqn").isin(ENTRY_POINT, PROGRAM) & F.col("assembly").isNotNull()
    fqn = F.when(bare, F.concat_ws(".", "assembly", "fqn")).otherwise(F.col("fqn"))
    placed = F.col("kind") != "Namespace"
    made = own.select(
        "kind",
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", fqn).otherwise(F.col("name")).alias("name"),
        fqn.alias("fqn"),
        *[F.when(placed, F.col(c)).alias(c) for c in ("file", "span_start", "span_end")],
    )
    first = made.groupBy("kind", "fqn").agg(F.min(F.struct("file", "span_start", "span_end", "name")).alias("_d"))
    return first.select(schema.node_id(F.col("kind"), F.col("fqn")).alias("id"), "kind", F.col("_d.name").alias("name"), "fqn", F.col("_d.file").alias("file"), F.col("_d.span_start").alias("span_start"), F.col("_d.span_end").alias("span_end"))


def edge(source_kind: str, source: str, target_kind: str, target: str, kind: Column) -> list[Column]:
    ident = lambda k, f: schema.node_id(F.col(k), F.col(f))
    return [ident(source_kind, source).alias("source_id"), ident(target_kind, target).alias("target_id"), kind.alias("kind")]


def type_edges(bases: DataFrame) -> DataFrame:
    """Inherits and Implements edges of rows (kind, fqn, base_kind, base_fqn, is_contract); a base that all types have gives none."""
    own = bases.filter(F.col("is_contract") | ~F.col("base_fqn").isin(*IMPLIED_BASES))
    return own.select(*edge("kind", "fqn", "base_kind", "base_fqn", F.when(F.col("is_contract"), "Implements").otherwise("Inherits"))).distinct()


def containment(types: DataFrame) -> DataFrame:
    """Contains edges of types (kind, fqn, namespace, project, outer_kind, outer_fqn).

    A nested type lies in the outer one; others in their namespace, whose chain hangs below the project; a
    type without namespace in the project itself.
    """
    nested = types.filter(F.col("outer_fqn").isNotNull()).select(*edge("outer_kind", "outer_fqn", "kind", "fqn", F.lit("Contains")))
    top = types.filter(F.col("outer_fqn").isNull()).withColumn("n", F.lit("Namespace")).withColumn("p", F.lit("Project"))
    spaced = F.coalesce(F.trim("namespace"), F.lit("")) != ""
    bare = top.filter(~spaced).select(*edge("p", "project", "kind", "fqn", F.lit("Contains")))
    held = top.filter(spaced)
    own = held.select(*edge("n", "namespace", "kind", "fqn", F.lit("Contains")))
    chains = held.select("p", "n", "project", symbols.dotted_prefixes(F.col("namespace")).alias("chain")).distinct()
    roots = chains.withColumn("root", F.element_at("chain", 1)).select(*edge("p", "project", "n", "root", F.lit("Contains")))
    steps = chains.select("n", F.explode(F.zip_with(F.slice("chain", F.lit(1), F.size("chain") - 1), F.slice("chain", F.lit(2), F.size("chain") - 1), lambda a, b: F.struct(a.alias("up"), b.alias("down")))).alias("s"))
    links = steps.select("n", F.col("s.up").alias("up"), F.col("s.down").alias("down")).select(*edge("n", "up", "n", "down", F.lit("Contains")))
    return nested.unionByName(bare).unionByName(own).unionByName(roots).unionByName(links).distinct()


def member_containment(members: DataFrame) -> DataFrame:
    """Contains edges of members (kind, fqn, type_kind, type_fqn)."""
    return members.select(*edge("type_kind", "type_fqn", "kind", "fqn", F.lit("Contains"))).distinct()


def enclosing_members(uses: DataFrame, members: DataFrame) -> DataFrame:
    """uses (file, at) with member_id: the innermost of members (file, span_start, span_end, id) whose span holds the place.

    One sort a file: starts, ends and uses in order of place; spans nest, so the depth after each event
    says which start is the innermost open one: the last start at the use's depth.
    """
    opens = members.select("file", F.col("span_start").alias("at"), F.lit(1).alias("step"), F.lit(1).alias("turn"), F.col("id").alias("member_id"), (-F.col("span_end")).alias("wide"))
    closes = members.select("file", F.col("span_end").alias("at"), F.lit(-1).alias("step"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("member_id"), F.lit(0).alias("wide"))
    asked = uses.select("file", "at").distinct().select("file", "at", F.lit(0).alias("step"), F.lit(2).alias("turn"), F.lit(None).cast("string").alias("member_id"), F.lit(0).alias("wide"))
    order = Window.partitionBy("file").orderBy("at", "turn", "wide").rowsBetween(Window.unboundedPreceding, 0)
    events = opens.unionByName(closes).unionByName(asked).withColumn("depth", F.sum("step").over(order)).withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("at", "turn", "wide")))
    at_depth = Window.partitionBy("file", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = events.filter("turn > 0").withColumn("inner", F.last("member_id", ignorenulls=True).over(at_depth))
    found = named.filter("turn = 2").select("file", "at", F.when(F.col("depth") > 0, F.col("inner")).alias("member_id"))
    return uses.join(found, ["file", "at"], "left")


def use_edges(uses: DataFrame) -> DataFrame:
    """Calls and References edges of uses (source_id, target_id, is_call, is_delegate_call, in_declaration).

    Calls of delegates and names in declarations or imports give none, nor does a reference to oneself.
    """
    is_call = F.coalesce(F.col("is_call"), F.lit(False))
    own = uses.filter("source_id is not null and target_id is not null").filter(~F.coalesce(F.col("is_delegate_call"), F.lit(False)) & ~F.coalesce(F.col("in_declaration"), F.lit(False)))
    return own.filter(is_call | (F.col("source_id") != F.col("target_id"))).select("source_id", "target_id", F.when(is_call, "Calls").otherwise("References").alias("kind")).distinct()


# ---------------------------------------------------------------- endpoints


def controller_routes(actions: DataFrame, attributes: DataFrame, class_routes: DataFrame) -> DataFrame:
    """For actions (action_id, controller, action, area, is_abstract) their routes, refusals and whether they are routed by convention.

    attributes: (action_id, name, template) without the suffix Attribute; class_routes: (action_id, template)
    of the nearest class that has any. Each template meets its own verb and all verbs without template; a
    [Route] needs a verb from the latter. Verbs outside the modelled set, abstract controllers, routes
    without a verb and tokens that aren't known are refused.
    """
    pairs = [F.lit(x) for p in VERB_ATTRIBUTES.items() for x in p]
    verb = F.try_element_at(F.create_map(*pairs), F.col("name"))
    usable = attributes.withColumn("verb", verb)
    templated = F.col("template").isNotNull() & (F.col("verb").isNotNull() | (F.col("name") == "Route"))
    grouped = usable.groupBy("action_id").agg(
        F.collect_list(F.when(templated, F.struct("verb", "template"))).alias("providers"),
        F.collect_set(F.when(F.col("template").isNull(), F.col("verb"))).alias("bare"),
        F.collect_set(F.when(F.col("name").isin(*UNSUPPORTED_ATTRIBUTES), F.concat(F.lit("'"), F.col("name"), F.lit("' isn't a verb that endpoints have")))).alias("odd"),
    )
    above = class_routes.groupBy("action_id").agg(F.collect_set("template").alias("above"))
    strings = F.array().cast("array<string>")
    rows = actions.join(grouped, "action_id", "left").join(above, "action_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, strings) for c in ("bare", "odd", "above")})
    rows = rows.withColumn("providers", F.coalesce("providers", F.array().cast("array<struct<verb:string,template:string>>")))
    any_template = (F.size("providers") > 0) | (F.size("above") > 0)
    verbs_of = lambda p: F.when(p["verb"].isNull(), F.col("bare")).otherwise(F.array_distinct(F.concat(F.array(p["verb"]), F.col("bare"))))
    asked = F.when(F.size("providers") > 0, F.flatten(F.transform("providers", lambda p: F.transform(verbs_of(p), lambda v: F.struct(v.alias("verb"), p["template"].alias("template")))))).otherwise(F.transform("bare", lambda v: F.struct(v.alias("verb"), F.lit(None).cast("string").alias("template"))))
    rows = rows.withColumn("asked", F.when(any_template & ~F.col("is_abstract"), asked).otherwise(F.array().cast("array<struct<verb:string,template:string>>")))
    each = rows.select("action_id", "controller", "action", "area", "above", F.explode("asked").alias("q")).select("action_id", "controller", "action", "area", "above", "q.verb", F.col("q.template").alias("own"))
    under = F.transform("above", lambda c: F.when(F.col("own").isNull(), c).otherwise(F.concat(c, F.lit("/"), F.col("own"))))
    absolute = F.coalesce(routes.is_absolute(F.col("own")), F.lit(False))
    combined = F.when(absolute, F.array(F.regexp_replace("own", "^~?/", ""))).when(F.size("above") == 0, F.array("own")).otherwise(under)
    composed = each.withColumn("template", F.explode(combined)).withColumn("filled", routes.fill_tokens(F.col("template"), F.col("controller"), F.col("action"), F.col("area")))
    empty = F.lit("")
    made = composed.groupBy("action_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("filled").isNotNull(), F.concat_ws(" ", "verb", routes.compose(empty, F.col("filled")))))).alias("routes"),
        F.collect_set(F.when(F.col("filled").isNull(), F.concat(F.lit("route '"), F.col("template"), F.lit("' keeps an unknown token")))).alias("unfilled"),
    )
    lone = F.transform(F.filter("providers", lambda p: p["verb"].isNull() & (F.size("bare") == 0)), lambda p: F.concat(F.lit("route '"), p["template"], F.lit("' names no verb")))
    silent = (F.size("providers") == 0) & (F.size("bare") == 0) & (F.size("odd") == 0)
    refused = (
        F.when(~any_template, F.col("odd"))
        .when(F.col("is_abstract"), F.array_append("odd", F.concat(F.lit("its controller is abstract: '"), F.col("controller"), F.lit("'"))))
        .otherwise(F.concat(F.col("odd"), lone, F.when(silent, F.array(F.lit("no verb is given"))).otherwise(strings)))
    )
    out = rows.join(made, "action_id", "left")
    return out.select("action_id", F.coalesce("routes", strings).alias("routes"), F.array_sort(F.concat(refused, F.coalesce("unfilled", strings))).alias("refusals"), (~any_template & (F.size("odd") == 0)).alias("is_conventional"))


def group_prefixes(groups: DataFrame, hops: int = MAX_GROUP_HOPS) -> DataFrame:
    """(name, prefix) of route groups (name, receiver, segment): segments from the root on, null where a chain is longer than hops or its root isn't known.

    Pointer jumping: in each round every group takes over its receiver's receiver and prefix, so a chain of
    16 takes 5 rounds.
    """
    now = stored(groups.select("name", "receiver", F.array("segment").alias("parts"), F.lit(1).alias("n")), "groups")
    reach = 1
    while reach < hops:
        up = now.select(F.col("name").alias("receiver"), F.col("receiver").alias("r2"), F.col("parts").alias("p2"), F.col("n").alias("n2"))
        joined = now.join(up, "receiver", "left")
        now = stored(joined.select("name", F.when(F.col("n2").isNotNull(), F.col("r2")).otherwise(F.col("receiver")).alias("receiver"), F.when(F.col("n2").isNotNull(), F.concat("p2", "parts")).otherwise(F.col("parts")).alias("parts"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "groups")
        reach *= 2
    known = F.col("receiver").isNull() & (F.col("n") <= hops) & ~F.exists("parts", lambda p: p.isNull())
    return now.select("name", F.when(known, F.array_join(F.filter("parts", lambda p: p != ""), "/")).alias("prefix"))


def constants(assignments: DataFrame, hops: int = MAX_CONSTANT_HOPS) -> DataFrame:
    """(name, value) of constants (name, value, alias): an alias has the value of what it names, within so many hops; null beyond."""
    now = stored(assignments.select("name", "value", "alias", F.lit(0).alias("n")), "constants")
    reach = 1
    while reach < 2 * hops:
        up = now.select(F.col("name").alias("alias"), F.col("value").alias("v2"), F.col("alias").alias("a2"), F.col("n").alias("n2"))
        now = stored(now.join(up, "alias", "left").select("name", F.coalesce("value", "v2").alias("value"), F.when(F.col("value").isNull() & F.col("v2").isNull(), F.col("a2")).alias("alias"), F.when(F.col("value").isNull(), F.col("n") + 1 + F.coalesce("n2", F.lit(0))).otherwise(F.col("n")).alias("n")), "constants")
        reach *= 2
    return now.select("name", F.when(F.col("n") <= hops, F.col("value")).alias("value"))


def folded_template(parts: Column) -> Column:
    """A template of parts (text, is_hole, failure): holes are {*}; null if a part failed."""
    text = F.array_join(F.transform(parts, lambda p: F.when(p["is_hole"], "{*}").otherwise(p["text"])), "")
    return F.when(~F.exists(parts, lambda p: p["failure"].isNotNull()), text)


def first_failure(parts: Column) -> Column:
    return F.try_element_at(F.transform(F.filter(parts, lambda p: p["failure"].isNotNull()), lambda p: p["failure"]), F.lit(1))


def classified_calls(calls: DataFrame) -> DataFrame:
    """Call sites (callee, method, method_is_literal, parts, file, line, column, span_start, span_end) as rows of an artifact.

    callee: fetch, or client for a method of an HTTP client. What has no verb or no argument of the shape
    of a path is no call site.
    """
    verb = F.when(F.col("callee") == "fetch", routes.fetch_verb(F.col("method"), F.coalesce(F.col("method_is_literal"), F.lit(True)))).otherwise(routes.client_verb(F.col("method")))
    template, failure = folded_template(F.col("parts")), first_failure(F.col("parts"))
    rows = calls.withColumns({"verb": verb, "template": template, "category": failure})
    own = rows.filter(F.col("verb").isNotNull() & (F.col("category").isNotNull() | routes.is_url_shaped(F.col("template"))))
    kind = F.when(F.col("category").isNull(), "FrontendCallSite").otherwise("UnresolvedCallSite")
    return own.select(kind.alias("kind"), "verb", "template", "category", "file", "line", "column", "span_start", "span_end").orderBy("file", "line", "column")


# ---------------------------------------------------------------- environment


# How far a pinned version may roll forward, by policy, as the level in which the installed one must lie; and where the policy
# counts bands (hundreds of the patch), from the pinned band's start.
ROLL_FORWARD = {"disable": "version", "patch": "band", "feature": "minor", "latestfeature": "minor", "minor": "major", "latestminor": "major", "major": "any", "latestmajor": "any"}
WITHIN_BAND = "band"


def version_parts(version: Column) -> Column:
    """An array of major, minor and patch; null for what isn't three numbers, after which a hyphen and a name may follow."""
    numbers = F.regexp_extract(version, r"^(\d{1,9}\.\d{1,9}\.\d{1,9})(-.*)?$", 1)
    return F.when(numbers != "", F.transform(F.split(numbers, r"\."), lambda x: x.cast("long")))


def rolled_forward(pins: DataFrame, installed: DataFrame) -> DataFrame:
    """pins (version, policy, ...) with found: the latest version of installed (version) that satisfies the pin under its policy, or null.

    A range join without ranges: what a policy allows are the versions of a level (the same version, band, minor or major version, or
    any) that aren't before the pin, or its band. So the latest version of each level decides, and pins meet it by an
    equality of level and prefix.
    """
    parts = version_parts(F.col("version"))
    at = F.struct(parts[0].alias("major"), parts[1].alias("minor"), parts[2].alias("patch"))

    def prefix(level: str, v: Column) -> Column:
        """The first numbers of a version, of the level; a band is a hundred of the patch."""
        whole = [v["major"], v["minor"], F.floor(v["patch"] / 100), v["patch"]]
        return F.concat_ws(".", *(x.cast("string") for x in whole[: ("any", "major", "minor", "band", "version").index(level)]))

    levels = ("any", "major", "minor", "band", "version")
    there = installed.filter(parts.isNotNull()).select(F.explode(F.array(*(F.struct(F.lit(x).alias("level"), prefix(x, at).alias("prefix"), at.alias("at")) for x in levels))).alias("x"))
    latest = there.groupBy("x.level", "x.prefix").agg(F.max("x.at").alias("latest"))
    policy = F.lower(F.coalesce("policy", F.lit("")))
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ROLL_FORWARD.items() for x in p)), policy), F.lit(WITHIN_BAND))
    asked = pins.select(F.struct(*pins.columns).alias("pin"), level.alias("level"), at.alias("own"), policy.isin("disable", "patch").alias("exact"))
    own = F.col("own")
    of_level = F.coalesce(*(F.when(F.col("level") == x, prefix(x, own)) for x in levels))
    met = asked.withColumn("prefix", of_level).join(stored(latest, "latest"), ["level", "prefix"], "left")
    least = F.struct(own["major"].alias("major"), own["minor"].alias("minor"), F.when(F.col("exact"), own["patch"]).otherwise(F.floor(own["patch"] / 100) * 100).alias("patch"))
    found = F.when(own["major"].isNotNull() & (F.col("latest") >= least), F.concat_ws(".", *(F.col(f"latest.{x}").cast("string") for x in ("major", "minor", "patch"))))
    return met.select("pin.*", found.alias("found"))
