"""Constant folding of expressions: what string an expression has at compile time, or why it has none.

expressions: id, op (string, number, template, plus, name, property, import, env or other), text (the value of a string or number,
the head of a template), parent and position of a part of a plus or of a template, after (the text that follows a part
of a template), and of names and properties what their symbol is declared as: declared (variable, property or null), of (the
initializer's expression) and is_const (whether the variable, or the variable that holds the property, is constant).

What an expression is worth depends on how many steps are left when it is reached, as a chain that is too long fails. So
f(expression, steps) is made for one step, then two, ...: each round is a join of the expressions that are still too long with
their parts' values of the round before. A value, or a failure of another kind, that was found with few steps holds with more, so
only those that are too long stay in a round. An initializer is folded once, however many expressions lead to it, and
chains that run in circles are too long.

Nulls: a part that isn't in the table counts as computed at run time. Rows of one id are one expression, the least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Steps that a chain may have.
STEPS = 8
# Why an expression has no value, and how a template was found.
BASE_URL, RUNTIME, NOT_CONSTANT, DYNAMIC_IMPORT, TOO_LONG = "dynamic-base-url", "runtime-computed-segment", "non-constant-identifier", "dynamic-import-or-indirection", "resolution-depth-exceeded"
LITERAL, CONSTANT, FOLDED, WITH_HOLES = "literal", "const-resolved", "template-folded", "template-param-holes"
HOLE = "{*}"
COLUMNS = ("id", "op", "text", "parent", "position", "after", "declared", "of", "is_const")


def one_row_each(expressions: DataFrame) -> DataFrame:
    rest = F.struct(*(c for c in COLUMNS if c != "id"))
    return stored(expressions.groupBy("id").agg(F.min(rest).alias("e")).select("id", "e.*"), "expressions")


def told(expressions: DataFrame) -> DataFrame:
    """(id, value, category) of one_row_each() as far as the expression itself tells; both are null where its parts tell."""
    imports = expressions.filter("op = 'import'").select(F.col("id").alias("of"), F.lit(True).alias("imported"))
    op, variable = F.col("op"), F.col("declared") == "variable"
    declared = F.col("of").isNotNull() & ((op.isin("name", "property") & variable) | ((op == "property") & (F.col("declared") == "property")))
    of_name = F.when(~F.coalesce("is_const", F.lit(False)), NOT_CONSTANT).when(variable & F.col("imported"), DYNAMIC_IMPORT)
    category = F.when(op.isin("string", "number", "plus"), F.lit(None)).when(op == "import", DYNAMIC_IMPORT).when(op == "env", BASE_URL).when(declared, of_name).otherwise(RUNTIME)
    value = F.when(op.isin("string", "number"), F.coalesce("text", F.lit("")))
    return expressions.join(stored(imports, "imports"), "of", "left").select("id", value.alias("value"), category.alias("category"))


def resolved(expressions: DataFrame, steps: int = STEPS) -> DataFrame:
    """(id, value, category, cause) of each expression: its value, or why it has none and the expression that the failure is of."""
    own = one_row_each(expressions)
    begun = stored(told(own), "told")
    known = begun.filter("value is not null or category is not null").withColumn("cause", F.col("id"))
    open_ = begun.filter("value is null and category is null").select("id")
    parts = own.filter("parent is not null").select(F.col("parent").alias("id"), "position", F.col("id").alias("part"))
    parts = parts.unionByName(own.filter("op in ('name', 'property')").select("id", F.lit(0).cast(parts.schema["position"].dataType).alias("position"), F.col("of").alias("part")))
    edges = stored(parts.join(open_, "id", "left_semi"), "edges")
    # With one step every part is one too many; with none left, the first of them is where it fails.
    first = edges.groupBy("id").agg(F.min(F.struct("position", "part")).alias("p")).select("id", F.col("p.part").alias("cause"))
    known = stored(known.unionByName(open_.join(first, "id", "left_anti").select("id", F.lit(None).cast("string").alias("value"), F.lit(RUNTIME).alias("category"), F.col("id").alias("cause"))), "known")
    long = stored(first, "long")
    for _ in range(steps - 1):
        if not long.take(1):
            break
        of_parts = known.unionByName(long.select("id", F.lit(None).cast("string").alias("value"), F.lit(TOO_LONG).alias("category"), "cause"))
        met = edges.join(long.select("id"), "id", "left_semi").join(of_parts.select(F.col("id").alias("part"), F.lit(True).alias("there"), "value", "category", "cause"), "part", "left")
        lost = F.col("there").isNull()
        part = F.struct("position", "part", "value", F.when(lost, RUNTIME).otherwise(F.col("category")).alias("category"), F.when(lost, F.col("part")).otherwise(F.col("cause")).alias("cause"))
        grouped = met.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        failed = F.try_element_at(F.filter("parts", lambda p: p["category"].isNotNull()), F.lit(1))
        value = F.when(failed.isNull(), F.array_join(F.transform("parts", lambda p: p["value"]), ""))
        now = stored(grouped.select("id", value.alias("value"), failed["category"].alias("category"), F.coalesce(failed["cause"], "id").alias("cause")), "folded")
        too_long = F.coalesce(F.col("category") == TOO_LONG, F.lit(False))
        known, long = known.unionByName(now.filter(~too_long)), now.filter(too_long).select("id", "cause")
    return known.unionByName(long.select("id", F.lit(None).cast("string").alias("value"), F.lit(TOO_LONG).alias("category"), "cause"))


def folded(arguments: DataFrame, expressions: DataFrame, steps: int = STEPS) -> DataFrame:
    """(call, template, tier, category, cause) of arguments (call, id): the route template of each call's argument, and how it was found; or why there is none.

    A template always has a route: its parts that are computed at run time are holes. A part that fails otherwise, the first
    one, makes the call fail.
    """
    own = one_row_each(expressions)
    results = stored(resolved(own, steps), "resolved")
    roots = stored(arguments.select("call", "id").join(own.select("id", "op", "text"), "id", "left"), "roots")
    plain = roots.filter("op is null or op <> 'template'").join(results, "id", "left")
    tier = F.when(F.col("value").isNull(), F.lit(None)).when(F.col("op") == "string", LITERAL).otherwise(CONSTANT)
    missing = F.when(F.col("value").isNull(), F.coalesce("category", F.lit(RUNTIME)))
    plain = plain.select("call", F.col("value").alias("template"), tier.alias("tier"), missing.alias("category"), F.when(F.col("value").isNull(), F.coalesce("cause", "id")).alias("cause"))
    part = F.struct("position", "value", "category", "cause", "after")
    holes = own.filter("parent is not null").join(results, "id").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    made = roots.filter("op = 'template'").join(stored(holes, "holes"), "id", "left").withColumn("parts", F.coalesce("parts", F.array().cast(holes.schema["parts"].dataType)))
    failed = F.try_element_at(F.filter("parts", lambda p: p["category"] != RUNTIME), F.lit(1))
    text = F.concat(F.coalesce("text", F.lit("")), F.array_join(F.transform("parts", lambda p: F.concat(F.coalesce(p["value"], F.lit(HOLE)), F.coalesce(p["after"], F.lit("")))), ""))
    tier = F.when(F.exists("parts", lambda p: p["value"].isNull()), WITH_HOLES).when(F.size("parts") == 0, LITERAL).otherwise(FOLDED)
    whole = made.select("call", F.when(failed.isNull(), text).alias("template"), F.when(failed.isNull(), tier).alias("tier"), failed["category"].alias("category"), failed["cause"].alias("cause"))
    return plain.unionByName(whole)
