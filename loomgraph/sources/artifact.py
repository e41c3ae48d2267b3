"""Call sites that a frontend extractor wrote as JSON: validated as a whole before any row is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .store import first_of_each

VERSION = 2
RESOLVED, UNRESOLVED = "FrontendCallSite", "UnresolvedCallSite"  # fixed values: kinds in the artifact
CALL_SITE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("kind", "verb", "template", "resolutionTier", "category", "reason", "file")]
    + [T.StructField(c, T.IntegerType()) for c in ("line", "column", "spanStart", "spanEnd")]
)
ARTIFACT = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()),
    T.StructField("producer", T.StringType()),
    T.StructField("producerVersion", T.StringType()),
    T.StructField("project", T.StructType([T.StructField("root", T.StringType()), T.StructField("tsconfig", T.StringType())])),
    T.StructField("stats", T.StructType([
        T.StructField("resolvedCount", T.IntegerType()),
        T.StructField("unresolvedCount", T.IntegerType()),
        T.StructField("coveragePercent", T.DoubleType()),
        T.StructField("byCategory", T.MapType(T.StringType(), T.IntegerType())),
    ])),
    T.StructField("callSites", T.ArrayType(CALL_SITE)),
])


class ArtifactError(ValueError):
    """The artifact can't be used; nothing of it was."""


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTIFACT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_usable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The artifacts of a folder that can be used, with their file, and (file, fault) of those that can't, the first fault of each.

    A file that is no JSON, or has a fault, is left out as a whole; the others are read all the same.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    read = texts.select("file", F.from_json("value", ARTIFACT).alias("a")).select("file", "a.*")
    empty = F.when(F.col("schemaVersion").isNull() & F.col("producer").isNull() & F.col("callSites").isNull(), "the file can't be read")
    whole = read.select("file", F.coalesce(empty, whole_fault()).alias("fault"))
    sites = read.select("file", F.explode("callSites").alias("s")).select("file", site_fault().alias("fault"))
    bad = whole.unionByName(sites).filter("fault is not null").groupBy("file").agg(F.min("fault").alias("fault"))
    return read.join(bad.select("file"), "file", "left_anti"), bad


def render(sites: DataFrame, producer: str, version: str = "1") -> DataFrame:
    """(root, json): an artifact for each project root, of call sites (root, and the fields of CALL_SITE), in order of file, line and column."""
    order = F.struct("file", "line", "column", *(f.name for f in CALL_SITE.fields if f.name not in ("file", "line", "column")))
    resolved, unresolved = F.count_if(F.col("kind") == RESOLVED), F.count_if(F.col("kind") == UNRESOLVED)
    coverage = F.when(resolved + unresolved == 0, 100.0).otherwise(F.floor(resolved * 1000 / (resolved + unresolved) + 0.5) / 10)
    listed = sites.groupBy("root").agg(F.array_sort(F.collect_list(order)).alias("s"), resolved.cast("int").alias("r"), unresolved.cast("int").alias("u"), coverage.alias("c"))
    stats = F.struct(F.col("r").alias("resolvedCount"), F.col("u").alias("unresolvedCount"), F.col("c").alias("coveragePercent"))
    own = F.transform("s", lambda x: F.struct(*(x[f.name].alias(f.name) for f in CALL_SITE.fields)))
    whole = F.struct(F.lit(VERSION).alias("schemaVersion"), F.lit(producer).alias("producer"), F.lit(version).alias("producerVersion"), F.struct("root").alias("project"), stats.alias("stats"), own.alias("callSites"))
    return listed.select("root", F.to_json(whole, {"pretty": "true"}).alias("json"))


def parse(texts: DataFrame, column: str = "json") -> DataFrame:
    """Artifacts of a column of JSON texts; a text that can't be parsed gives nulls."""
    return texts.select(F.from_json(column, ARTIFACT).alias("a")).select("a.*")


def site_fault() -> Column:
    """What is wrong with a call site (column s), or null."""
    blank = lambda c: F.coalesce(F.trim(F.col(f"s.{c}")), F.lit("")) == ""
    resolved, unresolved = F.col("s.kind") == RESOLVED, F.col("s.kind") == UNRESOLVED
    return (
        F.when(blank("file"), "a call site has no file")
        .when(blank("verb"), "a call site has no verb")
        .when(F.coalesce(resolved, F.lit(False)) & blank("template"), "a resolved call site has no template")
        .when(F.coalesce(unresolved, F.lit(False)) & blank("category"), "an unresolved call site has no category")
        .when(F.coalesce(unresolved, F.lit(False)) & blank("reason"), "an unresolved call site has no reason")
        .when(~F.coalesce(resolved | unresolved, F.lit(False)), F.concat(F.lit("unknown call site kind "), F.coalesce(F.col("s.kind"), F.lit("null"))))
    )


def whole_fault(producer: str | None = None) -> Column:
    """What is wrong with an artifact but for its call sites, or null."""
    foreign = F.lit(False) if producer is None else F.coalesce(F.col("producer") != producer, F.lit(True))
    return (
        F.when(F.col("schemaVersion") == 1, "the artifact has schema version 1, which an older extractor wrote; extract again")
        .when(F.coalesce(F.col("schemaVersion") != VERSION, F.lit(True)), "the artifact has another schema version")
        .when(foreign, "the artifact has another producer")
        .when(F.col("callSites").isNull(), "the artifact has no callSites")
    )


def faults(artifact: DataFrame, producer: str | None = None) -> DataFrame:
    """All faults of artifacts, as rows; none if they can be used. producer: the only one that is accepted."""
    whole = artifact.select(whole_fault(producer).alias("fault"))
    sites = artifact.select(F.explode("callSites").alias("s")).select(site_fault().alias("fault"))
    return whole.unionByName(sites).filter(F.col("fault").isNotNull())


def validate(artifact: DataFrame, producer: str | None = None) -> None:
    """Raise ArtifactError on the first fault."""
    if found := faults(artifact, producer).take(1):
        raise ArtifactError(found[0].fault)


def nodes(artifact: DataFrame) -> DataFrame:
    """Graph nodes of call sites; of those with one id the least row."""
    s = artifact.select("project.root", F.explode("callSites").alias("s")).select("root", "s.*")
    place = F.concat_ws(":", "file", "line", "column")
    resolved = F.col("kind") == RESOLVED
    fqn = F.when(resolved, F.concat_ws(" ", "verb", place)).otherwise(F.concat_ws(" ", "verb", "category", place))
    name = F.when(resolved, F.col("template")).otherwise(F.concat_ws(": ", "category", "reason"))
    absolute = F.when(F.col("root").isNull(), F.col("file")).otherwise(F.concat(F.regexp_replace(F.translate("root", "\\", "/"), "/+$", ""), F.lit("/"), F.col("file")))
    made = s.select("kind", name.alias("name"), fqn.alias("fqn"), absolute.alias("file"), F.col("spanStart").alias("span_start"), F.col("spanEnd").alias("span_end"))
    return first_of_each(made.withColumn("id", schema.node_id(F.col("kind"), F.col("fqn"))).select(*schema.NODES.names), ["id"])


def statistics(sites: DataFrame) -> DataFrame:
    """resolved, unresolved, coverage in percent to one decimal, and unresolved call sites by category, of rows (kind, category)."""
    resolved, unresolved = F.count_if(F.col("kind") == RESOLVED), F.count_if(F.col("kind") == UNRESOLVED)
    by_category = sites.filter((F.col("kind") == UNRESOLVED) & F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n"))
    named = by_category.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    total = resolved + unresolved
    coverage = F.when(total == 0, 100.0).otherwise(F.floor(resolved * 1000 / total + 0.5) / 10)
    return sites.agg(resolved.alias("resolved"), unresolved.alias("unresolved"), coverage.alias("coverage")).crossJoin(named)
