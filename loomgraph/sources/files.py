"""Source files: content hashes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_files(spark: SparkSession, paths: list[str] | str, pattern: str = "*") -> DataFrame:
    """path and lowercase SHA-256 of each readable file; unreadable ones are left out."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    return read.load(paths).select("path", F.sha2("content", 256).alias("content_hash"))


def hash_texts(sources: DataFrame) -> DataFrame:
    """path and hash of texts that are a table already; a null text can't be read and is left out."""
    return sources.filter(F.col("text").isNotNull()).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def read_sources(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path and whole text of files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def one_per_path(entries: DataFrame, order: str) -> DataFrame:
    """Of entries with one path (a project built for several targets) the first in order."""
    rest = [c for c in entries.columns if c not in ("path", order)]
    return entries.groupBy("path").agg(F.min(F.struct(order, *rest)).alias("_row")).select("path", F.col(f"_row.{order}").alias(order), *[F.col(f"_row.{c}").alias(c) for c in rest])


def nearest_pins(paths: DataFrame, pins: DataFrame) -> DataFrame:
    """(path, pin_path, version, policy): what the nearest file in a path's folder or above it pins; null where there is none, or it pins nothing.

    paths: (path); pins: (path, json) of global.json files. Folders are joined by name, one row for each above a path.
    """
    folder = lambda c: F.regexp_replace(F.translate(c, "\\", "/"), "[^/]*$", "")
    parts = F.split(F.regexp_replace("_folder", "/$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    asked = paths.select("path").distinct().withColumn("_folder", folder("path"))
    each = asked.select("path", F.posexplode(above).alias("_depth", "_at"))
    told = pins.select(folder("path").alias("_at"), F.col("path").alias("pin_path"), F.get_json_object("json", "$.sdk.version").alias("version"), F.get_json_object("json", "$.sdk.rollForward").alias("policy"))
    near = each.join(told, "_at").groupBy("path").agg(F.max(F.struct("_depth", "pin_path", "version", "policy")).alias("p"))
    return asked.select("path").join(near.filter("p.version is not null").select("path", "p.pin_path", "p.version", "p.policy"), "path", "left")
