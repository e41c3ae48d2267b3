"""Which project and which namespace a node belongs to.

Both are longest-prefix lookups. A file or name is exploded into its prefixes, which join by equality (a
shuffle or broadcast hash join, whatever the sizes), instead of comparing each node with each container.
The lookup runs once for each distinct file or name and is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import symbols
from ..sources.scratch import sized, stored


def project_dirs(nodes: DataFrame) -> DataFrame:
    """dir (lower case, a slash at its end) and project of each project; of projects in one place the first by name."""
    own = nodes.filter((F.col("kind") == "Project") & F.col("file").isNotNull())
    return own.groupBy(F.lower(symbols.directory(F.col("file"))).alias("dir")).agg(F.min("name").alias("project"))


def project_of_files(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """file and project, of the distinct files of a frame with a column file, where there is one."""
    exploded = files.select("file").filter(F.col("file").isNotNull()).distinct().select("file", F.explode(symbols.directories(F.col("file"))).alias("dir"))
    found = exploded.join(sized(stored(project_dirs(nodes), "dirs")), "dir")
    return found.groupBy("file").agg(F.max_by("project", F.length("dir")).alias("project"))


def with_project(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with the column project of their column file; null where no project's directory holds it."""
    return rows.join(project_of_files(rows, nodes), "file", "left")


def project_of_nodes(nodes: DataFrame) -> DataFrame:
    """id and container (project) of nodes that have one."""
    return with_project(nodes.select("id", "file"), nodes).filter(F.col("project").isNotNull()).select("id", F.col("project").alias("container"))


def namespace_of_nodes(nodes: DataFrame) -> DataFrame:
    """id and container: the longest namespace that is the node's name or ends before one of its dots."""
    spaces = nodes.filter(F.col("kind") == "Namespace").select(F.col("fqn").alias("prefix")).distinct()
    exploded = nodes.select("id", F.explode(symbols.dotted_prefixes(F.col("fqn"))).alias("prefix"))
    return exploded.join(spaces, "prefix").groupBy("id").agg(F.max_by("prefix", F.length("prefix")).alias("container"))
