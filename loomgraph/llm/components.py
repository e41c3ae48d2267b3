"""Connected components of a graph given as edges, by alternating stars.

The large star links every larger neighbour of a node to the node's smallest neighbour (or itself), the
small star does so with its smaller neighbours; in turn they leave, after a number of rounds logarithmic
in the size, one star for each component. A round is aggregations (a minimum, combined before the
shuffle) and joins of two shuffled tables, which Spark splits where a node has very many edges. Each
round's edges are written to the shared folder, so plans stay short and no edge comes to the driver.

Edges with a null end and loops are left out, repeated edges count once, and an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first())


def star(neighbours: DataFrame, large: bool) -> DataFrame:
    """neighbours: (u, v), for the small star with v < u only."""
    least = common.stored(neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    joined = neighbours.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))
    return common.stored(out.distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), the component being its smallest node."""
    now = common.stored(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = star(star(both, large=True), large=False)
        before, mark = mark, fingerprint(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
