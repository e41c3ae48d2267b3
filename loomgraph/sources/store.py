"""A graph kept as versions of Parquet tables, swapped by the rename of one pointer file.

A version is written in full before the pointer moves, so readers see the old graph or the new one, and a
failed save leaves the old one in place. Nodes and edges are partitioned by kind, so a scan by kind reads
that kind only. Within a kind nodes are dealt out by ranges of names and edges by ranges of what they lead from, and
sorted, so a file spans few names and a lookup skips the others. The same edges are there once more by what they lead to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..schema import Graph
from .scratch import cleaned_up, told

POINTER = "CURRENT"
TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "incoming": schema.EDGES, "files": schema.FILES, "meta": schema.META}
BY_KIND = ("nodes", "edges", "incoming")
PRINTS = "table string, n long, either long, total long"
ORDER = {"nodes": ("kind", "fqn"), "edges": ("kind", "source_id"), "incoming": ("kind", "target_id")}


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> str | None:
        """The name of the current version."""
        pointer = self._path(POINTER)
        if not self._fs.exists(pointer):
            return None
        return self.spark.read.text(f"{self.root}/{POINTER}").first()[0]

    def _read(self, table: str) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{version}/{table}").select(*TABLES[table].names)

    def load(self, tolerant: bool = True) -> Graph:
        """The current graph; kinds that aren't known are read as Unknown."""
        nodes, edges = self._read("nodes"), self._read("edges")
        version = self.version()
        # Graphs of older versions of this library have their edges once.
        incoming = self._read("incoming") if version is None or self._fs.exists(self._path(f"{version}/incoming")) else edges
        if tolerant:
            nodes = nodes.withColumn("kind", schema.known(F.col("kind"), schema.NODE_KINDS))
            edges, incoming = (df.withColumn("kind", schema.known(F.col("kind"), schema.EDGE_KINDS)) for df in (edges, incoming))
        return Graph(nodes, edges, incoming)

    def unknown_kinds(self) -> DataFrame:
        """The kinds (table, kind, n) that this version of the library doesn't know."""
        nodes = self._read("nodes").filter(~F.col("kind").isin(*schema.NODE_KINDS)).select(F.lit("nodes").alias("table"), "kind")
        edges = self._read("edges").filter(~F.col("kind").isin(*schema.EDGE_KINDS)).select(F.lit("edges").alias("table"), "kind")
        return nodes.unionByName(edges).groupBy("table", "kind").agg(F.count("*").alias("n"))

    def files(self) -> DataFrame:
        return self._read("files")

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self._read("meta").collect()}

    def save(self, graph: Graph, files: DataFrame, meta: Mapping[str, str], both: bool = True) -> str:
        """Write a new version and make it current. Of nodes with one id the least row stays; edges are a set, whose ids may be as packed() makes them.

        Its fingerprint is taken as the rows are written and kept in it. both: lay the edges out by what they lead to, too;
        without, the graph is half as large, and lookups by target read all edges of a kind.
        """
        name = f"v-{uuid.uuid4().hex}"
        tables = {
            "nodes": first_of_each(graph.nodes.select(*schema.NODES.names), ["id"]),
            "edges": graph.edges.select(*schema.EDGES.names),
            **({"incoming": None} if both else {}),
            "files": first_of_each(files.select(*schema.FILES.names), ["path"]),
            "meta": self.spark.createDataFrame(sorted(({"schema_version": schema.SCHEMA_VERSION} | dict(meta)).items()), schema.META),
        }
        prints = {table: Observation() for table in PRINTED}
        try:
            for table, df in tables.items():
                order = ORDER.get(table)
                if table == "incoming":  # the edges as they were written, so that what they come from is computed once
                    df = self.spark.read.schema(schema.EDGES).parquet(f"{self.root}/{name}/edges").select(*schema.EDGES.names)
                ids = [c for c in ("source_id", "target_id") if c in df.columns]
                texts = [c for c in ids if dict(df.dtypes)[c] == "string"]
                writer = df.select(*[packed(c) if c in texts else c for c in df.columns]) if texts else df
                writer = writer.repartitionByRange(*order) if order else writer
                if table == "edges":  # equal ones have met by then, so they needn't be shuffled again
                    writer = writer.distinct()
                writer = writer.sortWithinPartitions(*order) if order else writer
                writer = writer.select(*[unpacked(c) if c in ids else c for c in df.columns]) if ids else writer
                if table in prints:  # above the sort, so that rows count once however often what is below runs
                    writer = writer.observe(prints[table], *sums(F.xxhash64(*PRINTED[table])))
                out = writer.write.partitionBy("kind") if table in BY_KIND else writer.coalesce(1).write if table == "meta" else writer.write
                with cleaned_up(self.spark):
                    out.option("compression", "zstd").parquet(f"{self.root}/{name}/{table}")
            heard = {table: told(seen) for table, seen in prints.items()}
            if all(heard.values()):
                rows = [(table, x["n"], x["either"], x["total"]) for table, x in heard.items()]
                self.spark.createDataFrame(rows, PRINTS).coalesce(1).write.parquet(f"{self.root}/{name}/fingerprint")
        except Exception:
            self._fs.delete(self._path(name), True)
            raise
        self._point_to(name)
        return name

    def _point_to(self, name: str) -> None:
        new = self._path(f"{POINTER}.{name}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path(POINTER), options)

    def has(self, name: str) -> bool:
        """Whether the current version has a table of this name."""
        version = self.version()
        return version is not None and bool(self._fs.exists(self._path(f"{version}/{name}")))

    def derived(self, name: str, make: Callable[[Graph], DataFrame]) -> DataFrame:
        """A table that is made of the current graph. It is kept in its version, so it is as old as the graph, made once and goes with it."""
        version = self.version()
        if version is None:
            return make(self.load())
        path = self._path(f"{version}/{name}")
        if not self._fs.exists(path):
            new = f"{version}/{name}.{uuid.uuid4().hex}"
            made = make(self.load())
            with cleaned_up(self.spark):
                made.write.parquet(f"{self.root}/{new}")
            if self._fs.exists(path) or not self._fs.rename(self._path(new), path):  # another was faster
                self._fs.delete(self._path(new), True)
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def vacuum(self) -> int:
        """Delete versions that aren't current; returns how many."""
        keep, gone = self.version(), 0
        for status in self._fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("v-") and name != keep:
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone

    def fingerprint(self) -> tuple:
        """The fingerprint of the current graph: kept, or taken from its rows if its version holds none."""
        if not self.has("fingerprint"):
            return fingerprint(self.load(tolerant=False))
        kept = {r.table: (r.n, r.either, r.total) for r in self.spark.read.schema(PRINTS).parquet(f"{self.root}/{self.version()}/fingerprint").collect()}
        return tuple(kept[table] for table in PRINTED)

    def save_if_changed(self, graph: Graph, files: DataFrame, meta: Mapping[str, str]) -> bool:
        """Save unless nodes and edges are the current ones. The current ones are read only if their fingerprint is that of the new."""
        if self.version() is not None and self.fingerprint() == fingerprint(graph) and same_rows(self.load(tolerant=False), graph):
            return False
        self.save(graph, files, meta)
        return True


def packed(column: str | Column) -> Column:
    """An id as bytes to be shuffled: 16 for 32 lower-case hexadecimal digits, which ids of this library are, else the text behind 17 zeros. Their order is that of ids of one sort."""
    text = F.col(column) if isinstance(column, str) else column
    digits = F.unhex(text)
    out = F.when((F.length(text) == 32) & digits.isNotNull() & (F.lower(text) == text), digits).otherwise(F.concat(F.lit(bytes(17)), text.cast("binary")))
    return out.alias(column) if isinstance(column, str) else out


def unpacked(column: str) -> Column:
    """The id that packed() made bytes of."""
    return F.when(F.octet_length(column) == 16, F.lower(F.hex(column))).otherwise(F.expr(f"substring({column}, 18)").cast("string")).alias(column)


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the least by its other columns, so that the choice doesn't depend on order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


#: The tables, and their columns, that a fingerprint is taken of.
PRINTED = {"nodes": schema.NODES.names, "edges": schema.EDGES.names}


def sums(h: Column) -> list[Column]:
    """Aggregates of row hashes that don't depend on the order of rows: their number, exclusive or and sum."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("either"), F.sum(h % 1_000_003).alias("total")]


def fingerprint(graph: Graph) -> tuple:
    """Numbers that equal graphs share, for nodes and edges as sets: those of sums()."""
    return tuple(tuple(df.select(F.xxhash64(*PRINTED[table]).alias("h")).distinct().agg(*sums(F.col("h"))).first()) for table, df in (("nodes", graph.nodes), ("edges", graph.edges)))


def same_rows(a: Graph, b: Graph) -> bool:
    return all(not x.select(*c).distinct().exceptAll(y.select(*c).distinct()).take(1) for x, y, c in ((a.nodes, b.nodes, PRINTED["nodes"]), (a.edges, b.edges, PRINTED["edges"])))


def graphs_equal(a: Graph, b: Graph) -> bool:
    """Whether nodes and edges are the same sets: fingerprints first, rows only if these agree."""
    return fingerprint(a) == fingerprint(b) and same_rows(a, b)
