"""Tables that cut lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Thread

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a stored frontier up to which it is broadcast; ids take about 40 bytes a row.
BROADCAST_ROWS = 200_000
#: Seconds that rows_of() waits.
WAIT = 15
#: Values of a block.
BLOCK = 4096


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session names none, and on one machine, a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import atexit
    import shutil
    import tempfile

    made = tempfile.mkdtemp(prefix="loomgraph-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return spark.conf.get("spark.checkpoint.dir")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables stored in each open scope of temporaries(), the innermost last; threads have scopes of their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def cleaned_up(spark: SparkSession):
    """The shuffle files of writes inside go when these end, as they are the only use of their plans; else they stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs a read.

    Inside temporaries() the table goes with the scope, or, to be kept, with the scope around it. Its rows are counted
    as they are written; rows_of() tells.
    """
    spark = df.sparkSession
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        counted.write.option("compression", "zstd").parquet(path)
    around = _scopes.get()[:-1] if keep else _scopes.get()
    if around:
        around[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seen = seen
    return out


def told(seen: Observation | None) -> dict:
    """What a write told of its rows; nothing if the message got lost, which it can on a very busy cluster, for WAIT seconds."""
    heard: list[dict] = []
    if seen is not None:
        asking = Thread(target=lambda: heard.append(seen.get), daemon=True)
        asking.start()
        asking.join(WAIT)
    return heard[0] if heard else {}


def rows_of(df: DataFrame) -> int:
    """How many rows a frame has: told by the write of what stored() returned, else counted."""
    n = told(df.__dict__.get("_seen")).get("n")
    return df.count() if n is None else n


@contextmanager
def temporaries(spark: SparkSession):
    """Deletes the tables stored inside at the end; what is still to be read must have been kept, or stored around it."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def sized(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its rows, which are counted, are few enough."""
    return F.broadcast(df) if rows_of(df) <= BROADCAST_ROWS else df


def among(rows: DataFrame, found: DataFrame, column: str, named: str | None = None) -> DataFrame:
    """The rows whose column is among those of a stored table, where it may be named otherwise. If its rows, which are counted, are few, their ids are sent to the rows, which then aren't shuffled."""
    ids = found.select(F.col(named or column).alias(column)).distinct()
    return rows.join(F.broadcast(ids) if rows_of(found) <= BROADCAST_ROWS else ids, column, "left_semi")


def blocks(rows: DataFrame, key: str, value: str, size: int = BLOCK) -> DataFrame:
    """rows (key, value) as (key, value), where value is an array of about as many values as size, or fewer: a key with more has several rows."""
    large = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > size)  # no more than one in so many
    many = F.broadcast(large.select(key, F.ceil(F.col("n") / size).alias("parts")))
    part = F.pmod(F.xxhash64(value), F.coalesce("parts", F.lit(1)))
    return rows.join(many, key, "left").groupBy(key, part.alias("part")).agg(F.collect_list(value).alias(value)).select(key, value)


def one_by_one(values: str | Column) -> Column:
    """A row for each value of an array, made when it is asked for.

    A plain explode is compiled to a loop that makes all rows of an array, and with a second one behind it all pairs, before the first is
    passed on: gigabytes a task where blocks meet. An array that comes from a function with a lambda isn't, whose rows are made one by one.
    """
    return F.explode(F.transform(values, lambda x: x))


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out evenly, whatever their bytes, as each is to become many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
