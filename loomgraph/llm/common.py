"""What the corpus operators share: reading tables, scratch tables, passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import rows_of, stored, temporaries

#: Bytes of text that one step of a Python pass works on, or one document if it is longer.
SLICE_BYTES = 6 << 20
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20
#: Distinct words whose results a Python worker keeps in each of two generations.
CACHE_WORDS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text), one row of each doc_id that isn't null: of rows that share one, the least text.

    Also the ids whose rows differ in their texts, with the text that counts; None if there are none.
    """
    rows = id_and_text(docs).filter("doc_id is not null")
    again = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if not rows_of(again):
        return rows, None
    several = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("text").alias("most"))
    several = stored(several, "several", keep=True)
    differ = several.filter("text < most").select("doc_id", "text")
    return rows.join(again, "doc_id", "left_anti").unionByName(several.select("doc_id", "text")), differ if differ.take(1) else None


def where_counted(joined: DataFrame, differ: DataFrame | None, found: list[str]) -> DataFrame:
    """The columns found of joined (row, *found) made null where row.text is null, or isn't the text that counts for its doc_id."""
    counts = F.col("row.text").isNotNull()
    if differ is not None:
        joined = joined.join(differ.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), F.col("row.doc_id") == F.col("_id"), "left")
        counts = counts & (F.col("_id").isNull() | (F.col("row.text") == F.col("_text")))
    return joined.select("row", *(F.when(counts, F.col(c)).alias(c) for c in found))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_BYTES, so that long texts don't make large ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Just doc_id (long) and text (string), for passes in small batches; whatever else the rows hold is left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch of rows with a text in runs of at most about `most` bytes of text, and at least one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_arrow(docs: DataFrame, make: Callable[[], Callable[[pa.Array, pa.Array], dict]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """One Python pass over (doc_id, text) in Arrow batches, a bounded slice of rows at a time.

    make() runs once for each task and returns a function of (ids, texts), Arrow arrays, that gives columns by name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, most):
                cols = step(part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([as_arrow(cols[f.name], f.type) for f in out], schema=out)
            pa.default_memory_pool().release_unused()

    return id_and_text(docs).mapInArrow(run, schema)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """map_arrow() for functions of Python lists."""

    def lists():
        step = make()
        return lambda ids, texts: step(ids.to_pylist(), texts.to_pylist())

    return map_arrow(docs, lists, schema)


class Words(NamedTuple):
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: which distinct word each is, and where each text's begin."""

    distinct: list[bytes]
    codes: np.ndarray
    starts: np.ndarray

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """For each text the sum of a value, or a row of values, that each distinct word has."""
        total = np.zeros((len(self.codes) + 1, *per_word.shape[1:]), dtype=np.float64 if per_word.dtype.kind == "f" else np.int64)
        np.cumsum(per_word[self.codes], axis=0, out=total[1:])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def words_of(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().cast(pa.large_binary())
    there = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(there).as_py():  # white space at an end gives empty words
        kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
        starts, flat = kept[starts - starts[0]], flat.filter(there)
    coded = flat.dictionary_encode()
    return Words(coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts - starts[0])


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def gather(results: list[bytes], words: Words) -> list[np.ndarray]:
    """For each text, the 32-bit integers of its words in turn; results holds those of each distinct word."""
    flat = np.frombuffer(b"".join(results), dtype="<u4")
    sizes = np.fromiter(map(len, results), dtype=np.int64, count=len(results)) >> 2
    firsts = (np.cumsum(sizes) - sizes)[words.codes]
    sizes = sizes[words.codes]
    ends = np.cumsum(sizes)
    at = np.repeat(firsts - (ends - sizes), sizes)
    at += np.arange(len(at))
    cuts = np.concatenate([[0], ends])[words.starts]
    out = flat[at]
    return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class WordCache:
    """word -> result, filled for many words at once by fill(words), and bounded.

    Two generations: words that are asked for again move to the young one; when that is full it becomes
    the old one, and what hasn't been asked for since is forgotten.
    """

    def __init__(self, fill: Callable[[list], list], limit: int = CACHE_WORDS, longest: int = 64):
        self.fill, self.limit, self.longest = fill, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: list) -> list:
        """The result of each of the words, which are distinct."""
        known = self.load(set(words))
        return list(map(known.__getitem__, words))

    def load(self, words: set) -> dict:
        """A mapping that holds each of the words; words that are too long stay out of the cache."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = words - young.keys()
        if old and missing:
            again = missing & old.keys()
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            missing -= again
        if not missing:
            return young
        new = list(missing)
        results = self.fill(new)
        if max(map(len, new)) <= self.longest:
            young.update(zip(new, results, strict=True))
            return young
        found = dict(zip(new, results, strict=True))
        young.update((w, x) for w, x in found.items() if len(w) <= self.longest)
        return found | {w: young[w] for w in words if w not in found}


def bounded_sample(df: DataFrame, stratum: str, id_col: str, n: int, values: int = 200) -> DataFrame:
    """At most n rows of each non-null value of stratum, chosen by a hash of the id; of more values than `values` the most frequent.

    Two passes: counts, then the rows whose hash is below a share that leaves about 1.5 n of each
    value; the final choice sorts no more than those.
    """
    from pyspark.sql import Window

    df = df.filter(F.col(stratum).isNotNull())
    counts = df.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(values).collect()
    if not counts:
        return df
    unit = (F.xxhash64(id_col).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("unit")
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1.0, (1.5 * n + 50) / r[1]))))
    near = df.filter(unit < F.coalesce(F.element_at(shares, F.col(stratum)), F.lit(0.0)))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(id_col), id_col)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo modulus."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
