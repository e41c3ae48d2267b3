"""Document fingerprints by spot signatures (operator 2).

A spot is an occurrence of a common word; its signature is that word with the chain of the CHAIN content words
that follow it (words that aren't common). A document's fingerprint is its set of signatures, each a 32-bit
hash, in order; two fingerprints are as alike as their sets' Jaccard coefficient. A text without a
complete chain has one signature, of its whole sequence of words, so that equal short texts are alike
and others aren't; a text without words has none.

Near duplicates among fingerprints are found by set length: sets of n and m signatures can reach a
coefficient t only if min(n, m) >= t * max(n, m), so lengths are dealt into partitions whose bounds grow
by 1 / t and a set meets only its own partition and the next. Within them, candidates share a signature
of the prefix that any partner must touch (the rarest n - ceil(t n) + 1 signatures), and the coefficient
is counted only for these.

Nulls: a null text is an empty one; two empty fingerprints are alike (1.0), an empty and another are not
(0.0). Rows of equal id follow in order of their texts; a null id counts as the lowest. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CHAIN = 2
SIMILARITY = 0.75
#: Ranges of ids for each partition, so that hashing deals them out evenly.
RANGES = 4
#: Stands for a null id, below all others.
NO_ID = -(1 << 63)
#: Common words of the corpus's languages.
COMMON_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this at are an from or not "
    "der die das und in den von zu mit ist im für auf dem des ein eine nicht sich als "
    "le la les de des et un une du en que qui dans pour par sur au est pas ce "
    "el los las y un una que se del por con para al es su lo como".split()
)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TRIMMED = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def word_value(word: bytes) -> tuple[int, bool]:
    """A 64-bit hash of the word in lower case without marks at its ends, and whether it is a common word."""
    bare = word.lower().strip(TRIMMED) or word
    return int.from_bytes(hashlib.blake2b(bare, digest_size=8).digest(), "little"), bare.decode() in COMMON_WORDS


_cache = common.WordCache(lambda words: [word_value(w) for w in words], 80_000)


def signature_sets(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct signatures of each text."""
    words = common.words_of(texts)
    known = _cache.of(words.distinct)
    hashes = np.array([h for h, _ in known], dtype=np.uint64)[words.codes] if known else np.zeros(0, dtype=np.uint64)
    spots = np.array([c for _, c in known], dtype=bool)[words.codes] if known else np.zeros(0, dtype=bool)
    content = np.flatnonzero(~spots)
    chains = len(content) - chain + 1
    at = np.flatnonzero(spots)
    doc = np.searchsorted(words.starts, at, side="right") - 1
    first = np.searchsorted(content, at)
    whole = first < max(0, chains)
    at, doc, first = at[whole], doc[whole], first[whole]
    whole = content[first + chain - 1] < words.starts[doc + 1] if len(first) else np.zeros(0, dtype=bool)
    at, doc, first = at[whole], doc[whole], first[whole]
    mixed = hashes[at].copy()
    for k in range(chain):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MULTIPLIERS[k] + hashes[content[first + k]]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * MULTIPLIERS[3] >> np.uint64(32)
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | mixed)
    cuts = np.searchsorted(both, np.arange(len(words.starts), dtype=np.uint64) << np.uint64(32))
    values = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
    out = [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for k, own in enumerate(out):
        a, b = words.starts[k], words.starts[k + 1]
        if not len(own) and b > a:
            digest = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=4).digest()
            out[k] = np.frombuffer(digest, dtype="<u4")
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id and its signatures, a sorted array of distinct longs."""

    def make():
        return lambda ids, texts: {"doc_id": ids, "signatures": [x.astype(np.int64) for x in signature_sets(texts, chain)]}

    return common.map_arrow(docs, make, "doc_id long, signatures array<long>")


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """(doc_id, class_id, n) of fingerprints(): class_id is the smallest doc_id with equal signatures, n their number."""
    classes = prints.groupBy("signatures").agg(F.min("doc_id").alias("class_id"))
    return prints.join(classes, "signatures").select("doc_id", "class_id", F.size("signatures").cast("long").alias("n"))


def near_duplicates(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (doc_id, other_id, likeness) of classes of equal fingerprints that are at least so alike.

    Takes the rows of fingerprints(); each class is named by its smallest doc_id, so copies aren't
    expanded into pairs. Documents without signatures are in no pair.
    """
    classes = common.stored(prints.filter(F.size("signatures") > 0).groupBy("signatures").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("signatures").cast("long")), "spots")
    counts = classes.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    # The rarest signatures come first; a pair that is alike enough shares one of the prefix.
    ranked = classes.select("doc_id", "n", F.explode("signatures").alias("s")).join(counts, "s")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "s")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n")) + 1).filter("df > 1")
    band = F.floor(F.log("n") / math.log(1 / similarity)).cast("int")
    own = prefix.select("s", "doc_id", "n", band.alias("band"))
    reach = own.select(F.col("s"), F.col("doc_id").alias("other_id"), F.col("n").alias("m"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    pairs = own.join(reach, ["s", "band"]).filter((F.col("n") <= F.col("m")) & (F.col("n") >= similarity * F.col("m")) & ((F.col("n") < F.col("m")) | (F.col("doc_id") < F.col("other_id"))))
    pairs = pairs.select("doc_id", "other_id").distinct()
    sets = classes.select("doc_id", "signatures")
    joined = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("other_id"), F.col("signatures").alias("t")), "other_id")
    both = F.size(F.array_intersect("signatures", "t"))
    return joined.withColumn("likeness", both / (F.size("signatures") + F.size("t") - both)).filter(F.col("likeness") >= similarity).select("doc_id", "other_id", "likeness")


def ranges(docs: DataFrame, parts: int) -> np.ndarray:
    """At most parts - 1 ids that cut the documents into ranges of about equal numbers of rows."""
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.select(F.percentile_approx("doc_id", shares, 10 * parts).alias("cuts")).first().cuts if shares else None
    return np.unique(np.array(cuts or [], dtype=np.int64))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Documents dealt out by ranges of ids; the first of the next lower range (after the lowest, the highest document) stands in as a guest."""
    docs = common.id_and_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    cuts = ranges(docs, parts)
    part_of = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(cuts, ids.to_numpy()).astype("int32")), "int")
    # One row for each range: bounded by parts, so it may be collected and broadcast.
    tops = {r.part: r.top for r in docs.select("doc_id").withColumn("part", part_of("doc_id")).groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    there = sorted(tops)
    guests = [(tops[there[k - 1]], p) for k, p in enumerate(there)]
    dealt = docs.withColumn("part", part_of("doc_id")).withColumn("guest", F.lit(False))
    if not guests:
        return dealt
    named = F.broadcast(docs.sparkSession.createDataFrame(guests, "_id long, part int"))
    extra = docs.join(named, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "part").agg(F.min("text").alias("text"))
    return dealt.unionByName(extra.select("doc_id", "text", "part", F.lit(True).alias("guest")))


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, parts: int) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are to each other and to the next document's."""
    dealt = with_next(docs, RANGES * max(1, parts))
    ordered = dealt.repartition(max(1, parts), "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc(), "text").select("doc_id", "text", "part", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # a document whose next one hasn't come yet: id, part, text, signatures
        for batch in batches:
            for piece in common.slices(batch):
                texts = piece.column(1).to_pylist()
                sets = signature_sets(piece.column(1))
                ready, following = [], []
                for doc_id, part, guest, text, own in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), texts, sets, strict=True):
                    if waiting:
                        ready.append(waiting)
                        following.append((text or "", own))
                    waiting = None if guest else (doc_id, part, text or "", own)
                yield rows(ready, following)

    def rows(ready: list, following: list) -> pa.RecordBatch:
        edited = [edit(text, after) for (_, _, text, _), (after, _) in zip(ready, following, strict=True)]
        edited_sets = signature_sets(pa.array(edited, type=pa.string()))
        columns = [
            pa.array([None if d == NO_ID else d for d, *_ in ready], type=pa.int64()),
            pa.array([len(t) for _, _, t, _ in ready], type=pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], type=pa.string()),
            pa.array([s.tobytes().hex() for *_, s in ready], type=pa.string()),
            pa.array([s.tobytes().hex() for s in edited_sets], type=pa.string()),
            pa.array([jaccard(own, s) for (*_, own), s in zip(ready, edited_sets, strict=True)], type=pa.float64()),
            pa.array([jaccard(own, s) for (*_, own), (_, s) in zip(ready, following, strict=True)], type=pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return ordered.mapInArrow(run, SCHEMA)


def op2_fingerprints(spark, sf_dir) -> DataFrame:
    return fingerprint_edits(common.documents(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))
