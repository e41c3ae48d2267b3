"""Near-duplicate documents by MinHash (operator 1).

A document's set: the distinct 5-word shingles of its whole text with A-Z in lower case; with fewer
words, the whole sequence as one; without words, empty. Documents are linked if their sets' Jaccard
coefficient is SIMILARITY or more.

1. One Python pass hashes each set and makes its sketch by fast similarity sketching: in round r each
   element throws a value (r, hash) into a bin, in the first T rounds a hashed one, then bin r - T, so
   after 2 T rounds every bin is filled; bins keep the smallest. Equal sets become one class.
2. The sketch is cut into BANDS bands of ROWS bins. Classes that agree in a band share a bucket. At the
   threshold a pair misses all bands with probability below 4e-6.
3. Each class is checked on the full sets with one candidate, the smallest of the smallest members of its
   buckets: a pair a class, and the links join up most of a group of copies.
4. Where a bucket still holds several components, its members are compared with each other on the full sets, in
   place, by a product of 0/1 matrices: pairs of different components whose sketches agree in FLOOR of the bins or
   more (a true link is below it with probability under 1e-9). Only links that join components leave the task. No
   pair within a component is made, no pair is written that isn't such a link, and no bucket is capped. This is
   done for FIRST_BANDS bands first.
5. A bucket of more than BLOCK members, or BLOCK_SHINGLES shingles, holds mostly documents that share a passage
   without being alike. First of all, each of its members must share with one of another component a shingle that
   sets alike enough do share: one of the n - ceil(0.75 n) + 1 rarest of its n, in one order for all, counted over all
   such members. Who differs from all others in a quarter of its shingles shares none and leaves, so the rows are as
   many as the members' shingles. Those who stay are compared in their buckets, block by block if there are many.

Nulls: a null text has an empty set; a null doc_id can't be linked to but is found a copy of others. Documents
with an empty set are linked with nothing. Rows with equal doc_id are one document, with the least of their texts,
and one row; rows without doc_id have a row each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 64, 6
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
FIRST_BANDS = 8
FLOOR = 0.6
#: Hash values that are worked on at once while sketching.
LOT = 4096
#: Pairs up to which their ids are broadcast: 24 MB.
BROADCAST_PAIRS = 1_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; x is changed in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_hashes(words: list[bytes]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words]


_words = common.WordCache(word_hashes, 60_000)  # a hash is cheap to make again


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = common.words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    h = np.array(_words.of(words.distinct), dtype=U)[words.codes] if words.distinct else np.zeros(0, dtype=U)
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, dtype=U)
    for k in range(size):
        rolled = mix(rolled + h[k : k + n] + U(0x9E3779B97F4A7C15))
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")], dtype=U))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def sketch(values: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a set of hashes, which isn't empty."""
    bins = np.full(t, np.iinfo(U).max, dtype=U)
    lot = max(1, LOT // len(values))
    for first in range(0, 2 * t, lot):
        rounds = np.arange(first, min(first + lot, 2 * t), dtype=U)
        h = mix(values[None, :] + mix((rounds + U(1)) * U(0xD6E8FEB86659FD93))[:, None])
        at = np.where(rounds[:, None] < t, h % U(t), rounds[:, None] - U(t)).astype(np.int64)
        value = (rounds[:, None] << U(48)) | (mix(h) >> U(16))
        np.minimum.at(bins, at.ravel(), value.ravel())
        if bins.max() < np.iinfo(U).max:
            break
    return bins


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each sketch; bands of different index never share one but by chance."""
    parts = sketches.reshape(len(sketches), bands, rows)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)), (len(sketches), 1))
    for k in range(rows):
        out = mix(out + parts[:, :, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, and for sets that aren't empty: key (names the set), bands and the last byte of each coordinate."""

    def make():
        def step(ids, texts):
            sets = shingle_sets(texts, shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            made = np.stack([sketch(sets[k], bands * rows) for k in full]) if full else np.zeros((0, bands * rows), dtype=U)
            keys: list = [None] * len(sets)
            band: list = [None] * len(sets)
            low: list = [None] * len(sets)
            for k, b, s in zip(full, band_keys(made, bands, rows), made.astype(np.uint8), strict=True):
                keys[k], band[k], low[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), b, s.tobytes()
            return {"doc_id": ids, "n_shingles": [len(s) for s in sets], "key": keys, "bands": band, "sketch": low}

        return step

    return common.map_arrow(docs, make, "doc_id long, n_shingles long, key binary, bands array<long>, sketch binary")


def sets_of(wanted: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The full sets of documents, which have one row each: wanted (_id, b) becomes (a, b, set).

    Sets are computed where the texts are read. The ids are broadcast if they are few, which is counted;
    else both sides are shuffled.
    """
    wanted = F.broadcast(wanted) if common.rows_of(wanted) <= BROADCAST_PAIRS else wanted
    texts = common.id_and_text(docs).join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, type=pa.list_(pa.int64()))], names=["a", "b", "set"])

    return common.stored(texts.mapInArrow(run, "a long, b long, set array<long>"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. A set moves once, to the b that it is compared with."""
    pairs = common.stored(pairs, "pairs")
    wanted = common.stored(pairs.select(F.col("a").alias("_id"), "b").unionByName(pairs.select(F.col("b").alias("_id"), "b").distinct()), "wanted")
    sets = sets_of(wanted, docs, shingle)
    both = sets.filter("a <> b").join(sets.filter("a = b").select("b", F.col("set").alias("other")), "b")
    common_size = F.size(F.array_intersect("set", "other"))
    enough = 100 * common_size >= percent * (F.size("set") + F.size("other") - common_size)
    return common.stored(both.filter(enough).select("a", "b"), "links")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets, by products of 0/1 matrices."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    several = counts[column] > 1
    _, column = np.unique(column[several], return_inverse=True)
    owner = owner[several]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 8192
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def joined_up(rep: np.ndarray, comp: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of linked pairs of indices as few as join the same components."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = top(int(comp[i])), top(int(comp[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(rep[i]), int(rep[j])))
    return out


def links_in_blocks(percent: int):
    """For rows (i, j, members) of a block, or of two, links that join its components; checked on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = members.values
                rep, comp, block = (rows.field(k).to_numpy() for k in ("rep", "comp", "block"))
                sets = rows.field("set")
                cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(sets).to_numpy())])
                flat = sets.flatten().to_numpy()
                n = np.diff(cuts)
                small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
                tried = (comp[:, None] < comp[None, :]) & (100 * small >= percent * large)
                if i != j:
                    tried &= block[:, None] != block[None, :]
                sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
                for k in np.flatnonzero(tried.any(axis=1)):
                    at = np.flatnonzero(tried[k])
                    tried[k, at] = (sketch[at] == sketch[k]).mean(axis=1) >= FLOOR
                used = np.flatnonzero(tried.any(axis=0) | tried.any(axis=1))
                if not len(used):
                    continue
                shared = shared_counts([flat[cuts[k] : cuts[k + 1]] for k in used])
                own = np.ix_(used, used)
                linked = tried[own] & (100 * shared >= percent * (n[used][:, None] + n[used][None, :] - shared))
                found += joined_up(rep[used], comp[used], np.argwhere(linked))
            a, b = (np.array([p[k] for p in found], dtype=np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return run


def labelled(buckets: DataFrame, near: DataFrame) -> DataFrame:
    """Bucket rows with the component of the member."""
    joined = buckets.join(near.withColumnRenamed("node", "rep"), "rep", "left")
    return common.stored(joined.select("band", "rep", "n", F.coalesce("component", "rep").alias("comp")), "members")


def in_mixed_buckets(members: DataFrame, block: int) -> DataFrame:
    """The members (band, rep, n, comp, blocks) of buckets that hold several components."""
    found = members.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("low <> high")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = common.stored(found.select("band", blocks.alias("blocks")), "mixed")
    return common.stored(members.join(mixed, "band"), "rest")


def with_rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The reps of members (rep, comp) that share with another component a shingle of which sets that are alike enough share one."""
    own = members.select("rep", "comp").distinct()
    each = sets.select(F.col("a").alias("rep"), "set").join(own, "rep").select("rep", "comp", F.size("set").cast("long").alias("n"), F.explode("set").alias("x"))
    each = common.stored(each, "shingles")
    shared = common.stored(each.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    of_set = Window.partitionBy("rep")
    ranked = each.join(shared, "x").withColumn("k", F.row_number().over(of_set.orderBy("df", "x"))).withColumn("m", F.count("*").over(of_set))
    # The n - m shingles that no other has are the rarest, and come before these.
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = common.stored(ranked.filter(F.col("n") - F.col("m") + F.col("k") <= first).select("x", "rep", "comp"), "rare")
    mixed = rare.groupBy("x").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("x")
    return common.stored(rare.join(mixed, "x", "left_semi").select("rep").distinct(), "near_others")


def links(reps: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Components (node, component) of the classes reps (rep, n, bands, sketch)."""
    banded = reps.select("rep", "n", F.posexplode("bands").alias("b", "band"))
    leaders = common.stored(banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1").select("band", "leader"), "leaders")
    buckets = common.stored(banded.join(leaders, "band"), "buckets")
    # Each member with the smallest of its leaders first: one pair a class joins up most of a group.
    stars = buckets.filter("rep <> leader").groupBy(F.col("rep").alias("a")).agg(F.min("leader").alias("b"))
    found = verified(stars, docs, shingle, percent)
    near = common.stored(components(found), "components")
    # Then all members of a bucket, where it still holds several components; the first bands leave little for the others.
    sets = None
    for part in (buckets.filter(F.col("b") < FIRST_BANDS), buckets.filter(F.col("b") >= FIRST_BANDS)):
        rest = in_mixed_buckets(labelled(part, near), block)
        if not common.rows_of(rest):
            continue
        have = rest.select(F.col("rep").alias("_id"), F.lit(0).cast("long").alias("b")).distinct()
        have = have if sets is None else have.join(sets.select(F.col("a").alias("_id")), "_id", "left_anti")
        new = sets_of(common.stored(have, "wanted"), docs, shingle)
        sets = new if sets is None else sets.unionByName(new)
        large = rest.filter("blocks > 1")
        if large.take(1):
            staying = large.drop("blocks").join(with_rare_shingles(large, sets, percent), "rep", "left_semi")
            rest = rest.filter("blocks = 1").unionByName(in_mixed_buckets(common.stored(staying, "staying"), block))
        full = reps.select("rep", "sketch").join(sets.select(F.col("a").alias("rep"), "set"), "rep")
        rows = rest.drop("n").join(full, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        grouped = rows.groupBy("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("rep", "comp", "block", "sketch", "set")).alias("members"))
        more = grouped.select("i", "j", "members").mapInArrow(links_in_blocks(percent), "a long, b long").distinct()
        found = common.stored(found.unionByName(more), "links")
        near = common.stored(components(found), "components")
    return near


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) and kept of each document."""
    with common.temporaries(docs.sparkSession):
        single, _ = common.one_text_each(docs)
        made = common.stored(sketches(single.unionByName(common.id_and_text(docs).filter("doc_id is null")), shingle, bands, rows), "sketches", keep=True)
        classes = common.stored(made.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
        own = classes.withColumnRenamed("rep", "doc_id")
        reps = made.join(own, ["key", "doc_id"], "left_semi")
        reps = common.stored(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch"), "reps")
        near = common.stored(links(reps, single, shingle, percent, block).withColumnRenamed("node", "rep"), "near")
        named = common.stored(classes.join(near, "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id")), "named", keep=True)
    joined = made.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op1_minhash_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM sets LEFT JOIN least USING (doc_id)
"""
