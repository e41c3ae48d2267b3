"""Near-duplicate documents by SimHash (operator 12), found by a generalised pigeonhole.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's shingles, repeats included. Two
fingerprints are linked if they differ in DISTANCE bits or less.

1. One Python pass makes the fingerprints. Equal ones are one class.
2. Counted over all classes: how often each two bits are set together, then, for GROUPS groups of correlated bits, how
   often each value occurs. From the values follows exactly at what distances a group's pairs lie; for groups together
   their distances are taken for independent. The groups are dealt into parts.
3. A part i of the bits gets a threshold t[i] from -1, and the t[i] + 1 add up to DISTANCE + 1: two fingerprints
   that differ in t[i] + 1 bits or more of every part differ in more than DISTANCE, so a link is within the threshold of
   some part, and a part with -1 isn't used. For each way of dealing groups into parts a dynamic
   program over the parts finds the thresholds with the least cost, rows that are probed and candidates that are
   compared; the cheapest way is taken. All of them find all links; they differ in their cost only.
4. Each fingerprint is filed under its value of a part and probes the smaller values within the threshold, so that
   a pair of different values meets once. Those that meet are compared in all bits. Of a bucket's links only such
   leave the task as join components; no pair is written that isn't one.
5. A bucket of more than BLOCK rows is dealt into blocks, which are compared in pairs, each in a task. If it has more
   than HOT rows, comparing would cost more than looking up: every fingerprint of such buckets is filed under all
   values within 1 and within 2 bits. Two that differ in 3 bits or less share a value that is within 1 bit of one of
   them, so each is linked with the smallest that is within 1 bit. The rows are 2081 a fingerprint.
6. Components of the links, named by their smallest doc_id.

Nulls: a null text has no words; the fingerprint of a text without words is zero, and linked like any other. Rows that
share a doc_id have a fingerprint and a component each. A null doc_id names no component: where there is no other, the
component is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .minhash import joined_up

SHINGLE, SEED, DISTANCE = 3, 42, 3
BITS, GROUPS = 64, 8
#: What a row that is probed costs, in comparisons.
ROW_COST = 500
BLOCK, HOT = 8192, 1 << 18
#: Shingles that are hashed at once.
LOT = 1 << 16
#: Comparisons at once.
SQUARE = 1 << 20
U = np.uint64


def shingle_spans(words: common.Words, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words joined by spaces; where each shingle starts and ends in it, and its text. Fewer words than size are one shingle."""
    flat = b" ".join(map(words.distinct.__getitem__, words.codes.tolist()))
    lengths = np.fromiter(map(len, words.distinct), dtype=np.int64, count=len(words.distinct))[words.codes]
    ends = np.cumsum(lengths + 1) - 1
    n = np.diff(words.starts)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = words.starts[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(at + size, words.starts[1:][text]) - 1
    return flat, (ends - lengths)[at], ends[last], text


def simhashes(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    flat, starts, ends, text = shingle_spans(common.words_of(pc.ascii_lower(pc.fill_null(texts, ""))), size)
    ones, total = np.zeros((len(texts), BITS), dtype=np.int64), np.bincount(text, minlength=len(texts))
    named = xxhash.xxh64_intdigest
    for first in range(0, len(text), LOT):
        spans = zip(starts[first : first + LOT].tolist(), ends[first : first + LOT].tolist(), strict=True)
        own = text[first : first + LOT]
        h = np.fromiter((named(flat[a:b], SEED) for a, b in spans), dtype=U, count=len(own))
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[cuts]] += np.add.reduceat(bits_of(h), cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def bits_of(prints: np.ndarray) -> np.ndarray:
    """(n, BITS) zeros and ones, the lowest bit first."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and print, the 64 bits as a signed long."""

    def make():
        return lambda ids, texts: {"doc_id": ids, "print": simhashes(texts, size).view(np.int64)}

    return common.map_arrow(docs, make, "doc_id long, print long")


def counted(prints: DataFrame, count, schema: str) -> list:
    """The rows that count(prints, as unsigned integers) gives, the last of them added up; as many at most as there are of the others."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                *keys, n = count(batch.column(0).to_numpy(zero_copy_only=False).view(U))
                total = n if total is None else total + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (*keys, total)], names=names)

    made = prints.select("print").mapInArrow(run, schema)
    return made.groupBy(*names[:-1]).agg(F.sum(names[-1]).alias(names[-1])).collect()


def groups_of_bits(prints: DataFrame, n: int) -> list[list[int]]:
    """GROUPS groups of bits, each bit with those that it is most correlated with; groups that follow each other are correlated too."""
    i, j = (x.ravel() for x in np.indices((BITS, BITS)))

    def together(values: np.ndarray):
        bits = bits_of(values).astype(np.float64)
        return i, j, (bits.T @ bits).astype(np.int64).ravel()

    both = np.zeros((BITS, BITS))
    for r in counted(prints, together, "i long, j long, n long"):
        both[r.i, r.j] = r.n
    p = both.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    left, order = set(range(BITS)), []
    for k in range(BITS):
        near = order[k - k % (BITS // GROUPS) :] or order  # a new group begins with what is nearest to those before
        order.append(max(sorted(left), key=lambda b: (strength[b, near].sum() if near else strength[b].sum(), -b)))
        left.remove(order[-1])
    return [order[k : k + BITS // GROUPS] for k in range(0, BITS, BITS // GROUPS)]


def distances(prints: DataFrame, groups: list[list[int]], n: int) -> list[np.ndarray]:
    """For each group the share of ordered pairs of classes that differ in 0, 1, ... of its bits."""
    values = 1 << (BITS // GROUPS)
    g, v = (x.ravel() for x in np.indices((GROUPS, values)))

    def occurring(found: np.ndarray):
        return g, v, np.concatenate([np.bincount(gathered(found, bits).astype(np.int64), minlength=values) for bits in groups])

    hist = np.zeros((GROUPS, values))
    for r in counted(prints, occurring, "g long, v long, n long"):
        hist[r.g, r.v] = r.n
    apart = np.bitwise_count(np.arange(values)[:, None] ^ np.arange(values)[None, :]).ravel()
    return [np.bincount(apart, weights=np.outer(h, h).ravel(), minlength=BITS // GROUPS + 1) / (n * n) for h in hist]


def gathered(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values that these bits make, the first one lowest."""
    out = np.zeros(len(prints), dtype=U)
    for k, b in enumerate(bits):
        out |= ((prints >> U(b)) & U(1)) << U(k)
    return out


def cheapest(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """costs[i][u] is the cost of threshold u - 1 in part i; the least sum with all u adding up to units, and the thresholds."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u in range(min(len(part) - 1, units - used) + 1):
                total = cost + part[u]
                if used + u not in now or total < now[used + u][0]:
                    now[used + u] = (total, [*chosen, u - 1])
        best = now
    return best[units]


def allotted(groups: list[list[int]], apart: list[np.ndarray], n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The parts that are used, as (bits, threshold), dealt and with thresholds so that the estimated cost is least."""
    found = None
    for parts in range(1, distance + 2):
        cuts = [round(k * GROUPS / parts) for k in range(parts + 1)]
        made, costs = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            spread = np.ones(1)
            for x in apart[a:b]:
                spread = np.convolve(spread, x)
            near, width = np.cumsum(spread), sum(map(len, groups[a:b]))
            rows = np.cumsum([comb(width, t) for t in range(distance + 1)])  # half of the probes, being those to smaller values
            made.append([x for group in groups[a:b] for x in group])
            costs.append([0.0, *(ROW_COST * n * (1 + (rows[t] - 1) / 2) + n * n / 2 * near[t] for t in range(distance + 1))])
        cost, thresholds = cheapest(costs, distance + 1)
        if found is None or cost < found[0]:
            found = cost, [(bits, t) for bits, t in zip(made, thresholds, strict=True) if t >= 0]
    return found[1]


def filed(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, print, probe): each fingerprint under its value of each part, and as a probe under the smaller ones within the threshold."""
    masks = [np.array([0, *(sum(1 << x for x in flips) for t in range(1, most + 1) for flips in combinations(range(len(bits)), t))], dtype=U) for bits, most in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for k, (bits, _) in enumerate(parts):
                step = max(1, SQUARE // len(masks[k]))
                for first in range(0, len(prints), step):
                    own = prints[first : first + step]
                    values = gathered(own, bits)[:, None] ^ masks[k][None, :]
                    row, probe = np.nonzero(values <= values[:, :1])
                    columns = [pa.array(np.full(len(row), k, dtype=np.int32)), pa.array(values[row, probe].view(np.int64)), pa.array(own[row].view(np.int64)), pa.array(probe > 0)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "value", "print", "probe"])

    return prints.select("print").mapInArrow(run, "part int, value long, print long, probe boolean")


def joining(prints: np.ndarray, probe: np.ndarray, block: np.ndarray, apart: bool, distance: int) -> list[tuple[int, int]]:
    """Of a bucket, or two blocks of one, links that join its components; pairs of probes aren't compared, and if apart, none of one block."""
    comp, found = np.arange(len(prints)), []
    own = np.flatnonzero(~probe)
    step = max(1, SQUARE // max(1, len(prints)))
    for first in range(0, len(own), step):
        rows = own[first : first + step]
        near = np.bitwise_count(prints[rows][:, None] ^ prints[None, :]) <= distance
        near &= comp[rows][:, None] != comp[None, :]
        if apart:
            near &= block[rows][:, None] != block[None, :]
        pairs = np.argwhere(near)
        if not len(pairs):
            continue
        pairs[:, 0] = rows[pairs[:, 0]]
        _, one = np.unique(comp[pairs].min(axis=1) * len(prints) + comp[pairs].max(axis=1), return_index=True)
        new = joined_up(np.arange(len(prints)), comp, pairs[one])
        for a, b in new:
            low, high = sorted((comp[a], comp[b]))
            comp[comp == high] = low
        found += new
    return found


def links_of_buckets(distance: int):
    """For rows (i, j, members) of a bucket's block, or of two, the links (a, b) that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = members.values
                prints, probe, block = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("print", "probe", "block"))
                pairs = joining(prints.view(U), probe, block, i != j, distance)
                if pairs:
                    found.append(prints[np.array(pairs)])
            both = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def links_by_balls(hot: DataFrame) -> DataFrame:
    """(a, b) that join all fingerprints of hot (print) that differ in 3 bits or less, in rows linear in their number."""
    masks = np.array([0, *(sum(1 << x for x in flips) for t in (1, 2) for flips in combinations(range(BITS), t))], dtype=U)
    close = np.bitwise_count(masks) < 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for first in range(0, len(prints), SQUARE // len(masks)):
                own = prints[first : first + SQUARE // len(masks)]
                values = own.view(U)[:, None] ^ masks[None, :]
                columns = [pa.array(values.ravel().view(np.int64)), pa.array(np.repeat(own, len(masks))), pa.array(np.tile(close, len(own)))]
                yield pa.RecordBatch.from_arrays(columns, names=["value", "print", "close"])

    balls = hot.select("print").mapInArrow(run, "value long, print long, close boolean")
    centres = balls.groupBy("value").agg(F.min(F.when(F.col("close"), F.col("print"))).alias("b"), F.count("*").alias("n")).filter("n > 1 and b is not null").select("value", "b")
    met = balls.select("value", F.col("print").alias("a")).join(common.stored(centres, "centres"), "value")
    return met.filter("a <> b").select("a", "b").distinct()


def links(prints: DataFrame, parts: list[tuple[list[int], int]], distance: int = DISTANCE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Links (a, b) of distinct fingerprints (print), of which the components are those of all links."""
    rows = common.stored(filed(prints, parts), "filed")
    size = F.count("*").alias("size")
    buckets = rows.groupBy("part", "value").agg(size, F.bool_and("probe").alias("probes")).filter("size > 1 and not probes").select("part", "value", "size")
    met = common.stored(rows.join(common.stored(buckets, "buckets"), ["part", "value"]), "met")
    # Only distance 3 is covered by balls of 1 and 2 bits; any other is compared in blocks, however large the bucket.
    by_ball = met.filter(F.col("size") > hot) if distance == 3 else met.filter("false")
    compared = met.filter(F.col("size") <= hot) if distance == 3 else met
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = compared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = dealt.groupBy("part", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("print", "probe", "block")).alias("members"))
    found = grouped.select("i", "j", "members").mapInArrow(links_of_buckets(distance), "a long, b long")
    if by_ball.take(1):
        found = found.unionByName(links_by_balls(common.stored(by_ball.select("print").distinct(), "hot")))
    return common.stored(found.distinct(), "links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    with common.temporaries(docs.sparkSession):
        made = common.stored(fingerprints(docs, size), "prints", keep=True)
        classes = common.stored(made.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
        n = common.rows_of(classes)
        if n > 1:
            groups = groups_of_bits(classes, n)
            found = links(classes, allotted(groups, distances(classes, groups, n), n, distance), distance, block, hot)
            near = common.stored(components(found).withColumnRenamed("node", "print"), "near")
            labelled = common.stored(classes.join(near, "print", "left").withColumn("component", F.coalesce("component", "print")), "labelled")
            least = common.stored(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "least")
            named = common.stored(labelled.join(least, "component").select("print", "component_id"), "named", keep=True)
        else:
            named = common.stored(classes.withColumnRenamed("least", "component_id"), "named", keep=True)
    return made.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
