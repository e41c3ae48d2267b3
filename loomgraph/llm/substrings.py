"""Repeated passages of bytes (operator 8).

Each byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or same document and
earlier start) is removed; overlaps count, and strings are judged on the input.

A suffix array of all bytes would be many times the input, so it is sparse and cut into groups that can
be sorted apart. Of the 69 seeds (SEED-byte strings) in each LENGTH-byte string the one of the smallest
hash, the leftmost of equals, is its anchor; it depends on the string's bytes alone, so equal strings
have equal anchors at equal offsets. A string therefore belongs to one anchor, and only occurrences of
the same anchor need comparing, by their context: 68 bytes to the left and 100 from the anchor on.

1. Anchors that occur once are dropped.
2. Occurrences with equal contexts: all but the first lose all their strings. The inside of a copied
   passage is settled here, whatever the number of copies, by hashes alone.
3. What is left are first occurrences of anchors with several contexts, mostly at the edges of copied
   passages. Their contexts are sorted from the anchor on (an enhanced suffix array: order and longest
   common prefixes); a stack scan gives the tree of common-prefix intervals. In each interval the
   contexts to the left, read backwards, are treated alike: their intervals tell which left extensions
   are shared, and where they divide the extension is diverse. A right and a left interval that together
   span LENGTH bytes or more are a maximal repeat (within the context); all its members are occurrences,
   and all but the first lose the strings that the pair of intervals accounts for.
4. The contexts of an anchor that has more than GROUP of them may be as many as there are documents, so they
   are dealt out by ranges of string starts before the scan. Strings that start lo to hi bytes before the anchor
   need hi bytes to its left and LENGTH - lo from it on, and all share what lo bytes to the left and LENGTH - hi
   from it on are. A range is halved; contexts cut to a half that are equal there are one (the later ones lose
   its strings), and the others meet only those with the same shared bytes. Groups of up to GROUP contexts go to
   the scan; larger ones are halved again, until a range is one start, whose equal contexts are equal strings. A
   context is in about two ranges of each size, 14 in all, whatever its anchor's number of contexts.

Anchors and contexts are named by hashes of 64 bits each, and contexts are taken for equal if both agree; the scan
and the ranges compare bytes. Every step is an aggregation with a partial sum before the shuffle or a join that
Spark splits where a key is frequent.

Nulls: a null text is empty. Rows of equal doc_id count as one document with the least of their texts: rows with
that text have the same result, and a row with another keeps all its bytes, as does one without doc_id. Texts
shorter than LENGTH lose nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

LENGTH = 100
SEED = 32
GROUP = 64
#: Seeds in a string.
SEEDS = LENGTH - SEED + 1
LOST = ["doc_id", "first", "last", "of_doc", "of_first"]
#: Positions that are searched for anchors at once; their number fits the lowest COLUMN_BITS bits.
ROW, COLUMN_BITS = 4096, 13
#: Bytes whose seeds are hashed at once; arrays are eight times as large.
SLICE_BYTES = 1 << 18
U = np.uint64
BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=U) | U(1)
STEPS = np.random.default_rng(21).integers(0, 1 << 64, 16, dtype=U) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in turn, and where each begins."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the SEED bytes from each position on, by doubling."""
    h, size, k = BYTE_VALUES[data], 1, 0
    while size < SEED:
        h = h[:-size] * STEPS[k] + h[size:]
        h ^= h >> U(29)
        size, k = 2 * size, k + 1
    return mix(h)


def anchors(seeds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions of all strings inside texts: document, position, first and last start of its strings."""
    ends = starts[1:] - LENGTH  # the last start of a string in each text
    docs = np.flatnonzero(ends >= starts[:-1])
    if not len(docs):
        return (np.zeros(0, dtype=np.int64),) * 4
    n = int(ends[docs[-1]]) + 1
    rows = -(-n // ROW)
    wide = ROW + SEEDS - 1
    at = np.empty(rows * ROW, dtype=np.int64)
    columns = np.arange(wide, dtype=U)
    full = np.full(rows * ROW + SEEDS, np.iinfo(U).max, dtype=U)
    kept = min(len(seeds), len(full))  # texts that are too short may follow the last long one
    full[:kept] = seeds[:kept]
    for first in range(0, rows, 32):
        count = min(32, rows - first)
        part = np.lib.stride_tricks.as_strided(full[first * ROW :], (count, wide), (8 * ROW, 8))
        m = (part >> U(COLUMN_BITS) << U(COLUMN_BITS)) | columns
        size = 1
        while 2 * size <= SEEDS:
            m = np.minimum(m[:, :-size], m[:, size:])
            size *= 2
        if size < SEEDS:
            m = np.minimum(m[:, : ROW], m[:, SEEDS - size : SEEDS - size + ROW])
        own = (m[:, :ROW] & U((1 << COLUMN_BITS) - 1)).astype(np.int64)
        own += np.arange(first, first + count)[:, None] * ROW
        at[first * ROW : (first + count) * ROW] = own.ravel()
    at = at[:n]
    change = np.zeros(n, dtype=bool)
    change[1:] = at[1:] != at[:-1]
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, starts[docs], 1)
    np.add.at(inside, ends[docs] + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change[starts[docs]] = True
    begin = np.flatnonzero(change & inside)
    # A run ends before the next one, or with its text.
    doc = docs[np.searchsorted(starts[docs], begin, side="right") - 1]
    last = np.minimum(np.append(begin[1:], n) - 1, ends[doc])
    return doc, at[begin], begin, last


def context_hashes(seeds: np.ndarray, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
    """A hash of the bytes from left to right (exclusive; at least SEED) and of where the anchor is in them."""
    h = mix((position - left).astype(U) * STEPS[8] + (right - position).astype(U) * STEPS[9])
    for k in range(-(-(2 * LENGTH - SEED) // SEED)):
        h = mix(h * STEPS[10] + seeds[np.minimum(left + SEED * k, right - SEED)])
    return h


def packed(position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's position in its text and how far before it its strings start, in one number that sorts by position."""
    return (position << 14) | ((position - first) << 7) | (position - last)


def unpacked(at):
    """Position, farthest and nearest distance of a start before it."""
    return at >> 14, (at >> 7) & 127, at & 127


def occurrences(docs: DataFrame) -> DataFrame:
    """Each anchor of each document: its hash a, the hash c of its context, doc_id and at (see packed())."""

    def make():
        def step(ids, texts):
            data, starts = buffers(texts)
            if len(data) < LENGTH:
                none = np.zeros(0, dtype=np.int64)
                return {"a": none, "c": none, "doc_id": none, "at": none}
            seeds = seed_hashes(data)
            doc, position, first, last = anchors(seeds, starts)
            left = np.maximum(position - (LENGTH - SEED), starts[doc])
            right = np.minimum(position + LENGTH, starts[doc + 1])
            c = context_hashes(seeds, left, right, position)
            base = starts[doc]
            at = packed(position - base, first - base, last - base)
            return {"a": seeds[position].view(np.int64), "c": c.view(np.int64), "doc_id": ids.take(pa.array(doc)), "at": at}

        return step

    return common.map_arrow(common.id_and_text(docs).filter("doc_id is not null"), make, "a long, c long, doc_id long, at long", SLICE_BYTES)


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """The common-prefix intervals of a sorted list: depth, depth of the parent, first and last index.

    lcp[i] belongs to entries i - 1 and i (lcp[0] is not read); depths are at least `least`, and so is the root's.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = [(least - 1, 0)]
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i], i - 1) if i < len(lcp) else (least - 1, i - 1)
        while stack[-1][0] > now:
            depth, first = stack.pop()
            out.append((depth, max(now, stack[-1][0]), first, i - 1))
        if stack[-1][0] < now:
            stack.append((now, first))
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def repeats(group: list[tuple[bytes, bytes, tuple, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats among the occurrences (left bytes reversed, right bytes, order, at) of one anchor.

    Yields the nearest and farthest distance of starts before the anchor that a repeat accounts for, and
    the indices of all its occurrences, the earliest first.
    """
    rights = sorted(range(len(group)), key=lambda k: group[k][1])
    lcp = [0] + [common_prefix(group[x][1], group[y][1]) for x, y in zip(rights, rights[1:], strict=False)]
    for depth, parent, first, last in intervals(lcp, SEED):
        low, high = max(0, LENGTH - depth), min(LENGTH - SEED, LENGTH - parent - 1)
        lefts = sorted(rights[first : last + 1], key=lambda k: group[k][0])
        back = [0] + [common_prefix(group[x][0], group[y][0]) for x, y in zip(lefts, lefts[1:], strict=False)]
        for shared, above, i, j in intervals(back, 0):
            near, far = max(low, above + 1), min(high, shared)
            if near <= far:
                yield near, far, sorted(lefts[i : j + 1], key=lambda k: group[k][2])


def later_starts(group: list[tuple[bytes, bytes, tuple, int]]) -> list[tuple[int, int, int, int, int]]:
    """For each later occurrence in a repeat: its doc_id, first and last start of strings that it loses, and where the first of these occurs first."""
    out = []
    for near, far, members in repeats(group):
        (of_doc, first_at), first_position = group[members[0]][2], unpacked(group[members[0]][3])[0]
        for k in members[1:]:
            position, own_far, own_near = unpacked(group[k][3])
            a, b = max(near, own_near), min(far, own_far)
            if a <= b and group[k][2] != (of_doc, first_at):
                out.append((group[k][2][0], position - b, position - a, of_doc, first_position - b))
    return out


def contexts(rest: DataFrame, docs: DataFrame) -> DataFrame:
    """The context bytes of occurrences (a, doc_id, at): l to the left, backwards, and r from the anchor on."""
    listed = rest.groupBy("doc_id").agg(F.collect_list("a").alias("as"), F.collect_list("at").alias("ats"))
    joined = listed.join(docs, "doc_id").select("doc_id", "text", "as", "ats")
    names = ["a", "doc_id", "at", "l", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, SLICE_BYTES):
                columns: list[list] = [[] for _ in names]
                for doc_id, text, hashes, ats in zip(*part.columns, strict=True):
                    raw, own = text.as_py().encode(), doc_id.as_py()
                    for a, at in zip(hashes.values.to_pylist(), ats.values.to_pylist(), strict=True):
                        p = at >> 14
                        for c, x in zip(columns, (a, own, at, raw[max(0, p - (LENGTH - SEED)) : p][::-1], raw[p : p + LENGTH]), strict=True):
                            c.append(x)
                kinds = [pa.int64()] * 3 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)
            pa.default_memory_pool().release_unused()

    return joined.mapInArrow(run, "a long, doc_id long, at long, l binary, r binary")


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """later_starts() of each run of equal keys; rows (key, doc_id, at, l, r) come sorted by key."""
    group: list[tuple] = []
    now = None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(LOST)
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=LOST)

    for batch in batches:
        rows: list[tuple] = []
        for a, doc_id, at, left, right in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if a != now:
                if len(group) > 1:
                    rows += later_starts(group)
                group, now = [], a
            group.append((left, right, (doc_id, at), at))
        yield table(rows)
    yield table(later_starts(group) if len(group) > 1 else [])


def distances(at: str = "at") -> tuple:
    """Columns: an anchor's position, and the farthest and nearest distance of a start before it."""
    return F.shiftright(at, 14), F.shiftright(at, 7).bitwiseAND(F.lit(127)), F.col(at).bitwiseAND(F.lit(127))


def later_rows(rows: DataFrame, least, most) -> DataFrame:
    """What rows (doc_id, at, first) that aren't the first lose: their strings at distances from least to most."""
    position = distances()[0]
    later = rows.filter(F.struct("doc_id", "at") > F.col("first"))
    return later.select("doc_id", (position - most).alias("first"), (position - least).alias("last"), F.col("first.doc_id").alias("of_doc"), (F.shiftright("first.at", 14) - most).alias("of_first"))


def dealt_out(rows: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts (a, doc_id, at, l, r) by ranges of starts: what the later of equal ones lose, and groups (key, doc_id, at, l, r) of up to most that differ."""
    _, far, near = distances()
    lost, groups = [], []
    now = rows.select("a", F.lit(0).alias("lo"), F.lit(LENGTH - SEED).alias("hi"), "doc_id", "at", "l", "r")
    own = ["a", "lo", "hi", "l", "r"]
    while True:
        middle = F.expr("(lo + hi) div 2").cast("int")
        half = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))
        cut = now.withColumn("half", half).select("a", "half.lo", "half.hi", "doc_id", "at", F.expr("substring(l, 1, half.hi)").alias("l"), F.expr(f"substring(r, 1, {LENGTH} - half.lo)").alias("r"))
        cut = common.stored(cut.filter((far >= F.col("lo")) & (near <= F.col("hi"))), "ranges")
        classes = common.stored(cut.groupBy(*own).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")), "classes")
        again = cut.join(classes.filter("n > 1").select(*own, "first"), own)
        lost.append(common.stored(later_rows(again, F.greatest(near, F.col("lo")), F.least(far, F.col("hi"))), "again"))
        key = F.xxhash64("a", "lo", "hi", F.expr("substring(l, 1, lo)"), F.expr(f"substring(r, 1, {LENGTH} - hi)"))
        left = classes.filter("lo < hi").select(key.alias("key"), *own, "first.doc_id", "first.at")
        sizes = left.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        left = common.stored(left.join(sizes, "key"), "left")
        groups.append(left.filter(F.col("m") <= most).select("key", "doc_id", "at", "l", "r"))
        now = left.filter(F.col("m") > most).drop("key", "m")
        if not now.take(1):
            return lost, groups


def lost_starts(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """Runs of starts (doc_id, first, last) of strings that also start earlier: the first at of_first in of_doc, and so on.

    docs: (doc_id, text), one row a document. A string's occurrences are those that name the same earliest one, and that.
    """
    _, far, near = distances()
    repeated = common.stored(occurrences(docs).groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "repeated")
    found = common.stored(occurrences(docs).join(repeated, "a"), "found")
    firsts = common.stored(found.groupBy("a", "c").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")), "firsts")
    whole = later_rows(found.join(firsts.filter("n > 1").select("a", "c", "first"), ["a", "c"]), near, far)
    several = common.stored(firsts.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    rest = common.stored(firsts.join(several, "a").select("a", "m", "first.doc_id", "first.at"), "rest")
    few, many = rest.filter(F.col("m") <= most), rest.filter(F.col("m") > most)
    lost, groups = [whole], [contexts(few, docs).withColumnRenamed("a", "key")]
    if many.take(1):
        for into, more in zip((lost, groups), dealt_out(contexts(many, docs), most), strict=True):
            into += more
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trees = reduce(DataFrame.unionByName, groups).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sorted_groups, ", ".join(f"{c} long" for c in LOST))
    return common.stored(reduce(DataFrame.unionByName, [*lost, trees]), "lost")


def merged(first: list[int], last: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start from first to last."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        b = min(b + LENGTH, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(raw)], strict=True))


def map_kept(docs: DataFrame, columns: list[str], row, schema: StructType, most: int = GROUP) -> DataFrame:
    """The rows that row(values of the columns, bytes, spans lost) gives for each document, if any."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with common.temporaries(docs.sparkSession):
        single, differ = common.one_text_each(docs)
        lost = lost_starts(single, most)
        runs = common.stored(lost.groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")), "runs", keep=True)
    # Each row goes as a struct, so that its columns can't clash with others.
    whole = docs.select(F.struct(*columns).alias("row"))
    joined = whole.join(runs.hint("merge"), F.col("row.doc_id") == F.col("doc_id"), "left").select("row", "first", "last")
    joined = common.where_counted(joined, differ, ["first", "last"])
    out = to_arrow_schema(schema)
    text_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                cells = [x.to_pylist() for x in part.column(0).flatten()]
                for values, first, last in zip(zip(*cells, strict=True), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (values[text_at] or "").encode()
                    made = row(list(values), raw, merged(first or [], last or [], len(raw)))
                    if made is not None:
                        rows.append(made)
                cells = zip(*rows, strict=True) if rows else [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cells, out, strict=True)], schema=out)

    return joined.mapInArrow(run, schema)


def removed_bytes(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """For each document how many bytes it loses, in how many runs, and a digest of what is left."""

    def row(values, raw, spans):
        return values[0], len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest()

    return map_kept(common.id_and_text(docs), ["doc_id", "text"], row, StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), most)


def delete_repeats(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """docs with the text that is left; characters that were cut apart go too. Texts left without a word go with their rows."""
    columns = docs.columns
    text_at = columns.index("text")

    def row(values, raw, spans):
        kept = without(raw, spans)
        if spans and not kept.split():
            return None
        if spans:
            values[text_at] = kept.decode("utf-8", errors="ignore")
        return tuple(values)

    return map_kept(docs, columns, row, docs.schema, most)


def op8_substring_dedup(spark, sf_dir) -> DataFrame:
    return removed_bytes(common.documents(spark, sf_dir))


ORACLE_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(raw) AS h FROM documents),
starts AS (SELECT doc_id, raw, unnest(range(0, length(h) // 2 - 99)) AS s FROM docs),
named AS MATERIALIZED (SELECT doc_id * 4294967296 + s AS place, hash(raw[s + 1 : s + 100]) AS name, hash(raw[s + 2 : s + 99]) AS tail FROM starts),
firsts AS (SELECT name, tail, min(place) AS first FROM named GROUP BY name, tail HAVING count(*) > 1),
again AS (SELECT place // 4294967296 AS doc_id, place % 4294967296 AS s FROM named JOIN firsts USING (name, tail) WHERE place > first),
later AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM again),
numbered AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM later),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS ends, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(ends, 0) + 1))) AS kept_sha256 FROM docs LEFT JOIN cut USING (doc_id)
"""
