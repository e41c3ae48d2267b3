"""Prefix trie of conversations (operator 11).

A conversation is the sequence of its turns, a turn its role and text. A node of the trie is a distinct sequence of
the first d turns of some conversation; the conversations that begin so are its members, the smallest of them its name.

1. Turns are named by digests, so that texts don't move. One sort by ranges of (conversation, turn) over all tasks
   numbers them: a conversation may lie in several ranges, whose sizes are added up, so that one of any length is
   no task's alone.
2. Chained digests. Turns are chained in blocks of BLOCK; the last links of full blocks are chained in the same way,
   and so on. A prefix is named by the link in its block and the chain of the blocks before, and so is the prefix
   that is a turn shorter. Each chain carries the bytes of its texts so far. Names are SHA-256, cut to 128 bits.
3. Each conversation is exploded to all its prefixes, which grouped by (depth, digest) are the nodes.
4. Subtree sums. Every node reports to all its ancestors, through its smallest member, on whose chain they all lie.
   The nodes that a conversation is the smallest member of are the end of its chain; what they report is put together
   first, so the rows are as many as the turns, while node by node they would grow with the square of a conversation's
   length. Tokens saved are the bytes of turns which a smaller member has too: in a subtree, each member's from the
   node on to where it becomes the smallest.
5. The digest of the members that end at a node takes their ids in order. They are sorted by ranges, strung together
   in pieces where they lie, and only the pieces of a node come to one task, as a stream.

Nulls: a null turn comes first, a null role or text is empty; rows without conv_id are left out. Turns of equal
number go by the digest of role and text, and equal rows count as often as they occur. A conversation without turns ends at
the root. An empty table gives no rows, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 128
KEY_BYTES = 16
#: Conversations c - c % FAMILY, ... borrow the first turns of the first of them; HEADS bounds their number.
FAMILY, HEADS = 5, 9
#: Bytes of a piece of strung ids.
PIECE_BYTES = 1 << 16
#: Names the root.
ROOT = hashlib.sha256(b"").digest()[:KEY_BYTES]


def digest(of: Column) -> Column:
    return F.substring(F.unhex(F.sha2(of, 256)), 1, KEY_BYTES)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, x (names role and text) and w, the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x = digest(F.concat(F.sha2(role, 256), F.sha2(text, 256)))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), x.alias("x"), F.octet_length(text).cast("long").alias("w"))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of turns() with i, the place in the conversation from 0; and the conversations with their n turns."""
    lying = common.stored(rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "x").withColumn("at", F.monotonically_increasing_id()), "turns")
    lying = lying.withColumn("task", F.shiftright("at", 33))
    pieces = common.stored(lying.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count("*").alias("n")), "pieces")
    # As many rows of a conversation as tasks that it lies in.
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task")) - F.col("n")
    shifts = common.stored(pieces.select("conv_id", "task", (F.col("first") - before).alias("shift")), "shifts")
    placed = lying.join(shifts, ["conv_id", "task"]).select("conv_id", (F.col("at") - F.col("shift")).alias("i"), "x", "w")
    return common.stored(placed, "placed"), common.stored(pieces.groupBy("conv_id").agg(F.sum("n").alias("n")), "conversations")


def sequences(placed: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, k, x, w, last) of each conversation as it is, k counting its turns from 1; and all c with their lengths."""
    ends = lengths.select(F.col("conv_id").alias("c"), F.col("n").alias("length"))
    items = placed.join(ends, F.col("conv_id") == F.col("c"))
    return items.select("c", (F.col("i") + 1).alias("k"), "x", "w", (F.col("i") + 1 == F.col("length")).alias("last")), ends


def rebuilt(placed: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As sequences(), where c begins with the first h turns of the conversation c - c % FAMILY, followed by its own after the first h; h = crc32(c) % HEADS."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    lent = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = lengths.select(F.col("conv_id").alias("c"), "n", base.alias("base"), h.alias("h")).join(lent, "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = common.stored(convs.select("c", "base", "h", "m", "length"), "rebuilt")
    own = placed.join(convs, F.col("conv_id") == F.col("c")).filter("i >= h").withColumn("k", F.col("m") + F.col("i") - F.col("h") + 1)
    heads = common.stored(placed.filter((F.col("i") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)), "heads")
    borrowed = heads.join(convs, F.col("conv_id") == F.col("base")).filter("i < m").withColumn("k", F.col("i") + 1)
    columns = ["c", "k", "x", "w", (F.col("k") == F.col("length")).alias("last")]
    return own.select(columns).unionByName(borrowed.select(columns)), convs.select("c", "length")


def chained(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """items (c, k, x, w, last), k from 1 without a gap, with key (names the first k), parent (the first k - 1) and total, the sum of w so far."""
    place = F.struct("k", "x", "w", "last")
    grouped = items.groupBy("c", F.expr(f"(k - 1) div {block}").alias("b")).agg(F.array_sort(F.collect_list(place)).alias("items"))
    first = F.array(F.struct(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("total")))

    def follow(links, item):
        before = F.element_at(links, -1)
        return F.array_append(links, F.struct(digest(F.concat(before["key"], item["x"])).alias("key"), (before["total"] + item["w"]).alias("total")))

    blocks = common.stored(grouped.withColumn("links", F.aggregate("items", first, follow)), "blocks")
    end = F.element_at("links", -1)
    full = blocks.filter(F.size("items") == block).select("c", (F.col("b") + 1).alias("k"), end["key"].alias("x"), end["total"].alias("w"), F.lit(False).alias("last"))
    if full.take(1):
        above = chained(common.stored(full, "ends"), block)
        parent = F.when(F.col("k") == 1, F.col("x")).otherwise(digest(F.concat("parent", "x")))
        above = above.select("c", F.col("k").alias("b"), F.col("key").alias("above"), parent.alias("above_parent"), F.col("total").alias("above_total"))
        blocks = blocks.join(common.stored(above, "above"), ["c", "b"], "left")
    else:
        blocks = blocks.withColumns({"above": F.lit(None).cast("binary"), "above_parent": F.lit(None).cast("binary"), "above_total": F.lit(None).cast("long")})

    def name(link):
        return F.when(F.col("above").isNull(), link).otherwise(digest(F.concat("above", link)))

    def row(item, at):
        own, before = F.element_at("links", at + 2), F.element_at("links", at + 1)
        parent = F.when(at > 0, name(before["key"])).otherwise(F.coalesce("above_parent", F.lit(ROOT)))
        total = own["total"] + F.coalesce("above_total", F.lit(0))
        return F.struct(item["k"].alias("k"), item["x"].alias("x"), item["w"].alias("w"), item["last"].alias("last"), name(own["key"]).alias("key"), parent.alias("parent"), total.alias("total"))

    return blocks.select("c", F.explode(F.transform("items", row)).alias("p")).select("c", "p.*")


def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, c) in order: (key, first, ids) with the ids of a key in pieces."""
    rows: list[tuple] = []
    key, ids, size = None, [], 0

    def close():
        if ids:
            rows.append((key, ids[0], ",".join(map(str, ids)).encode()))

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or size >= PIECE_BYTES:
                close()
                key, ids, size = k, [], 0
            ids.append(c)
            size += 20
        yield piece_table(rows)
        rows.clear()
    close()
    yield piece_table(rows)


def piece_table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["key", "first", "ids"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, first, ids) in order: (key, ends_sha256); the state is one digest."""
    key, state = None, None
    for batch in batches:
        rows: list[tuple] = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                state.update(b",")
                state.update(ids)
            else:
                if state:
                    rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids)
        yield digest_table(rows)
    yield digest_table([(key, state.hexdigest())] if state else [])


def digest_table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], type=pa.binary()), pa.array([x for _, x in rows], type=pa.string())], names=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of each node where conversations end; ends: (key, c)."""
    common.small_batches(ends.sparkSession)
    pieces = ends.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(strung, "key binary, first long, ids binary")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, build=sequences, block: int = BLOCK) -> DataFrame:
    """A row for each node of the prefix trie of conversations (conv_id, turn, role, text), which build() makes of the numbered turns."""
    with common.temporaries(conversations.sparkSession):
        items, ends = build(*numbered(turns(conversations)))
        ends = common.stored(ends, "lengths")
        chains = chained(common.stored(items, "items"), block)
        below = chains.select(F.col("k").alias("depth"), "key", "parent", "c", (F.col("total") - F.col("w")).alias("before"), "total", "last")
        roots = ends.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "c", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("total"), (F.col("length") == 0).alias("last"))
        prefixes = common.stored(below.unionByName(roots), "prefixes")
        nodes = common.stored(prefixes.groupBy("depth", "key", "parent").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("before").alias("before")), "nodes")
        children = common.stored(nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
        nodes = common.stored(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
        # Where a conversation becomes the smallest member, and whether it is that of a childless node.
        owners = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("before").alias("stop"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
        totals = prefixes.filter("last").select("c", "total")
        reports = common.stored(totals.join(owners, "c", "left").select("c", F.coalesce("stop", "total").alias("stop"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "reports")
        told = prefixes.select("key", "c", "before").join(reports, "c").groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("stop") - F.col("before"))).alias("saved_tokens"))
        told = common.stored(told, "told")
        digests = common.stored(end_digests(prefixes.filter("last")), "digests")
        parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        whole = nodes.join(told, "key").join(digests, "key", "left").join(parents, "parent", "left")
        none = F.lit(hashlib.sha256(b"").hexdigest())
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")]
        return common.stored(whole.select(columns), "trie", keep=True)


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuilt)


ORACLE_SQL = f"""
WITH told AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) - 1 AS i, x, w FROM told),
lengths AS (SELECT conv_id, count(*) AS n FROM told GROUP BY conv_id),
hashed AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, b: xor(a // 256, list_reduce(list_prepend(xor(a, b) % 256, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))) % {HEADS} AS h FROM lengths),
convs AS (SELECT a.conv_id AS c, a.conv_id - a.conv_id % {FAMILY} AS base, a.h, least(a.h, coalesce(b.n, 0)) AS m FROM hashed a LEFT JOIN lengths b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
items AS (SELECT c, m + i - h + 1 AS k, x, w FROM placed JOIN convs ON conv_id = c WHERE i >= h UNION ALL SELECT c, i + 1, x, w FROM placed JOIN convs ON conv_id = base WHERE i < m),
longest AS (SELECT c, coalesce(max(k), 0) AS length FROM convs LEFT JOIN items USING (c) GROUP BY c),
prefixes AS (SELECT c, k AS depth, array_to_string(list(x) OVER (PARTITION BY c ORDER BY k), '') AS key, w FROM items UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, coalesce(string_agg(CASE WHEN depth = length THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM prefixes JOIN longest USING (c) GROUP BY depth, key),
children AS (SELECT left(key, length(key) - 64) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children, left(key, length(key) - 64) AS parent FROM nodes n LEFT JOIN children USING (key)),
each AS (SELECT *, unnest(range(0, CAST(depth AS BIGINT) + 1)) AS up FROM known),
told_up AS (SELECT left(key, CAST(up * 64 AS BIGINT)) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM each GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM known n JOIN told_up USING (key) LEFT JOIN known p ON n.depth > 0 AND p.key = n.parent
"""
