"""The prefix trie of conversations against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, key string, c string, depth string, w string, n long, total long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "c", "d", "w", 1, 2) for r in rows], SCHEMA).repartition(3)


def name(role, text):
    return hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + hashlib.sha256((text or "").encode()).hexdigest()).encode()).digest()


def as_they_are(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, name(role, text), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}


def rebuilt(rows):
    own, out = as_they_are(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    ends = {p: ",".join(str(c) for c in m if len(convs[c]) == len(p)) for p, m in members.items()}
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def conversations():
    r = random.Random(3)
    texts = ["", "a", "é🙂", None, "hello there", "x" * 300]
    rows = []
    for c in [*range(40), 102, 1009, 10**12 + 3]:
        start = r.choice([[], [("system", "be brief")], [("user", "hi"), ("assistant", "hello")]])
        turns = start + [(r.choice(["user", "assistant", None, ""]), r.choice(texts)) for _ in range(r.randint(0 if start else 1, 12))]
        rows += [(c, t if t else r.choice([0, None]), *x) for t, x in enumerate(turns)]
    rows += [(7, 3, "user", "a tie"), (7, 3, "user", "a tie"), (7, 3, "user", "b tie"), (None, 1, "user", "nobody's")]
    first = [x for x in rows if x[0] == 10]
    return rows + [(c, *x[1:]) for c in (210, 211, 215) for x in first]  # copies


def test_trie_of_rebuilt_conversations_equals_a_plain_one(spark):
    rows = conversations()
    assert found(prefixes.trie(table(spark, rows), prefixes.rebuilt)) == plain(rebuilt(rows))


@pytest.mark.parametrize("block", [2, 3])
def test_chains_of_chains(spark, block):
    """Long conversations, of which one is the other's prefix, in small blocks, so that blocks are chained over several levels."""
    r = random.Random(5)
    turns = [("user", r.choice("ab")) for _ in range(60)]
    rows = [(c, t, *x) for c, n in ((4, 60), (2, 60), (9, 41), (5, 16), (8, 1)) for t, x in enumerate(turns[:n])]
    rows += [(3, t, *(x if t != 20 else ("user", "c"))) for t, x in enumerate(turns)]
    assert found(prefixes.trie(table(spark, rows), block=block)) == plain(as_they_are(rows))


def test_ids_of_a_large_node_are_strung_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE_BYTES", 200)
    ends = spark.range(0, 3000).select(F.lit(b"k").alias("key"), F.col("id").alias("c")).repartition(7)
    got = prefixes.end_digests(ends.unionByName(spark.createDataFrame([(b"z", -5)], "key binary, c long"))).collect()
    assert {bytes(x.key): x.ends_sha256 for x in got} == {b"k": hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest(), b"z": hashlib.sha256(b"-5").hexdigest()}


def test_no_conversations_and_one_without_turns(spark):
    assert found(prefixes.trie(table(spark, []), prefixes.rebuilt)) == []
    lone = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "gone"), (lone, 1, "user", "gone too")]
    assert found(prefixes.trie(table(spark, rows), prefixes.rebuilt)) == plain(rebuilt(rows)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_a_conversation_in_several_ranges(spark):
    """One conversation holds most turns and is numbered over several tasks."""
    r = random.Random(6)
    rows = [(4, t if t else None, "user", f"t{r.randrange(9)}") for t in range(700)] + [(c, t, "user", f"t{t}") for c in range(30) for t in range(3) if c != 4]
    rows += [(9, t, *x[2:]) for t, x in enumerate(rows[:650])]
    rows = [x for x in rows if x[0] != 9 or x[3] != f"t{x[1]}"] + [(9, 10_000, "user", "end")]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        placed, lengths = prefixes.numbered(prefixes.turns(table(spark, rows)))
        tasks = placed.filter("conv_id = 4").groupBy("i").count()
        assert tasks.count() == 700 and {x["count"] for x in tasks.collect()} == {1}
        assert {x.conv_id: x.n for x in lengths.collect()}[4] == 700
        in_order = [x.x for x in placed.filter("conv_id = 4").orderBy("i").collect()]
        assert in_order == [name(role, text)[:16] for c, _, role, text in rows if c == 4]
        assert found(prefixes.trie(table(spark, rows), prefixes.rebuilt)) == plain(rebuilt(rows))
    finally:
        spark.conf.set(key, before)
