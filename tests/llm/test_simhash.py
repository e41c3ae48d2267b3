"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import common, simhash

ODD = [None, "", " \t", "a", "A b", "a B", "é\x85ü 日本語 🙂", "one two three four", "ONE two three four", "x" * 5000, "ab " * 900]
SCHEMA = "doc_id long, text string, print string, value string, component string, size string, part string, least long"


def table(spark, texts):
    return spark.createDataFrame([(k, t, "p", "v", "c", "s", "t", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(id, print) to the smallest id of the component, by all pairs."""
    ids, values = [i for i, _ in prints], np.array([p for _, p in prints], dtype=np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, k in zip(ids, label.tolist(), strict=True):
        least[k] = min(least.get(k, i), i)
    return {i: least[k] for i, k in zip(ids, label.tolist(), strict=True)}


def check(df, texts):
    got = {r.doc_id: r for r in df.collect()}
    prints = [(i, plain_print(t)) for i, t in enumerate(texts)]
    assert {i: r.fingerprint for i, r in got.items()} == {i: format(p, "016x") for i, p in prints}
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def near_copies():
    r = random.Random(11)
    words = [f"w{k}" for k in range(200)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(12)]
    return [" ".join(w if r.random() > 0.01 else r.choice(words) for w in b) for b in base for _ in range(20)]


def test_documents_equal_brute_force(spark, small):
    docs = common.documents(spark, small)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, plain_print(t)) for i, t in sorted(texts.items())]
    assert {i: r.fingerprint for i, r in got.items()} == {i: format(p, "016x") for i, p in prints}
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def test_odd_texts_and_near_copies(spark):
    texts = ODD + near_copies()
    check(simhash.near_duplicates(table(spark, texts)), texts)


def scattered(seed, n, kept=64):
    """Random fingerprints, and chains of such that differ by 1 to 4 bits; the bits from `kept` on hardly vary."""
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(kept)
        for _ in range(r.randint(1, 6)):
            out.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    return sorted(out)


def components_of(spark, prints, **options):
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long").repartition(3)
    parts = options.pop("parts")
    pairs = simhash.links(frame, parts, **options).collect()
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in pairs):
        assert (a ^ b).bit_count() <= 3
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {p: top(p) for p in prints}


BITS = random.Random(2).sample(range(64), 64)
QUARTERS = [BITS[k : k + 16] for k in range(0, 64, 16)]
WAYS = {
    "quarters": [(b, 0) for b in QUARTERS],
    "one unused": [(QUARTERS[0], 1), (QUARTERS[1], 0), (QUARTERS[2], 0)],
    "halves": [(BITS[:32], 1), (BITS[32:], 1)],
    "uneven": [(BITS[:20], 2), (BITS[20:], 0)],
}


@pytest.mark.parametrize("way", ["quarters", "one unused", "halves", "uneven"])
def test_any_thresholds_find_all_links(spark, way):
    prints = scattered(4, 1500, 24)
    assert components_of(spark, prints, parts=WAYS[way]) == plain_components([(p, p) for p in prints])


@pytest.mark.parametrize("options", [{"block": 7}, {"block": 40, "hot": 60}, {"hot": 1}])
def test_large_buckets(spark, options):
    """Buckets in blocks, and those too large to be compared."""
    prints = scattered(6, 300, 12)
    assert components_of(spark, prints, parts=WAYS["quarters"], **options) == plain_components([(p, p) for p in prints])


def test_thresholds_follow_the_estimates():
    """Every allotment adds up; parts whose values hardly vary are left out, and more fingerprints take wider parts."""
    groups = [list(range(k, k + 8)) for k in range(0, 64, 8)]
    even = [np.array([1, 8, 28, 56, 70, 56, 28, 8, 1]) / 256] * 8
    for n in (10, 10**5, 10**7, 10**10):
        parts = simhash.allotted(groups, even, n)
        assert sum(t + 1 for _, t in parts) == 4
    assert max(len(b) for b, _ in simhash.allotted(groups, even, 10**5)) < max(len(b) for b, _ in simhash.allotted(groups, even, 10**11))
    still = [np.array([1.0] + [0] * 8)] * 2
    used = [b for bits, _ in simhash.allotted(groups, still + even[2:], 10**8) for b in bits]
    assert not {*range(16)} <= {*used} or len(used) > 48


def test_estimates_are_exact_for_groups(spark):
    prints = scattered(9, 400)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long").repartition(3)
    groups = simhash.groups_of_bits(frame, len(prints))
    assert sorted(b for g in groups for b in g) == list(range(64))
    values = np.array(prints, dtype=np.uint64)
    for bits, got in zip(groups, simhash.distances(frame, groups, len(prints)), strict=True):
        mask = np.uint64(sum(1 << b for b in bits))
        want = np.bincount(np.bitwise_count((values[:, None] ^ values[None, :]) & mask).ravel(), minlength=9) / len(prints) ** 2
        assert np.allclose(got, want)


def test_correlated_bits_are_grouped(spark):
    r = np.random.default_rng(3)
    bits = r.integers(0, 2, (2000, 64))
    twins = [(0, 40), (1, 63), (17, 30)]
    for a, b in twins:
        bits[:, b] = bits[:, a]
    prints = np.packbits(bits.astype(bool), axis=1, bitorder="little").view("<i8").ravel()
    frame = spark.createDataFrame([(int(p),) for p in prints], "print long")
    groups = simhash.groups_of_bits(frame, 2000)
    assert all(any({a, b} <= {*g} for g in groups) for a, b in twins[:2])


def test_long_texts_are_hashed_in_lots(monkeypatch):
    text = " ".join(f"w{k % 37}" for k in range(3000))
    whole = simhash.simhashes(pa.array([text, None, "a b"]))
    monkeypatch.setattr(simhash, "LOT", 7)
    assert (simhash.simhashes(pa.array([text, None, "a b"])) == whole).all()
    assert whole.tolist() == [plain_print(t) for t in (text, None, "a b")]


def test_nothing_repeated_rows_and_no_ids(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []
    rows = [(None, "p q r s"), (3, "p q r s"), (3, "p q r s"), (3, "wholly other words here"), (None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got.collect())) == sorted((i or -1, format(plain_print(t), "016x"), 3 if t else -1) for i, t in rows)
    assert got.select(F.col("doc_id")).schema[0].dataType.simpleString() == "bigint"
