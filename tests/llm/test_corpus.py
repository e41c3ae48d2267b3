"""The corpus operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, common, fingerprints, langid, lines, minhash, packing, quality, registry, substrings, toxicity, wordpiece

ODD_TEXTS = [None, "", " ", "a", "The", "x" * 3000, "ab " * 900, "é\x85ü 日本語 🙂", "a<|endoftext|>b", "line\n\nline\n", "\t\x0b lead and trail \r\n", "1234 5678", "one two three four", "one two three four"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, gone string, first long, last long, row string, bands string, part string, rep long"


def table(spark, texts, first=0):
    """Rows of documents, with extra columns and names that operators use inside."""
    rows = [(first + k, t, ("en", "de", None)[k % 3], "s", len(t or ""), "k", "i", "g", 1, 2, "r", "b", "p", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD_TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return common.documents(spark, small)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# ---------------------------------------------------------------- 1


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k) and top(i) != top(j):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies():
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    passage = [r.choice(words) for _ in range(60)]
    texts = []
    for size in (6, 25, 90):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(25):
            t = list(base)
            for _ in range(r.randint(0, 1 + size // 25)):
                t[r.randrange(size)] = r.choice(words)
            texts.append(" ".join(t + [r.choice(words) for _ in range(r.randint(0, size // 6))]))
    texts += [" ".join(passage + [r.choice(words) for _ in range(r.randint(5, 60))]) for _ in range(30)]
    return texts


def check_components(df, texts):
    got, want = by_id(df), plain_components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_minhash_equals_brute_force(spark, docs):
    check_components(minhash.near_duplicates(docs), texts_of(docs))


def test_minhash_in_small_blocks(spark):
    texts = near_copies() + ODD_TEXTS
    check_components(minhash.near_duplicates(table(spark, texts), block=5), {k: t or "" for k, t in enumerate(texts)})


def test_many_unlinked_classes_of_a_bucket(spark):
    """Documents that share a passage meet in buckets but not by their rare shingles; the few that are alike still do."""
    r = random.Random(12)
    words = [f"w{k}" for k in range(4000)]
    passage = [r.choice(words) for _ in range(60)]
    texts = [" ".join(passage + [r.choice(words) for _ in range(45)]) for _ in range(400)]
    texts += [" ".join([*t.split()[:-3], r.choice(words)]) for t in texts[:20]]
    frame = table(spark, texts)
    check_components(minhash.near_duplicates(frame, block=16), {k: t for k, t in enumerate(texts)})
    sets = common.stored(minhash.sets_of(frame.select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("b")), common.id_and_text(frame), 5), "sets")
    members = sets.select(F.col("a").alias("rep"), F.col("a").alias("comp"))
    near = {r.rep for r in minhash.with_rare_shingles(members, sets, 75).collect()}
    assert {*range(20), *range(400, 420)} <= near
    assert len(near) < 60


def test_minhash_odd_rows(spark, empty):
    assert minhash.near_duplicates(empty).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "b c d e f g h"), (None, "a b c d e f"), (None, "alone in the world"), (5, None), (6, "b c d e f g h"), (6, None)]
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 2, 1, True): 1, (None, 2, 1, False): 1, (None, 1, None, True): 1, (5, 0, 5, True): 1, (6, 3, 6, True): 1})


def test_sketch_estimates_similarity():
    a, b = (minhash.sketch(np.arange(lo, lo + 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 384) for lo in (0, 100))
    assert abs((a == b).mean() - 0.5) < 0.1
    one = minhash.sketch(np.array([5], dtype=np.uint64), 64)
    assert (one < np.iinfo(np.uint64).max).all()


# ---------------------------------------------------------------- 2


def test_fingerprints(spark, docs, empty):
    for frame, parts in ((docs, 4), (table(docs.sparkSession, ODD_TEXTS), 2), (table(docs.sparkSession, ["only one"]), 3)):
        texts = texts_of(frame)
        got, ids = by_id(fingerprints.fingerprint_edits(frame, parts)), sorted(texts, reverse=True)
        assert sorted(got, reverse=True) == ids
        for k, i in enumerate(ids):
            after = texts[ids[(k + 1) % len(ids)]]
            half = len(texts[i]) // 2
            edited = texts[i][: len(texts[i]) - half] + after[:half]
            own, changed, following = fingerprints.signature_sets(pa.array([texts[i], edited, after]))
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), changed.tobytes().hex())
            assert (r.near_edited, r.near_next) == (fingerprints.jaccard(own, changed), fingerprints.jaccard(own, following))
    assert fingerprints.fingerprint_edits(empty, 2).collect() == []


def plain_spots(text):
    """Common words with the two content words that follow them; without any, the whole sequence of words."""
    marks = "".join(chr(k) for k in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    words = [lower(w).strip(marks) or lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    spots = set()
    for k, w in enumerate(words):
        chain = [x for x in words[k + 1 :] if x not in fingerprints.COMMON_WORDS][:2] if w in fingerprints.COMMON_WORDS else []
        if len(chain) == 2:
            spots.add((w, *chain))
    return spots or ({tuple(words)} if words else set())


def test_fingerprints_equal_brute_force(docs):
    frame = docs.filter(F.length("text") < 6000).unionByName(table(docs.sparkSession, [t for t in ODD_TEXTS if t], 10**6).select(docs.columns))
    texts = texts_of(frame)
    ids = sorted(texts, reverse=True)
    likeness = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
    got = by_id(fingerprints.fingerprint_edits(frame, 3))
    of_print = {}
    for k, i in enumerate(ids):
        after = texts[ids[(k + 1) % len(ids)]]
        own, changed, following = map(plain_spots, (texts[i], fingerprints.edit(texts[i], after), after))
        assert len(got[i].fingerprint) == 8 * len(own)
        assert of_print.setdefault(got[i].fingerprint, own) == own
        assert abs(got[i].near_edited - likeness(own, changed)) < 1e-9
        assert abs(got[i].near_next - likeness(own, following)) < 1e-9


def test_fingerprint_classes(spark):
    frame = table(spark, ["the quick brown", "the quick brown", "other words", None, ""])
    rows = sorted(map(tuple, fingerprints.fingerprint_classes(fingerprints.fingerprints(frame)).collect()))
    assert rows == [(0, 0, 1), (1, 0, 1), (2, 2, 1), (3, 3, 0), (4, 3, 0)]


def test_fingerprint_join_equals_brute_force(docs, empty):
    prints = common.stored(fingerprints.fingerprints(docs), "prints")
    classes = {}
    for r in prints.collect():
        if r.signatures:
            classes.setdefault(tuple(r.signatures), []).append(r.doc_id)
    reps = [(min(ids), set(s)) for s, ids in classes.items()]
    want = {tuple(sorted((a, b))) for k, (a, s) in enumerate(reps) for b, t in reps[:k] if len(s & t) >= 0.75 * len(s | t)}
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in fingerprints.near_duplicates(prints).collect()} == want
    assert fingerprints.near_duplicates(fingerprints.fingerprints(empty)).collect() == []


# ---------------------------------------------------------------- 3


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.vocabulary_path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, odd, empty, library):
    for frame in (docs, odd):
        texts = texts_of(frame)
        for i, r in by_id(bpe.digests(frame)).items():
            ids = library.encode(texts[i], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty).collect() == []
    back = by_id(bpe.decode(bpe.encode(odd)))
    assert {i: r.text for i, r in back.items()} == texts_of(odd)


def test_bpe_on_random_texts(library):
    r = random.Random(1)
    texts = ["".join(r.choice(" \n\tab'st1é.,日 <|>\x1c") for _ in range(r.randint(0, 40))) for _ in range(400)]
    own = bpe.encoder(common.vocabulary_path("byte_bpe_50k.json"))
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_very_long_words(spark, library):
    """One word of 60 KB, and one of 60 KB of the same letter, through every operator that reads words in Python."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcdé日") for _ in range(30000)), "z" * 60000]
    frame = table(spark, texts)
    for i, row in by_id(bpe.digests(frame)).items():
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
    assert [x.n_words for x in wordpiece.count_tokens(frame).collect()] == [1, 1]
    assert all(x.base_failed for x in quality.judge(frame, []).collect())
    assert {x.n_shingles for x in minhash.sketches(frame).collect()} == {1}
    assert len(fingerprints.fingerprint_edits(frame, 2).collect()) == 2
    net = langid.Network.fresh(["a", "b"], 4, 1)
    assert {x.lang_pred for x in langid.predict(frame, net).collect()} <= {"a", "b"}
    assert sum(p.length for p in packing.pack(frame).collect()) > 2
    assert len(toxicity.score(frame, toxicity.Scorer.always(0.5)).collect()) == 2


def test_repeated_rows_and_null_ids(spark):
    """Operators on single documents give a row for each row, whatever its id."""
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (1, "x"), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter({1: 3, None: 1, 2: 1})
    net, scorer = langid.Network.fresh(["a", "b"], 4, 1), toxicity.Scorer.always(0.5)
    for out in (bpe.digests(frame), quality.judge(frame, []), wordpiece.count_tokens(frame), langid.predict(frame, net), toxicity.score(frame, scorer), fingerprints.fingerprint_edits(frame, 2)):
        assert Counter(x.doc_id for x in out.collect()) == want
    assert Counter((p.doc_id, p.start) for p in packing.pack(frame).collect() if p.start == 0) == Counter({(1, 0): 3, (None, 0): 1, (2, 0): 1})


def test_both_trees_merge_alike():
    vocab = bpe.encoder(common.vocabulary_path("byte_bpe_50k.json")).vocab
    words = [w.encode() for w in ("a", "ab", "hello", "internationalisation", "zzzzzzzzzzzz", "été")]
    assert bpe.merge_many(vocab, words, 32) == [bpe.merge_one(vocab, w) for w in words]


# ---------------------------------------------------------------- 4


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for v in where.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(covered)


def test_quality_statistics(docs, odd):
    for frame in (docs, odd):
        texts = texts_of(frame)
        for i, r in by_id(quality.judge(frame, [])).items():
            n, chars, symbols, dup, repeat = plain_counts(texts[i])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
            assert r.kept == (not r.base_failed)


def test_decision_list_is_learned():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    bad = ((x["a"] > 0.9) & (x["b"] < 0.5)) | (x["c"] > 0.97)
    rules = quality.learn(x, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= quality.covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.98
    assert quality.learn(x, np.zeros(3000, dtype=bool)) == []


def test_quality_keeps_good_documents(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rules = quality.fit(docs, labels)
    good = quality.judge(docs, rules).join(labels.filter("quality = 1"), "doc_id").filter("not base_failed")
    assert good.filter("kept").count() >= 0.97 * good.count()
    bad = quality.judge(docs, rules).join(labels.filter("quality = 0"), "doc_id")
    assert bad.filter("not kept").count() >= 0.9 * bad.count() > 0
    assert quality.fit(docs, labels.limit(0)) == []
    assert quality.judge(docs.limit(0), rules).collect() == []


# ---------------------------------------------------------------- 5


def plain_pieces(word, first, later):
    n, rest, have = 0, word, first
    while rest:
        k = next((k for k in range(len(rest), -1, -1) if rest[:k] in have and (k or have is first)), None)
        if k is None:
            return 1
        n, rest, have = n + 1, rest[k:], later
    return n


def test_token_counts(odd, empty):
    first, later = map(set, wordpiece.pieces_of(common.vocabulary_path("byte_bpe_50k.json")))
    texts = texts_of(odd)
    for i, r in by_id(wordpiece.count_tokens(odd)).items():
        words = texts[i].encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(plain_pieces(w, first, later) for w in words))
    assert wordpiece.count_tokens(empty).collect() == []


def test_automaton_on_random_vocabularies():
    r = random.Random(2)
    word = lambda n: bytes(r.choice(b"abc") for _ in range(r.randint(1, n)))
    for _ in range(150):
        first, later = {word(5) for _ in range(r.randint(1, 5))}, {word(5) for _ in range(r.randint(1, 6))}
        a, words = wordpiece.Automaton(list(first), list(later)), [word(12) for _ in range(30)]
        want = [plain_pieces(w, first, later) for w in words]
        assert a.count_many(words) == want
        assert [a.count(w) for w in words] == want


# ---------------------------------------------------------------- 6


def plain_probabilities(net, raw):
    """Of each language at each byte, from the equations of the network, position by position."""
    w, n = net.weights, len(net.weights["umf"])
    squash = lambda x: 1 / (1 + np.exp(-x))
    states = {}
    for d in "fb":
        h = np.zeros(n)
        for t in range(len(raw)) if d == "f" else reversed(range(len(raw))):
            z = squash(w["z" + d][raw[t]] + h @ w["uz" + d])
            r = squash(w["r" + d][raw[t]] + h @ w["ur" + d])
            m = np.tanh(w["m" + d][raw[t]] + r * (h @ w["um" + d] + w["c" + d]))
            h = (1 - z) * m + z * h
            states[d, t] = h
    out = []
    for t in range(len(raw)):
        e = np.exp(np.concatenate([states["f", t], states["b", t]]) @ w["o"] + w["b"])
        out.append(e / e.sum())
    return np.array(out)


def small_network(seed=1):
    net = langid.Network.fresh(["a", "b", "c"], 4, seed)
    net.weights = {k: v.astype("f8") for k, v in net.weights.items()}
    return net


def test_network_gradients():
    net = small_network()
    text, target = np.frombuffer(b"hello ab, q all ", dtype=np.uint8).reshape(4, 4).T, np.array([0, 2, 1, 1])
    loss = lambda: -np.mean([np.log(net.probabilities(text)[t, i, target[i]]) for t in range(4) for i in range(4)])
    grads = net.gradients(text, target)
    assert set(grads) == set(net.weights)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w = net.weights[k]
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5, k


def test_network_reads_across_words_and_windows():
    net, r = small_network(3), random.Random(6)
    texts = ["", "é", "a short one", "".join(r.choice("abc dé") for _ in range(700)), "x" * 500, "日本語のテキスト" * 40]
    langs, scores = langid.read(net, pa.array([*texts, None]))
    for text, lang, score in zip(texts, langs, scores, strict=False):
        raw = text.encode()
        total = np.zeros(3)
        for first in range(0, len(raw), langid.CORE):
            edge = b" " * langid.RUN_IN
            around = (edge + raw.ljust(-(-len(raw) // langid.CORE) * langid.CORE) + edge)[first : first + langid.CORE + 2 * langid.RUN_IN]
            p = plain_probabilities(net, around)[langid.RUN_IN :]
            total += p[: min(langid.CORE, len(raw) - first)].sum(axis=0)
        if text:
            assert lang == net.langs[int(total.argmax())]
            assert abs(score - total.max() / len(raw)) < 1e-6
    assert (langs[0], langs[-1], scores[0], scores[-1]) == ("und", "und", 0.0, 0.0)
    whole = plain_probabilities(net, b" " * 12 + texts[2].encode() + b" " * (langid.CORE - len(texts[2])) + b" " * 12)
    assert np.abs(whole[12 : 12 + len(texts[2])].mean(axis=0).max() - scores[2]) < 1e-6


def test_language_of_held_out_documents(spark, docs, small, odd, empty):
    got = by_id(registry.queries()["op6_language_id"](spark, small))
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == true[i] for i in held]) > 0.95
    net = langid.fit(docs)
    out = by_id(langid.predict(odd, net))
    assert {ODD_TEXTS[i] for i, r in out.items() if r.lang_pred == "und"} == {None, "", " ", "1234 5678"}
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.predict(empty, net).collect() == []
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.drop_unknown(odd, net).columns == odd.columns


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = registry.queries()[name](spark, small)
    want = c.sql(registry.oracle_sql()[name])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain_lines(texts, least):
    split = {i: t.split("\n") for i, t in texts.items()}
    gone = {i: set() for i in texts}
    for n in range(1, max(map(len, split.values())) + 1):
        seen = set()
        for i in sorted(split):
            for k in range(len(split[i]) - n + 1):
                run = tuple(split[i][k : k + n])
                if run in seen and sum(map(len, run)) >= least:
                    gone[i] |= set(range(k, k + n))
                seen.add(run)
    return {i: "\n".join(x for k, x in enumerate(split[i]) if k not in gone[i]) for i in texts}


def test_line_runs_equal_brute_force(spark, empty):
    r = random.Random(5)
    texts = {k: "\n".join(r.choice(["a", "bb", "", "ccc", "d" * 9, f"u{k}{r.random()}"]) for _ in range(r.randint(1, 14))) for k in range(60)}
    frame = spark.createDataFrame([*texts.items(), (100, None), (None, "a\nbb")], "doc_id long, text string")
    got = [(row.doc_id, row.text) for row in lines.delete_repeats(frame, 6).collect()]
    assert dict(x for x in got if x[0] is not None and x[0] < 100) == plain_lines(texts, 6)
    assert (100, None) in got
    assert (None, "a\nbb") in got
    assert lines.delete_repeats(empty).collect() == []
    assert lines.delete_repeats(empty).columns == empty.columns
    clash = table(spark, ["a line of more than forty characters, surely\nx", "y\na line of more than forty characters, surely"])
    assert sorted((row.text, row.gone, row.row) for row in lines.delete_repeats(clash).collect()) == [("a line of more than forty characters, surely\nx", "g", "r"), ("y", "g", "r")]
    assert substrings.delete_repeats(table(spark, ["z" * 300])).select("first", "row").collect() == [(1, "r")]


def test_line_runs_of_every_length(spark):
    r = random.Random(8)
    texts = {k: "\n".join(r.choice(["a", "bb", "", "ccc", "d" * 9, f"u{k}{r.random()}"]) for _ in range(r.randint(1, 14))) for k in range(60)}
    texts |= {60: "\n" * 40 + "ccc\nccc" + "\n" * 9, 61: "u\n" + "\n" * 50 + "ccc\nccc" + "\n" * 20, 62: "a\nbb\n" * 20}
    rows = [*texts.items(), (7, texts[7])]
    for least in (1, 13):
        got = lines.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
        assert len(got) == len(rows)
        assert {(x.doc_id, x.text) for x in got} == set(plain_lines(texts, least).items())
    rows, want = [], {}
    for k, sizes in enumerate(([100, 5, 5, 5, 5], [19, 19, 19], [9] * 7)):
        run = "\n".join(chr(97 + 9 * k + j) * n for j, n in enumerate(sizes))
        rows += [(2 * k, "one\n" + run), (2 * k + 1, run + f"\nown {k}")]
        want |= {2 * k: "one\n" + run, 2 * k + 1: f"own {k}"}
    got = lines.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == want


def test_repeated_rows_are_one_document(spark):
    long = "\n".join(f"line {k} of a run with a good many lines" for k in range(9))
    once = [(1, long), (2, "own\n" + long), (3, None), (None, long)]
    contested = [(4, "zz\n" + long), (4, "an own text\n" + long)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, long), (2, "own"), (3, None), (None, long), (4, "an own text"), (4, "zz\n" + long)}
    got = lines.delete_repeats(frame(once * 3 + contested)).collect()
    assert len(got) == 14
    assert set(map(tuple, got)) == want
    single, differ = common.one_text_each(frame(once * 3 + contested))
    assert {tuple(r) for r in single.collect()} == {(1, long), (2, "own\n" + long), (3, None), (4, "an own text\n" + long)}
    assert [r.doc_id for r in differ.collect()] == [4]
    sizes = []
    for times in (1, 2):
        single, _ = common.one_text_each(frame(once * times))
        sizes.append([x.count() for x in lines.suffix_array(common.stored(lines.sequences(single), "lines"))])
    assert sizes[0] == sizes[1]


def test_suffixes_are_ranked_in_order(spark):
    texts = {1: "b\na\nb\na\nc", 2: "a\nb\na\nb\na", 3: "c\nb\na\nb"}
    single = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    name = {r.doc_id * 100 + r.i: bytes(r.name) for r in lines.sequences(single).collect()}
    for h, level in enumerate(lines.suffix_array(common.stored(lines.sequences(single), "lines"))):
        rows = {(r.doc_id, r.i): r.r for r in level.collect()}
        prefix = {(d, i): [name[d * 100 + i + k] for k in range(1 << h)] for d, i in rows}
        for x in rows:
            for y in rows:
                assert (rows[x] < rows[y]) == (prefix[x] < prefix[y])
    runs = {(r.doc_id, r.i): (r.n, r.fd, r.fi) for r in lines.repeated_runs(common.stored(lines.sequences(single), "lines"), 1).collect()}
    split = {d: t.split("\n") for d, t in texts.items()}
    for d, own in split.items():
        for i in range(len(own)):
            shared = [next((k for k in range(min(len(own) - i, len(o) - j)) if own[i + k] != o[j + k]), min(len(own) - i, len(o) - j)) for e, o in split.items() for j in range(len(o)) if (e, j) < (d, i)]
            assert runs.get((d, i), (0,))[0] == max(shared, default=0)


# ---------------------------------------------------------------- 8


def plain_bytes(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        marks = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                marks[s : s + 100] = b"\1" * 100
            else:
                seen.add(raw[s : s + 100])
        spans = sum(marks[k] and (k == 0 or not marks[k - 1]) for k in range(len(marks)))
        out[i] = (len(raw), sum(marks), spans, hashlib.sha256(bytes(x for x, m in zip(raw, marks, strict=True) if not m)).hexdigest())
    return out


def test_passages_equal_brute_force(spark, docs, odd, empty):
    r = random.Random(4)
    bases = ["".join(r.choice("abcdé ") for _ in range(400)) for _ in range(4)]
    cut = lambda b: b[(a := r.randint(0, 300)) : a + r.randint(20, 300)]
    mixed = table(spark, [*ODD_TEXTS, *("".join(cut(r.choice(bases)) if r.random() < 0.7 else "".join(r.choice("abc ") for _ in range(r.randint(1, 80))) for _ in range(r.randint(1, 6))) for _ in range(90))])
    for frame, most in ((docs, substrings.GROUP), (mixed, 1000), (mixed, 2)):
        got = {r.doc_id: tuple(r)[1:] for r in substrings.removed_bytes(frame, most).collect()}
        assert got == plain_bytes(texts_of(frame))
    assert substrings.removed_bytes(empty).collect() == []


def test_an_anchor_with_very_many_contexts(spark):
    r = random.Random(14)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(190)
    rows = [(k, word(r.randint(0, 90)) + passage[r.choice([0, 0, 0, 20, 45]) : r.choice([190, 190, 140, 120])] + word(r.randint(0, 90))) for k in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: tuple(x)[1:] for x in substrings.removed_bytes(frame).collect()} == plain_bytes(dict(rows))
    texts = {d: t.encode() for d, t in rows}
    lost = substrings.lost_starts(frame).collect()
    assert len({x.doc_id for x in lost}) > 1500
    for x in lost:
        for k in range(x.last - x.first + 1):
            assert (x.of_doc, x.of_first + k) < (x.doc_id, x.first + k)
            assert texts[x.doc_id][x.first + k :][:100] == texts[x.of_doc][x.of_first + k :][:100]


def test_passages_of_odd_rows(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(1, "own " + passage), (1, "own " + passage), (2, "x"), (2, passage), (None, passage), (3, None), (3, passage), (4, None)]
    got = Counter(tuple(x)[:4] for x in substrings.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 304, 0, 0): 2, (2, 1, 0, 0): 1, (2, 300, 300, 1): 1, (None, 300, 0, 0): 1, (3, 0, 0, 0): 1, (3, 300, 300, 1): 1, (4, 0, 0, 0): 1})


def test_short_texts_after_a_long_one():
    r = random.Random(9)
    texts = ["".join(r.choice("abc ") for _ in range(4090)), *("short" * 15 for _ in range(80))]
    data, starts = substrings.buffers(pa.array(texts))
    doc, position, first, last = substrings.anchors(substrings.seed_hashes(data), starts)
    assert set(doc.tolist()) == {0}
    assert first[0] == 0
    assert last[-1] == 4090 - substrings.LENGTH
    assert (first[1:] == last[:-1] + 1).all()
    assert ((position >= last) & (position <= first + substrings.LENGTH - substrings.SEED)).all()


def test_intervals_of_a_suffix_array():
    words = sorted(["banana"[k:] for k in range(6)])
    lcp = [0, *(substrings.common_prefix(a.encode(), b.encode()) for a, b in zip(words, words[1:], strict=False))]
    got = {(words[i][:depth], j - i + 1) for depth, _, i, j in substrings.intervals(lcp, 0) if depth}
    assert got == {("a", 3), ("ana", 2), ("na", 2)}


# ---------------------------------------------------------------- 9


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.vocabulary_path("word_bpe_49k.json"))
    for frame in (docs, odd):
        texts = texts_of(frame)
        pieces = packing.pack(frame).collect()
        by_doc, by_sequence = {}, {}
        for p in pieces:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_sequence.setdefault(p.sequence_id, []).append(p)
        assert set(by_doc) == set(texts)
        for i, own in by_doc.items():
            ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        padding = 0
        for own in by_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding <= 0.02 * sum(p.length for p in pieces) + 20
    assert packing.pack(empty).collect() == []


def test_cuts_are_the_cheapest():
    r = random.Random(3)
    for _ in range(200):
        points = [0, *sorted(r.sample(range(1, 40), 12))]
        points = [p for k, p in enumerate(points) if k == 0 or p - points[k - 1] <= 10]
        costs = [0.0, *(r.choice([0.0, 1.0, 3.0]) for _ in points[1:])]
        if any(b - a > 10 for a, b in zip(points, points[1:], strict=False)):
            continue
        best = [0.0] + [float("inf")] * (len(points) - 1)
        for j in range(1, len(points)):
            best[j] = min(best[i] + 10 - (points[j] - points[i]) + costs[j] for i in range(j) if points[j] - points[i] <= 10)
        cuts = packing.best_cuts(points, costs, 10)
        assert sum(10 - (points[b] - points[a]) + costs[b] for a, b in zip(cuts, cuts[1:], strict=False)) == best[-1]


# ---------------------------------------------------------------- 10


def test_isotonic_is_monotone():
    r = np.random.default_rng(2)
    x = r.random(500)
    at, share = toxicity.isotonic(x, (r.random(500) < x).astype(float), np.ones(500))
    assert (np.diff(at) >= 0).all()
    assert (np.diff(share) >= 0).all()


def test_obfuscated_words_are_read():
    lex = toxicity.Lexicon(frozenset(["idiot"]), frozenset(["stup"]))
    assert lex.mark(b"IDIOT!") & toxicity.LEX
    assert lex.mark(b"stupidest") & toxicity.STEM
    for w in (b"1d10t", b"i.d.i.o.t", b"id-iot", b"idiooot"):
        assert bool(lex.mark(w) & toxicity.HIDDEN) == (w != b"idiooot") or toxicity.unmasked(w.decode()) == "idiot", w
    assert lex.mark(b"---") == 0


def test_toxicity_of_held_out_documents(spark, odd, empty):
    r = random.Random(1)
    words = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(500):
        t = [r.choice(words) for _ in range(40)]
        if k % 4 == 0:
            for _ in range(2):
                t[r.randrange(40)] = r.choice(["scumbag", "scumbags", "scumling"])
        rows.append((k, " ".join(t), int(k % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(frame, frame.filter("doc_id >= 200"))
    got = by_id(toxicity.score(frame, scorer))
    assert np.mean([got[k].predicted == y for k, _, y in rows[:200]]) > 0.97
    assert all(0 <= x.score <= 1 for x in toxicity.score(odd, scorer).collect())
    assert toxicity.score(empty, scorer).collect() == []
    nothing = toxicity.fit(frame, frame.limit(0))
    assert {(x.score, x.predicted) for x in toxicity.score(odd, nothing).collect()} == {(0.0, 0)}


def test_training_reads_whole_texts(spark):
    r = random.Random(2)
    words = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(300):
        t = [r.choice(words) for _ in range(1700)]
        if k % 3 == 0:
            for at in r.sample(range(1600, 1700), 3):
                t[at] = r.choice(["scumbag", "scumbags", "scumling"])
        assert len(" ".join(t[:1600])) > 8000
        rows.append((k, " ".join(t), int(k % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = by_id(toxicity.score(frame, toxicity.fit(frame, frame.filter("doc_id >= 100"))))
    assert np.mean([got[k].predicted == y for k, _, y in rows[:100]]) > 0.97
    own = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["quick", "brown", "jumps"]}
    named = [(k, "12 " * 1400 + " ".join(r.choice(own[lang]) for _ in range(2000)), lang) for k, lang in enumerate(["aa", "bb"] * 10)]
    net = langid.fit(spark.createDataFrame(named, "doc_id long, text string, lang string"))
    told = by_id(langid.predict(table(spark, [" ".join(x) for x in own.values()]), net))
    assert [told[k].lang_pred for k in (0, 1)] == ["aa", "bb"]
    assert min(told[k].score for k in (0, 1)) > 0.8


def plain_tree_score(model, row):
    total = model.base
    for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += v[node - len(f)]
    return total


def test_trees_equal_a_plain_walk():
    r = np.random.default_rng(4)
    x = r.random((300, 5))
    model = toxicity.Boosted.fit(x, (x[:, 0] + x[:, 3] > 1).astype(float), np.ones(300))
    got = model.raw(x)
    assert np.allclose(got, [plain_tree_score(model, row) for row in x])
    assert ((got > 0) == (x[:, 0] + x[:, 3] > 1)).mean() > 0.95


def test_toxicity_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(registry.queries()["op10_toxicity"](spark, sf))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i, r in got.items() if r.held_out and labels.get(i) is not None]
    assert {i for i, r in got.items() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    bad, good = ([got[i].score for i in held if labels[i] == y] for y in (1, 0))
    assert len(bad) >= 3
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.93
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.93


def test_a_million_empty_texts_are_packed_in_bounded_memory():
    """A block holds so many documents at most; its cut points take a few bytes a token."""
    import tracemalloc

    packer = packing.Packer(np.zeros(10, dtype=bool), 2048, 4, 12, 0)
    closing = np.asarray([1], dtype="<u4")
    tracemalloc.start()
    pieces = sequences = 0
    for doc in range(1_000_000):
        packer.add(doc, closing)
        if len(packer.docs) >= packing.BLOCK_DOCS:
            found = packing.table(packer.flush(last=False))
            pieces, sequences = pieces + found.num_rows, found.column(5)[-1].as_py() + 1
    pieces += packing.table(packer.flush(last=True)).num_rows
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()
    assert pieces == 1_000_000 and sequences >= 1_000_000 // 2048 - 64


def test_hard_cut_points_are_whole_windows_after_documents_and_in_long_sentences():
    r = random.Random(31)
    for window in (3, 8):
        packer = packing.Packer(np.array([False, True]), window, 4, 12, 0)
        docs = [np.array([int(r.random() < 0.05) for _ in range(r.randint(1, 40))]) for _ in range(30)]
        for k, ids in enumerate(docs):
            packer.add(k, ids)
        points, _ = packer._points()
        stream = np.concatenate(docs)
        ends = np.cumsum([len(d) for d in docs]).tolist()
        soft = sorted({0, *ends, *(np.flatnonzero(stream == 1) + 1).tolist()})
        want = {*soft, *(s + window * k for s in [0, *ends] for k in range(1, len(stream)) if s + window * k < len(stream))}
        want |= {x for a, b in zip(soft, soft[1:], strict=False) if b - a > window for x in range(a + window, b, window)}
        assert points == sorted(want)
