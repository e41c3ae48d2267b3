"""Collocations: frequent phrases that occur more often than their parts let expect (operator 13).

Per language f(phrase) counts the contiguous occurrences of a phrase within pieces of texts, and n all words. A candidate
has 2 to LONGEST words and f >= MINIMUM. Its score is the least over its cuts in two of 1000 f n / (l r), rounded
down, l and r being f of both parts. Candidates inside a longer one that is as frequent go.

Phrases are counted by pivot partitioning:

1. Words are counted per language. A table of CELLS cells, so of one size whatever the input, tells for a hash of a word
   the count of the most frequent frequent word with that hash, or that there is none. It puts all words in one
   order, from rare to frequent, with ties by hash; the order need only be the same everywhere, so words that
   share a cell cost work and change no result. A map of PAIRS bits tells in the same way of two such words next to each
   other that they may be frequent together; two that aren't are in no candidate.
2. The pivot of a phrase is its rarest word, at its first place. For each occurrence of a word the fragment around it is
   written out in which it is the pivot: up to LONGEST - 1 words to each side, to the left as far as words are less rare,
   to the right as far as they aren't rarer; words that aren't frequent end it, and pairs that aren't. Each occurrence of a
   candidate so lies in one fragment around its pivot. A task puts together fragments that are
   equal, with their number, and sends a pivot's in one row to the pivot's task.
3. There all phrases of a fragment that contain its pivot's place are counted, pivot by pivot in bounded lots. All
   of a pivot's fragments are in one task, so what is too rare goes at once. Pivots with more than SPLIT occurrences are
   dealt over several tasks, and one with more fragments than a lot is counted in several lots; their counts are added up
   afterwards.

Parts of a candidate are at least as frequent as it is, so their counts are there: the scores are joins on (language,
phrase). Products are decimals of 38 digits; an overflow raises an error.

Nulls: a null text has no words, a null language is `und`. Rows count as often as they occur, whatever their doc_id. Ties end with the
phrase in byte order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import sized
from . import common

LONGEST, MINIMUM, TOP = 5, 100, 2000
#: A candidate goes if one that it lies in occurs in so many of a hundred of its occurrences.
ABSORBED = 100
CELLS, PAIRS = 1 << 20, 1 << 22
#: Occurrences of a pivot for each task that counts it.
SPLIT = 1 << 18
#: Fragments that are counted at once.
LOT = 400_000
NO_LANGUAGE = "und"
#: The marks that end a piece, and A-Z.
ENDS = b".,;:!?\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TABLE = bytes.maketrans(UPPER + ENDS + b"\t", UPPER.lower() + b"\n" * len(ENDS) + b" ")
U = np.uint64


def language_and_text(docs: DataFrame) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of a language in bounded slices: one string, in lower case, with a newline after each piece and spaces between words."""
    for batch in batches:
        for part in common.slices(batch):
            coded = part.column(0).dictionary_encode()
            codes, texts = coded.indices.to_numpy(), part.column(1).cast(pa.large_binary())
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                own = texts.filter(pa.array(codes == k)).drop_null().to_pylist()
                yield lang, b"\n".join(own).translate(TABLE)


def hashes_of(lang: str, words: list[bytes]) -> np.ndarray:
    named, seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((named(w, seed) for w in words), dtype=U, count=len(words))


def coded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and for each word which it is."""
    found = pa.array(words, type=pa.large_binary()).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in by_language(batches):
            words, codes = coded(data.split())
            columns = [pa.array([lang] * len(words), type=pa.string()), pa.array(words, type=pa.binary()).cast(pa.string()), pa.array(hashes_of(lang, words).view(np.int64)), pa.array(np.bincount(codes, minlength=len(words)))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])

    made = language_and_text(docs).mapInArrow(run, "lang string, word string, h long, n long")
    return made.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def rarity(frequent: DataFrame, cells: int = CELLS) -> np.ndarray:
    """For each cell the count of its most frequent word, or zero."""
    rows = frequent.groupBy(F.col("h").bitwiseAND(cells - 1).alias("cell")).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(cells, dtype=np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


class Places:
    """The words of a language's texts in turn, a newline standing between pieces, with each distinct one's hash, count and rank, which is -1 if it can't be in a candidate."""

    def __init__(self, lang: str, data: bytes, table: np.ndarray, minimum: int):
        self.distinct, codes = coded(data.replace(b"\n", b" \n ").split(b" "))
        self.h = hashes_of(lang, self.distinct)
        self.f = table[(self.h & U(len(table) - 1)).astype(np.int64)]
        rank = np.empty(len(self.distinct), dtype=np.int64)
        rank[np.lexsort((self.h, self.f))] = np.arange(len(rank))
        rank[self.f < minimum] = -1
        rank[[w == b"\n" for w in self.distinct]] = -1
        self.codes = codes[~np.array([not w for w in self.distinct], dtype=bool)[codes]]  # several spaces
        self.rank = rank[self.codes]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a word and the one after it may be in a candidate, and a hash of the two."""
        at = np.flatnonzero((self.rank[:-1] >= 0) & (self.rank[1:] >= 0))
        h = self.h[self.codes]
        mixed = (h[at] * U(0x9E3779B97F4A7C15) ^ (h[at + 1] >> U(7))) + h[at + 1]
        return at, (mixed ^ (mixed >> U(31))) * U(0xBF58476D1CE4E5B9)

    def joined(self, pairs: np.ndarray) -> np.ndarray:
        """For each place whether the word and the one before it may be together in a candidate."""
        out = np.zeros(len(self.codes), dtype=bool)
        at, h = self.pairs()
        cell = (h & U(8 * len(pairs) - 1)).astype(np.int64)
        out[at + 1] = pairs[cell >> 3] >> (cell & 7) & 1
        return out


def frequent_pairs(docs: DataFrame, table: np.ndarray, minimum: int, cells: int = PAIRS) -> np.ndarray:
    """A bit for each hash of two words: whether any such pair is frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in by_language(batches):
            pair, n = np.unique(Places(lang, data, shared.value, minimum).pairs()[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])

    counts = language_and_text(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= minimum).select(F.col("pair").bitwiseAND(cells - 1).alias("cell")).distinct().toArrow()
    out = np.zeros(cells, dtype=bool)
    out[rows["cell"].to_numpy()] = True
    return np.packbits(out, bitorder="little")


def reaches(rank: np.ndarray, joined: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each place's fragment goes to the left, where ranks are above its own, and to the right, where they aren't below; -1 ends all, and so does a place that isn't joined to the one before."""
    out = []
    for to_left in (True, False):
        far, open_ = np.zeros(len(rank), dtype=np.int64), rank >= 0
        for k in range(1, most):
            other, near = np.full(len(rank), -1, dtype=rank.dtype), np.zeros(len(rank), dtype=bool)
            if to_left:
                other[k:], near[k - 1 :] = rank[:-k], joined[: len(rank) - k + 1]
                open_ = open_ & near & (other > rank)
            else:
                other[:-k], near[:-k] = rank[k:], joined[k:]
                open_ = open_ & near & (other >= rank)
            if not open_.any():
                break
            far += open_
        out.append(far)
    return out[0], out[1]


def cut_out(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings flat[start:end]."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(flat, dtype=np.uint8)[at])])


FRAGMENTS = "lang string, pivot int, salt int, whole boolean, fragments array<struct<left:int,n:long,words:string>>"


def combined(parts: list[pa.RecordBatch], lang: str, longest: int, split: int) -> pa.RecordBatch:
    """Rows of FRAGMENTS of some fragments (pivot, f, left, words, n) of a language: equal ones put together, and those of a pivot and salt in one row."""
    whole = pa.Table.from_batches(parts).combine_chunks()
    words = whole["words"].combine_chunks()
    which = words.dictionary_encode().indices.to_numpy().astype(np.int64) * longest + whole["left"].to_numpy()
    _, one, group = np.unique(which, return_index=True, return_inverse=True)
    n = np.zeros(len(one), dtype=np.int64)
    np.add.at(n, group, whole["n"].to_numpy())
    pivot = whole["pivot"].to_numpy()[one]
    salts = -(-whole["f"].to_numpy()[one] // split)
    salt = np.arange(len(one)) % salts
    order = np.lexsort((salt, pivot))
    cuts = np.flatnonzero((np.diff(pivot[order], prepend=0) != 0) | (np.diff(salt[order], prepend=0) != 0))
    cuts = cuts if len(cuts) and cuts[0] == 0 else np.concatenate([[0], cuts])
    first = order[cuts]
    held = pa.StructArray.from_arrays([whole["left"].combine_chunks().take(pa.array(one[order])), pa.array(n[order]), words.take(pa.array(one[order])).cast(pa.binary()).cast(pa.string())], names=["left", "n", "words"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)).astype(np.int32)), held)
    columns = [pa.array([lang] * len(cuts), type=pa.string()), pa.array(pivot[first]), pa.array(salt[first].astype(np.int32)), pa.array(salts[first] == 1), lists]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "pivot", "salt", "whole", "fragments"])


def fragments(docs: DataFrame, table: np.ndarray, pairs: np.ndarray, longest: int, minimum: int, split: int, lot: int = LOT) -> DataFrame:
    """Rows of FRAGMENTS: pivot is half its hash, left its place in the words; whole tells that the pivot has one salt.

    A task puts together what it has whenever that is two lots, and at its end.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs = shared.value
        waiting: dict[str, list[pa.RecordBatch]] = {}
        rows = 0
        for lang, data in by_language(batches):
            places = Places(lang, data, table, minimum)
            left, right = reaches(places.rank, places.joined(pairs), longest)
            at = np.flatnonzero(left + right)
            if not len(at):
                continue
            size = np.fromiter(map(len, places.distinct), dtype=np.int64, count=len(places.distinct))[places.codes]
            ends = np.cumsum(size + 1) - 1
            flat = b" ".join(map(places.distinct.__getitem__, places.codes.tolist()))
            strings = cut_out(flat, (ends - size)[at - left[at]], ends[at + right[at]])
            which = strings.dictionary_encode().indices.to_numpy().astype(np.int64) * longest + left[at]
            _, one, n = np.unique(which, return_index=True, return_counts=True)
            pivot = places.codes[at[one]]
            columns = [pa.array((places.h[pivot] >> U(32)).astype(np.uint32).view(np.int32)), pa.array(places.f[pivot]), pa.array(left[at[one]].astype(np.int32)), strings.take(pa.array(one)), pa.array(n)]
            waiting.setdefault(lang, []).append(pa.RecordBatch.from_arrays(columns, names=["pivot", "f", "left", "words", "n"]))
            rows += len(one)
            if rows >= 2 * lot:
                for own, parts in waiting.items():
                    yield combined(parts, own, longest, split)
                waiting, rows = {}, 0
        for own, parts in waiting.items():
            yield combined(parts, own, longest, split)

    return language_and_text(docs).mapInArrow(run, FRAGMENTS)


def phrases_in(lefts: np.ndarray, words: pa.Array, n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All phrases of at least two words around the pivots of some fragments: a fragment that has it, how often it occurs, and the phrase."""
    lists = pc.split_pattern(words, " ")
    firsts = lists.offsets.to_numpy().astype(np.int64)
    firsts, stops = firsts[:-1] - firsts[0], firsts[1:] - firsts[0]
    found = lists.flatten().dictionary_encode()
    codes = found.indices.to_numpy().astype(np.int64)
    shuffled = np.random.default_rng(0).integers(1, 1 << 63, len(found.dictionary), dtype=U)[codes]
    keys, rows, begins, sizes = [], [], [], []
    for back in range(longest):
        own = np.flatnonzero(lefts >= back)
        begin = firsts[own] + lefts[own] - back
        key = np.zeros(len(own), dtype=U)
        for k in range(longest):
            there = begin + k < stops[own]
            own, begin, key = own[there], begin[there], key[there]
            key = (key ^ (key >> U(29)) ^ shuffled[begin + k]) * U(0xBF58476D1CE4E5B9)
            if k and k >= back:
                keys.append(key ^ (key >> U(32)))
                rows.append(own)
                begins.append(begin)
                sizes.append(np.full(len(own), k + 1))
    key, row, begin, size = (np.concatenate(x) for x in (keys, rows, begins, sizes))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    # Hashes stand for phrases only where all that share one are the same.
    same = size == size[one][which]
    for k in range(longest):
        there = np.flatnonzero(same & (size > k))
        same[there] &= codes[begin[there] + k] == codes[begin[one][which[there]] + k]
    if not same.all():
        known: dict[tuple, int] = {}
        which = np.array([known.setdefault(tuple(codes[a : a + m].tolist()), len(known)) for a, m in zip(begin.tolist(), size.tolist(), strict=True)])
        _, one = np.unique(which, return_index=True)
    total = np.zeros(len(one), dtype=np.int64)
    np.add.at(total, which, n[row])
    return row[one], total, (codes, found.dictionary, begin[one], size[one])


def spelled(place, chosen: np.ndarray) -> list[str]:
    codes, words, begin, size = place
    return [" ".join(words[c].as_py() for c in codes[a : a + m].tolist()) for a, m in zip(begin[chosen].tolist(), size[chosen].tolist(), strict=True)]


def single(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (lang, pivot, whole, fragments) as a row for each fragment."""
    lists = batch.column(3)
    row = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy()))
    held = lists.flatten()
    columns = [*(batch.column(k).take(row) for k in range(3)), *(held.field(k) for k in ("left", "words", "n"))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "pivot", "whole", "left", "words", "n"])


def mined(longest: int, minimum: int, lot: int):
    """For fragments in the order of language and pivot (lang, phrase, n), of phrases that are too rare only where others may add to them."""

    def counts(parts: list[pa.RecordBatch], open_ends: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        langs = whole["lang"].combine_chunks().dictionary_encode()
        at = langs.indices.to_numpy()
        pivots = whole["pivot"].to_numpy()
        complete = whole["whole"].to_numpy(zero_copy_only=False).astype(bool)
        if open_ends[0]:
            complete &= pivots != pivots[0]
        if open_ends[1]:
            complete &= pivots != pivots[-1]
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(at == k)
            part = whole.take(pa.array(own))
            row, n, place = phrases_in(part["left"].to_numpy().astype(np.int64), part["words"].combine_chunks(), part["n"].to_numpy(), longest)
            kept = np.flatnonzero((n >= minimum) | ~complete[own][row])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), type=pa.string()), pa.array(spelled(place, kept), type=pa.string()), pa.array(n[kept])], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows, was_open = 0, False
        for lists in batches:
            batch = single(lists)
            while batch.num_rows:
                waiting.append(batch.slice(0, lot - rows))
                batch = batch.slice(lot - rows)
                rows += waiting[-1].num_rows
                if rows < lot:
                    continue
                # The last pivot waits for its other fragments, unless it fills the lot.
                pivots = np.concatenate([x.column(1).to_numpy() for x in waiting])
                cut = int(np.flatnonzero(pivots != pivots[-1])[-1]) + 1 if (pivots != pivots[-1]).any() else rows
                table = pa.Table.from_batches(waiting)
                yield from counts(table.slice(0, cut).to_batches(), (was_open, cut == rows))
                was_open, waiting = cut == rows, table.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield from counts(waiting, (was_open, False))

    return run


def phrase_counts(pieces: DataFrame, longest: int, minimum: int, lot: int = LOT) -> DataFrame:
    """(lang, phrase, a) of the phrases of fragments() that are frequent."""
    dealt = pieces.repartition("lang", "pivot", "salt").sortWithinPartitions("pivot", "lang", "salt")
    made = dealt.select("lang", "pivot", "whole", "fragments").mapInArrow(mined(longest, minimum, lot), "lang string, phrase string, n long")
    return made.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= minimum)


def scored(candidates: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the lowest-scoring cut. frequent: (lang, word, n), totals: (lang, n)."""
    counted = frequent.select("lang", F.col("word").alias("part"), "n").unionByName(candidates.select("lang", F.col("phrase").alias("part"), F.col("a").alias("n")))
    counted = common.stored(counted, "parts")
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = common.stored(cuts.join(counted.select("lang", F.col("part").alias(part), F.col("n").alias(name)), ["lang", part]).drop(part), "cuts")
    exact = "(1000 * (cast(a as decimal(18, 0)) * cast(n as decimal(18, 0)))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    each = cuts.join(sized(totals), "lang").withColumn("score", F.expr(exact))
    best = each.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def absorbed(candidates: DataFrame, percent: int) -> DataFrame:
    """The candidates (lang, phrase) inside a longer one that is nearly as frequent."""
    words = F.split("phrase", " ")
    longer = candidates.filter(F.size(words) > 2).select("lang", F.col("a").alias("most"), words.alias("words"))
    longer = longer.select("lang", "most", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    longer = longer.select("lang", "most", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i"))
    inside = longer.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("most").alias("most"))
    return candidates.join(common.stored(inside, "inside"), ["lang", "phrase"]).filter(100 * F.col("most") >= percent * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, minimum: int = MINIMUM, top: int = TOP, percent: int = ABSORBED, cells: int = CELLS, pairs: int = PAIRS, split: int = SPLIT, lot: int = LOT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases. docs needs text and lang."""
    with common.temporaries(docs.sparkSession):
        words = common.stored(word_counts(docs), "words")
        totals = common.stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent = common.stored(words.filter(F.col("n") >= minimum), "frequent")
        table = rarity(frequent, cells)
        pieces = fragments(docs, table, frequent_pairs(docs, table, minimum, pairs), longest, minimum, split, lot)
        candidates = common.stored(phrase_counts(pieces, longest, minimum, lot), "candidates")
        staying = scored(candidates, frequent, totals).join(common.stored(absorbed(candidates, percent), "absorbed"), ["lang", "phrase"], "left_anti")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = staying.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return common.stored(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def op13_phrases(spark, sf_dir) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


LETTERS = UPPER.decode()
ORACLE_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS words FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3), (4), (5)) AS sizes(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, any_value(words) AS words, count(*) AS a FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
known AS MATERIALIZED (SELECT * FROM f WHERE a >= {MINIMUM}),
candidates AS (SELECT * FROM known WHERE k > 1),
cuts AS MATERIALIZED (SELECT lang, phrase, a, c, array_to_string(words[1 : c], ' ') AS head, array_to_string(words[c + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scores AS (SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n, c, CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts JOIN totals USING (lang) JOIN known x ON x.lang = cuts.lang AND x.phrase = cuts.head JOIN known y ON y.lang = cuts.lang AND y.phrase = cuts.rest),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scores),
parts AS MATERIALIZED (SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, words, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL),
inside AS (SELECT lang, phrase FROM candidates JOIN parts USING (lang, phrase) WHERE 100 * most >= {ABSORBED} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
