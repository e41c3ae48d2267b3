"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "lang string, text string, word string, n string, h string, phrase string, a string, pivot string, whole string, doc_id string"


def table(spark, rows):
    return spark.createDataFrame([(lang, text, *["x"] * 8) for lang, text in rows], SCHEMA).repartition(4)


def plain(rows, minimum, top=2000, longest=5, percent=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= minimum}
        inside = {p[i : i + k] for p, b in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= percent * candidates[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if p not in inside:
                found.append((-score, -a, " ".join(p).encode(), (lang, " ".join(p), a, left, right, n[lang], score)))
        out += [(x[0], rank, *x[1:]) for rank, (*_, x) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def texts():
    r = random.Random(8)
    rows = [(None, None), ("en", ""), ("en", " .\t,; "), ("", "an empty name of a language an empty name"), (None, "nobody says, nobody says. Nobody says"), ("de", "É é É é É é É é É é \x85   x")]
    words = ["The", "the", "of", "cat", "sat", "on", "mat", "rare", "é", "日本", "a b"]
    for k in range(300):
        weights = [8, 8, 6, 3, 3, 3, 2, 0.05, 1, 1, 1]
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ", ", ".\n"]) for w in r.choices(words, weights, k=r.randint(1, 60)))
        rows.append((("en", "de", None)[k % 3], text))
    rows += [("en", "the same passage over and over again " * 40)] * 3
    return rows


@pytest.mark.parametrize("options", [{}, {"cells": 2, "pairs": 8}, {"cells": 16, "pairs": 64, "split": 50}, {"lot": 40}, {"lot": 7, "split": 100, "cells": 64}, {"percent": 60, "top": 15}])
def test_collocations_equal_plain_counts(spark, options):
    """Whatever the words' order (few cells), pivots over several tasks and lots that end within a pivot."""
    rows = texts()
    got = found(phrases.collocations(table(spark, rows), minimum=8, **options))
    assert got == plain(rows, 8, **{k: v for k, v in options.items() if k in ("top", "percent")})
    assert len(got) > 20


def test_other_lengths_and_thresholds(spark):
    rows = texts()
    assert found(phrases.collocations(table(spark, rows), longest=3, minimum=2)) == plain(rows, 2, longest=3)


def test_empty_table_and_texts_without_frequent_words(spark):
    assert found(phrases.collocations(table(spark, []))) == []
    assert found(phrases.collocations(table(spark, [("en", "too few words here"), (None, None)]))) == []


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_each_phrase_is_owned_once(share):
    """The fragments of a piece hold each phrase of frequent words and pairs once, around its rarest word's first place."""
    r = np.random.default_rng(1)
    rank, joined = r.integers(-1, 6, 400), r.random(400) < share
    left, right = phrases.reaches(rank, joined, 5)
    owned = Counter((p - x, p + y) for p in np.flatnonzero(rank >= 0) for x in range(left[p] + 1) for y in range(right[p] + 1) if 1 < x + y + 1 <= 5)
    want = Counter((i, j) for i in range(400) for j in range(i + 1, min(400, i + 5)) if (rank[i : j + 1] >= 0).all() and joined[i + 1 : j + 1].all())
    assert owned == want


def test_phrases_of_equal_hashes_are_told_apart(monkeypatch):
    """Should two phrases share a hash, the words decide."""

    class Same:
        def integers(self, low, high, n, dtype):
            return np.zeros(n, dtype=dtype)

    monkeypatch.setattr(phrases.np.random, "default_rng", lambda seed: Same())
    row, n, place = phrases.phrases_in(np.array([0, 1, 0]), pa.array(["a b c", "b a", "a b"]), np.array([2, 3, 5]), 5)
    assert dict(zip(phrases.spelled(place, np.arange(len(n))), n.tolist(), strict=True)) == {"a b": 7, "a b c": 2, "b a": 3}


def test_scores_beyond_64_bits(spark):
    """f n beyond 64 bits, at quotients that floating point would round."""
    many = 123_456_789_012_345
    candidates = spark.createDataFrame([("en", "p q", many)], "lang string, phrase string, a long")
    words = [("en", "p", many + 7), ("en", "q", 3 * many + 1)]
    frequent = spark.createDataFrame(words, "lang string, word string, n long")
    total = 987_654_321_098_765
    got = phrases.scored(candidates, frequent, spark.createDataFrame([("en", total)], "lang string, n long")).collect()
    assert [r.score for r in got] == [1000 * many * total // (words[0][2] * words[1][2])]
    n = words[0][2] * words[1][2] // 1000
    exact = phrases.scored(spark.createDataFrame([("en", "p q", 1000)], "lang string, phrase string, a long"), spark.createDataFrame([("en", "p", 10**9), ("en", "q", 10**9 - 1)], "lang string, word string, n long"), spark.createDataFrame([("en", 10**17 - 1)], "lang string, n long")).collect()
    assert n and exact[0].score == 1000 * 1000 * (10**17 - 1) // (10**9 * (10**9 - 1))
