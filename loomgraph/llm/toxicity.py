"""Toxicity scores (operator 10): gradient-boosted trees over dense features of whole texts.

Features are densities of words of a learned lexicon and of learned word stems (insults take endings),
the same after undoing obfuscation (`1d10t`, `i.d.i.o.t`), how near such words stand to the second
person, how many lie in one stretch of STRETCH words, the share of words in capitals, of exclamation and
question marks and of obfuscated words, and the length. Trees are grown on binned features by second-order
gains of the logistic loss; scores are calibrated by isotonic regression on folds that the trees of the
fold haven't seen. A word or stem enters the lexicon if it is far more frequent among toxic documents
than chance allows (Chernoff bound below CHANCE).

It is fitted on the whole texts of at most LABELLED documents of each label: words and stems are counted and
features made in distributed passes, and the driver gets counts and numbers. Rows are weighted so that the
sample has the labels' true shares.

Nulls: a null text scores as an empty one. Without labelled rows all scores are 0; with one label only
they are that label. Repeated rows give repeated rows. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LABELLED = 3000
CHANCE = 1e-7
STEM_LENGTHS = range(4, 9)
STEM_PRECISION = 0.95
NEAR = 5
STRETCH = 50
TREES, DEPTH, RATE, BINS, MIN_LEAF = 60, 3, 0.2, 32, 8
FOLDS = 3
LEX, STEM, YOU, CAPS, ODD, HIDDEN = 1, 2, 4, 8, 16, 32
#: Words for the second person in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros tus su sus os".split())
#: Signs that stand for letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGES = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$")
SIGNS = regex.compile(r"[^\p{L}]")
TRIPLE = regex.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    return EDGES.sub("", word).lower()


def unmasked(word: str) -> str:
    """The word with signs read as letters, other signs dropped and long runs of a letter shortened."""
    return TRIPLE.sub(r"\1", SIGNS.sub("", word.translate(DISGUISES)))


def unlikely(k: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """Bound on the chance of k or more of n documents being toxic, if the share is the prior."""
    p = np.clip(k / n, 1e-12, 1 - 1e-12)
    kl = p * np.log(p / prior) + (1 - p) * np.log((1 - p) / (1 - prior))
    return np.where(k / n > prior, np.exp(-n * kl), 1.0)


@dataclass
class Lexicon:
    words: frozenset
    stems: frozenset

    def has_stem(self, word: str) -> bool:
        return any(word[:k] in self.stems for k in STEM_LENGTHS)

    @classmethod
    def learn(cls, texts: DataFrame, labels: dict[int, list[int]], prior: float) -> Lexicon:
        """From the texts of labelled ids; labels has the numbers of rows labelled 0 and 1 of each id."""

        def make():
            def step(ids, texts):
                counts: dict[tuple[str, bool], list[int]] = {}
                for i, t in zip(ids, texts, strict=True):
                    clean, toxic = labels[i]
                    words = {p for w in set((t or "").split()) if (p := plain(w))}
                    stems = {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k}
                    for name in [*((w, False) for w in words), *((x, True) for x in stems)]:
                        n = counts.setdefault(name, [0, 0])
                        n[0] += toxic
                        n[1] += clean
                return {"name": [x for x, _ in counts], "stem": [x for _, x in counts], "inside": [n for n, _ in counts.values()], "outside": [n for _, n in counts.values()]}

            return step

        counts = common.map_texts(texts, make, "name string, stem boolean, inside long, outside long").groupBy("name", "stem").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        # A precision below a half is never enough.
        found = counts.filter("inside >= 3 and inside >= outside").collect()
        prior = min(max(prior, 1e-6), 1 - 1e-6)

        def chosen(stem: bool, precision: float) -> set:
            rows = [r for r in found if r.stem == stem]
            k = np.array([r.inside for r in rows], dtype=float)
            n = k + np.array([r.outside for r in rows], dtype=float)
            return {r.name for r, ok in zip(rows, (unlikely(k, n, prior) < CHANCE) & (k / n >= precision), strict=True) if ok}

        words = chosen(False, max(0.5, (1 + prior) / 2))
        stems = chosen(True, max(STEM_PRECISION, (1 + prior) / 2))
        return cls(frozenset(words), frozenset(x for x in stems if not any(x[:k] in stems for k in STEM_LENGTHS if k < len(x))))

    def mark(self, raw: bytes) -> int:
        text = raw.decode()
        word = plain(text)
        if not word:
            return 0
        out = YOU if word in SECOND_PERSON else 0
        if word in self.words:
            out |= LEX
        if self.has_stem(word):
            out |= STEM
        if len(word) > 1 and text.isupper():
            out |= CAPS
        if not word.isalpha():
            bare = unmasked(word)
            if bare and bare != word and any(c.isalpha() for c in word):
                out |= ODD
                if bare in self.words or self.has_stem(bare):
                    out |= HIDDEN
        elif TRIPLE.search(word):
            bare = unmasked(word)
            out |= ODD | (HIDDEN if bare in self.words or self.has_stem(bare) else 0)
        return out


def features(lexicon: Lexicon, texts: pa.Array, cache: common.WordCache | None = None) -> np.ndarray:
    """A row of features for each text."""
    words = common.words_of(texts)
    marks = np.array(cache.of(words.distinct) if cache else [lexicon.mark(w) for w in words.distinct], dtype=np.uint8)
    flags = np.stack([(marks & bit) > 0 for bit in (LEX, STEM, YOU, CAPS, ODD, HIDDEN)], axis=1).astype(np.int64) if len(marks) else np.zeros((0, 6), dtype=np.int64)
    lex, stem, you, caps, odd, hidden = words.sums(flags).T
    n = np.diff(words.starts)
    per = np.maximum(n, 1)
    each = marks[words.codes]
    bad = np.flatnonzero(each & (LEX | STEM | HIDDEN))
    doc = np.searchsorted(words.starts, bad, side="right") - 1
    first, last = words.starts[doc], words.starts[doc + 1]
    yous = np.concatenate([[0], np.cumsum((each & YOU) > 0)])
    bads = np.concatenate([[0], np.cumsum((each & (LEX | STEM | HIDDEN)) > 0)])
    near = (yous[np.minimum(bad + NEAR + 1, last)] - yous[np.maximum(bad - NEAR, first)]) > 0
    close = np.bincount(doc, weights=near, minlength=len(n))
    dense = np.zeros(len(n))
    np.maximum.at(dense, doc, bads[np.minimum(bad + STRETCH, last)] - bads[bad])
    raw = [(t or "").encode() for t in texts.to_pylist()]
    marks_of = [np.array([t.count(sign) for t in raw], dtype=float) for sign in (b"!", b"?")]
    return np.stack([lex / per, np.log1p(lex), stem / per, np.log1p(stem), hidden / per, np.log1p(hidden), close / per, dense, you / per, caps / per, odd / per, *(m / per for m in marks_of), np.log1p(n)], axis=1)


@dataclass
class Boosted:
    """Trees of fixed depth; node k has children 2 k + 1 and 2 k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        p = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        model = cls(float(np.log(p / (1 - p))), *([] for _ in range(3)))
        score = np.full(len(y), model.base)
        inner = 2**DEPTH - 1
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            g, h = weight * (y - q), weight * np.maximum(q * (1 - q), 1e-9)
            f, t, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
            cut = np.full(inner, BINS + 1)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * MIN_LEAF:
                    best = 1e-6
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j, e in enumerate(edges):
                        size = len(e) + 1
                        b = binned[rows, j]
                        gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], None))
                        ok = (nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF)
                        gain = np.where(ok, gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1), 0)
                        if len(gain) and gain.max() > best:
                            best, f[k], cut[k] = gain.max(), j, int(np.argmax(gain))
                            t[k] = e[cut[k]]
                node[rows] = 2 * k + 1 + (binned[rows, f[k]] > cut[k])
            leaf = node - inner
            v = RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
            score += v[leaf]
            for to, what in ((model.feature, f), (model.threshold, t), (model.value, v)):
                to.append(what)
        model.feature, model.threshold, model.value = np.array(model.feature), np.array(model.threshold), np.array(model.value)
        return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the non-decreasing shares of ones there."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of weights, of weighted ones, first and last score
    for s, t, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([w, w * t, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2], high]
    at = np.array([x for b in blocks for x in b[2:]])
    return at, np.array([x for b in blocks for x in [b[1] / b[0]] * 2])


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: Boosted | None
    at: np.ndarray
    share: np.ndarray
    constant: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        raw = self.trees.raw(x)
        # A small part of the uncalibrated score keeps the order within the steps.
        return np.clip(0.98 * np.interp(raw, self.at, self.share) + 0.02 / (1 + np.exp(-raw)), 0, 1)

    @classmethod
    def learn(cls, lexicon: Lexicon, x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, seed: int = 5) -> Scorer:
        y = toxic.astype(float)
        fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
        held = np.zeros(len(y))
        for k in range(FOLDS):
            rest = fold != k
            held[~rest] = Boosted.fit(x[rest], y[rest], weight[rest]).raw(x[~rest])
        return cls(lexicon, Boosted.fit(x, y, weight), *isotonic(held, y, weight))

    @classmethod
    def always(cls, value: float) -> Scorer:
        return cls(Lexicon(frozenset(), frozenset()), None, np.zeros(0), np.zeros(0), value)


def featured(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and x, the features of each whole text."""

    def make():
        cache = common.WordCache(lambda words: [lexicon.mark(w) for w in words], 150_000)
        return lambda ids, texts: {"doc_id": ids, "x": features(lexicon, texts, cache).tolist()}

    return common.map_arrow(texts, make, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Scorer:
    """A scorer from labels (doc_id, toxic) of 0 and 1; no more than 2 x labelled ids come to the driver and are sent out."""
    labels = labels.select(F.col("doc_id").alias("_id"), "toxic").filter("_id is not null and toxic in (0, 1)")
    true = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    of_id: dict[int, list[int]] = {}
    for r in common.bounded_sample(labels, "toxic", "_id", labelled).collect():
        of_id.setdefault(r[0], [0, 0])[r[1]] += 1
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(of_id)], "_id long")
    texts = common.stored(common.id_and_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi"), "labelled")
    there = [of_id[r[0]] for r in texts.select("doc_id").collect()]
    clean, bad = (sum(n[y] for n in there) for y in (0, 1))
    if not clean or not bad:
        return Scorer.always(float(bad > 0))
    lexicon = Lexicon.learn(texts, of_id, bad / (clean + bad))
    rows = sorted((r.doc_id, y, r.x) for r in featured(texts, lexicon).collect() for y in (0, 1) for _ in range(of_id[r.doc_id][y]))
    toxic = np.array([y for _, y, _ in rows], dtype=int)
    weight = np.array([true[y] / (bad if y else clean) for y in toxic.tolist()])
    return Scorer.learn(lexicon, np.array([x for _, _, x in rows]), toxic, weight / weight.mean())


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score and predicted of each whole text."""

    def make():
        cache = common.WordCache(lambda words: [scorer.lexicon.mark(w) for w in words], 150_000)

        def step(ids, texts):
            s = scorer.score(features(scorer.lexicon, texts, cache))
            return {"doc_id": ids, "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return step

    return common.map_arrow(docs, make, "doc_id long, score double, predicted int")


def op10_toxicity(spark, sf_dir) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(common.crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
