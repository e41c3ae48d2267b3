"""Quality rules (operator 4): a learned decision list over statistics of whole texts.

Sequential covering: a rule is a conjunction of thresholds on statistics, grown condition by condition
by FOIL's gain on two thirds of the labelled rows, then pruned on the last third; the rows it covers are
taken away, and the next rule is learned, until a rule no longer names bad documents precisely enough
on rows that it wasn't grown on. The rules become one ordered chain of Spark conditions.

Words are `[^\\x20\\x09-\\x0D]+`. The base rules reject texts of fewer than 20 words and those in which
over 30 % of the words lie in 8-word windows that the text repeats.

It is fitted on at most LABELLED documents of each quality value.

Nulls: a null text has no words and fails the base rules. Without labels of both kinds no rule is
learned. Ties between conditions go to the statistic that is listed first, then the lower threshold.
Repeated rows give repeated rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LABELLED = 5000
#: The least precision of a rule on rows that it wasn't grown on.
PRECISION = 0.9
MIN_COVER = 3
MAX_RULES = 12
MAX_CONDITIONS = 4
WINDOW = 8
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_exclaims", "n_pipes", "n_stops", "n_distinct")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

#: What the rules may ask about: ratios of counts.
FEATURES = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "upper_per_lower": ("n_upper", "n_lower"),
    "digits_per_char": ("n_digits", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of words that occurs twice or more.

    Windows are named exactly: each pair of neighbouring names gets a name of its own, three times over.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        _, names = np.unique(names[: len(names) - step] * (n + 1) + names[step:], return_inverse=True)
        reach += step
    counts = np.bincount(names)
    if len(counts) == len(names):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[names] > 1)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text or "") - without(raw, SPACES),
        without(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(raw, UPPER),
        without(raw, LOWER),
        without(raw, DIGITS),
        raw.count(b"!"),
        raw.count(b"|"),
        raw.count(b". ") + raw.count(b".\n"),
        len(set(words)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each whole text."""

    def make():
        def step(ids, texts):
            rows = [counts_of(t) for t in texts]
            return {"doc_id": ids} | {c: list(x) for c, x in zip(COUNTS, zip(*rows, strict=True), strict=True)}

        return step

    return common.map_texts(docs, make, SCHEMA)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        top, under = FEATURES[self.feature]
        value = F.col(top) / F.greatest(F.col(under), F.lit(1))
        return value >= self.threshold if self.above else value <= self.threshold

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:g}"


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for c in rule:
        hit &= c.test(x)
    return hit


def grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    """Add the condition of the highest FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and (~bad[rows]).any():
        base = np.log2(max(1e-9, bad[rows].mean()))
        best, gain = None, 1e-9
        for name, values in x.items():
            v = values[rows]
            order = np.argsort(v, kind="stable")
            v, b = v[order], bad[rows][order]
            cut = np.flatnonzero(v[1:] > v[:-1])  # between this row and the next
            if not len(cut):
                continue
            p = np.cumsum(b)[cut]
            for above in (True, False):
                pos, total = (b.sum() - p, len(b) - cut - 1) if above else (p, cut + 1)
                g = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / total) - base), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    gain = g[k]
                    best = Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        rows = rows[best.test({best.feature: x[best.feature][rows]})]
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Leave away last conditions while that doesn't lower (bad - good) / covered on other rows."""

    def worth(r: list[Condition]) -> float:
        hit = covers(r, x, len(bad))
        return (bad[hit].sum() - (~bad[hit]).sum()) / hit.sum() if hit.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, seed: int = 11) -> list[list[Condition]]:
    """The ordered rules that name bad rows."""
    rules: list[list[Condition]] = []
    rng = np.random.default_rng(seed)
    left = np.arange(len(bad))
    while len(rules) < MAX_RULES and bad[left].sum() >= MIN_COVER:
        part = rng.permutation(left)
        # Both parts get their share of the bad rows.
        part = part[np.argsort(bad[part], kind="stable")]
        held = part[::3]
        own = np.setdiff1d(part, held)
        rule = grow(x, bad, own)
        if not rule:
            break
        rule = prune(rule, {k: v[held] for k, v in x.items()}, bad[held])
        hit_held, hit_all = covers(rule, {k: v[held] for k, v in x.items()}, len(held)), covers(rule, {k: v[left] for k, v in x.items()}, len(left))
        if hit_all.sum() < MIN_COVER or not hit_held.any() or bad[held][hit_held].mean() < precision or bad[left][hit_all].mean() < precision:
            break
        rules.append(rule)
        left = left[~hit_all]
    return rules


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> list[list[Condition]]:
    """Rules from a bounded sample of the labelled documents; no more than 2 x labelled ids are broadcast."""
    sample = common.bounded_sample(labels.select(F.col("doc_id").alias("_id"), "quality").filter("_id is not null and quality in (0, 1)"), "quality", "_id", labelled)
    texts = common.id_and_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = statistics(texts).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id").toPandas().sort_values(["doc_id", "quality"])
    x = {name: (rows[a] / rows[b].clip(lower=1)).to_numpy(dtype=float) for name, (a, b) in FEATURES.items()}
    return learn(x, (rows["quality"] == 0).to_numpy())


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule names the document bad."""
    if not rules:
        return F.lit(True)
    chain = F
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        chain = chain.when(test, False)
    return chain.otherwise(True)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Statistics of each document, whether the base rules reject it and whether it is kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark, sf_dir) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
