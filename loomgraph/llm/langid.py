"""Language identification (operator 6).

A bidirectional gated recurrent network reads the bytes of a text, whatever they are, and labels every position
with language probabilities; a document's probabilities are their mean over all its positions. It is trained
here, in numpy, by backpropagation through time.

Whole texts are read, in windows of CORE positions side by side, so that many are read at once. Before and after
these, the network runs over RUN_IN more bytes of the text, so its state at a position comes from that many
bytes at least on both sides, across words and windows; beyond the text there are spaces.

It is fitted on at most WINDOWS windows of TRAINED bytes of each of at most LANGUAGES languages (the most
frequent), drawn by hash from the whole texts of at most DOCS_PER_LANGUAGE documents of each, before they come to
the driver.

Nulls and texts without a letter are `und`, score 0. Rows without a language aren't learned from; if
none has one, all are `und`. Ties go to the language that sorts first. Repeated rows give repeated
rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LANGUAGES, DOCS_PER_LANGUAGE, WINDOWS, TRAINED = 200, 200, 4000, 48
CORE, RUN_IN = 120, 12
#: Windows that are read at once.
AT_ONCE = 1024
HIDDEN = 8
STEPS = 220
BATCH = 192
UNKNOWN = "und"
#: Bytes of text that are cut into windows at once, or one document if it is longer.
SLICE_BYTES = 1 << 20
LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """One GRU for each direction and the output layer.

    Of a direction: input weights by byte of the update gate (z), the reset gate (r) and the candidate (m), the
    recurrent ones (uz, ur, um) and a bias of the candidate's recurrent part (c).
    """

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            for gate in "zrm":
                w[gate + d] = rng.normal(0, 0.3, (256, hidden)).astype("f4")
                w["u" + gate + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype("f4")
            w["c" + d] = np.zeros(hidden, dtype="f4")
        w["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(langs))).astype("f4")
        w["b"] = np.zeros(len(langs), dtype="f4")
        return cls(langs, w)

    def run(self, text: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction at each position of text (position, window), and what its backward pass needs."""
        z_in, r_in, m_in, uz, ur, um, c = (self.weights[k + d] for k in ("z", "r", "m", "uz", "ur", "um", "c"))
        h = np.zeros((text.shape[1], len(uz)), dtype=uz.dtype)
        out, steps = np.empty((*text.shape, len(uz)), dtype=uz.dtype), []
        for t in range(len(text)) if d == "f" else range(len(text) - 1, -1, -1):
            z, r = sigmoid(z_in[text[t]] + h @ uz), sigmoid(r_in[text[t]] + h @ ur)
            q = h @ um + c
            m = np.tanh(m_in[text[t]] + r * q)
            new = m + z * (h - m)
            if keep:
                steps.append((t, h, z, r, q, m))
            out[t] = h = new
        return out, steps

    def probabilities(self, text: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Of each language at positions first to last (exclusive), shaped (position, window, language)."""
        y = np.concatenate([self.run(text, d)[0][first:last] for d in "fb"], axis=2) @ self.weights["o"] + self.weights["b"]
        y = np.exp(np.clip(y, -80, 80))
        return y / (y @ np.ones((y.shape[2], 1), dtype=y.dtype))

    def gradients(self, text: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over all positions; target: the language of each window."""
        w, n = self.weights, len(self.weights["umf"])
        runs = {d: self.run(text, d, keep=True) for d in "fb"}
        h = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        y = h @ w["o"] + w["b"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        y[:, np.arange(text.shape[1]), target] -= 1
        y /= text.size
        grads = {"o": h.reshape(-1, 2 * n).T @ y.reshape(-1, y.shape[2]), "b": y.sum(axis=(0, 1))}
        dh_out = y @ w["o"].T
        for k, d in enumerate("fb"):
            own = {name: np.zeros_like(w[name + d]) for name in ("z", "r", "m", "uz", "ur", "um", "c")}
            dh = np.zeros((text.shape[1], n), dtype=h.dtype)
            for t, before, z, r, q, m in reversed(runs[d][1]):
                dh = dh + dh_out[t][:, k * n : (k + 1) * n]
                dm = dh * (1 - z) * (1 - m * m)
                dz, dr, dq = dh * (before - m) * z * (1 - z), dm * q * r * (1 - r), dm * r
                for name, x in (("z", dz), ("r", dr), ("m", dm)):
                    np.add.at(own[name], text[t], x)
                for name, x in (("uz", dz), ("ur", dr), ("um", dq)):
                    own[name] += before.T @ x
                own["c"] += dq.sum(axis=0)
                dh = dh * z + dz @ w["uz" + d].T + dr @ w["ur" + d].T + dq @ w["um" + d].T
            grads |= {name + d: g for name, g in own.items()}
        return grads

    def fit(self, windows: np.ndarray, targets: np.ndarray, steps: int, batch: int, seed: int, rate: float = 0.02) -> None:
        """Adam over batches of windows (window, position) in which each language has the same share."""
        rng = np.random.default_rng(seed)
        own = [np.flatnonzero(targets == k) for k in range(len(self.langs))]
        mean, square = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, max(1, batch // len(own))) for rows in own])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradients(windows[pick].T, targets[pick]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.weights[k] -= pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)


def windows_of(texts: list[bytes], core: int, run_in: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The windows (window, position) of core bytes of texts side by side, with run_in bytes on both sides; and how many each text has."""
    counts = np.array([-(-len(t) // core) for t in texts], dtype=np.int64)
    edge = b" " * run_in
    data = np.frombuffer(b"".join(edge + t.ljust(int(k) * core) + edge for t, k in zip(texts, counts, strict=True)), dtype=np.uint8)
    firsts = np.cumsum(counts * core + 2 * run_in) - (counts * core + 2 * run_in)
    starts = np.repeat(firsts - (np.cumsum(counts) - counts) * core, counts) + np.arange(counts.sum()) * core
    return data[starts[:, None] + np.arange(core + 2 * run_in)], counts


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network from rows with doc_id, text and lang; None where nothing can be learned."""
    sample = common.bounded_sample(labelled.select("doc_id", "text", "lang").filter("text is not null"), "lang", "doc_id", docs_per_language, LANGUAGES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _ = windows_of([text.encode()], TRAINED)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([doc_id] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["lang", "doc_id", "k", "window"])

    pieces = sample.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(cut, "lang string, doc_id long, k long, window binary")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "window")
    rows = pieces.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= WINDOWS).select("lang", "window").collect()
    rows = sorted((r.lang, bytes(r.window)) for r in rows)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    net = Network.fresh(langs, HIDDEN, seed)
    net.fit(np.frombuffer(b"".join(x for _, x in rows), dtype=np.uint8).reshape(len(rows), -1), np.array([langs.index(lang) for lang, _ in rows]), steps, BATCH, seed)
    return net


def read(net: Network, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language of each text, and its mean probability over all positions."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()
    totals = np.zeros((len(raw), len(net.langs)))
    windows, counts = windows_of(raw, CORE, RUN_IN)
    owner = np.repeat(np.arange(len(raw)), counts)
    sizes = np.array([len(t) for t in raw], dtype=np.int64)
    # How many positions of each window are of the text.
    inside = np.minimum(CORE, sizes[owner] - (np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]) * CORE)
    for at in range(0, len(windows), AT_ONCE):
        p = net.probabilities(np.ascontiguousarray(windows[at : at + AT_ONCE].T), RUN_IN, RUN_IN + CORE)
        p *= (np.arange(CORE)[:, None] < inside[at : at + AT_ONCE])[:, :, None]
        np.add.at(totals, owner[at : at + AT_ONCE], p.sum(axis=0))
    best = np.argmax(totals, axis=1)
    scores = np.clip(totals[np.arange(len(raw)), best] / np.maximum(sizes, 1), 0, 1)
    known = [bool(t and LETTER.search(t)) for t in texts.to_pylist()]
    return [net.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], np.where(known, scores, 0.0).tolist()


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""

    def make():
        def step(ids, texts):
            langs, scores = read(net, texts) if net else ([UNKNOWN] * len(ids), [0.0] * len(ids))
            return {"doc_id": ids, "lang_pred": langs, "score": scores}

        return step

    return common.map_arrow(docs, make, "doc_id long, lang_pred string, score double", SLICE_BYTES)


def drop_unknown(docs: DataFrame, net: Network | None, least: float = 0.0) -> DataFrame:
    """The rows of docs whose language is known, with a score of at least `least`."""
    common.small_batches(docs.sparkSession)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, SLICE_BYTES, text_at):
                langs, scores = read(net, part.column(text_at)) if net else ([], [])
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)] if net else [False] * part.num_rows, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that the language model may learn from."""
    return docs.filter(common.crc_mod("doc_id", 4) != 2)


def op6_language_id(spark, sf_dir) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False))
    return predict(docs, fit(learnable(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
