"""Packing documents into training windows (operator 9).

Order-preserving dynamic programming. The documents of a partition form one stream of tokens, in
their order; cut points are the ends of documents and sentences, every number of full windows after the end
of a document, and every WINDOW tokens inside a longer sentence. With c the cut points in order,

    f(j) = min over i with c[j] - c[i] <= WINDOW of f(i) + padding(c[j] - c[i]) + penalty(j)

where a cut at a document's end costs nothing, at a sentence's end SENTENCE_COST and elsewhere
HARD_COST. Padding is linear, so f(j) needs the smallest f(i) + c[i] of a sliding window, which a
monotone queue keeps: linear time.

The stream of a partition is worked off in blocks of tokens and of documents, so memory is bounded by a block and
the longest document. There is no shuffle: partitions are packed by themselves, and what is left at the end of
one is cut into powers of two, which need no padding.

Nulls: a null text is an empty document, which is the one closing token. Repeated rows are packed
as often as they occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .common import byte_alphabet, vocabulary_path

WINDOW = 2048
SENTENCE_COST = 4
HARD_COST = 12
END_ID = 1
#: Tokens, and documents, of a partition that are worked on at once.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 1 << 17
#: Letters of ASCII and Latin-1 in UTF-8.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """The ids of texts by the tokenizers library, word by word.

    The tokenizer drops white space and none of its rules looks across it, so the ids of a text are
    those of its words in turn; frequent words are encoded once. Words here end at ASCII white space;
    whatever else counts as a space is left to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache = common.WordCache(self._encode)
        ends = [t for w, t in self.library.get_vocab().items() if w.removesuffix("</w>") and not w.removesuffix("</w>").strip(".!?")]
        self.is_end = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.is_end[ends] = True
        self.shown = dict(enumerate(byte_alphabet()))

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Words of plain letters are one word to the tokenizer too, so they go straight to its model."""
        out: list[bytes | None] = [None] * len(words)
        model, shown = self.library.model.tokenize, self.shown
        for k, w in enumerate(words):
            if w.isalpha():
                out[k] = array("I", [t.id for t in model(w.lower().decode())]).tobytes()
            elif PLAIN.fullmatch(w):
                out[k] = array("I", [t.id for t in model(w.decode().lower().encode().decode("latin-1").translate(shown))]).tobytes()
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            found = self.library.encode_batch([words[k].decode() for k in rest], add_special_tokens=False)
            for k, e in zip(rest, found, strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # the added tokens tell upper case
            texts = pc.ascii_lower(texts)
        # A letter and a mark before a space are never in one word of the tokenizer; told apart, they make fewer words.
        words = common.words_of(pc.replace_substring_regex(texts, "([a-zà-öø-ÿ])([.,])([ \n])", r"\1 \2\3"))
        return common.gather(self.cache.of(words.distinct), words)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_cuts(points: list[int], costs: list[float], window: int = WINDOW) -> list[int]:
    """Indices into points (sorted, the first is the start, gaps of at most window) of the cheapest cuts, ends included."""
    n = len(points)
    key, back = [0.0] * n, [0] * n
    key[0] = points[0]
    queue, head = [0], 0
    for j in range(1, n):
        at = points[j]
        while at - points[queue[head]] > window:
            head += 1
        i = queue[head]
        back[j] = i
        key[j] = k = key[i] + window + costs[j]  # f(j) + points[j]
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Takes documents in order and gives the rows of finished windows."""

    def __init__(self, is_end: np.ndarray, window: int, sentence_cost: float, hard_cost: float, first_sequence: int):
        self.is_end, self.window, self.costs, self.sequence = is_end, window, (sentence_cost, hard_cost), first_sequence
        self.docs: list[list] = []  # doc_id, ids, where its pending ids start, where they start in the stream
        self.length = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.length += len(ids)

    def _points(self) -> tuple[list[int], list[float]]:
        """Cut points of the pending stream, and what a cut there costs."""
        n, w = self.length, self.window
        kind = np.full(n + 1, 3, dtype=np.int8)
        stream = np.concatenate([ids[start:] for _, ids, start in self.docs])
        ends = np.cumsum([len(ids) - start for _, ids, start in self.docs])
        kind[1:][self.is_end[np.minimum(stream, len(self.is_end) - 1)]] = 1
        kind[ends] = 0
        kind[0] = 0
        soft = np.flatnonzero(kind < 2)
        # Full windows after the end of a document: in rows of a window each, everything below one in its column.
        below = np.zeros(-(-(n + 1) // w) * w, dtype=bool)
        below[ends], below[0] = True, True
        below = np.logical_or.accumulate(below.reshape(-1, w), axis=0).ravel()[: n + 1]
        kind[below & (kind == 3)] = 2
        for g in np.flatnonzero(np.diff(soft) > w):
            inside = kind[soft[g] + w : soft[g + 1] : w]
            inside[inside == 3] = 2
        points = np.flatnonzero(kind < 3)
        return points.tolist(), np.array([0.0, *self.costs])[kind[points]].tolist()

    def flush(self, last: bool) -> list[tuple]:
        """Rows of the windows up to the last cut; the last window stays pending unless this is the end."""
        if not self.length:
            return []
        points, costs = self._points()
        cuts = [points[i] for i in best_cuts(points, costs, self.window)]
        sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        sizes = [*sizes[:-1], *powers_of_two(sizes[-1])] if last else sizes[:-1]
        return self._take(sizes)

    def _take(self, sizes: list[int]) -> list[tuple]:
        rows, d = [], 0
        for size in sizes:
            offset = 0
            while offset < size:
                doc_id, ids, start = self.docs[d]
                n = min(size - offset, len(ids) - start)
                rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n]), len(ids), self.sequence, offset))
                offset += n
                self.docs[d][2] = start + n
                d += start + n == len(ids)
            self.sequence += 1
        self.docs = self.docs[d:]
        self.length -= sum(sizes)
        return rows


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, sentence_cost: float = SENTENCE_COST, hard_cost: float = HARD_COST, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document: where it starts in the document and where it lies in its sequence."""
    path = tokenizer_path or vocabulary_path("word_bpe_49k.json")
    closing = np.asarray([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        packer = Packer(words.is_end, window, sentence_cost, hard_cost, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in common.slices(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), words.ids(part.column(1)), strict=True):
                    packer.add(doc_id, np.concatenate([ids, closing]))
                    if packer.length >= BLOCK_TOKENS or len(packer.docs) >= BLOCK_DOCS:
                        yield table(packer.flush(last=False))
        yield table(packer.flush(last=True))

    return common.id_and_text(docs).mapInArrow(run, SCHEMA)


def table(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)


def op9_packing(spark, sf_dir) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
