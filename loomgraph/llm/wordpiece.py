"""Token counts by greedy longest match, without building pieces (operator 5).

The vocabulary is a trie. Each node v has a failure link f(v) and a number F(v): when the next
character can't be matched at v, the greedy match of what has been read so far gives up F(v) pieces
and goes on at f(v), so each character is read once and a word takes linear time. Both are computed
beforehand, breadth first:

* v ends a piece: one piece goes, and f(v) is the root of continuation pieces;
* otherwise f(v) and F(v) follow the failure links of v's parent until one has v's character as a
  child; where none has, v has no failure link and the word has no greedy split.

The pieces come from a byte-level vocabulary file: tokens that begin with its space mark begin words
(the mark is what the word's first byte follows), tokens without it continue them, and as every byte
is a continuation piece and the mark itself begins words, each word can be split. Words are
`[^\\x20\\x09-\\x0D]+`, read as UTF-8 bytes.

Nulls: a null text has no words and no tokens. Repeated rows give repeated rows. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .common import vocabulary_path

#: Failure links: no link, for a word without a split.
DEAD = -1


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin words (without the space mark; one is empty) and pieces that continue them."""
    from .bpe import Vocabulary

    vocab = Vocabulary(path)
    ordinary = [b for k, b in enumerate(vocab.bytes) if b and k not in vocab.added.values()]
    return [b[1:] for b in ordinary if b[:1] == b" " and b" " not in b[1:]], [b for b in ordinary if b" " not in b]


class Automaton:
    """The trie of a vocabulary with failure links and popped counts."""

    def __init__(self, first: list[bytes], later: list[bytes]):
        # Node 0 begins words, node 1 continues them.
        edges: dict[tuple[int, int], int] = {}
        ends = [b"" in set(first), False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    child = edges.get((node, byte))
                    if child is None:
                        edges[node, byte] = child = len(ends)
                        ends.append(False)
                    node = child
                if piece:
                    ends[node] = True
        self.edges = edges
        children: dict[int, list[tuple[int, int]]] = {}
        for (node, byte), child in edges.items():
            children.setdefault(node, []).append((byte, child))
        n = len(ends)
        self.link, self.popped = [DEAD] * n, [0] * n
        if ends[0]:
            self.link[0], self.popped[0] = 1, 1
        queue = [0, 1]
        for node in queue:
            for byte, child in children.get(node, ()):
                queue.append(child)
                if ends[child]:
                    self.link[child], self.popped[child] = 1, 1
                    continue
                z, gone = self.link[node], self.popped[node]
                while z != DEAD and (z, byte) not in edges:
                    gone += self.popped[z]
                    z = self.link[z]
                if z != DEAD:
                    self.link[child], self.popped[child] = edges[z, byte], gone
        # A word is over where a node leads, by failure links alone, back to the continuation root.
        self.rest = [self._rest(v) for v in range(n)]
        codes = np.array([v * 256 + b for v, b in edges], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.targets = codes[order], np.array(list(edges.values()), dtype=np.int64)[order]
        self.links, self.pops, self.rests = (np.array(x, dtype=np.int64) for x in (self.link, self.popped, self.rest))

    def _rest(self, v: int) -> int:
        gone = 0
        while v not in (1, DEAD):
            gone += self.popped[v]
            v = self.link[v]
        return DEAD if v == DEAD else gone

    def count(self, word: bytes) -> int:
        """The number of pieces of one word; 1 (an unknown) if it can't be split."""
        node, n = 0, 0
        for byte in word:
            while (child := self.edges.get((node, byte))) is None:
                n += self.popped[node]
                node = self.link[node]
                if node == DEAD:
                    return 1
            node = child
        return n + self.rest[node] if self.rest[node] != DEAD else 1

    def count_many(self, words: list[bytes]) -> list[int]:
        """count() for many words at once: the n-th step reads the n-th byte of each."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        node, n = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            live = np.flatnonzero(sizes > at) if at else np.arange(len(words))
            byte = text[starts[live] + at].astype(np.int64)
            live, byte = live[node[live] != DEAD], byte[node[live] != DEAD]
            while len(live):
                code = node[live] * 256 + byte
                found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[found] == code
                node[live[hit]] = self.targets[found[hit]]
                live, byte = live[~hit], byte[~hit]
                n[live] += self.pops[node[live]]
                node[live] = self.links[node[live]]
                alive = node[live] != DEAD
                live, byte = live[alive], byte[alive]
        rest = np.where(node == DEAD, DEAD, self.rests[node])
        out = np.empty(len(words), dtype=np.int64)
        out[order] = np.where(rest == DEAD, 1, n + rest)
        return out.tolist()


_automata: dict[str, tuple[Automaton, common.WordCache]] = {}


def automaton(path: str) -> tuple[Automaton, common.WordCache]:
    if path not in _automata:
        a = Automaton(*pieces_of(path))
        _automata[path] = a, common.WordCache(lambda words: fill(a, words))
    return _automata[path]


def fill(a: Automaton, words: list[bytes], longest: int = 256) -> list[int]:
    short = [w for w in words if len(w) <= longest]
    found = dict(zip(short, a.count_many(short), strict=True))
    return [found[w] if w in found else a.count(w) for w in words]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text."""
    path = path or vocabulary_path("byte_bpe_50k.json")

    def make():
        _, cache = automaton(path)

        def step(ids, texts):
            words = common.words_of(texts)
            counts = np.array(cache.of(words.distinct), dtype=np.int64)
            return {"doc_id": ids, "n_words": np.diff(words.starts), "n_tokens": words.sums(counts)}

        return step

    return common.map_arrow(docs, make, "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark, sf_dir) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
