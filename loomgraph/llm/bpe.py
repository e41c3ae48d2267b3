"""Byte-level BPE encoding and decoding (operator 3).

A word's symbols are the leaves of a segment tree: the leaf of a symbol holds the rank of the pair it
makes with its right neighbour, and the position, so the root is the leftmost pair of the lowest rank.
That pair is merged, three leaves change (the merged symbol's, its left neighbour's and that of the
symbol that went), each in logarithmic time, and this goes on until the root holds no mergeable pair.

Words of up to TREE_LEAVES bytes are worked off many at a time, one numpy row each, with the same tree;
longer ones singly, so a text without any space costs n log n.

Nulls: a null text is encoded as an empty one. Repeated rows give repeated rows. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from . import common
from .common import byte_alphabet, vocabulary_path

#: The widest tree that is built for many words at once.
TREE_LEAVES = 64
NONE = np.iinfo(np.int64).max
#: A fixed pattern of the byte-level pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters are split by WORDS; others by the library, whose Unicode tables may be of another version.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏΑ-ΡΣ-ωА-я‐-‧]*")
#: A single space between two words always starts a token of its own right.
SINGLE = re.compile(r"(?<=\S) (?=\S)")
RUN = re.compile(r"\s\s")


class Vocabulary:
    """Merges by rank, bytes by id, and added tokens, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        shown = byte_alphabet()
        of = {c: b for b, c in enumerate(shown)}
        self.byte_ids = np.array([ids[c] for c in shown], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, k in ids.items():
            self.bytes[k] = bytes(of[c] for c in token)
        for token, k in self.added.items():
            self.bytes[k] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = len(self.bytes)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        self.ranks_by_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where they don't merge; negative ids stand for no symbol."""
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)


def merge_many(vocab: Vocabulary, words: list[bytes], leaves: int) -> list[bytes]:
    """The ids of words of 1 to leaves bytes (a power of two), as little-endian 32-bit integers."""
    n, w = len(words), leaves
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    text = np.frombuffer(b"".join(words), dtype=np.uint8)
    row = np.repeat(np.arange(n), lengths)
    col = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # One cell beyond each end holds -1, "no symbol"; column c of a word is cell c + 1.
    sym = np.full((n, w + 2), -1, dtype=np.int64)
    sym[row, col + 1] = vocab.byte_ids[text]
    right = np.tile(np.arange(1, w + 3), (n, 1))
    left = np.tile(np.arange(-1, w + 1), (n, 1))
    right[np.arange(n), lengths] = w + 1
    tree = np.full((n, 2 * w), NONE, dtype=np.int64)

    def leaf(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = vocab.ranks(a, b)
        return np.where(r == NONE, NONE, r * w + at)

    tree[:, w:] = leaf(sym[:, 1 : w + 1], sym[:, 2 : w + 2], np.arange(w)[None, :])
    for level in (2**k for k in range(w.bit_length() - 2, -1, -1)):
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        rank, at = np.divmod(tree[live, 1], w)
        cell = at + 1
        gone = right[live, cell]
        after = right[live, gone]
        before = left[live, cell]
        new = vocab.merged[rank]
        sym[live, cell] = new
        sym[live, gone] = -1
        right[live, cell] = after
        left[live, after] = cell
        values = [(gone - 1, np.full(len(live), NONE)), (at, leaf(new, sym[live, after], at))]
        has = before > 0
        values.append((np.where(has, before - 1, at), np.where(has, leaf(sym[live, np.maximum(before, 0)], new, before - 1), values[1][1])))
        nodes = []
        for where, value in values:
            tree[live, where + w] = value
            nodes.append((where + w) >> 1)
        while nodes[0][0] >= 1:
            for node in nodes:
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            nodes = [node >> 1 for node in nodes]
        live = live[tree[live, 1] != NONE]
    kept = sym[:, 1 : w + 1]
    there = kept >= 0
    flat, sizes = kept[there].astype("<u4").tobytes(), (4 * there.sum(axis=1)).tolist()
    out, start = [], 0
    for size in sizes:
        out.append(flat[start : start + size])
        start += size
    return out


def merge_one(vocab: Vocabulary, word: bytes) -> bytes:
    """The ids of one word of any length, by the same tree."""
    ids = vocab.byte_ids[np.frombuffer(word, dtype=np.uint8)]
    n, size, ranks = len(ids), vocab.size, vocab.ranks_by_pair
    w = 1 << max(0, n - 1).bit_length()
    whole = np.full(2 * w, NONE, dtype=np.int64)
    first = vocab.ranks(ids[:-1], ids[1:])
    whole[w : w + n - 1] = np.where(first == NONE, NONE, first * w + np.arange(n - 1))
    for level in (2**k for k in range(w.bit_length() - 2, -1, -1)):
        whole[level : 2 * level] = np.minimum(whole[2 * level : 4 * level : 2], whole[2 * level + 1 : 4 * level : 2])
    # Arrays of machine integers: 32 bytes or so for each byte of the word.
    sym, tree, left, right = (array("q", x.astype(np.int64).tobytes()) for x in (ids, whole, np.arange(-1, n - 1), np.append(np.arange(1, n), -1)))

    def leaf(i: int) -> int:
        r = ranks.get(sym[i] * size + sym[right[i]]) if right[i] >= 0 else None
        return NONE if r is None else r * w + i

    def update(i: int, value: int) -> None:
        i += w
        tree[i] = value
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    while w > 1 and tree[1] != NONE:
        rank, i = divmod(tree[1], w)
        gone, sym[i] = right[i], int(vocab.merged[rank])
        right[i] = right[gone]
        if right[i] >= 0:
            left[right[i]] = i
        sym[gone] = -1
        update(gone, NONE)
        update(i, leaf(i))
        if left[i] >= 0:
            update(left[i], leaf(left[i]))
    kept = np.frombuffer(sym, dtype=np.int64)
    return kept[kept >= 0].astype("<u4").tobytes()


class Encoder:
    def __init__(self, path: str):
        self.path, self.vocab, self._library = path, Vocabulary(path), None
        self.chunks = common.WordCache(self._encode_chunks)
        self.words: dict[bytes, bytes] = {}

    def split(self, chunk: str) -> list[bytes]:
        if PLAIN.fullmatch(chunk):
            return [w.encode() for w in WORDS.findall(chunk)]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
            self._of = {c: b for b, c in enumerate(byte_alphabet())}
        return [bytes(map(self._of.__getitem__, w)) for w, _ in self._library.pre_tokenize_str(chunk)]

    def merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, by_size = {}, {}
        for w in words:
            by_size.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
        for leaves, group in by_size.items():
            ids = merge_many(self.vocab, group, leaves) if leaves <= TREE_LEAVES else [merge_one(self.vocab, w) for w in group]
            found.update(zip(group, ids, strict=True))
        return found

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        parts = [self.split(c) for c in chunks]
        found = self.merge(list({w for p in parts for w in p}))
        return [b"".join(map(found.__getitem__, p)) for p in parts]

    def chunked(self, text: str) -> list[str]:
        """The text cut before single spaces, where no rule looks across."""
        parts = SINGLE.split(text) if RUN.search(text) or text[:1] == " " or text[-1:] == " " else text.split(" ")
        return [parts[0], *(" " + p for p in parts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        pieces = []
        for text in texts:
            out: list = []
            for part in self.vocab.added_pattern.split(text) if self.vocab.added_pattern and text and any(t in text for t in self.vocab.added) else [text or ""]:
                if part in self.vocab.added:
                    out.append(part)
                elif part:
                    out += self.chunked(part)
            pieces.append(out)
        known = self.chunks.load({p for out in pieces for p in out if p not in self.vocab.added})
        added = {t: np.array([k], dtype="<u4").tobytes() for t, k in self.vocab.added.items()}
        get = known.__getitem__
        return [b"".join([added[p] if p in added else get(p) for p in out] if any(t in (text or "") for t in added) else map(get, out)) for out, text in zip(pieces, texts, strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.vocab.bytes.__getitem__, numbers)).decode("utf-8", errors="replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its token ids, an array of integers."""
    path = path or vocabulary_path("byte_bpe_50k.json")

    def make():
        enc = encoder(path)
        return lambda ids, texts: {"doc_id": ids, "ids": [np.frombuffer(x, dtype="<u4").astype("<i4") for x in enc.encode(texts)]}

    return common.map_texts(docs, make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    import pyarrow as pa

    path = path or vocabulary_path("byte_bpe_50k.json")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes each text, decodes the ids again, and gives the number of ids and digests of both."""
    path = path or vocabulary_path("byte_bpe_50k.json")

    def make():
        enc = encoder(path)

        def step(doc_ids, texts):
            ids = enc.encode(texts)
            return {
                "doc_id": doc_ids,
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids],
            }

        return step

    return common.map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
