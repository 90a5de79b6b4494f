"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Method: speculate and verify. A word's tokens are proposed by greedy longest match. A token sequence is what byte-pair
merging gives if and only if merging leaves each two adjacent tokens as they are; so all adjacent pairs of all words of
a batch are tested together in numpy, by undoing merges from the seam outwards. Only words with a pair that fails are
merged exactly.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import spread

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: How the vocabulary's texts are cut into words before any merge (fixed value, part of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 400_000  # words whose tokens a worker remembers


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable ones stand for themselves, the others follow
    from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        special = {t for t in model["vocab"] if any(c not in letters for c in t)}
        ids = {t: i for t, i in model["vocab"].items() if t not in special}
        self.id = {to_bytes(t): i for t, i in ids.items()}
        self.size = max(model["vocab"].values()) + 1
        self.longest = max(map(len, self.id))
        # the order of merges; a merge's rank orders its result as well
        left, right, rank = (np.full(self.size, v, np.int64) for v in (-1, -1, -1))
        keys, self.merge = [], {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ia, ib, ic = ids[a], ids[b], ids[a + b]
            self.merge[(ia, ib)] = (r, ic)
            keys.append(ia * self.size + ib)
            if rank[ic] < 0:
                left[ic], right[ic], rank[ic] = ia, ib, r
        order = np.argsort(np.array(keys, np.int64))
        self.key, self.key_rank = np.array(keys, np.int64)[order], order.astype(np.int64)
        self.left, self.right, self.rank = left, right, rank
        self.byte = [self.id[bytes([b])] for b in range(256)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(PATTERN)
        self.failed = self.seen = 0
        # a whole token is proposed alone only if merging its bytes really gives it
        self.whole = {t for t, i in self.id.items() if len(t) == 1 or tuple(self.exact(t)) == (i,)}

    def greedy(self, word: bytes) -> list[int]:
        """Longest token at each place, from the left."""
        out, at, n, ids, whole = [], 0, len(word), self.id, self.whole
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                piece = word[at:end]
                if piece in whole:
                    out.append(ids[piece])
                    at = end
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost first, until no pair can be merged. Pairs wait in a heap over a
        linked list, so a word of n bytes takes n log n steps, however long it is."""
        n = len(word)
        ids = [self.byte[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                m = self.merge.get((ids[i], ids[after[i]]))
                if m is not None:
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of them was merged meanwhile
            ids[i], ids[j] = self.merge[(x, y)][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, or a huge number."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.key_rank[at], 1 << 60)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b ends in just these two tokens.

        It does unless somewhere on the way a merge across the seam comes first. The states of the seam are visited
        backwards: the side whose last merge came later is undone; the merge across the seam of the two tokens that
        touch it must not have come before the earliest one undone since on either side.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 59, np.int64)
        strict = np.ones(len(a), bool)  # across the seam at the limit's own rank: the left one of two equals comes first
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            r = self.pair_rank(x, y)
            bad = np.where(strict[live], r < lim, r <= lim)
            ok[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            rx, ry = self.rank[x], self.rank[y]
            live, x, y, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (live, x, y, rx, ry))
            undo_left = rx > ry  # equal ranks: the left one was merged first, so the right one is undone first
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            # a merge across the seam wins against one on its right at equal rank, and loses against one on its left
            limit[live] = np.where(undo_left, rx, ry)
            strict[live] = undo_left
        return ok

    def learn(self, words: Iterable[str]) -> None:
        """Tokens of new words into the memo."""
        new = [w for w in words if w not in self.memo]
        raw = [w.encode("utf-8", "replace") for w in new]
        guess = [self.greedy(w) for w in raw]
        lens = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((i for g in guess for i in g), np.int64, int(lens.sum()))
        owner = np.repeat(np.arange(len(guess)), lens)
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        failed = set(owner[seam[~self.compatible(flat[seam], flat[seam + 1])]].tolist())
        self.seen += len(new)
        self.failed += len(failed)
        for i, (w, g) in enumerate(zip(new, guess)):
            self.memo[w] = tuple(self.exact(raw[i])) if i in failed else tuple(g)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; a null and an empty text have none."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.learn(set().union(*cut) if cut else ())
        memo = self.memo
        return [[i for w in ws for i in memo[w]] for ws in cut]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.learn(set().union(*cut) if cut else ())
        memo = self.memo
        return [sum(len(memo[w]) for w in ws) for ws in cut]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """Loaded once per Python worker."""
    return Bpe(path)


def _path(tokenizers: str, name: str) -> str:
    return os.path.join(tokenizers, name)


def _rows(b: pa.RecordBatch, n: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, n):
        yield b.slice(i, n)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens (their strings are ordinary text).

    A null and an empty text both give an empty list; rows are kept as they are, with null and repeated keys; texts of
    any length are encoded whole; other columns are dropped; an empty table gives an empty table. Nothing is shuffled.
    """
    path = _path(tokenizers, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for b in _rows(batch):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.encode_batch(b.column(1).to_pylist()), pa.list_(pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, tokens): like encode, the number of ids only."""
    path = _path(tokenizers, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for b in _rows(batch):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.count_batch(b.column(1).to_pylist()), pa.int64())], names=[key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"`{key}` {kind}, tokens long")
