"""Problem 4: passages of held-out cases inside training documents.

Method: greedy string tiling. Running Karp-Rabin hashes of MIN_WORDS consecutive words seed the matches of a document
with the test passages; then the longest match that overlaps no earlier one is marked, again and again, until none of
MIN_WORDS words is left. The share of a case's words that tiles cover finds reordered passages too.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.joins import running
from verdigris.session import stored

MIN_WORDS = 12
#: Most characters of cases that are broadcast at once; more cases are taken in blocks, each against all documents.
BLOCK_CHARS = 120_000_000
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


def text_values(state: str | None) -> list[str]:
    """The strings of a JSON text at any depth, in order; the whole text if it is no JSON object, array or string."""
    if state is None:
        return []
    try:
        v = json.loads(state)
    except (ValueError, RecursionError):
        return [state]
    out: list[str] = []
    todo = [v]
    if not isinstance(v, (dict, list, str)):
        return [state]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return out


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every k consecutive codes."""
    if len(codes) < k:
        return np.empty(0, np.uint64)
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    for i in range(k):
        h = h * BASE + c[i : i + n]
    return h


class Passages:
    """The test passages, with words as numbers and their seeds sorted by hash."""

    def __init__(self, cases: list[tuple[str, str]], k: int = MIN_WORDS):
        self.k = k
        self.vocab: dict[str, int] = {}
        self.case, self.codes, seen = [], [], {}
        for case, state in cases:
            for value in text_values(state):
                w = words(value)
                if len(w) >= k and (key := (case, tuple(w))) not in seen:
                    seen[key] = True
                    self.case.append(case)
                    self.codes.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64))
        hashes = [rolling(c, k) for c in self.codes]
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.empty(0, np.int64)
        self.at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.of, self.at = self.hash[order], self.of[order], self.at[order]
        self.total: dict[str, int] = {}
        for case, c in zip(self.case, self.codes):
            self.total[case] = self.total.get(case, 0) + len(c)

    def tiles(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(case, tiles, words in tiles, longest tile, share of the case's words covered) of each case with a tile."""
        doc = words(text)
        if len(doc) < self.k or not len(self.hash):
            return []
        get = self.vocab.get
        codes = np.array([get(w, -1) for w in doc], np.int64)
        h = rolling(codes, self.k)
        lo = np.searchsorted(self.hash, h)
        hit = np.flatnonzero((lo < len(self.hash)) & (self.hash[np.minimum(lo, len(self.hash) - 1)] == h))
        if not len(hit):
            return []
        seeds: dict[int, set[tuple[int, int]]] = {}
        for i in hit.tolist():
            j = int(lo[i])
            while j < len(self.hash) and self.hash[j] == h[i]:
                seeds.setdefault(int(self.of[j]), set()).add((i, int(self.at[j])))
                j += 1
        per: dict[str, list[int]] = {}
        for p, found in sorted(seeds.items()):
            got = greedy_tiles(codes, self.codes[p], found, self.k)
            if got:
                per.setdefault(self.case[p], []).extend(n for _, _, n in got)
        return [(c, len(ns), sum(ns), max(ns), min(1.0, sum(ns) / self.total[c])) for c, ns in per.items()]


def greedy_tiles(a: np.ndarray, b: np.ndarray, seeds: set[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, words), the longest first, the earlier on ties; no word is in two tiles.

    Seeds (i, j) claim a[i:i+k] == b[j:j+k]; each is compared word by word, so a collision of hashes is no match.
    """
    used_a, used_b, runs = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    ok = {(i, j) for i, j in seeds if np.array_equal(a[i : i + k], b[j : j + k])}
    for i, j in ok:
        if (i - 1, j - 1) not in ok:
            n = k
            while (i + n - k + 1, j + n - k + 1) in ok:
                n += 1
            runs.append((-n, i, j))
    tiles: list[tuple[int, int, int]] = []
    heapq.heapify(runs)
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        free = ~(used_a[i : i + n] | used_b[j : j + n])
        if free.all():
            tiles.append((i, j, n))
            used_a[i : i + n] = used_b[j : j + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= k:
                heapq.heappush(runs, (s - e, i + s, j + s))
    return tiles


def leaked_cases(documents: DataFrame, cases: DataFrame, split: str = "test", min_words: int = MIN_WORDS, min_share: float = 0.0) -> DataFrame:
    """doc_id, case_id, tiles, words, longest, share: the held-out cases of (id, split, state) that a document gives
    away, and how much of each.

    A pair comes out if the document holds min_words or more consecutive words of one text value of the case's state,
    and the tiles cover at least min_share of the words of the case's text values. The cases are broadcast in blocks of at
    most BLOCK_CHARS characters (a case larger than that is a block of its own), so what a task holds is bounded however
    many there are; the documents aren't shuffled, and read once per block. Null and empty texts and states match
    nothing; an id delivered twice is one case with the texts of both; null ids are ignored; without documents or cases
    the result is empty; other columns are ignored.
    """
    held = cases.filter((F.col("split") == split) & F.col("id").isNotNull() & F.col("state").isNotNull()).select("id", "state")
    size = held.select(F.coalesce(F.sum(F.char_length("state")), F.lit(0))).first()[0]
    if size <= BLOCK_CHARS:
        return _matches(documents, held, min_words, min_share)
    sized = held.groupBy("id").agg(F.sum(F.char_length("state")).alias("value"))
    # whole cases by the characters before them
    block = running(sized, ["id"], "value").select("id", F.floor(F.col("before") / BLOCK_CHARS).alias("block"))
    placed = stored(held.join(block, "id"), "cases")
    blocks = [r["block"] for r in placed.select("block").distinct().orderBy("block").collect()]
    return reduce(DataFrame.unionByName, [_matches(documents, placed.filter(F.col("block") == b), min_words, min_share) for b in blocks])


def _matches(documents: DataFrame, held: DataFrame, min_words: int, min_share: float) -> DataFrame:
    """leaked_cases for one block of cases."""
    spark: SparkSession = documents.sparkSession
    passages = spark.sparkContext.broadcast(Passages([(r["id"], r["state"]) for r in held.select("id", "state").distinct().collect()], min_words))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = passages.value
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for case, tiles, n, longest, share in p.tiles(text):
                    if share >= min_share:
                        for col, v in zip(out, (doc, case, tiles, n, longest, share)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "case_id", "tiles", "words", "longest", "share"])

    return documents.select("doc_id", "text").filter("text is not null").mapInArrow(match, "doc_id long, case_id string, tiles int, words int, longest int, share double")
