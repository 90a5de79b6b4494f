"""Problem 9: abusive, hateful or sexually explicit language.

Method: non-negative positive-unlabelled learning. Reviewed documents that were confirmed are the positive bags, all
other texts are unlabelled; a numpy logistic model over hashed features of sentences is fitted to the class-prior
corrected risk  pi E+[l(s)] + max(0, E_u[l(-s)] - pi E+[l(-s)]).  A document's passages are scored one by one, whole, and
the highest is the document's score. Which sentences of a confirmed document are the reason is not known: rounds of
fitting pick them out, and confirmed documents without any are dropped as wrong labels.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import spread

BITS = 18
DIM = 1 << BITS

# Letters that look like Latin ones, by the letter they pass for (fixed values).
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьвβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оοσ", "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ѡԝ", "x": "хχ", "y": "уү", "z": "ᴢ",
}
# Signs written for letters inside words (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l", "8": "b", "9": "g"}
_MAP = {ord(x): k for k, v in LOOKALIKES.items() for x in v + v.upper() if not x.isascii()}
_LEET = str.maketrans(LEET)
_HIDDEN = re.compile("[​-‏‪-‮⁠-⁤﻿­͏]")
_MOJIBAKE = re.compile("[ÃÂâ][-¿ -〿]")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?}])[\"'”»)\]*_]*\s+|\s{4,}")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_][^\W_*@$!|#+\-']*(?:[*@$!|#+'\-]+[^\W_]+)*|[*#]{2,}")
_LEETISH = re.compile(r"(?=.*[^\W\d_])(?=.*[0134578@$!€|9])")
_MASKED = re.compile(r"[*#]{2,}")
_CODE = re.compile(r"[0-9]+[a-z]{1,2}|[a-z]{1,2}[0-9]+|.*[0-9]{3,}.*")
_GAPS = re.compile(r"[ .\-_*]")
_STRETCH = re.compile(r"(.)\1{2,}")
_ACCENT = re.compile(r"[̀-ͯ]")


def plain(text: str) -> str:
    """Undoes what hides a word: invisible characters, compatibility forms, look-alike letters, HTML
    entities, double encoding."""
    if _MOJIBAKE.search(text):
        for enc in ("cp1252", "latin-1"):
            try:
                text = text.encode(enc).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).translate(_MAP)
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text)).replace("ß", "ss")
    return text.lower()


def sentences(text: str | None) -> list[str]:
    """The passages that are scored: sentences and lines, blank ones left out."""
    return [s for s in (x.strip() for x in _CUT.split(text)) if s] if text else []


@lru_cache(maxsize=200_000)
def _word(w: str) -> str:
    """A token with digits folded, signs read as letters and stretched letters cut."""
    if w.isdigit():
        return "#"
    if not w.isalpha():
        w = w if _MASKED.search(w) else w.strip("*#'-+|")
        if _LEETISH.search(w) and not _CODE.fullmatch(w):
            w = w.translate(_LEET)
    return _STRETCH.sub(r"\1\1", w)


def tokens(sentence: str) -> list[str]:
    """Words of a sentence after plain(), digits folded, spaced-out words joined, signs inside words read as letters."""
    s = _SPACED.sub(lambda m: _GAPS.sub("", m.group()), plain(sentence))
    return [w for w in map(_word, _TOKEN.findall(s)) if w]


def _crc(f: str) -> int:
    return zlib.crc32(f.encode("utf-8", "surrogatepass")) & (DIM - 1)


@lru_cache(maxsize=200_000)
def _of_word(w: str) -> tuple[int, ...]:
    """Hashes of a word, of its four-letter runs with its ends marked, and of its shape where letters are masked."""
    out = [_crc("w" + w)]
    if len(w) > 3:
        p = f"<{w}>"
        out += [_crc("c" + p[i : i + 4]) for i in range(len(p) - 3)]
    if "*" in w or "#" in w and len(w) > 1:
        out.append(_crc(f"m{w[0]}{w[-1]}{len(w)}"))
    return tuple(out)


@lru_cache(maxsize=200_000)
def _known(w: str) -> tuple[int, np.ndarray]:
    """(a 64-bit hash of a word, its features), remembered by the worker."""
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"), np.array(_of_word(w), np.int64)


#: What mixes the hashes of neighbours, and of words with one between.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _pairs(h: np.ndarray, row: np.ndarray, gap: int, mix: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    a, b, same = h[:-gap], h[gap:], row[:-gap] == row[gap:]
    x = (a[same] * mix) ^ b[same]
    x = (x ^ (x >> np.uint64(29))) * mix
    return row[:-gap][same], (x >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and distinct; sorting is several times quicker here than the hash table of np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def features(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), sorted and distinct, of a batch of sentences: words, pairs, pairs with a gap, starts and inner
    four-letter runs of words, hashed. Words are looked up once per batch; pairs are hashed in numpy."""
    rows: list[np.ndarray] = []
    cols: list[np.ndarray] = []
    words = [tokens(x) for x in sentences]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), lens)
    index: dict[str, int] = {}
    code = np.array([index.setdefault(w, len(index)) for ws in words for w in ws], np.int64)
    known = [_known(w) for w in index]
    if known:
        h = np.array([x for x, _ in known], np.uint64)
        many = np.fromiter((len(f) for _, f in known), np.int64, len(known))
        flat, first = np.concatenate([f for _, f in known]), np.cumsum(many) - many
        # a word's features once per sentence
        seen = _distinct(row * len(known) + code)
        r, c = seen // len(known), seen % len(known)
        n = many[c]
        rows.append(np.repeat(r, n))
        cols.append(flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[c], n)])
        for gap, mix in zip((1, 2), _MIX):
            r, c = _pairs(h[code], row, gap, mix)
            rows.append(r)
            cols.append(c)
    key = _distinct(np.concatenate(rows) * DIM + np.concatenate(cols)) if rows else np.empty(0, np.int64)
    return key // DIM, key % DIM


class Rows:
    """Feature rows in compressed form; a row's values are 1 / sqrt(number of features)."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int):
        self.n, self.row, self.col = n, row, col
        lens = np.bincount(row, minlength=n)
        self.val = (1.0 / np.sqrt(np.maximum(lens, 1)))[row]

    @classmethod
    def of(cls, sentences: list[str], used: np.ndarray | None = None, at_once: int = 4096) -> Rows:
        """The rows of sentences, of the features in use if those are given."""
        parts = [features(sentences[i : i + at_once]) for i in range(0, len(sentences), at_once)]
        row = np.concatenate([r + i * at_once for i, (r, _) in enumerate(parts)]) if parts else np.empty(0, np.int64)
        col = np.concatenate([c for _, c in parts]) if parts else np.empty(0, np.int64)
        if used is not None:
            row, col = row[used[col]], col[used[col]]
        return cls(row, col, len(sentences))

    def dot(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n) + b

    def grad(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], minlength=DIM)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    prior: float
    info: dict

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Highest sentence score of each text as a probability; 0 where there is no sentence."""
        parts = [sentences(t) for t in texts]
        flat = Rows.of([s for p in parts for s in p])
        s = flat.dot(self.weights, self.bias)
        out, at = np.zeros(len(texts)), 0
        for i, p in enumerate(parts):
            if p:
                out[i] = 1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, float(s[at : at + len(p)].max())))))
            at += len(p)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(x: Rows, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 60, rate: float = 0.3, l2: float = 2e-5, w: np.ndarray | None = None, b: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss, by Adam over all rows.

    positive and unlabelled are row weights that sum to 1. Where the estimated negative risk falls below 0 its gradient
    is reversed, as the method prescribes.
    """
    w = np.zeros(DIM) if w is None else w.copy()
    m, v, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    for t in range(1, steps + 1):
        s = x.dot(w, b)
        up = _sigmoid(s)  # derivative of the loss for the label -1; for +1 it is up - 1
        negative = float(unlabelled @ np.logaddexp(0, s) - prior * (positive @ np.logaddexp(0, s)))
        gneg = unlabelled * up - prior * positive * up
        g = prior * positive * (up - 1) + gneg if negative >= 0 else -gneg
        gw, gb = x.grad(g) + l2 * w, float(g.sum())
        m, mb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
        k = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * k * m / (np.sqrt(v) + 1e-7)
        b -= rate * k * mb / (np.sqrt(vb) + 1e-7)
    return w, b


def passages(text: str | None) -> list[str]:
    """The distinct sentences of a text, with digits folded."""
    return [re.sub(r"\d+", "0", s) for s in dict.fromkeys(sentences(text))]


def train(texts: list[str], votes: list[float | None], rounds: int = 3, seed: int = 17, stands_for: list[float] | None = None, share_above: Callable[[np.ndarray, float, np.ndarray], float] | None = None) -> Model:
    """A model from documents with the share of reviewers who confirmed them (None: not reviewed).

    Equal sentences (numbers apart) are one row with a weight. Each document counts in the unlabelled risk as the
    documents it stands for (one by default). The class prior of sentences is the share that the round before scores
    above 0: of all that share_above(weights, bias, features in use) sees, of the given texts without it; the threshold is the score that agrees best with the reviews, leaving them out of no step but the
    choice among confirmed sentences.
    """
    index: dict[str, int] = {}
    docs: list[list[int]] = []
    for t in texts:
        docs.append([index.setdefault(s, len(index)) for s in passages(t)])
    x = Rows.of(list(index))
    often = np.bincount(x.col, minlength=DIM) > 1
    x = Rows(x.row[often[x.col]], x.col[often[x.col]], x.n)  # what occurs in one sentence only can teach nothing about others
    n = len(index)
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    each = np.repeat(np.ones(len(docs)) if stands_for is None else np.array(stands_for, float), lens)
    u = np.bincount(np.fromiter((i for d in docs for i in d), np.int64, int(lens.sum())), each, minlength=max(n, 1))[:n]
    bags = [d for d, v in zip(docs, votes) if v is not None and v >= 0.5 and d]
    if not bags or not n:
        return Model(np.zeros(DIM), -30.0, 0.5, 0.0, {"positive": 0, "sentences": n})
    u /= u.sum()
    prior, w, b, s = 0.05, None, 0.0, None
    for r in range(rounds):
        p = np.zeros(n)
        kept = 0
        for d in bags:
            if s is None:
                p[d] += 1.0 / len(d)
                continue
            sd = s[d]
            top = [i for i, v in zip(d, sd) if v > 0]
            if not top and r == 1:
                top = [d[int(sd.argmax())]] if sd.max() > cutoff else []
            for i in top:
                p[i] += 1.0
            kept += bool(top)
        if not p.sum():
            break
        p /= p.sum()
        w, b = fit_nnpu(x, p, u, prior)
        s = x.dot(w, b)
        if r == 0:  # the margin of what confirmed documents are rich in
            cutoff = float(np.sort(s[np.unique(np.concatenate([np.array(d) for d in bags]))])[::-1][min(len(bags) - 1, n - 1)])
            s = s - max(cutoff, float(np.quantile(s, 0.9)))
            cutoff = 0.0
        elif r < rounds - 1:
            above = u @ (s > 0) if share_above is None else share_above(w, b, often)
            prior = float(min(0.3, max(0.003, above)))
    best, threshold = -1.0, 0.5
    reviewed = [(max((float(s[i]) for i in d), default=-30.0), v >= 0.5) for d, v in zip(docs, votes) if v is not None]
    if reviewed:
        sc = np.array([a for a, _ in reviewed])
        y = np.array([a for _, a in reviewed])
        for c in np.linspace(-3, 3, 61):
            f = 2 * float((y & (sc > c)).sum()) / max(1, y.sum() + (sc > c).sum())
            if f > best + 1e-9 or abs(f - best) <= 1e-9 and abs(c) < abs(np.log(threshold / (1 - threshold))):
                best, threshold = f, float(_sigmoid(np.array([c]))[0])
    return Model(w, b, threshold, prior, {"positive": len(bags), "kept": kept, "sentences": n, "agreement_f1": best})


#: The classifier is fitted on at most so many reviewed and so many other documents, chosen by a hash of their ids, with
#: their whole texts.
MAX_REVIEWED, MAX_OTHERS = 12_000, 4_000


def passages_above(documents: DataFrame, w: np.ndarray, b: float, used: np.ndarray) -> float:
    """The share of the passages of all documents that score above 0, summed in the tasks; 0 if there are none. Only
    the features in use count, as in the fit."""
    shared = documents.sparkSession.sparkContext.broadcast((w, b, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, used = shared.value
        above = n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = Rows.of([x for t in batch.column(0).slice(i, 512).to_pylist() for x in passages(t)], used)
                above += int((rows.dot(w, b) > 0).sum())
                n += rows.n
        yield pa.RecordBatch.from_arrays([pa.array([above], pa.int64()), pa.array([n], pa.int64())], names=["above", "n"])

    got = spread(documents.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "above long, n long").agg(F.sum("above").alias("above"), F.sum("n").alias("n")).first()
    return got["above"] / got["n"] if got["n"] else 0.0


def fit_model(documents: DataFrame, labels: DataFrame, max_reviewed: int = MAX_REVIEWED, max_others: int = MAX_OTHERS, seed: int = 17) -> Model:
    """Fits on a bounded sample: reviews are averaged per document over all reviewers who gave a verdict.

    Reviewed and other documents are sampled apart, and each part has the weight in the unlabelled risk that it has
    among all documents. The class prior is counted over all documents.
    """
    yes = F.greatest("abusive", "hateful", "sexual")  # nulls are passed over; null if all are
    votes = labels.filter("doc_id is not null").select("doc_id", F.when(yes >= 1, 1.0).when(yes == 0, 0.0).alias("v")).groupBy("doc_id").agg(F.avg("v").alias("vote")).filter("vote is not null")
    docs = documents.select("doc_id", "text").filter("text is not null and doc_id is not null").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    some = votes.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).orderBy("h", "doc_id").limit(max_reviewed).select("doc_id", "vote")
    reviewed = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "vote")
    # ids are chosen before any text is moved
    ids = docs.select("h", "doc_id")
    without = ids.join(votes.select("doc_id"), "doc_id", "left_anti")
    chosen = without.select("h", "doc_id").orderBy("h", "doc_id").limit(max_others).select("doc_id").distinct()
    others = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.lit(None).cast("double").alias("vote"))
    got = reviewed.toArrow().to_pylist() + others.toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    n, rest = ids.count(), without.count()
    drawn = sum(r["vote"] is None for r in got)
    stand = {True: rest / max(1, drawn), False: (n - rest) / max(1, len(got) - drawn)}
    return train([r["text"] for r in got], [r["vote"] for r in got], seed=seed, stands_for=[stand[r["vote"] is None] for r in got], share_above=lambda w, b, used: passages_above(documents, w, b, used))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score in [0, 1], flagged. Whole texts are scored; a null, empty or blank text has score 0; rows
    are kept as they are, other columns dropped; an empty table gives an empty table."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, t = shared.value
        m = Model(w, b, t, 0.0, {})
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                s = m.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(s), pa.array(s > t)], names=["doc_id", "source", "score", "flagged"])

    return spread(documents.select("doc_id", "source", F.col("text").cast("string"))).mapInArrow(run, "doc_id long, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Per source (null being one): documents, flagged ones and their share."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))
