"""Problem 3: how characteristic a term is of its record.

Method: graph-of-words weighting. In each record every term is linked to the terms within a window around it; the
number of its distinct neighbours takes the place of its frequency and is multiplied by the rarity of the term in the
collection, ln(N / df).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.joins import checked_join, salted_join
from verdigris.session import spread, stored

TERM = re.compile("[a-z]{3,}")
WINDOW = 4  # a term is linked to the WINDOW - 1 terms before and after it


def term_graph(texts: list[str], window: int = WINDOW, degrees: bool = True) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, code, tf, degree): one entry per row and distinct term, code indexing terms.

    The window runs over the row's terms in order. All rows are handled at once: tokens become integers, a pair of
    neighbours one integer of (row and term, other term), and distinct pairs are counted after one sort.
    """
    found = [TERM.findall(t.lower()) for t in texts]
    lens = np.fromiter(map(len, found), np.int64, len(found))
    codes: dict[str, int] = {}
    code = np.fromiter((codes.setdefault(w, len(codes)) for ws in found for w in ws), np.int64, int(lens.sum()))
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lens)
    v = max(1, len(codes))
    node, tf = np.unique(row * v + code, return_counts=True)
    degree = np.zeros(len(node), np.int64)
    if degrees and len(code):
        at = np.searchsorted(node, row * v + code)
        pairs = []
        for d in range(1, window):
            a, b = slice(None, -d), slice(d, None)
            ok = (row[a] == row[b]) & (code[a] != code[b])
            x, y = at[a][ok], at[b][ok]
            pairs.append(np.minimum(x, y) * len(node) + np.maximum(x, y))
        links = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
        links.sort()
        if len(links):
            links = links[np.concatenate(([True], links[1:] != links[:-1]))]
        degree = np.bincount(links // len(node), minlength=len(node)) + np.bincount(links % len(node), minlength=len(node))
    return list(codes), node // v, node % v, tf, degree


def _texts(b: pa.RecordBatch) -> list[str]:
    cols = [b.column(c).to_pylist() for c in ("path", "symbol", "text")]
    return ["\n".join(x or "" for x in r) for r in zip(*cols)]


def records(df: DataFrame) -> DataFrame:
    """One row per record: rows alike in path, start_line and text (nulls being alike) are one, named by the smallest
    chunk_id. Texts aren't moved for this: copies are found by their digests, and the few that aren't the smallest are
    taken out."""
    keys = df.select("chunk_id", F.struct("path", "start_line", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).alias("_key"))
    groups = keys.groupBy("_key").agg(F.min("chunk_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = salted_join(keys, groups, "_key", F.col("chunk_id")).filter("chunk_id > keep")
    copies = stored(again.select("chunk_id"), "copies")
    return checked_join(df.select("chunk_id", "path", "symbol", "text"), copies, ["chunk_id"], "left_anti")


def document_frequency(recs: DataFrame, max_df: int | None = None) -> DataFrame:
    """(term, df) over all records. Counts are added up inside each task before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            terms, _, code, _, _ = term_graph(_texts(b), degrees=False)
            for t, n in zip(terms, np.bincount(code, minlength=len(terms)).tolist()):
                held[t] = held.get(t, 0) + n
            if len(held) > 500_000:
                yield _counts(held)
                held = {}
        yield _counts(held)

    out = recs.select("path", "symbol", "text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return out if max_df is None else out.filter(F.col("df") <= max_df)


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])


def term_degrees(recs: DataFrame, min_tf: int = 1, max_df: int | None = None, window: int = WINDOW) -> DataFrame:
    """(chunk_id, term, tf, degree) of the terms that occur at least min_tf times in a record. With max_df, terms that
    occur in more records than that within one batch are left out, since they must in the whole table as well."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, row, code, tf, degree = term_graph(_texts(b), window)
            ok = tf >= min_tf
            if max_df is not None and len(code):
                ok &= np.bincount(code, minlength=len(terms))[code] <= max_df
            ids = b.column("chunk_id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[ok])), pa.array(terms, pa.string()).take(pa.array(code[ok])), pa.array(tf[ok], pa.int64()), pa.array(degree[ok], pa.int64())], names=["chunk_id", "term", "tf", "degree"])

    return recs.mapInArrow(score, "chunk_id long, term string, tf long, degree long")


#: A term in more than this share of all records is "common"; as the pairs of record and term are N times a record's
#: number of terms at most, the common terms are bounded by that number divided by the share.
COMMON = 0.001
COMMON_ROWS = 100_000


def distinctive_terms(df: DataFrame, min_tf: int = 1, min_df: int = 1, max_df: int | None = None, window: int = WINDOW) -> DataFrame:
    """chunk_id, term, tf, degree, df, score = degree * ln(N / df) for the terms of every record of (chunk_id, path,
    start_line, symbol, text).

    A term is a longest run of three or more letters a-z after lower-casing, counted over path, symbol and text
    together; null columns count as empty; a record without terms has no rows; a term with no neighbour has degree and
    score 0; an empty table gives an empty table; other columns are ignored. min_tf, min_df and max_df choose which
    terms are reported, all statistics are of the whole table. The frequencies of common terms (a bounded number, which
    is counted) are broadcast; those of the rest are joined by shuffle, where no key is hot any more.
    """
    recs = records(spread(df.select("chunk_id", "path", "start_line", "symbol", "text")))
    n = recs.select("chunk_id").count()
    freq = document_frequency(recs, max_df).filter(F.col("df") >= min_df)
    rows = term_degrees(recs, min_tf, max_df, window)
    if max_df is not None and max_df <= max(50, n * COMMON):
        out = rows.join(freq, "term")
    else:
        freq = stored(freq, "df")
        common = freq.filter(F.col("df") > n * COMMON)
        few = common.limit(COMMON_ROWS + 1).count() <= COMMON_ROWS
        if few:
            first = rows.join(F.broadcast(common), "term", "left")
            rare = first.filter("df is null").drop("df").join(freq.filter(F.col("df") <= n * COMMON), "term")
            out = first.filter("df is not null").unionByName(rare)
        else:
            out = rows.join(freq, "term")
    return out.select("chunk_id", "term", "tf", "degree", "df", (F.col("degree") * F.log(F.lit(float(max(n, 1))) / F.col("df"))).alias("score"))
