"""Pairs of rows that share a key of which some values are very common: sorted intervals, cut into blocks where they are hot.

What is common is read from a table of a fixed number of counters. A hot interval is dealt to a square of blocks, rows of
one side to its rows and of the other side to its columns, so every pair meets in exactly one task of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 1 << 18
#: Rows of an interval that one block holds of each side.
BLOCK = 8192
#: Pairs written at once.
AT_ONCE = 1 << 19

Columns = dict[str, np.ndarray]


def scanned(array: DataFrame, key: list[str], read: Callable[[Columns, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Reads the sorted partitions of a suffix array interval by interval: read(columns, starts of the intervals in them).

    An interval is a run of rows with equal `key`; runs that batches cut are put together first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Columns = {}
        for b in batches:
            new = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)}
            rows = {c: np.concatenate((held[c], v)) for c, v in new.items()} if held else new
            n = len(rows[key[0]])
            change = np.zeros(max(0, n - 1), bool)
            for c in key:
                change |= rows[c][1:] != rows[c][:-1]
            starts = np.concatenate(([0], np.flatnonzero(change) + 1))
            cut = int(starts[-1])
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield from read({c: v[:cut] for c, v in rows.items()}, starts[:-1])
        if held and len(held[key[0]]):
            yield from read(held, np.zeros(1, np.int64))

    return array.mapInArrow(run, schema)


def counted(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """How often the hashes (uint64) of batches fall in each of COUNTERS slots, which is all that reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for h in hashes(b):
                total += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot], pa.int64())], names=["slot", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    got = rows.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts


def blocks_of(counts: np.ndarray) -> np.ndarray:
    """Into how many blocks a side an interval of so many rows is cut."""
    return np.maximum(-(-counts // BLOCK), 1).astype(np.int32)


def pairs_in_intervals(rows: DataFrame, key: str, order: list[str], fit: Callable[[Columns, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): ids of rows (id, side, key, parts, ...) with equal key, the first with side true, the second with side false,
    for which fit(columns, positions of a, positions of b) holds; each pair once. parts, equal for all rows of a key, says
    how many blocks a side its interval is cut into. Within an interval rows are sorted by `order`."""
    at = F.pmod(F.xxhash64("id"), F.col("parts"))
    blocks = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long")))
    blocks = blocks.when(F.col("side"), F.sequence(at * F.col("parts"), (at + 1) * F.col("parts") - 1)).otherwise(F.sequence(at, at + F.col("parts") * (F.col("parts") - 1), F.col("parts").cast("long")))
    array = rows.withColumn("block", F.explode(blocks)).drop("parts").repartition(key, "block").sortWithinPartitions(key, "block", *order, "side")
    at_once = AT_ONCE

    def read(x: Columns, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, e = np.flatnonzero(x["side"]), np.flatnonzero(~x["side"])
        if not len(t) or not len(e):
            return
        ends = np.append(starts[1:], len(x["side"]))
        of = np.searchsorted(starts, e, "right") - 1
        lo, hi = np.searchsorted(t, starts)[of], np.searchsorted(t, ends)[of]
        e, lo, many = e[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        total = np.cumsum(many)
        i = 0
        while i < len(e):  # so many rows of the second side that their pairs fit in memory
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + at_once, "right")))
            m = many[i:j]
            b = np.repeat(e[i:j], m)
            a = t[np.arange(len(b)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[i:j], m)]
            i = j
            ok = fit(x, a, b)
            pair = np.unique(np.stack((x["id"][a[ok]], x["id"][b[ok]]), 1), axis=0)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["a", "b"])

    return scanned(array, [key, "block"], read, "a long, b long").distinct()
