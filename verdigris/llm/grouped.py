"""Problem 2: splits that keep related records together.

Method: records tie a source to a base id. Parallel hooking and shortcutting over a parent table (node, parent) joined
with the edge table yields connected components; a subset-sum bitset over the sizes' multiplicities then chooses which
groups make each split come closest to its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.components import components
from verdigris.operators.joins import checked_join, numbered, salted_join
from verdigris.session import stored


def collection_key(source: Column) -> Column:
    """One name per collection: letter case, white space, underscores for hyphens and a trailing remark in brackets
    don't count. Null, and what is blank then, is null."""
    c = F.regexp_replace(F.lower(source), r"\s+", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(\([^()]*\))+$", ""), r"[_‐-―]", "-")
    return F.nullif(c, F.lit(""))


def base_key(id_: Column) -> Column:
    """The base record of an id: without case and white space, the mark of an augmented copy (~p and a number) and, for
    typeddec cases (tdc-<case>-<question>), the number of the question."""
    c = F.regexp_replace(F.regexp_replace(F.lower(id_), r"\s+", ""), r"[_‐-―]", "-")
    c = F.regexp_replace(c, r"(~p\d+)+$", "")
    return F.nullif(F.regexp_replace(c, r"^(tdc-[^-]+)-\d+$", "$1"), F.lit(""))


def tied_groups(df: DataFrame) -> DataFrame:
    """record_no, group_no, source_key of every record; group_no is the smallest record_no it is tied to, by any chain.

    A key stands for itself by its smallest record, so groups come out as record numbers and no key is hashed. The
    links are distinct (source, base id) pairs, aggregated before any join. A record with neither is its own group.
    Null record_no are dropped.
    """
    rows = df.filter("record_no is not null").select("record_no", collection_key(F.col("source")).alias("source_key"), base_key(F.col("id")).alias("base_key"))
    pairs = stored(rows.groupBy("source_key", "base_key").agg(F.min("record_no").alias("first_no")), "pairs")
    by_source = pairs.filter("source_key is not null").groupBy("source_key").agg(F.min("first_no").alias("s"))
    by_base = pairs.filter("base_key is not null").groupBy("base_key").agg(F.min("first_no").alias("b"))
    linked = salted_join(salted_join(pairs, by_source, "source_key", F.col("base_key"), "left"), by_base, "base_key", F.col("source_key"), "left")
    linked = stored(linked.select("source_key", "base_key", "s", "b"), "linked")
    known = linked.filter("s is not null or b is not null")
    roots = components(known.select(F.coalesce("s", "b").alias("a"), F.coalesce("b", "s").alias("b")))
    named = known.withColumn("at", F.coalesce("s", "b"))
    named = salted_join(named, roots.withColumnRenamed("node", "at"), "at", F.col("base_key")).select("source_key", "base_key", F.col("root").alias("group_no"))
    key = lambda d: d.withColumn("_pair", F.struct(F.col("source_key"), F.col("base_key")))
    both = salted_join(key(rows), key(named).select("_pair", "group_no"), "_pair", F.col("record_no"))
    alone = rows.filter("source_key is null and base_key is null").select("record_no", F.col("record_no").alias("group_no"), "source_key")
    return both.select("record_no", "group_no", "source_key").unionByName(alone)


def mixed_groups(groups: DataFrame) -> DataFrame:
    """(group_no, record_no) for the groups whose records don't all have one and the same source, null being one of
    its own; the record that names the group is left out."""
    per = groups.groupBy("group_no").agg(F.min("source_key").alias("lo"), F.max("source_key").alias("hi"), F.count("source_key").alias("named"), F.count("*").alias("n"))
    mixed = stored(per.filter("lo <> hi or (named > 0 and named < n)").select("group_no"), "mixed")
    others = groups.filter("record_no <> group_no").select("group_no", "record_no")
    if mixed.limit(200_001).count() <= 200_000:
        return others.join(F.broadcast(mixed), "group_no", "left_semi")
    return salted_join(others, mixed, "group_no", F.col("record_no"))


def closest_subset(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many items of each size (size: number) to take so that the sum comes closest to target, the smaller on ties;
    exact for targets of any size.

    Bitset subset-sum: bit s of a big integer says that the sum s can be reached; a multiplicity is taken in powers of
    two. Sums above twice the target can't be closer than none at all. All sums are multiples of the sizes' common
    divisor, so a step that reaches the multiple nearest to the target is the last. Only the steps are kept, not what
    each of them reached: the way back halves them again and again and repeats the first half up to the sum it looks
    for, so there are never more bitsets than the logarithm of the number of steps.
    """
    if target <= 0 or not counts:
        return {}
    width = min(target + max(counts), 2 * target) + 1
    mask, reach, unit = (1 << width) - 1, 1, math.gcd(*counts)
    goal = target - target % unit + (unit if 2 * (target % unit) > unit else 0)
    steps: list[tuple[int, int]] = []
    for size in sorted(counts, reverse=True):
        left, k = min(counts[size], width // size + 1), 1
        while left > 0 and not reach >> goal & 1:
            k = min(k, left)
            wider = reach | (reach << (size * k)) & mask
            if wider != reach:
                reach = wider
                steps.append((size, k))
            left -= k
            k *= 2
    at = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    high = reach >> (target + 1)
    if high:
        above = target + 1 + (high & -high).bit_length() - 1
        if above - target < target - at:
            at = above
    taken: dict[int, int] = {}
    _walk_back(steps, 0, len(steps), 1, at, taken)
    return taken


def _walk_back(steps: list[tuple[int, int]], lo: int, hi: int, reach: int, at: int, taken: dict[int, int]) -> int:
    """Adds to `taken` the steps from lo to hi that lead from one of the sums in `reach` to the sum `at`; that sum."""
    if reach >> at & 1:
        return at
    if hi - lo == 1:
        size, k = steps[lo]
        taken[size] = taken.get(size, 0) + k
        return at - size * k
    mid, mask = (lo + hi) // 2, (1 << (at + 1)) - 1
    half = reach & mask
    for size, k in steps[lo:mid]:
        half |= (half << (size * k)) & mask
    return _walk_back(steps, lo, mid, reach, _walk_back(steps, mid, hi, half, at, taken), taken)


#: Once the number of records above which the search gave up being exact. Nothing reads it: every total is searched alike.
MAX_BITS = 1 << 22


def allot(counts: dict[int, int], shares: list[tuple[str, float]]) -> dict[int, list[tuple[str, int]]]:
    """For each size the splits and how many groups of that size each gets. The largest split takes what the others,
    smallest first, leave; each of these comes as close to its share as the groups that are left allow. Shares are
    normalised; negative and null ones count as 0."""
    total = sum(s * n for s, n in counts.items())
    w = {k: max(0.0, float(v or 0)) for k, v in shares}
    norm = sum(w.values()) or 1.0
    order = sorted(w, key=lambda k: (w[k], k))
    left, out = dict(counts), {s: [] for s in counts}
    for k in order[:-1]:
        for s, n in closest_subset({s: n for s, n in left.items() if n > 0}, round(total * w[k] / norm)).items():
            left[s] -= n
            out[s].append((k, n))
    for s, n in left.items():
        if n > 0:
            out[s].append((order[-1], n))
    return out


def grouped_splits(df: DataFrame, shares: DataFrame, seed: int = 17) -> DataFrame:
    """record_no, group_no, split: all records of a tied group get the same split, in the proportions of `shares`
    (split, share).

    What reaches the driver is the number of groups per size: N records have at most sqrt(2N) different group sizes.
    Within a size the groups are dealt out in the order of a hash, numbered range by range so that no task orders all
    groups of a size. An empty table gives an empty table; without shares all splits are null.
    """
    groups = stored(tied_groups(df).select("record_no", "group_no"), "groups")
    sizes = stored(groups.groupBy("group_no").agg(F.count("*").alias("size")).withColumn("h", F.xxhash64("group_no", F.lit(seed))), "sizes")
    plan = allot({r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}, [(r["split"], r["share"]) for r in shares.select("split", "share").filter("split is not null").collect()]) if not shares.isEmpty() else {}
    ranges = [(s, k, lo, lo + n) for s, got in plan.items() for lo, (k, n) in zip(_running([n for _, n in got]), got)]
    spark = df.sparkSession
    cut = F.broadcast(spark.createDataFrame(ranges, "size long, split string, lo long, hi long"))
    placed = numbered(sizes.select("size", "h", "group_no"), ["size"], ["h", "group_no"]).withColumn("rank", F.col("rank") - 1)
    placed = placed.join(cut, (placed["size"] == cut["size"]) & (placed["rank"] >= cut["lo"]) & (placed["rank"] < cut["hi"]), "left").select("group_no", "split")
    return salted_join(groups, placed, "group_no", F.col("record_no")).select("record_no", "group_no", "split")


def _running(ns: list[int]) -> list[int]:
    out, at = [], 0
    for n in ns:
        out.append(at)
        at += n
    return out


__all__ = ["allot", "base_key", "checked_join", "closest_subset", "collection_key", "components", "grouped_splits", "mixed_groups", "tied_groups"]
