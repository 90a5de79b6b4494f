"""Joins that hold when one key owns a third of all rows, or when a side's size is unknown until it exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.session import stored

#: A side is broadcast only if it was counted and has at most this many rows (of a few numbers or a short string each).
BROADCAST_ROWS = 200_000


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """big JOIN small ON key, where small has one row per key and big may have most of its rows on one key.

    big's rows of a key are dealt to `salts` groups by `spread`; small is repeated once per group, so no task sees more
    than a salts-th of a hot key. Null keys match nothing; with how="left" they are kept. Columns of small that also
    exist in big must be renamed by the caller. Neither side is ever broadcast: the planner judges small by the size of its
    compressed files and doesn't count the repetition, so it would send the driver many times what it takes small for.
    """
    s = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", s)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """big JOIN small where small is already materialised: it is broadcast if a count proves at most `limit` rows, else
    both sides are shuffled (and AQE splits skewed partitions)."""
    return big.join(F.broadcast(small) if is_few(small, limit) else small.hint("shuffle_hash") if how == "left_anti" else small, on, how)


def is_few(small: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a materialised table is small enough to be broadcast."""
    return small.limit(limit + 1).count() <= limit


def hot_join(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", few: bool | None = None) -> DataFrame:
    """big JOIN small ON key, where one key may own most of big's rows and small, materialised, has one row per key: small is
    broadcast if it is few (counted if that isn't said), else both are salted."""
    if is_few(small) if few is None else few:
        return big.join(F.broadcast(small), key, how)
    return salted_join(big, small, key, spread, how)


def running(df: DataFrame, order: list[str], value: str | None = None, name: str = "before") -> DataFrame:
    """df with the sum of `value` (rows if None) over all rows that come earlier in the order, as bigint `name`; the order
    must be total. No task sees more than its range: rows are range-partitioned and written once, the totals of the ranges
    (one row each) are added up, and within a range a window goes on from there."""
    one = F.lit(1) if value is None else F.col(value)
    placed = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = placed.groupBy("_range").agg(F.sum(one).alias("_t"))
    offsets = per.withColumn("_o", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_range")
    return out.withColumn(name, (F.col("_o") + F.coalesce(F.sum(one).over(w), F.lit(0))).cast("long")).drop("_range", "_o")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the number of each row, from 1, within its group `by` in the order, which must be total; a group may hold most
    rows. df is written once. If it proves to be few rows a window numbers them; else they are range-partitioned by group
    and order, sorted and written with their place in the range, and where a group's rows begin in a range, one small row
    for each range and group, is added up and joined."""
    df = stored(df, "numbered")
    if is_few(df):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    keys = [*by, *order]
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_range", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    key = F.struct(F.lit(0).alias("_"), *by)  # groups may be null
    per = placed.groupBy(key.alias("_nkey"), "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("_nkey").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(per.select("_nkey", "_range", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_add")), "offsets")
    out = checked_join(placed.withColumn("_nkey", key), offsets, ["_nkey", "_range"], "inner")
    return out.withColumn(name, F.col("_place") + F.col("_add")).drop("_place", "_range", "_nkey", "_add")
