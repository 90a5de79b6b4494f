"""Writers: create-only tables and documents, prompt exports, tagged pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def create_only(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a new table; an existing one is an error and stays as it is. The commit protocol leaves no torn output."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_document(one: DataFrame, path: str) -> None:
    """One row of text as one file, create-only."""
    one.coalesce(1).write.mode("errorifexists").text(path)


def export_prompts(units: DataFrame, path: str) -> DataFrame:
    """Rendered prompts as JSON lines (id, prompt, layout, letters), create-only; a null or repeated id is an error; rows whose
    choice had to be expanded are skipped. Returns one row: exported, skipped."""
    bad = units.groupBy("req_id").agg(F.count_distinct("q_pos").alias("n")).filter("req_id is null or n > 1")
    if not bad.isEmpty():
        raise ValueError("ids must be unique and not null")
    rows = units.filter("sub_idx is null").select(F.col("req_id").alias("id"), "prompt", "layout", "slots")
    rows.write.mode("errorifexists").json(path)
    return units.agg(F.sum(F.col("sub_idx").isNull().cast("int")).alias("exported"), F.count_distinct(F.when(F.col("sub_idx").isNotNull(), F.col("req_id"))).alias("skipped"))


def verdict_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("verdict").agg(F.count("*").alias("n"))


def write_kept(rows: DataFrame, tagged: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Writes the rows whose verdict is ok, create-only, and returns the counts of all verdicts."""
    create_only(rows.join(tagged.filter("verdict = 'ok'").select(key), key, "left_semi"), path)
    return verdict_counts(tagged)


def append_store(fresh: DataFrame, store: DataFrame | None, path: str) -> None:
    """Appends to a content-addressed store (key, binding, ...): keys that it holds stay, repeated ones come once."""
    new = fresh.dropDuplicates(["key"])
    new = new if store is None else new.join(store.select("key"), "key", "left_anti")
    new.write.mode("append").partitionBy("binding").parquet(path)


def compact_store(store: DataFrame, live: DataFrame, path: str) -> None:
    """Rewrites a store with the keys still in use to a new place."""
    create_only(store.join(live.select("key").distinct(), "key", "left_semi"), path)
