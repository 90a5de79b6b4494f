"""Where logits come from: a column, an expression, a hash of the prompt, or a caller's Arrow function.

A source gives every unit `logits`, an array aligned with its slots. Equal prompts are scored once: the distinct prompts
are scored and joined back, which pays off whenever the scorer costs more than a shuffle of its prompts.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.once import once


class LogitSource(Protocol):
    def attach(self, units: DataFrame) -> DataFrame:
        """units plus `logits`."""


class ColumnLogits:
    """Logits that are already there, in a column or an expression of the unit's columns."""

    def __init__(self, column: Column | str = "logits"):
        self.column = F.col(column) if isinstance(column, str) else column

    def attach(self, units: DataFrame) -> DataFrame:
        return units.withColumn("logits", self.column)


def hash_logit(text: Column, letter: Column) -> Column:
    """A number in [-4, 4) that depends on the whole text and the letter."""
    return F.conv(F.substring(F.md5(F.concat(text, F.lit("\x00"), letter)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * 8 - 4


class HashLogits:
    """A deterministic stand-in for a model, for tests of everything above it: its answers mean nothing."""

    def attach(self, units: DataFrame) -> DataFrame:
        return once(units, logits=F.transform("slots", lambda s: hash_logit(F.col("prompt"), s["letter"])))


class ArrowLogits:
    """A caller's batch function from prompts and slot counts to logits. Batches come sorted by prompt, so a model can
    reuse the prefix that neighbours share."""

    def __init__(self, score: Callable[[list[str], list[int]], list[list[float]]]):
        self.score = score

    def attach(self, units: DataFrame) -> DataFrame:
        score = self.score
        asked = units.select(F.col("prompt").alias("_p"), F.size("slots").alias("_n")).distinct()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = score(b.column("_p").to_pylist(), b.column("_n").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("_p"), b.column("_n"), pa.array(got, pa.list_(pa.float64()))], names=["_p", "_n", "logits"])

        scored = asked.sortWithinPartitions("_p").mapInArrow(run, "_p string, _n int, logits array<double>")
        return units.join(scored, (F.col("prompt") == F.col("_p")) & (F.size("slots") == F.col("_n")), "left").drop("_p", "_n")


class HttpLogits(ArrowLogits):
    """Logits from a server: each batch of prompts is one POST of {"prompts": [...], "slots": [...]}, answered by
    {"logits": [[...], ...]}. A failing request is tried again, then in halves; what fails alone fails the task, which Spark
    retries."""

    def __init__(self, url: str, timeout: float = 60.0, size: int = 64, tries: int = 2):
        def post(prompts: list[str], sizes: list[int]) -> list[list[float]]:
            body = json.dumps({"prompts": prompts, "slots": sizes}).encode()
            for k in range(tries):
                try:
                    req = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                    with urllib.request.urlopen(req, timeout=timeout) as r:
                        return json.load(r)["logits"]
                except OSError:
                    if k + 1 == tries and len(prompts) == 1:
                        raise
            half = len(prompts) // 2
            return post(prompts[:half], sizes[:half]) + post(prompts[half:], sizes[half:])

        def score(prompts: list[str], sizes: list[int]) -> list[list[float]]:
            return [x for i in range(0, len(prompts), size) for x in post(prompts[i : i + size], sizes[i : i + size])]

        super().__init__(score)


def memoised(source: LogitSource, units: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units with logits, new memo rows): prompts found in memo (key, logits) aren't scored again; key is a digest of
    the prompt."""
    keyed = units.withColumn("_memo", F.sha2("prompt", 256))
    known = memo.select(F.col("key").alias("_memo"), "logits")
    hits = keyed.join(known, "_memo")
    fresh = source.attach(keyed.join(known.select("_memo"), "_memo", "left_anti"))
    cols = [*units.columns, "logits"]
    new = fresh.select(F.col("_memo").alias("key"), "logits").dropDuplicates(["key"])
    return hits.select(*cols).unionByName(fresh.select(*cols)), new


def read_row(tokens: DataFrame, letters: DataFrame) -> DataFrame:
    """Long logit rows (unit_id, token_id, logit) read at the letters' token variants (letter, token_id): per unit and
    letter the largest logit, and per unit the coverage, the share of all probability that falls on the letters. The
    letters are at most 26 times a few variants, so they are broadcast."""
    small = F.broadcast(letters.select("letter", "token_id").distinct())
    seen = tokens.join(small, "token_id", "left")
    top = tokens.groupBy("unit_id").agg(F.max("logit").alias("m"))
    per = seen.join(top, "unit_id").groupBy("unit_id").agg(
        (F.sum(F.when(F.col("letter").isNotNull(), F.exp(F.col("logit") - F.col("m")))) / F.sum(F.exp(F.col("logit") - F.col("m")))).alias("coverage"))
    best = seen.filter("letter is not null").groupBy("unit_id", "letter").agg(F.max("logit").alias("logit"))
    return best.join(per.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))), "unit_id")


def letter_variants(vocabulary: DataFrame) -> DataFrame:
    """(letter, token_id) from a vocabulary (token, token_id): the bare letter and those after a space or a line end."""
    bare = F.regexp_extract("token", r"^[ \n]?([A-Z])$", 1)
    return vocabulary.withColumn("letter", bare).filter("letter <> ''").select("letter", "token_id")
