"""Problem 8: mixing sources to target weights.

Method: temperature mixing. The weights of the mix lie between the targets and the sources' natural token shares:
w(a) ~ target^(1-a) * share^a; with no targets the targets are equal and a is the usual inverse temperature. a is
bisected until a target entropy, or a budget under the limits of repetition, is met. The weights are then realised as
budgeted block permutations: per repetition the texts of a source stand in the order of a hash, cut into blocks of the
hash's range; whole blocks are taken until the budget is spent, and only one block is looked at text by text.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm.encode import TOKENIZERS, VOCABULARY, token_counts
from verdigris.operators.joins import checked_join
from verdigris.session import spread, stored

#: Texts of a source per block, about, and most blocks per source.
PER_BLOCK, MAX_BLOCKS = 1000, 16_384


def tempered(target: dict[str, float], tokens: dict[str, int], a: float) -> dict[str, float]:
    """Normalised target^(1-a) * share^a over the sources with a target and tokens."""
    raw = {k: math.exp((1 - a) * math.log(w) + a * math.log(tokens[k])) for k, w in target.items() if w > 0 and tokens.get(k, 0) > 0}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(p: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in p.values() if v > 0)


def bisect(ok, lo: float, hi: float, steps: int = 60) -> float:
    """Smallest a in [lo, hi] with ok(a), ok being false below and true above; hi if it's nowhere true."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def capacity(weights: dict[str, float], room: dict[str, int]) -> float:
    """Largest total at which no source needs more than its room."""
    return min((room[k] / w for k, w in weights.items() if w > 0), default=0.0)


def choose_weights(target: dict[str, float], tokens: dict[str, int], repeats: dict[str, int], total: int | None = None, target_entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, exponent a, total tokens). Without a total the targets hold exactly and the total is the largest that the
    repetition limits allow. With one, a is the smallest exponent at which the total fits; where none does, the total is
    what fits at a = 1. With target_entropy, equal targets are sharpened towards the shares until it is met."""
    room = {k: tokens.get(k, 0) * max(0, repeats.get(k, 1)) for k in target}
    target = {k: w for k, w in target.items() if w > 0 and room[k] > 0}
    if not target:
        return {}, 0.0, 0.0
    if target_entropy is not None:
        flat = dict.fromkeys(target, 1.0)
        a = bisect(lambda x: entropy(tempered(flat, tokens, x)) <= target_entropy, 0.0, 8.0)
        w = tempered(flat, tokens, a)
    else:
        a, w = 0.0, tempered(target, tokens, 0.0)
        if total is not None and capacity(w, room) < total:
            a = bisect(lambda x: capacity(tempered(target, tokens, x), room) >= total, 0.0, 1.0)
            w = tempered(target, tokens, a)
    most = capacity(w, room)
    return w, a, most if total is None else min(total, most)


def sized_texts(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of the texts that can be used: in a source with a target, with a token at least, and each
    different text once, as its smallest doc_id (so copies don't get round the limit of repetitions)."""
    wanted = targets.filter("source is not null").select("source").distinct()
    rows = spread(documents.select("doc_id", "source", "text")).filter("text is not null and text <> '' and source is not null")
    rows = checked_join(rows, wanted, ["source"], "left_semi")
    first = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("d")).agg(F.min(F.struct("doc_id", "source")).alias("x")).select("x.*")
    first = stored(first, "texts")
    tokens = token_counts(rows.select("doc_id", "text"), "doc_id", "text", tokenizers, name).filter("tokens > 0")
    return first.join(tokens, "doc_id")


def _limits(targets: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    rows = targets.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("w"), F.min("max_repeats").alias("r")).collect()  # one row per source of the mix
    return {r["source"]: max(0.0, r["w"] or 0.0) for r in rows}, {r["source"]: 1 if r["r"] is None else r["r"] for r in rows}


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, target_entropy: float | None = None, seed: int = 17, sized: DataFrame | None = None, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(rows, report): rows has source, doc_id, repetition (from 0), position (a hash to shuffle by) and tokens of each
    use of a text; report has one row per target with its target share, planned share, actual share, tokens,
    available tokens, most repetitions used and allowed.

    A source without texts gets nothing and the others keep their proportions; null sources and null or empty texts are
    left out; a null weight counts as 0 and a null limit as 1; repeated targets are added up, the lower limit holding.
    Texts that no longer fit a source's budget are passed over for shorter ones in the last block.
    """
    spark = documents.sparkSession
    sized = stored(sized if sized is not None else sized_texts(documents, targets, tokenizers), "sized")
    target, repeats = _limits(targets)
    stats = sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()  # one row per source of the mix
    have, blocks = {r["source"]: r["t"] for r in stats}, {r["source"]: max(1, min(MAX_BLOCKS, r["n"] // PER_BLOCK)) for r in stats}
    weights, a, size = choose_weights(target, have, repeats, total, target_entropy)
    plan = []
    for k, w in weights.items():
        budget = min(int(w * size + 1e-6), have[k] * repeats[k])
        plan.append((k, budget // have[k], budget % have[k], blocks[k]))
    cut = F.broadcast(spark.createDataFrame(plan, "source string, whole long, rest long, blocks int"))
    uses = sized.join(cut, "source")
    full = uses.filter("whole > 0").withColumn("repetition", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int")))).select("source", "doc_id", "repetition", "tokens")
    # the last, partial repetition
    part = uses.filter("rest > 0").withColumn("repetition", F.col("whole").cast("int")).withColumn("h", F.xxhash64(F.lit(seed), "repetition", "doc_id")).withColumn("block", F.pmod(F.shiftright("h", 20), F.col("blocks")).cast("int"))
    per = part.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0))).drop("t")  # MAX_BLOCKS rows per source at most
    per = stored(per, "blocks")
    part = checked_join(part, per, ["source", "block"], "inner").filter("before < rest")
    last = per.join(cut, "source").filter("before < rest").groupBy("source").agg(F.max("block").alias("last"))
    part = part.join(F.broadcast(last), "source")
    cols = ["source", "doc_id", "repetition", "tokens"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"])
        left, keep = int(pdf["rest"].iloc[0] - pdf["before"].iloc[0]), []
        for t in pdf["tokens"]:
            keep.append(t <= left)
            left -= t if t <= left else 0
        return pdf.loc[keep, cols]

    ends = part.filter("block = last").groupBy("source").applyInPandas(fill, "source string, doc_id long, repetition int, tokens long")
    rows = full.unionByName(part.filter("block < last").select(*cols)).unionByName(ends)
    rows = stored(rows.withColumn("position", F.xxhash64(F.lit(seed + 1), "repetition", "doc_id")), "mix")
    got = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("repetition") + 1).alias("repeats_used"))
    all_tokens = rows.select(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] or 1
    norm = sum(target.values()) or 1.0
    info = spark.createDataFrame([(k, t / norm, weights.get(k, 0.0), have.get(k, 0), repeats[k], a) for k, t in target.items()], "source string, target_share double, planned_share double, available_tokens long, repeats_allowed int, exponent double")
    report = info.join(F.broadcast(got), "source", "left").select("source", "target_share", "planned_share", (F.coalesce("tokens", F.lit(0)) / F.lit(all_tokens)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "available_tokens", F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"), "repeats_allowed", "exponent")
    return rows, report
