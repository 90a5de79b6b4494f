"""Temperatures per question type, out-of-fold calibration error and group bootstrap.

A bucket's samples stay distributed: the fit needs only the summed log-loss at a few temperatures, which one aggregation
per refinement gives for all buckets and folds at once. The bootstrap draws groups by hashed Poisson weights, so it is
one aggregation too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.prob import argmax_last, half_up, nll, powered
from verdigris.session import stored

FOLDS, MIN_SAMPLES, RESAMPLES, LOW, HIGH = 5, 4, 1000, 0.05, 20.0
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv64(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = OFFSET
    for b in data:
        h = ((h ^ b) * PRIME) & MASK
    return h


def fnv128(data: bytes) -> str:
    """FNV-1a, 128 bits, as hex."""
    h, mask = 0x6C62272E07BB014262B821756295C58D, (1 << 128) - 1
    for b in data:
        h = ((h ^ b) * 0x0000000001000000000000000000013B) & mask
    return f"{h:032x}"


def fold_of(id_: str, salt: str = "case-fold/", folds: int = FOLDS) -> int:
    """Fold of a case: the same for all its rows, whatever their order."""
    return fnv64((salt + id_).encode()) % folds


@F.pandas_udf(T.IntegerType())
def fold_udf(s):
    return s.map(lambda x: None if x is None else fold_of(x))


@F.pandas_udf(T.StringType())
def fnv64_udf(s):
    return s.map(lambda x: None if x is None else f"{fnv64(x.encode()):016x}")


@F.pandas_udf(T.StringType())
def fnv128_udf(s):
    return s.map(lambda x: None if x is None else fnv128(x.encode()))


class XorShift:
    """xorshift64*: a small generator whose draws don't depend on the platform."""

    def __init__(self, seed: int):
        self.x = seed | 1

    def next(self) -> int:
        x = self.x
        x ^= x >> 12
        x = (x ^ (x << 25)) & MASK
        self.x = x = x ^ (x >> 27)
        return (x * 0x2545F4914F6CDD1D) & MASK

    def below(self, n: int) -> int:
        return self.next() % max(n, 1)


def loss_table(samples: DataFrame, temps: DataFrame, by: list[str]) -> DataFrame:
    """Summed -ln p_T[y] of samples (bucket, by..., p, y) at the temperatures (bucket, t), and their number: one row per
    bucket, by and t, formed by partial sums per task. temps has a few rows per bucket."""
    j = samples.join(F.broadcast(temps), "bucket")
    return j.groupBy("bucket", *by, "t").agg(F.sum(nll(powered(F.col("p"), F.col("t")), F.col("y"))).alias("loss"), F.count("*").alias("n"))


def fit_temperatures(samples: DataFrame, points: int = 33, passes: int = 3, least: int = 2) -> dict[tuple[str, int], tuple[float, int]]:
    """(bucket, fold left out, -1 for none) to (temperature, samples fitted on), of samples (bucket, fold, p, y): the
    temperature that minimises the log-loss over ln T in [ln .05, ln 20]; 1 for fewer than `least` samples.

    A pass sums the losses per bucket, fold and temperature once; what a fold's absence leaves is the total less the fold. The
    loss has one minimum in ln T: each pass narrows a grid around the best point, and a parabola through the last three
    points gives the answer to a relative 1e-6. What the driver sees is a grid per bucket and fold."""
    spark = samples.sparkSession
    seen: dict[tuple[str, int], dict[float, float]] = {}
    many: dict[tuple[str, int], int] = {}
    spans: dict[tuple[str, int], tuple[float, float]] = {}
    low, high = math.log(LOW), math.log(HIGH)
    grid = {r["bucket"]: {low + (high - low) * i / (points - 1) for i in range(points)} for r in samples.select("bucket").distinct().collect()}
    for _ in range(passes):
        temps = spark.createDataFrame([(b, math.exp(x)) for b, xs in grid.items() for x in sorted(xs)], "bucket string, t double")
        at = {(b, math.exp(x)): x for b, xs in grid.items() for x in xs}
        losses: dict[tuple[str, float], dict[int, float]] = {}
        for r in loss_table(samples, temps, ["fold"]).collect() if grid else []:
            losses.setdefault((r["bucket"], at[(r["bucket"], r["t"])]), {})[r["fold"]] = r["loss"]
            many[(r["bucket"], r["fold"])] = r["n"]
        for (b, x), per in losses.items():
            total = math.fsum(per.values())
            for held, loss in ((-1, total), *((f, total - per.get(f, 0.0)) for f in range(FOLDS))):
                seen.setdefault((b, held), {})[x] = loss
        grid = {b: set() for b in grid}
        for k, found in seen.items():
            xs = sorted(found)
            i = min(range(len(xs)), key=lambda i: (found[xs[i]], xs[i]))
            a, z = xs[max(0, i - 1)], xs[min(len(xs) - 1, i + 1)]
            spans[k] = (a, z)
            grid[k[0]] |= {a + (z - a) * j / (points - 1) for j in range(1, points - 1)}
    out = {}
    for (b, held), found in seen.items():
        n = sum(c for (x, f), c in many.items() if x == b and f != held)
        xs = sorted(found)
        i = min(range(len(xs)), key=lambda i: (found[xs[i]], xs[i]))
        x = xs[i]
        if 0 < i < len(xs) - 1:
            d, e = xs[i] - xs[i - 1], xs[i + 1] - xs[i]
            f0, f1, f2 = (found[xs[j]] for j in (i - 1, i, i + 1))
            bend = d * (f2 - f1) + e * (f0 - f1)
            x += (d * d * (f1 - f2) + e * e * (f0 - f1)) / (2 * bend) if bend > 0 else 0.0
        out[(b, held)] = (math.exp(min(high, max(low, x))) if n >= least else 1.0, n)
    return out


def ece_of(rows: DataFrame, by: list[str], weight: Column | None = None, bins: int = 10) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    b = rows.withColumn("_w", w).groupBy(*by, F.least(F.lit(bins - 1), F.floor(F.col("conf") * bins)).alias("_b")).agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("conf")).alias("c"), F.sum(F.col("_w") * F.col("ok").cast("double")).alias("a"))
    return b.groupBy(*by).agg((F.sum(F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def calibrated(samples: DataFrame, temps: DataFrame, by: list[str]) -> DataFrame:
    """Samples at their fitted temperature: adds conf, ok."""
    j = samples.join(F.broadcast(temps.select(*by, "temperature")), by).withColumn("q", powered(F.col("p"), F.col("temperature")))
    top = argmax_last(F.col("q"))
    return j.withColumn("conf", F.get("q", top)).withColumn("ok", top == F.col("y")).drop("q", "temperature")


def bootstrap_ece(rows: DataFrame, group: str = "case_id", resamples: int = RESAMPLES, seed: int = 17) -> DataFrame:
    """(lo, hi): 95 % interval of the ECE of (group, conf, ok) under resampling of whole groups. Rows are first reduced to
    sums per group and bin; a resample weights each group by a Poisson(1) draw from a hash of (seed, resample, group), so
    draws need no order and no gathering. Each task adds its groups up to one row per resample and bin."""
    cells = rows.groupBy(group, F.least(F.lit(9), F.floor(F.col("conf") * 10)).cast("int").alias("b")).agg(F.sum(F.col("ok").cast("double") - F.col("conf")).alias("d"), F.count("*").alias("n"))

    def draw(batches):
        cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
        d, n = np.zeros((resamples, 10)), np.zeros((resamples, 10))
        salt = (np.arange(resamples, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h, b, dd, nn = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for at in range(0, len(h), 4096):
                part = slice(at, at + 4096)
                x = h[part].astype(np.int64).view(np.uint64)[None, :] ^ salt[:, None]
                for m, r in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
                    x = (x ^ (x >> np.uint64(r))) * np.uint64(m)
                w = np.searchsorted(cdf, (x >> np.uint64(11)) / float(1 << 53)).astype(float)
                for k in range(10):
                    at_k = b[part] == k
                    if at_k.any():
                        d[:, k] += w[:, at_k] @ dd[part][at_k]
                        n[:, k] += w[:, at_k] @ nn[part][at_k]
        i = np.repeat(np.arange(resamples), 10)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.tile(np.arange(10), resamples), pa.int32()), pa.array(d.ravel()), pa.array(n.ravel())], names=["i", "b", "d", "n"])

    sums = cells.select(F.xxhash64(group).alias("h"), "b", "d", F.col("n").cast("double").alias("n")).mapInArrow(draw, "i int, b int, d double, n double")
    per = sums.groupBy("i", "b").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).groupBy("i").agg(F.sum(F.abs("d")).alias("d"), F.sum("n").alias("n"))
    out = sorted(r["d"] / r["n"] if r["n"] else 0.0 for r in per.collect())  # one number per resample
    pair = (out[len(out) // 40], out[min(len(out) * 39 // 40, len(out) - 1)]) if out else (0.0, 0.0)
    return rows.sparkSession.createDataFrame([pair], "lo double, hi double")


def fit(samples: DataFrame, resamples: int = RESAMPLES) -> tuple[DataFrame, DataFrame]:
    """(temperatures, figures) of samples (case_id, bucket, p, y): temperatures per bucket, and one row of ECE raw, in-sample
    and out-of-fold with intervals and whether they are apart. Folds are by case; a fold with fewer than two other samples is
    left out; pooled over buckets."""
    s = stored(samples.select("case_id", "bucket", "p", "y").withColumn("fold", fold_udf("case_id")), "samples")
    fits = fit_temperatures(s)
    spark = samples.sparkSession
    temps = spark.createDataFrame([(b, t if n >= MIN_SAMPLES else 1.0, n) for (b, held), (t, n) in sorted(fits.items()) if held < 0], "bucket string, temperature double, n long")
    others = spark.createDataFrame([(b, held, t, n) for (b, held), (t, n) in sorted(fits.items()) if held >= 0 and n >= 2], "bucket string, fold int, temperature double, n long")
    after = calibrated(s, temps, ["bucket"])
    before = calibrated(s, temps.withColumn("temperature", F.lit(1.0)), ["bucket"])
    oof = calibrated(s, others, ["bucket", "fold"])
    used = after if oof.isEmpty() else oof
    cols = ["case_id", "conf", "ok"]
    ci_b, ci_o = bootstrap_ece(before.select(*cols), resamples=resamples).first(), bootstrap_ece(used.select(*cols), resamples=resamples).first()
    e = lambda d: (ece_of(d, []).first() or [0.0])[0] or 0.0
    row = (e(before), e(after), e(used), ci_b["lo"], ci_b["hi"], ci_o["lo"], ci_o["hi"], ci_o["hi"] < ci_b["lo"], s.count())
    figures = samples.sparkSession.createDataFrame([row], "ece_raw double, ece_in_sample double, ece_out_of_fold double, raw_lo double, raw_hi double, oof_lo double, oof_hi double, separated boolean, fitted long")
    return temps, figures


def document(temps: DataFrame, figures: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """One row of JSON: the calibration with its binding, temperatures rounded to four places."""
    t = temps.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", half_up(F.col("temperature"), 4).alias("t"))))).alias("temperatures"))
    return figures.crossJoin(F.broadcast(t)).select(F.to_json(F.struct(F.lit("calibration").alias("kind"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.col("fitted").alias("fitted_cases"), F.struct(F.col("ece_raw").alias("raw"), F.col("ece_in_sample").alias("in_sample"), F.col("ece_out_of_fold").alias("out_of_fold"), F.array("raw_lo", "raw_hi").alias("ci95_raw"), F.array("oof_lo", "oof_hi").alias("ci95_oof"), F.col("separated").alias("improvement_ci_separated")).alias("ece"), "temperatures")).alias("value"))
