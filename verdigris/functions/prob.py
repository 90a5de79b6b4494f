"""Column expressions over probability vectors (arrays of doubles); all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.once import let




def asum(a: Column) -> Column:
    """Sum of an array of doubles, 0 if empty."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column) -> Column:
    """a divided by its sum."""
    return let(asum(a), lambda s: F.transform(a, lambda x: x / s))


def softmax(logits: Column, t: Column | float = 1.0) -> Column:
    """exp((l - max) / T), normalised."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    e = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp((x - m) / t)))
    return let(e, scaled)


def half_up(x: Column, digits: int) -> Column:
    """Rounded half away from zero by scaling, as all reported figures are."""
    k = 10.0**digits
    return F.round(x * F.lit(k)) / F.lit(k)


def r6(x: Column) -> Column:
    return half_up(x, 6)


def r4(x: Column) -> Column:
    return half_up(x, 4)


def confidence(p: Column) -> Column:
    """max(0, (n top - 1) / (n - 1)); 1 below two options."""
    n = F.size(p)
    return F.when(n < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (n * F.array_max(p) - 1) / (n - 1)))


def argmax_last(p: Column) -> Column:
    """0-based index of the maximum, the last one on ties."""
    return F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def argmax_first(p: Column) -> Column:
    """0-based index of the maximum, the first one on ties."""
    return F.array_min(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))["i"]


def gap(p: Column) -> Column:
    """Lead of the largest over the second; 1 for a single option."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).otherwise(F.lit(1.0))


def normalise(p: Column) -> Column:
    """L1-normalised; null when the sum isn't positive."""
    return let(asum(p), lambda s: F.when(s > 0, F.transform(p, lambda x: x / s)))


def powered(p: Column, t: Column) -> Column:
    """p^(1/T), renormalised unless all is 0."""
    q = F.transform(p, lambda x: F.pow(x, 1.0 / t))
    return let(q, lambda v: let(asum(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(v)))


def nll(p: Column, y: Column) -> Column:
    """-ln of the target's probability, floored at 1e-15."""
    return -F.log(F.greatest(F.get(p, y), F.lit(1e-15)))


def brier(p: Column, y: Column) -> Column:
    """Squared distance to the one-hot target, summed over classes."""
    return asum(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-sum t log softmax(l)."""
    z = let(F.array_max(logits), lambda m: m + F.log(asum(F.transform(logits, lambda x: F.exp(x - m)))))
    return let(z, lambda v: -asum(F.zip_with(logits, target, lambda x, t: t * (x - v))))


def kl_floor(g: Column, p: Column, floor: float = 1e-6) -> Column:
    """KL(g || p), p being floored and renormalised; terms with g = 0 are 0."""
    c = F.transform(p, lambda x: F.greatest(x, F.lit(floor)))
    return let(c, lambda v: let(asum(v), lambda z: asum(F.zip_with(g, v, lambda a, b: F.when(a > 0, a * F.log(a / (b / z))).otherwise(F.lit(0.0))))))


def total_variation(g: Column, p: Column) -> Column:
    return asum(F.zip_with(g, p, lambda a, b: F.abs(a - b))) / 2


def squared(g: Column, p: Column) -> Column:
    return asum(F.zip_with(g, p, lambda a, b: (a - b) * (a - b)))


def expected_level(p: Column) -> Column:
    """sum of k p_k."""
    return asum(F.transform(p, lambda x, i: x * i))


def ece_bin(conf: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.floor(conf * bins).cast("int"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p-value from the discordant counts: min(1, 2 P[X <= min(b, c)]), X ~ Bin(b + c, 1/2).
    The coefficients are built by a running product in logarithms, so large counts don't overflow."""
    n, k = (b + c).cast("double"), F.least(b, c)
    step = lambda s, i: F.struct((s["c"] + F.log((n - i + 1) / i)).alias("c"), (s["t"] + F.exp(s["c"] + F.log((n - i + 1) / i) - n * F.log(F.lit(2.0)))).alias("t"))
    start = F.struct(F.lit(0.0).alias("c"), F.exp(-n * F.log(F.lit(2.0))).alias("t"))
    total = F.when(k <= 0, start["t"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, step)["t"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))
