"""From logits to typed answers: decoding, folding of expanded choices, the wire shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.once import let, once
from verdigris.functions.prob import argmax_last, asum, confidence, gap, half_up, r4, r6, softmax
from verdigris.operators.questions import ABOVE, ABSTAIN, BELOW

CONTESTED = 0.15
_PROBS = "array<struct<key:string,p:double>>"


def bucket(qtype: Column) -> Column:
    """Calibration bucket of a question type."""
    return F.when(qtype == "noul", "boolean").otherwise(qtype)


def status(best_key: Column, lead: Column) -> Column:
    return F.when(best_key == ABSTAIN, "abstained").when(best_key.isin(BELOW, ABOVE), "out_of_bounds").when(lead < CONTESTED, "contested").otherwise("decided")


def decode(qtype: Column, slots: Column, p: Column) -> Column:
    """The typed answer of slots with probabilities p, as a struct: status, confidence, probabilities (ordered array of key and
    p), boolean, choice, score, level, value. Fields of other types are null."""
    best = F.get(slots, argmax_last(p))
    z = F.arrays_zip(slots.alias("s"), p.alias("p"))
    real = F.filter(z, lambda e: ~e["s"]["special"])
    n = F.size(real)
    yes_no, is_score, is_num = qtype.isin("boolean", "noul"), qtype == "score", qtype == "numeric"
    p_of = lambda key: F.coalesce(F.get(F.filter(z, lambda e: e["s"]["key"] == key), F.lit(0))["p"], F.lit(0.0))
    entry = lambda e, k: F.struct(e["s"][k].alias("key"), r6(e["p"]).alias("p"))
    kept = F.filter(z, lambda e: ~e["s"]["special"] | (e["s"]["key"] == ABSTAIN))
    by_key = F.transform(kept, lambda e: entry(e, "key"))
    by_text = F.transform(kept, lambda e: F.when(e["s"]["special"], entry(e, "key")).otherwise(entry(e, "text")))
    bounds = F.transform(F.filter(z, lambda e: e["s"]["key"].isin(BELOW, ABOVE)), lambda e: entry(e, "key"))
    mass = asum(F.transform(real, lambda e: e["p"]))
    value = asum(F.transform(real, lambda e: e["p"] * F.coalesce(e["s"]["key"].try_cast("double"), F.lit(0.0)))) / mass
    level_score = F.when(n > 1, asum(F.transform(real, lambda e, i: e["p"] * i / (n - 1)))).otherwise(F.lit(0.0))
    yes = p_of("yes") >= p_of("no")
    return F.struct(
        status(best["key"], gap(p)).alias("status"), r4(confidence(p)).alias("confidence"),
        F.when(is_score, by_text).when(is_num, F.concat(by_key, bounds)).otherwise(by_key).cast(_PROBS).alias("probabilities"),
        F.when(yes_no, yes).alias("boolean"),
        F.when(yes_no, F.when(yes, "yes").otherwise("no")).when(qtype == "choice", best["key"]).alias("choice"),
        F.when(is_score, r4(level_score)).alias("score"),
        F.when(is_score & ~best["special"], best["key"].try_cast("int")).alias("level"),
        F.when(is_num & (mass > 0), r6(value)).alias("value"),
    )


def temperature(base: Column, fitted: Column) -> Column:
    """The request's temperature times the fitted one of the bucket, 1 where none was fitted."""
    return base * F.coalesce(fitted, F.lit(1.0))


def p_yes(logits: Column, t: Column | float = 1.0) -> Column:
    """P(yes) of a probe, rounded as probes are merged."""
    return r6(F.get(softmax(logits, t), F.lit(0)))


def _folded(keys: Column, share: Column, best: Column, state: Column) -> Column:
    return F.struct(
        state.alias("status"), r4(confidence(share)).alias("confidence"),
        F.zip_with(keys, share, lambda k, p: F.struct(k.alias("key"), r6(p).alias("p"))).cast(_PROBS).alias("probabilities"),
        F.lit(None).cast("boolean").alias("boolean"), F.coalesce(F.get(keys, best), F.lit("")).alias("choice"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("value"),
    )


def _share(p: Column) -> Column:
    return let(asum(p), lambda s: F.when(s > 0, F.transform(p, lambda x: x / s)).otherwise(F.transform(p, lambda x: 1.0 / F.size(p))))


def merge_scored(keys: Column, p: Column, allow_abstain: Column) -> Column:
    """Probes folded to one answer: shares are normalised, decisiveness is judged on the raw P(yes), and with abstention
    allowed no option at one half means abstained."""
    best = argmax_last(p)
    state = F.when(allow_abstain & (F.get(p, best) < 0.5), "abstained").when(gap(p) < CONTESTED, "contested").otherwise("decided")
    return _folded(keys, _share(p), best, state)


def merge_paged(keys: Column, p: Column, allow_abstain: Column) -> Column:
    """Pages folded to one answer: p is each option's share within its page, summed by key; the gap is that of the
    renormalised shares."""
    share = _share(p)
    state = F.when(allow_abstain & (asum(p) <= 0), "abstained").when(gap(share) < CONTESTED, "contested").otherwise("decided")
    return _folded(keys, share, argmax_last(share), state)


def decide(units: DataFrame, temps: DataFrame | None = None, base: float = 1.0, expand: str = "probes") -> DataFrame:
    """Units with logits to answers: (req_id, q_pos, q_name, qtype, answer). temps (bucket, temperature) has a handful
    of rows. Expanded units are gathered per question (256 at most)."""
    t = F.lit(base)
    if temps is not None:
        units = units.join(F.broadcast(temps.select("bucket", F.col("temperature").alias("_t"))), "bucket", "left")
        t = temperature(t, F.col("_t"))
    u = once(units, p=softmax(F.col("logits"), t))
    one = u.filter("sub_idx is null").select("req_id", "q_pos", "q_name", "qtype", decode(F.col("qtype"), F.col("slots"), F.col("p")).alias("answer"))
    many = u.filter("sub_idx is not null")
    if expand == "probes":
        rows = many.select("req_id", "q_pos", "q_name", "qtype", "allow_abstain", F.struct("sub_idx", "key", r6(F.get("p", F.lit(0))).alias("p")).alias("e"))
    else:
        page = many.select("*", F.posexplode(F.arrays_zip("slots", "p")).alias("_i", "_e"))
        rows = page.groupBy("req_id", "q_pos", "q_name", "qtype", "allow_abstain", F.col("_e.slots.key").alias("key")).agg(F.min(F.col("sub_idx") * 26 + F.col("_i")).alias("sub_idx"), F.sum(r6(F.col("_e.p"))).alias("p")).select("req_id", "q_pos", "q_name", "qtype", "allow_abstain", F.struct("sub_idx", "key", "p").alias("e"))
    per = rows.groupBy("req_id", "q_pos", "q_name", "qtype", "allow_abstain").agg(F.sort_array(F.collect_list("e")).alias("e"))
    merge = merge_scored if expand == "probes" else merge_paged
    folded = per.select("req_id", "q_pos", "q_name", "qtype", merge(F.col("e.key"), F.col("e.p"), F.col("allow_abstain")).alias("answer"))
    return one.unionByName(folded)


def wire(qtype: Column, slots: Column, a: Column) -> Column:
    """The answer as it goes over the wire: type tag, noul as P(yes), score on 0..n-1 with probabilities keyed by level
    index and the levels' texts as legend, numeric value null-safe."""
    real = F.filter(slots, lambda s: ~s["special"])
    n = F.size(real)
    index = lambda e: F.coalesce(F.get(F.filter(real, lambda s: s["text"] == e["key"]), F.lit(0))["key"], e["key"])
    probs = F.when(qtype == "score", F.transform(a["probabilities"], lambda e: F.struct(index(e).alias("key"), e["p"].alias("p")))).otherwise(a["probabilities"])
    yes = F.get(F.filter(a["probabilities"], lambda e: e["key"] == "yes"), F.lit(0))["p"]
    return F.struct(
        qtype.alias("type"), a["status"].alias("status"), a["confidence"].alias("confidence"), probs.cast(_PROBS).alias("probabilities"),
        F.when(qtype == "noul", yes).alias("noul"), F.when(qtype == "boolean", a["boolean"]).alias("boolean"),
        F.when(qtype == "choice", a["choice"]).alias("choice"), F.when(qtype == "score", half_up(a["score"] * (n - 1), 4)).alias("score"),
        F.when(qtype == "score", a["level"]).alias("level"),
        F.when(qtype == "score", F.transform(real, lambda s: F.struct(s["key"].alias("key"), s["text"].alias("text")))).alias("legend"),
        F.when(qtype == "numeric", a["value"]).alias("value"),
    )
