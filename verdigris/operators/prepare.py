"""Training cases: checks, near-duplicates, contamination, soft targets, permutations, stratified grouped splits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from verdigris.functions.once import let, once
from verdigris.functions.prob import asum
from verdigris.functions.text import norm_text, shingles
from verdigris.operators import intervals
from verdigris.operators.components import components
from verdigris.operators.drift import soft_labels
from verdigris.operators.joins import checked_join, hot_join, running, salted_join
from verdigris.operators.metrics import parse_expect
from verdigris.operators.questions import ABOVE, ABSTAIN, BELOW, MAX_SLOTS, anchors, float_text, parse_question, slots
from verdigris.session import spread, stored

BANDS, BAND, JACCARD, CONTAMINATED, SMOOTHING = 16, 4, 0.8, 0.5, 0.10
#: Characters of the shortest text that can contaminate, of a long one, and of one that a long one may hold.
GRAM, LONG_TEXT, HELD_TEXT = 15, 60, 30
#: Characters of evaluation texts that are broadcast at once.
EVAL_CHARS = 1_000_000
# Licenses that allow use, what their text may not contain, and the uses that are left out (fixed values).
PERMISSIVE = "cc0-1.0 cc-by-4.0 cc-by-3.0 cc-by-2.5 cc-by-sa-4.0 cc-by-sa-3.0 apache-2.0 mit odc-by pddl bsd gpl-3.0 lgpl-3.0 unlicense unspecified other unknown".split()
DENIED = ("non-commercial", "noncommercial", "non commercial", "research use", "research only", "research purposes", "academic")
DROPPED_USES = ("non-commercial",)
NONE_OF_ABOVE = ("none of the above", "nessuna delle precedenti", "none of these", "all of the above", "tutte le precedenti")


def license_ok(lic: Column, use: Column | None = None) -> Column:
    """Whether a license allows use: nothing denied in its text, a permissive name before its first bracket, and no dropped
    use. Null licenses don't."""
    low = F.lower(lic)
    denied = low.rlike("|".join(DENIED))
    if use is not None:
        denied = denied | F.coalesce(F.lower(use).isin(*DROPPED_USES), F.lit(False))
    return F.coalesce(~denied & F.trim(F.split(low, r"\(")[0]).isin(*PERMISSIVE), F.lit(False))


def case_errors(q: Column, expect: Column, state: Column, id_: Column) -> Column:
    """All errors of a training case as an array of texts, empty if it is fine. q and expect are parsed."""
    n = F.coalesce(F.size(q["criteria"]), F.lit(0))
    a = q["allow_abstain"].cast("int")
    t, num = q["qtype"], q["qtype"] == "numeric"
    e = expect
    keys = F.transform(q["criteria"], lambda x: F.coalesce(x["key"], x["text"]))
    norm = norm_text(state)
    has_status = e["status"].isNotNull()
    err = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), text)
    found = F.array(
        err(id_.isNull(), "missing id"), err(state.isNull(), "missing state"), err(q.isNull(), "question is no object"), err(e.isNull(), "expect is no object"),
        err(t.isNull() | ~t.isin("boolean", "noul", "choice", "score", "numeric"), "bad type"), err(F.size(q["unknown"]) > 0, "extra keys"),
        err((t == "noul") & q["allow_abstain"], "noul cannot abstain"), err(t.isin("choice", "score") & (n < 2), "fewer than two criteria"),
        err((t == "score") & (q["criteria_kind"] != "list"), "score needs a list"), err(t.isin("choice", "score") & (n + a > MAX_SLOTS), "too many slots"),
        err(num & ~F.coalesce(q["min"] < q["max"], F.lit(False)), "needs min below max"), err(num & ~q["granularity"].between(2, 24), "granularity"),
        err(num & (anchors(q) + 2 + a > MAX_SLOTS), "too many anchors"),
        err(has_status & ~e["status"].isin("abstained", "decided", "contested", "out_of_bounds"), "bad status"),
        err((e["status"] == "abstained") & ~q["allow_abstain"], "abstained without leave"),
        err(~has_status & (t == "choice") & ~F.coalesce(F.array_contains(keys, e["choice"]), F.lit(False)), "choice not in criteria"),
        err(~has_status & t.isin("boolean", "noul") & e["boolean"].isNull(), "no boolean"),
        err(~has_status & (t == "score") & ~F.coalesce((e["level"] >= 0) & (e["level"] < n), F.lit(False)), "level out of range"),
        err(~has_status & num & ~F.coalesce(e["value"].between(q["min"], q["max"]), F.lit(False)), "value out of range"),
        err(norm == "", "empty state"), err((norm != "") & (F.char_length(norm) < 15), "state too short"),
    )
    return F.filter(found, lambda x: x.isNotNull())


# ---- near-duplicates ----


def minhash(sh: Column, n: int = BANDS * BAND) -> Column:
    """n minima of hashes of the shingles: one 64-bit hash per shingle and index."""
    return let(sh, lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_min(F.transform(v, lambda s: F.xxhash64(i, s)))))


def bands(sig: Column) -> Column:
    """(band, hash) of a signature."""
    return let(sig, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.slice(v, b * BAND + 1, BAND)).alias("h"))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def shingle_hashes(texts: DataFrame) -> DataFrame:
    """(id, hs): the sorted distinct hashes of the 5-word shingles of texts (rep, norm). Similarities are of these; two
    shingles of one text that share a 64-bit hash would count as one."""
    return texts.select(F.col("rep").alias("id"), F.array_sort(F.array_distinct(F.transform(shingles(F.col("norm")), lambda s: F.xxhash64(s)))).alias("hs"))


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the hashes of a batch (..., hs)."""
    col = b.column("hs")
    lens = np.diff(col.offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), lens), col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, side, h, n, parts) of the rarest n - ceil(t n) + 1 of the n hashes of (id, hs), on either side; parts says how a
    common hash is cut into blocks. Rarity is counted in a table of fixed size; a hash that no other text has starts no
    pair, and is left out where the table shows it."""
    counts = intervals.counted(sets.select("hs"), lambda b: [_lists(b)[1]])
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            row, h = _lists(b)
            n = np.bincount(row, minlength=b.num_rows)
            often = seen[(h % np.uint64(intervals.COUNTERS)).astype(np.int64)]
            order = np.lexsort((h, often, row))
            want = np.maximum(1, n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1)
            start = np.cumsum(n) - n
            order = order[np.arange(len(row)) - start[row] < want[row]]
            order = order[often[order] > 1]
            both, r = np.concatenate((order, order)), np.concatenate((row[order], row[order]))
            side = np.arange(len(both)) < len(order)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(r)), pa.array(side), pa.array(h[both].view(np.int64)), pa.array(n[r].astype(np.int32)), pa.array(intervals.blocks_of(often[both]))], names=["id", "side", "h", "n", "parts"])

    return sets.mapInArrow(keep, "id long, side boolean, h long, n int, parts int")


def similar_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of texts (rep, norm), a < b, whose sets of 5-word shingles have a Jaccard similarity >= threshold; all of them.

    Prefix filter: with shingles in order of rarity, two sets of n shingles that are similar share one of their first
    n - ceil(t n) + 1. Only those prefixes meet, so boilerplate starts no pair unless a text consists of it; then its
    interval is cut into blocks. Sizes that differ too much are left out before sets are compared."""
    sets = stored(shingle_hashes(texts), "shingles")

    def fit(x: intervals.Columns, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = x["n"][a], x["n"][b]
        return (x["id"][a] < x["id"][b]) & (np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9)

    pairs = stored(intervals.pairs_in_intervals(prefixes(sets, threshold), "h", [], fit), "candidates")
    named = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "compared")
    some = stored(checked_join(sets, named, ["id"], "left_semi"), "sets")
    j = salted_join(salted_join(pairs, some.toDF("a", "sa"), "a", F.col("b"), salts=4), some.toDF("b", "sb"), "b", F.col("a"), salts=4)
    common = F.size(F.array_intersect("sa", "sb"))
    return j.filter(common / (F.size("sa") + F.size("sb") - common) >= threshold).select("a", "b")


def near_duplicates(df: DataFrame, id_: str, text: str, threshold: float = JACCARD, ascii_only: bool = False) -> DataFrame:
    """(id, keep, links): every row with the smallest id of its class of near-duplicates and the number of different texts
    it is directly linked to. Texts equal after normalisation are one; different ones are linked by a Jaccard similarity of
    5-word shingles at or above the threshold, and classes are connected components. Null and empty texts stand alone."""
    base = spread(df.select(id_, text)).select(F.col(id_).cast("long").alias("id"), norm_text(F.coalesce(F.col(text), F.lit("")), ascii_only).alias("norm"))
    base = stored(base.withColumn("h", F.when(F.col("norm") != "", F.sha2("norm", 256))), "normalised")
    firsts = stored(base.filter("h is not null").groupBy("h").agg(F.min("id").alias("rep"), F.first("norm").alias("norm")), "texts")
    edges = stored(similar_pairs(firsts, threshold), "links")
    roots = components(edges).withColumnRenamed("node", "rep")
    links = edges.select(F.col("a").alias("rep")).union(edges.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    linked = stored(roots.join(links, "rep"), "linked")
    reps = checked_join(firsts.select("h", "rep"), linked, ["rep"], "left").select("h", F.coalesce("root", "rep").alias("keep"), F.coalesce("links", F.lit(0)).alias("links"))
    out = hot_join(base.select("id", "h"), stored(reps, "classes"), "h", F.col("id"), "left")
    return out.select("id", F.coalesce("keep", "id").alias("keep"), F.coalesce("links", F.lit(0)).alias("links"))


def dedup_text(state: Column, q: Column) -> Column:
    """What makes a case a duplicate: state, instructions and criteria."""
    return F.concat(F.coalesce(state, F.lit("")), F.lit(" || "), F.coalesce(q["instructions"], F.lit("")), F.coalesce(q["criteria_json"], F.lit("")))


class EvalTexts:
    """A block of evaluation texts, to be found in other texts and to find them in.

    A text of GRAM characters or more that contains another holds the other's first GRAM characters; both kinds of
    candidates come from sorted hashes of them, and are then compared."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        self.sets = [word_runs_of(t) for t in self.texts]
        self.having: dict[tuple[str, ...], list[int]] = {}
        for k, s in enumerate(self.sets):
            for g in s:
                self.having.setdefault(g, []).append(k)
        grams = [gram_hashes(t) for t in self.texts]
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.every, self.of, self.at = every[order], of[order], at[order]
        first = np.array([g[0] for g in grams], np.uint64)
        self.by_first = np.argsort(first, kind="stable")
        self.first = first[self.by_first]

    def matches(self, text: str) -> set[int]:
        """The evaluation texts that a text of GRAM characters or more repeats."""
        found: set[int] = set()
        if len(text) >= LONG_TEXT:
            mine = word_runs_of(text)
            shared: dict[int, int] = {}
            for g in mine:
                for k in self.having.get(g, ()):
                    shared[k] = shared.get(k, 0) + 1
            found |= {k for k, n in shared.items() if n / (len(mine) + len(self.sets[k]) - n) >= CONTAMINATED}
        grams = gram_hashes(text)
        lo, hi = np.searchsorted(self.every, grams[0], "left"), np.searchsorted(self.every, grams[0], "right")
        found |= {int(k) for k, i in zip(self.of[lo:hi], self.at[lo:hi]) if self.texts[k].startswith(text, int(i))}
        lo = np.searchsorted(self.first, grams, "left")
        for i in np.flatnonzero((lo < len(self.first)) & (self.first[np.minimum(lo, len(self.first) - 1)] == grams)):
            j = int(lo[i])
            while j < len(self.first) and self.first[j] == grams[i]:
                k = int(self.by_first[j])
                if k not in found and (len(text) < LONG_TEXT or len(self.texts[k]) >= HELD_TEXT) and text.startswith(self.texts[k], int(i)):
                    found.add(k)
                j += 1
        return found


def word_runs_of(text: str) -> set[tuple[str, ...]]:
    """Runs of five words of a normalised text; the whole text if it is shorter."""
    w = text.split(" ")
    return set(zip(*(w[i:] for i in range(5)))) or {tuple(w)}


def gram_hashes(text: str) -> np.ndarray:
    """Hashes of every GRAM consecutive characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(c) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + len(h)]
    return h


def contaminated(cases: DataFrame, evals: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(id, eval_id) of cases (id, state) that repeat an evaluation state (eval_id, state): long normalised texts (60
    characters and more) by Jaccard >= .5 of 5-word shingles or by containment either way (an evaluation text of 30
    characters at least); shorter ones (15 at least) by containment either way. The evaluation texts are broadcast in blocks
    of EVAL_CHARS characters, each against all cases, which aren't shuffled; null texts match nothing."""
    norm = lambda d, i: d.select(F.col(i).alias(i), norm_text(F.coalesce("state", F.lit("")), ascii_only).alias("t")).filter(F.char_length("t") >= GRAM)
    c = stored(norm(spread(cases.select("id", "state")), "id"), "norm-cases")
    e = norm(evals, "eval_id").withColumn("value", F.char_length("t"))
    e = stored(running(e, ["eval_id", "t"], "value").withColumn("block", F.floor(F.col("before") / EVAL_CHARS)), "norm-evals")
    kind, arrow = (dict(c.dtypes)["id"], dict(e.dtypes)["eval_id"]), to_arrow_type(e.schema["eval_id"].dataType)

    def against(block: int) -> DataFrame:
        shared = cases.sparkSession.sparkContext.broadcast(EvalTexts([(r["eval_id"], r["t"]) for r in e.filter(F.col("block") == block).select("eval_id", "t").collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            ids = pa.array(held.ids, arrow)
            for b in batches:
                pairs = [(i, k) for i, t in enumerate(b.column("t").to_pylist()) for k in sorted(held.matches(t))]
                row, which = (np.array([x[j] for x in pairs], np.int64) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), ids.take(pa.array(which))], names=["id", "eval_id"])

        return c.mapInArrow(run, f"id {kind[0]}, eval_id {kind[1]}")

    blocks = [r["block"] for r in e.select("block").distinct().orderBy("block").collect()]
    none = c.limit(0).crossJoin(e.limit(0).select("eval_id")).select("id", "eval_id")
    return reduce(DataFrame.union, [against(b) for b in blocks], none).distinct()


def verdicts(cases: DataFrame, evals: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """(id, verdict): bad, duplicate, contaminated or ok, in this order of precedence. cases has id (bigint), state, question,
    expect (JSON texts)."""
    q, e = parse_question(F.col("question")), parse_expect(F.col("expect"))
    rows = cases.select("id", "state", q.alias("q"), e.alias("e")).withColumn("bad", F.size(case_errors(F.col("q"), F.col("e"), F.col("state"), F.col("id").cast("string"))) > 0)
    rows = stored(rows.select("id", "state", "bad", dedup_text(F.col("state"), F.col("q")).alias("text")), "checked")
    good = rows.filter("not bad")
    dup = near_duplicates(good, "id", "text", ascii_only=ascii_only).select("id", (F.col("keep") != F.col("id")).alias("dup"))
    out = rows.select("id", "bad").join(dup, "id", "left")
    if evals is not None:
        out = out.join(contaminated(good.select("id", "state"), evals, ascii_only).select("id").distinct().withColumn("leak", F.lit(True)), "id", "left")
    else:
        out = out.withColumn("leak", F.lit(None).cast("boolean"))
    return out.select("id", F.when(F.col("bad"), "bad").when(F.col("dup"), "duplicate").when(F.col("leak"), "contaminated").otherwise("ok").alias("verdict"))


# ---- targets ----


def expected_key(q: Column, e: Column) -> Column:
    """Key of the verified label; a score's is its level, a numeric one's its value."""
    t = q["qtype"]
    return F.when(e["status"] == "abstained", ABSTAIN).when(t.isin("boolean", "noul"), F.when(F.coalesce(e["boolean"], e["value"] != 0), "yes").otherwise("no")).when(t == "choice", e["choice"]).when(t == "score", e["level"].cast("string")).when(t == "numeric", float_text(e["value"]))


def slot_index(sl: Column, key: Column) -> Column:
    """0-based slot of a key: by key or text, else by numeric equality with either."""
    num = key.try_cast("double")
    exact = F.array_min(F.filter(F.transform(sl, lambda s, i: F.when((s["key"] == key) | (s["text"] == key), i)), lambda i: i.isNotNull()))
    equal = F.array_min(F.filter(F.transform(sl, lambda s, i: F.when((s["key"].try_cast("double") == num) | (s["text"].try_cast("double") == num), i)), lambda i: i.isNotNull()))
    return F.coalesce(exact, equal)


def numeric_slot(sl: Column, q: Column, v: Column) -> Column:
    """Slot of a number: the bound it lies beyond, else the nearest anchor, the first on ties."""
    near = F.array_min(F.filter(F.transform(sl, lambda s, i: F.struct(F.when(~s["special"], F.abs(s["key"].try_cast("double") - v)).alias("d"), i.alias("i"))), lambda x: x["d"].isNotNull()))["i"]
    return F.when(v < q["min"], slot_index(sl, F.lit(BELOW))).when(v > q["max"], slot_index(sl, F.lit(ABOVE))).otherwise(near)


def gold_index(q: Column, e: Column, sl: Column) -> Column:
    t = q["qtype"]
    by_level = F.when((e["level"] >= 0) & (e["level"] < F.size(sl)), e["level"])
    plain = slot_index(sl, expected_key(q, e))
    return F.when(e["status"] == "abstained", slot_index(sl, F.lit(ABSTAIN))).when(t == "score", by_level).when((t == "numeric") & e["value"].isNotNull(), numeric_slot(sl, q, e["value"])).otherwise(plain)


def soft_map(q: Column, soft: Column) -> Column:
    """A soft label (JSON object of one of its six shapes) as an ordered array of (key, p), or null where it is absent or
    malformed: positional lists (options, levels, distribution), a map of labels, p_yes or a fraction of yes votes, or the
    object itself as a map."""
    m = F.from_json(soft, "map<string,string>")
    t = q["qtype"]
    keys = F.when(t.isin("boolean", "noul"), F.array(F.lit("yes"), F.lit("no"))).when((t == "choice") | (q["criteria_kind"] == "map"), F.transform(q["criteria"], lambda x: F.coalesce(x["key"], x["text"]))).otherwise(F.transform(q["criteria"], lambda x, i: i.cast("string")))
    pair = "array<struct<key:string,p:double>>"

    def listed(raw: Column) -> Column:
        v = F.transform(F.from_json(raw, "array<string>"), lambda x: x.try_cast("double"))
        good = raw.startswith("[") & (F.size(v) == F.size(keys)) & F.forall(v, lambda x: x.isNotNull())
        return F.when(good, F.zip_with(keys, v, lambda k, x: F.struct(k.alias("key"), x.alias("p"))).cast(pair))

    def mapped(entries: Column) -> Column:
        v = F.transform(entries, lambda x: F.struct(x["key"].alias("key"), x["value"].try_cast("double").alias("p")))
        return F.when((F.size(v) > 0) & F.forall(v, lambda x: x["p"].isNotNull()), v.cast(pair))

    yes = lambda p: F.when(p.isNotNull(), F.array(F.struct(F.lit("yes").alias("key"), p.alias("p")), F.struct(F.lit("no").alias("key"), (1.0 - p).alias("p"))).cast(pair))
    d = m["distribution"]
    dist = F.when(d.startswith("{"), mapped(F.map_entries(F.from_json(d, "map<string,string>")))).when(d.startswith("["), listed(d)).when(t.isin("boolean", "noul"), yes(d.try_cast("double")))
    return F.when(m["options"].isNotNull(), listed(m["options"])).when(m["levels"].isNotNull(), listed(m["levels"])).when(m["p_yes"].isNotNull(), yes(m["p_yes"].try_cast("double"))).when(d.isNotNull(), dist).otherwise(mapped(F.map_entries(m)))


def project(sl: Column, dist: Column) -> Column:
    """Weights of a distribution per slot."""
    at = F.transform(dist, lambda x: F.struct(slot_index(sl, x["key"]).alias("i"), x["p"].alias("p")))
    return let(at, lambda v: F.transform(sl, lambda s, i: asum(F.transform(F.filter(v, lambda x: x["i"] == i), lambda x: x["p"]))))


def smoothed_gold(sl: Column, gi: Column, qtype: Column, eps: float = SMOOTHING) -> Column:
    """Target around the verified slot: a special gold shares eps with all real slots; an ordinal one with its two real
    neighbours, a missing side's share staying on the gold; else all other real slots share it."""
    real = F.size(F.filter(sl, lambda s: ~s["special"]))
    gold = F.get(sl, gi)
    near = lambda j: F.coalesce(~F.get(sl, j)["special"], F.lit(False)) & (j >= 0)
    nb = F.when((gi > 0) & near(F.greatest(gi - 1, F.lit(0))), 1).otherwise(0) + F.when(near(gi + 1), 1).otherwise(0)
    ordinal = F.transform(sl, lambda s, i: F.when(i == gi, F.when(nb > 0, 1 - eps + eps - eps / 2 * nb).otherwise(1.0)).when((F.abs(i - gi) == 1) & ~s["special"], eps / 2).otherwise(0.0))
    special = F.transform(sl, lambda s, i: F.when(i == gi, 1 - eps).when(~s["special"], eps / real).otherwise(0.0))
    flat = F.transform(sl, lambda s, i: F.when(i == gi, 1 - eps).when(~s["special"], eps / (real - 1)).otherwise(0.0))
    return F.when(gold["special"], special).when(qtype.isin("score", "numeric"), ordinal).otherwise(flat)


def with_target(cases: DataFrame, eps: float = SMOOTHING) -> DataFrame:
    """Cases (q, e, slots, soft) with gold (slot of the verified label), target_source, unmatched and target: human votes
    where there are any with a maximum below .99, mass beyond .05 that fits no slot going to the gold; else the smoothed
    gold; null target without either."""
    alias = lambda k: F.when(F.lower(k) == "true", "yes").when(F.lower(k) == "false", "no").otherwise(k)
    c = once(cases, gold=gold_index(F.col("q"), F.col("e"), F.col("slots")), _d=soft_map(F.col("q"), F.col("soft")))
    yes_no = F.col("q.qtype").isin("boolean", "noul")
    c = once(c, _d=F.when(yes_no, F.transform("_d", lambda x: F.struct(alias(x["key"]).alias("key"), x["p"].alias("p")))).otherwise(F.col("_d")))
    c = once(c, _v=project(F.col("slots"), F.col("_d")), _use=F.coalesce(F.array_max(F.transform("_d", lambda x: x["p"])) < 0.99, F.lit(False)), _all=asum(F.transform("_d", lambda x: x["p"])))
    c = once(c, _t=asum(F.col("_v")))
    c = once(c, _n=F.when(F.col("_t") > 0, F.transform("_v", lambda x: x / F.col("_t"))).otherwise(F.col("_v")), unmatched=F.when(F.col("_use"), F.col("_all") - F.col("_t")).otherwise(0.0))
    fixed = F.transform("_n", lambda x, i: x + F.when(i == F.col("gold"), F.col("unmatched")).otherwise(0.0))
    c = once(c, _f=F.when((F.col("unmatched") > 0.05) & F.col("gold").isNotNull(), fixed).otherwise(F.col("_n")))
    c = once(c, _s=asum(F.col("_f")), _g=F.when(F.col("gold").isNotNull(), smoothed_gold(F.col("slots"), F.col("gold"), F.col("q.qtype"), eps)))
    soft = F.when((F.col("unmatched") > 0.05) & (F.col("_s") > 0), F.transform("_f", lambda x: x / F.col("_s"))).otherwise(F.col("_f"))
    c = once(c, target=F.when(F.col("_use"), soft).otherwise(F.col("_g")), target_source=F.when(F.col("_use"), "soft").when(F.col("gold").isNotNull(), "gold"))
    return c.drop("_d", "_v", "_use", "_all", "_t", "_n", "_f", "_s", "_g")


def merge_target(anchor_key: Column, anchor_mass: Column, dist: Column) -> Column:
    """A teacher's distribution (key, p) with a fixed mass on the verified label and the rest scaled to what is left; as it is
    where the label isn't among its keys, all on the label where nothing else has mass."""
    other = asum(F.transform(F.filter(dist, lambda x: x["key"] != anchor_key), lambda x: x["p"]))
    known = F.coalesce(F.exists(dist, lambda x: x["key"] == anchor_key), F.lit(False))
    merged = let(other, lambda o: F.transform(dist, lambda x: F.struct(x["key"].alias("key"), F.when(x["key"] == anchor_key, anchor_mass).otherwise(x["p"] / o * (1 - anchor_mass)).alias("p"))))
    alone = F.array(F.struct(anchor_key.alias("key"), F.lit(1.0).alias("p")))
    return F.when(~known, dist).when(other <= 0, alone).otherwise(merged)


def teacher_label(q: Column, a: Column) -> Column:
    """The label a teacher's answer stands for: abstention, the likelier of yes and no, the choice, the level's text, else the
    key with the largest probability, the first on ties."""
    t = q["qtype"]
    return F.when(a["status"] == "abstained", ABSTAIN).when(t == "choice", a["choice"]).when(t == "score", F.get(q["criteria"], a["level"])["text"]).otherwise(teacher_argmax(a["probabilities"]))


def teacher_argmax(dist: Column) -> Column:
    """Label of the largest p, the first on ties."""
    return F.array_min(F.transform(dist, lambda x, i: F.struct((-x["p"]).alias("p"), i.alias("i"), x["key"].alias("k"))))["k"]


def label_cases(votes: DataFrame) -> DataFrame:
    """Voices (case_id, voice, dist) per case: their mean distribution, its argmax, and whether all voices agree on it."""
    v = votes.withColumn("pick", teacher_argmax(F.col("dist")))
    e = v.select("case_id", "pick", F.posexplode("dist").alias("pos", "x"))
    mean = e.groupBy("case_id", F.col("x.key").alias("key")).agg(F.avg("x.p").alias("p"), F.min("pos").alias("pos"))
    dist = mean.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key", "p"))), lambda x: F.struct(x["key"].alias("key"), x["p"].alias("p"))).alias("dist"))
    agree = v.groupBy("case_id").agg(F.count("*").alias("voices"), (F.min("pick") == F.max("pick")).alias("agree"))
    return dist.join(agree, "case_id").select("case_id", "voices", "agree", teacher_argmax(F.col("dist")).alias("label"), "dist")


def wants_question_first(id_: Column, fraction: float, options: Column) -> Column:
    """Whether a case is among the given fraction: the SHA-1 of its base id, as a number, mod 10000. Cases with an option like
    'none of the above' aren't. The 160 bits are folded digit by digit."""
    h = F.sha1(base_id(id_))
    mod = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0).cast("long"), lambda s, i: F.pmod(s * 16 + F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("long"), F.lit(10000)))
    nota = F.coalesce(F.exists(options, lambda t: F.lower(t).rlike("|".join(NONE_OF_ABOVE))), F.lit(False))
    return ~nota & (mod / 10000 < fraction)


def base_id(id_: Column) -> Column:
    return F.regexp_replace(id_, r"~p\d+$", "")


def group_key(id_: Column, chain: Column, state: Column) -> Column:
    """What must not be parted: the chain a case belongs to, else its state."""
    return F.coalesce(F.concat(F.lit("chain:"), chain), F.concat(F.lit("state:"), F.sha2(state, 256)))


def stratum(source: Column, qtype: Column, lang: Column, abstain: Column) -> Column:
    """(source family, type, language, abstention) as one text."""
    src = F.coalesce(source, F.lit("gen"))
    fam = F.when(src.contains("/"), F.split_part(src, F.lit("/"), F.lit(1))).when(src == "gen", "gen").otherwise(F.split_part(src, F.lit("-"), F.lit(1)))
    return F.concat_ws("|", fam, qtype, F.coalesce(lang, F.lit("en")), abstain.cast("string"))


def stratified_splits(rows: DataFrame, share: float = 0.05, floor: int = 10, frozen: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """(group_key, fold) for rows (group_key, stratum): dev and holdout each get max(1, round(share n)) rows of every stratum of
    `floor` rows or more, whole groups at a time, rarest strata first; frozen groups keep their fold; the rest is train.
    The strata are few and handled in a loop on their counts; groups are ordered by a hash and taken by running sums, never
    gathered on the driver."""
    g = stored(rows.groupBy("group_key", "stratum").agg(F.count("*").alias("n")), "groups")
    strata = g.groupBy("stratum").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor).orderBy("n", "stratum").collect()
    base = g.select("group_key").distinct()
    assigned = stored(frozen.select("group_key", "fold") if frozen is not None else base.limit(0).withColumn("fold", F.lit("")), "assigned")
    for s in strata:
        quota = max(1, int(share * s["n"] + 0.5))
        for fold in ("dev", "holdout"):
            mine = g.filter(F.col("stratum") == s["stratum"])
            have = mine.join(assigned.filter(F.col("fold") == fold), "group_key", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if have >= quota:
                continue
            free = mine.join(assigned.select("group_key"), "group_key", "left_anti").withColumn("h", F.md5(F.concat_ws(":", "group_key", F.lit(str(seed)), F.lit(fold))))
            run = running(free, ["h", "group_key"], "n")
            new = run.filter(F.col("before") < quota - have).select("group_key", F.lit(fold).alias("fold"))
            assigned = stored(assigned.unionByName(new), "assigned")
    return base.join(assigned, "group_key", "left").select("group_key", F.coalesce("fold", F.lit("train")).alias("fold"))


def cap_per_source(rows: DataFrame, n: int, source: str = "source", order: str = "record_no") -> DataFrame:
    """The first n rows of each source."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(order))).filter(F.col("_r") <= n).drop("_r")


def round_robin(rows: DataFrame, strata: str, n: int, order: str) -> DataFrame:
    """n rows, one of each stratum in turn."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(strata).orderBy(order)))
    return r.orderBy("_r", strata).limit(n).drop("_r")


def permuted(rows: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """(id, copy, options): n copies of each case's options (array column) in different orders, hash-driven, distinct orders
    only; options with fewer than two entries give none."""
    c = rows.filter(F.size("options") > 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    order = F.sort_array(F.transform("options", lambda o, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("copy").cast("string"), i.cast("string"))).alias("h"), o.alias("o"))))
    return c.select("id", "copy", F.transform(order, lambda x: x["o"]).alias("options")).dropDuplicates(["id", "options"])


def length_batches(rows: DataFrame, size: int, length: str, order: str) -> DataFrame:
    """Batches of rows of similar length: adds batch."""
    return running(rows, [length, order], name="_at").withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def encode_targets(target: Column) -> Column:
    """A target renormalised, null for one without mass."""
    return F.when(asum(target) > 0, F.transform(target, lambda x: x / asum(target)))


def preflight(splits: DataFrame) -> DataFrame:
    """One row of what must hold before training: rows per fold, groups in more than one fold, ids in more than one fold."""
    g = splits.groupBy("group_key").agg(F.count_distinct("fold").alias("k")).agg(F.sum((F.col("k") > 1).cast("int")).alias("torn_groups"))
    n = splits.agg(*(F.sum((F.col("fold") == f).cast("int")).alias(f) for f in ("train", "dev", "holdout")), F.count("*").alias("rows"))
    return n.crossJoin(g)


def vote_slots(sl: Column, votes: Column) -> Column:
    """Slots of teachers' labels."""
    return F.transform(votes, lambda v: slot_index(sl, v))


def contested(gold: Column, votes: Column) -> Column:
    """Whether any teacher's slot differs from the verified one."""
    return F.exists(votes, lambda v: ~v.eqNullSafe(gold))


def rekey_levels(dist: Column, q: Column) -> Column:
    """A distribution keyed by level index, keyed by the levels' texts."""
    return F.transform(dist, lambda x: F.struct(F.coalesce(F.get(q["criteria"], x["key"].try_cast("int"))["text"], x["key"]).alias("key"), x["p"].alias("p")))


def anchor_values(q: Column) -> Column:
    """Values of a numeric question's anchors."""
    n = anchors(q)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: q["min"] + (q["max"] - q["min"]) * i / (n - 1))


def label_anchor(q: Column, e: Column) -> Column:
    """(key, mass) that a verified label fixes in a teacher's distribution: .85 on abstention, .8 on an option or on yes or no,
    .75 on a level's text, a bound or the nearest anchor; no key and 0 where the side of a bound isn't known."""
    t, v = q["qtype"], e["value"]
    level = F.get(q["criteria"], F.when(e["level"] >= 0, e["level"]))["text"]
    outside = (e["status"] == "out_of_bounds") | (v < q["min"]) | (v > q["max"])
    nearest = float_text(F.array_min(F.transform(anchor_values(q), lambda x, i: F.struct(F.abs(x - v).alias("d"), i.alias("i"), x.alias("x"))))["x"])
    numeric = F.when(v.isNull(), F.lit(None)).when(F.coalesce(outside, F.lit(False)), F.when(v < q["min"], BELOW).otherwise(ABOVE)).otherwise(nearest)
    key = F.when(e["status"] == "abstained", ABSTAIN).when(t == "choice", e["choice"]).when(t.isin("boolean", "noul"), F.when(e["boolean"], "yes").otherwise("no")).when(t == "score", level).when(t == "numeric", numeric)
    mass = F.when(e["status"] == "abstained", 0.85).when(t.isin("choice", "boolean", "noul"), 0.8).when(key.isNotNull(), 0.75).otherwise(0.0)
    return F.struct(key.alias("key"), mass.alias("mass"))


def teacher_probs(dist: Column, p_yes: Column) -> Column:
    """A teacher's probabilities as (key, p), from a distribution or from a yes share."""
    pair = F.array(F.struct(F.lit("yes").alias("key"), p_yes.alias("p")), F.struct(F.lit("no").alias("key"), (1.0 - p_yes).alias("p")))
    return F.coalesce(dist, F.when(p_yes.isNotNull(), pair))


def export_rows(cases: DataFrame, prompts: DataFrame, drop_ids: DataFrame | None = None, drop_sources: tuple[str, ...] = (), per_source: int = 0, eps: float = SMOOTHING) -> DataFrame:
    """Training rows: cases (id, source, q, e, slots, soft) without dropped ids and sources (prefixes), capped per source, joined
    with their prompts (id, prompt), with targets; verdict tells rows without prompt or target from the ones to write."""
    c = cases
    if drop_ids is not None:
        c = c.join(drop_ids.select("id").distinct(), "id", "left_anti")
    for s in drop_sources:
        c = c.filter(F.col("source").isNull() | ~F.col("source").startswith(s))
    if per_source:
        c = cap_per_source(c, per_source, order="id")
    t = with_target(c, eps).join(prompts.select("id", "prompt"), "id", "left")
    verdict = F.when(F.col("prompt").isNull(), "noprompt").when(F.col("target").isNull(), "nogold").otherwise("ok")
    letter = F.get("slots", F.col("gold"))["letter"]
    return t.select("id", "source", "prompt", "target", letter.alias("gold_letter"), "target_source", "unmatched", verdict.alias("verdict"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["soft_labels"]
