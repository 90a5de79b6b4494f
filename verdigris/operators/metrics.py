"""Judging answers, evaluation reports and agreement between distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions.once import once
from verdigris.functions.prob import argmax_first, argmax_last, asum, brier, ece_bin, expected_level, half_up, kl_floor, mcnemar, r4, squared, total_variation
from verdigris.operators.joins import checked_join, numbered
from verdigris.operators.questions import ABOVE, ABSTAIN, BELOW
from verdigris.session import stored

SCORE_TOLERANCE = 0.34
# Texts of the stability probes (fixed values).
NOTE = "Unrelated note: a paperclip factory in another city changed its logo last Tuesday. It has no bearing on the matter at hand."
WRAPPER = "Using only the supplied evidence, decide: "


def parse_expect(e: Column) -> Column:
    """JSON text of an expectation as a struct; the fields that are absent are null."""
    return F.from_json(e, "status string, choice string, boolean boolean, level int, score double, value double, tol double")


def judge(expect: Column, a: Column) -> Column:
    """Whether the answer meets the expectation, by the first of status, choice, boolean, level, score and value that is
    expected; null if none is."""
    tol = expect["tol"]
    eq = lambda k: F.coalesce(a[k] == expect[k], F.lit(False))
    near = lambda k, t: F.coalesce(F.abs(a[k] - expect[k]) <= F.coalesce(tol, F.lit(t)), F.lit(False))
    return (
        F.when(expect["status"].isNotNull(), eq("status")).when(expect["choice"].isNotNull(), eq("choice"))
        .when(expect["boolean"].isNotNull(), eq("boolean")).when(expect["level"].isNotNull(), eq("level"))
        .when(expect["score"].isNotNull(), near("score", SCORE_TOLERANCE)).when(expect["value"].isNotNull(), near("value", 0.0))
    )


def target_key(q: Column, expect: Column, probs: Column) -> Column:
    """Key of the probability map that the expectation stands for, or null."""
    keys = F.transform(probs, lambda e: e["key"])
    has = lambda k: F.array_contains(keys, F.lit(k))
    level = F.coalesce(expect["level"], F.round(expect["score"] * (F.size(q["criteria"]) - 1)).cast("int"))
    v = expect["value"]
    nearest = F.array_min(F.filter(F.transform(keys, lambda k, i: F.struct(F.abs(k.try_cast("double") - v).alias("d"), i.alias("i"), k.alias("k"))), lambda s: s["d"].isNotNull()))["k"]
    numeric = F.when(v < q["min"], F.when(has(BELOW), BELOW)).when(v > q["max"], F.when(has(ABOVE), ABOVE)).otherwise(nearest)
    by_type = (
        F.when(q["qtype"] == "choice", expect["choice"])
        .when(q["qtype"].isin("boolean", "noul") & expect["boolean"].isNotNull(), F.when(expect["boolean"], "yes").otherwise("no"))
        .when((q["qtype"] == "score") & (level >= 0), F.get(q["criteria"], level)["text"])
        .when((q["qtype"] == "numeric") & v.isNotNull(), numeric)
    )
    s = expect["status"]
    return F.when((s == "abstained") & has(ABSTAIN), ABSTAIN).when(s.isNotNull() & (s != "out_of_bounds"), F.lit(None)).otherwise(by_type)


def target_index(probs: Column, key: Column) -> Column:
    """0-based position of a key, null if it isn't there."""
    at = F.array_position(F.transform(probs, lambda e: e["key"]), key)
    return F.when(at > 0, (at - 1).cast("int"))


def pick(a: Column) -> Column:
    """The answer as one comparable text, continuous values rounded to two places."""
    return F.coalesce(a["choice"], a["boolean"].cast("string"), a["level"].cast("string"), half_up(a["score"], 2).cast("string"), half_up(a["value"], 2).cast("string"))


def drift(a: Column, b: Column) -> Column:
    """Mean absolute difference over the union of two probability maps' keys (arrays of key and p), 0 if there is none."""
    keys = F.array_union(F.transform(a, lambda e: e["key"]), F.transform(b, lambda e: e["key"]))
    p = lambda m, k: F.coalesce(F.get(F.filter(m, lambda e: e["key"] == k), F.lit(0))["p"], F.lit(0.0))
    total = asum(F.transform(keys, lambda k: F.abs(p(a, k) - p(b, k))))
    return F.when(F.size(keys) > 0, total / F.size(keys)).otherwise(F.lit(0.0))


def auto_variants(cases: DataFrame) -> DataFrame:
    """Cases (case_id, state, question) with their stability probes: kind is base, option_reversal, criterion_wrapper or
    irrelevant_context; state and question are changed accordingly. Question objects keep the order of their keys."""
    cases = once(cases, _m=F.from_json("question", "map<string,string>"))
    m = F.col("_m")
    c = m["criteria"]
    keyed = F.transform(F.reverse(F.map_entries(F.from_json(c, "map<string,string>"))), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))
    listed = F.transform(F.reverse(F.from_json(c, "array<string>")), lambda v: F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    rev = F.when(c.startswith("{"), F.concat(F.lit("{"), F.array_join(keyed, ", "), F.lit("}"))).when(c.startswith("["), F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")))
    with_crit = _with_field("question", "criteria", rev)
    instr = m["instructions"]
    wrapped = _with_field("question", "instructions", _quoted(F.concat(F.lit(WRAPPER), instr)))
    is_obj = F.col("state").startswith("{")
    noted = F.when(is_obj, F.concat(F.regexp_replace("state", r"\s*\}\s*$", ""), F.lit(', "unrelated_note": '), _quoted(F.lit(NOTE)), F.lit("}"))).otherwise(F.concat("state", F.lit("\n\n" + NOTE)))
    kinds = F.array(
        F.struct(F.lit("base").alias("kind"), F.col("state").alias("s"), F.col("question").alias("q")),
        F.when((m["type"] == "choice") & rev.isNotNull(), F.struct(F.lit("option_reversal").alias("kind"), F.col("state").alias("s"), with_crit.alias("q"))),
        F.when(instr != "", F.struct(F.lit("criterion_wrapper").alias("kind"), F.col("state").alias("s"), wrapped.alias("q"))),
        F.when(~F.col("state").startswith("["), F.struct(F.lit("irrelevant_context").alias("kind"), noted.alias("s"), F.col("question").alias("q"))),
    )
    return cases.select("case_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("v")).select("case_id", F.col("v.kind").alias("kind"), F.col("v.s").alias("state"), F.col("v.q").alias("question"))


def _quoted(s: Column) -> Column:
    j = F.to_json(F.array(s))
    return j.substr(F.lit(2), F.length(j) - 2)


def _with_field(question: str, field: str, raw: Column) -> Column:
    """The question with one field replaced, the others as they are, in their order."""
    fields = F.map_entries("_m")
    plain = F.array(*map(F.lit, ("min", "max", "step", "granularity", "allow_abstain", "criteria")))
    text = lambda e: F.when(e["key"] == field, raw).when(e["value"].isNull(), F.lit("null")).when(F.array_contains(plain, e["key"]), e["value"]).otherwise(_quoted(e["value"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda e: F.concat(_quoted(e["key"]), F.lit(": "), text(e))), ", "), F.lit("}"))


def merged_case(state: Column, question: Column, v_state: Column, v_question: Column) -> tuple[Column, Column]:
    """State and question (JSON maps of raw texts) of a case under a declared variant: its fields win, the others stay."""
    over = lambda a, b: F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))
    return F.coalesce(v_state, state), F.when(v_question.isNull(), question).otherwise(over(question, v_question))


def with_distribution(scored: DataFrame) -> DataFrame:
    """Adds y (target position), p (probabilities), top, hit for rows whose expectation maps to a key; null elsewhere.
    Needs q, expect, answer."""
    probs = F.col("answer.probabilities")
    p = F.transform(probs, lambda e: e["p"])
    d = once(scored, _key=target_key(F.col("q"), F.col("expect"), probs))
    d = once(d, y=target_index(probs, F.col("_key")), p=p).drop("_key")
    return once(d, top=F.when(F.col("y").isNotNull(), argmax_last(F.col("p")))).withColumn("hit", F.col("top") == F.col("y"))


def ece(rows: DataFrame, by: list[str], conf: str = "conf", ok: str = "ok", bins: int = 10) -> DataFrame:
    """Expected calibration error per group: equal-width bins of the confidence, weighted gap to the accuracy."""
    b = rows.filter(F.col(ok).isNotNull()).groupBy(*by, ece_bin(F.col(conf), bins).alias("_b")).agg(F.count("*").alias("_n"), F.avg(conf).alias("_c"), F.avg(F.col(ok).cast("double")).alias("_a"))
    return b.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_a") - F.col("_c"))) / F.sum("_n")).alias("ece"))


def report(scored: DataFrame) -> DataFrame:
    """One row for all cases and one per question type: cases, scored, accuracy, balanced accuracy (over positions),
    Brier, ECE, mean confidence. Needs q, expect, answer. Accuracy is over rows that can be judged, the others over rows
    with a target. The cases are gone over once: all figures follow from sums per type, class and bin."""
    d = once(with_distribution(scored), ok=judge(F.col("expect"), F.col("answer")), conf=F.when(F.col("y").isNotNull(), F.array_max("p")), b=F.when(F.col("y").isNotNull(), brier(F.col("p"), F.col("y")))).withColumn("qtype", F.col("q.qtype"))
    d = d.select(F.explode(F.array(F.lit("all"), F.col("qtype"))).alias("qtype"), "ok", "y", "hit", "conf", "b", F.col("answer.confidence").alias("confidence"))
    ok, hit = F.col("ok").cast("double"), F.col("hit").cast("double")
    cells = d.groupBy("qtype", "y", ece_bin(F.col("conf")).alias("bin")).agg(
        F.count("*").alias("n"), F.count("ok").alias("scored"), F.sum(ok).alias("ok"), F.sum(F.when(F.col("ok").isNotNull(), F.col("confidence"))).alias("confidence"),
        F.sum("b").alias("b"), F.sum(hit).alias("hit"), F.sum("conf").alias("conf"))
    cells = stored(cells, "report")  # at most types x options x bins rows
    dist = F.col("y").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    main = cells.groupBy("qtype").agg(
        F.sum("n").alias("cases"), F.sum("scored").alias("scored"), r4(F.coalesce(F.try_divide(total("ok"), F.sum("scored")), F.lit(0.0))).alias("accuracy"),
        r4(F.try_divide(F.sum(F.when(dist, F.col("b"))), F.sum(F.when(dist, F.col("n"))))).alias("brier"), r4(F.coalesce(F.try_divide(total("confidence"), F.sum("scored")), F.lit(0.0))).alias("mean_confidence"))
    recall = cells.filter(dist).groupBy("qtype", "y").agg((F.sum("hit") / F.sum("n")).alias("r")).groupBy("qtype").agg(r4(F.avg("r")).alias("balanced_accuracy"))
    e = cells.filter(dist).groupBy("qtype", "bin").agg(F.sum("n").alias("n"), F.abs(F.sum("hit") - F.sum("conf")).alias("d")).groupBy("qtype").agg(r4(F.sum("d") / F.sum("n")).alias("ece"))
    return main.join(recall, "qtype", "left").join(e, "qtype", "left")


def failures(scored: DataFrame) -> DataFrame:
    """Cases that were judged wrong: case_id, type, answer, confidence."""
    bad = ~judge(F.col("expect"), F.col("answer"))
    return scored.filter(bad).select("case_id", F.col("q.qtype").alias("qtype"), pick(F.col("answer")).alias("answer"), F.col("answer.confidence").alias("confidence"))


def consistency(answers: DataFrame) -> DataFrame:
    """Agreement and mean drift of variants with their base: (case_id, kind, answer) to one row per kind and one for all. A
    case's answers, its base among them, come together once; they are as few as a case has variants."""
    per = answers.groupBy("case_id").agg(F.max(F.when(F.col("kind") == "base", F.col("answer"))).alias("b"), F.collect_list(F.when(F.col("kind") != "base", F.struct("kind", "answer"))).alias("vs"))
    v = per.filter(F.col("b").isNotNull()).select("b", F.explode("vs").alias("v")).select("b", "v.kind", "v.answer")
    rows = v.select(F.explode(F.array(F.lit("all"), F.col("kind"))).alias("kind"), F.coalesce(pick(F.col("answer")).eqNullSafe(pick(F.col("b"))), F.lit(False)).cast("double").alias("same"), drift(F.col("b.probabilities"), F.col("answer.probabilities")).alias("d"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), r4(F.avg("same")).alias("agreement"), r4(F.avg("d")).alias("mean_drift"))


def latency(rows: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    """n, p50 (upper median), p95 (floor index), mean, requests per second. Times are first counted, then numbered by ranges,
    so that no group comes together in one task."""
    rows = rows.select(F.struct(*by).alias("_g"), F.col(ms).alias("_ms"))  # null groups are groups
    per = stored(rows.groupBy("_g").agg(F.count("_ms").alias("n"), F.avg("_ms").alias("mean"), (F.count("_ms") / (F.sum("_ms") / 1000)).alias("req_s")), "latency")
    ranked = numbered(rows.filter("_ms is not null"), ["_g"], ["_ms"], "_i")
    at = checked_join(ranked, per.select("_g", "n"), ["_g"], "inner").withColumn("_i", F.col("_i") - 1)
    here = lambda i: F.max(F.when(F.col("_i") == i, F.col("_ms")))
    found = at.groupBy("_g").agg(here(F.floor(F.col("n") / 2)).alias("p50"), here(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).alias("p95"))
    return per.join(found, "_g", "left").select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", "p50", "p95", "mean", "req_s")


# ---- agreement of predicted and gold distributions ----


def gold_decisions(cases: DataFrame) -> DataFrame:
    """One row per (id, question) of gold cases: workflow, qtype, labels (ordered keys), gold (probabilities aligned),
    gold_label, gold_score. Labels of a noul or boolean are false, true; of a score the level indexes; of a choice its keys.
    The later of two deliveries of an id counts; null gold and broken JSON give no rows."""
    last = Window.partitionBy("id").orderBy(F.desc("revised_at"), F.desc("gold"))
    one = cases.filter("gold is not null and id is not null").withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    g = F.from_json("gold", "map<string,struct<type:string,label:string,probabilities:map<string,double>,score:double>>")
    qs = F.from_json("questions", "map<string,struct<type:string,criteria:string>>")
    rows = once(one, qs=qs).select("id", "workflow", "split", F.explode(g).alias("question", "g"), "qs")
    q = F.col("qs")[F.col("question")]
    crit = q["criteria"]
    labels = (
        F.when(q["type"].isin("noul", "boolean"), F.array(F.lit("false"), F.lit("true")))
        .when(q["type"] == "score", F.transform(F.from_json(crit, "array<string>"), lambda x, i: i.cast("string")))
        .when(crit.startswith("{"), F.transform(F.map_entries(F.from_json(crit, "map<string,string>")), lambda e: e["key"]))
        .otherwise(F.from_json(crit, "array<string>"))
    )
    d = once(rows, labels=labels).select("id", "workflow", "split", "question", q["type"].alias("qtype"), "labels", F.col("g.probabilities").alias("gp"), F.col("g.label").alias("gold_label"), F.col("g.score").alias("gold_score"))
    return d.withColumn("gold", F.transform("labels", lambda k: F.coalesce(F.element_at("gp", k), F.lit(0.0)))).drop("gp")


def decisions(rows: DataFrame) -> DataFrame:
    """Per decision (gold, pred aligned with labels): correct, soft, peak, kl, tv, brier, mae (score types)."""
    best = argmax_first(F.col("pred"))
    d = once(rows, _best=best)
    d = d.withColumn("guess", F.get("labels", F.col("_best"))).withColumn("soft", F.get("gold", F.col("_best"))).drop("_best")
    return d.withColumn("correct", (F.col("guess") == F.col("gold_label")).cast("double")).withColumn("peak", F.array_max("pred")).withColumn("kl", kl_floor(F.col("gold"), F.col("pred"))).withColumn("tv", total_variation(F.col("gold"), F.col("pred"))).withColumn("brier", squared(F.col("gold"), F.col("pred"))).withColumn("mae", F.when((F.col("qtype") == "score") & F.col("gold_score").isNotNull(), F.abs(expected_level(F.col("pred")) - F.col("gold_score"))))


_MEANS = ("correct", "soft", "peak", "kl", "tv", "brier", "mae")


def summary(dec: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Means and 10-bin ECE per grouping set of columns; columns outside a set are 'all'. One pass: rows are expanded to the
    sets, then partially aggregated."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    keys = F.explode(F.array(*(F.struct(*((F.col(c) if c in s else F.lit("all")).alias(c) for c in cols)) for s in sets))) if cols else None
    d = dec.select(*_MEANS, *((keys.alias("_k"),) if cols else ()))
    d = d.select(*_MEANS, *(F.col(f"_k.{c}").alias(c) for c in cols))
    bins = d.groupBy(*cols, ece_bin(F.col("peak")).alias("_b")).agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in _MEANS), F.count("mae").alias("_m"), F.sum(F.when(F.col("mae") <= 1, 1).otherwise(0)).alias("_w"))
    return bins.groupBy(*cols).agg(F.sum("n").alias("n"), *((F.sum(m) / F.sum("n")).alias(m) for m in _MEANS if m != "mae"), F.try_divide(F.sum("mae"), F.sum("_m")).alias("mae"), F.try_divide(F.sum("_w"), F.sum("_m")).alias("within_1"), (F.sum(F.abs(F.col("correct") - F.col("peak"))) / F.sum("n")).alias("ece"))


def macro_f1(dec: DataFrame) -> DataFrame:
    """F1 per label (gold or guessed), averaged per question, then over questions: one row."""
    both = dec.select("workflow", "question", F.col("gold_label").alias("g"), F.col("guess").alias("p"))
    per = both.select("workflow", "question", F.explode(F.array_distinct(F.array("g", "p"))).alias("label"), "g", "p").groupBy("workflow", "question", "label").agg(
        F.sum(((F.col("g") == F.col("label")) & (F.col("p") == F.col("label"))).cast("int")).alias("tp"), F.sum((F.col("g") == F.col("label")).cast("int")).alias("gn"), F.sum((F.col("p") == F.col("label")).cast("int")).alias("pn"))
    f1 = per.withColumn("f1", 2.0 * F.col("tp") / (F.col("gn") + F.col("pn")))
    return f1.groupBy("workflow", "question").agg(F.avg("f1").alias("f1")).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("questions"))


def uniform(dec: DataFrame) -> DataFrame:
    return dec.withColumn("pred", F.transform("labels", lambda k: F.lit(1.0) / F.size("labels")))


def prior(test: DataFrame, train: DataFrame) -> DataFrame:
    """Predictions by the training labels' frequencies per (workflow, question); uniform where there are none."""
    n = train.groupBy("workflow", "question", "gold_label").agg(F.count("*").alias("n"))
    per = n.groupBy("workflow", "question").agg(F.map_from_entries(F.collect_list(F.struct("gold_label", "n"))).alias("m"), F.sum("n").alias("t"))
    j = test.join(per, ["workflow", "question"], "left")
    freq = F.transform("labels", lambda k: F.coalesce(F.element_at("m", k), F.lit(0)) / F.col("t"))
    return j.withColumn("pred", F.when(F.col("m").isNull(), F.transform("labels", lambda k: F.lit(1.0) / F.size("labels"))).otherwise(freq)).drop("m", "t")


def constancy(dec: DataFrame) -> DataFrame:
    """Per (workflow, question) the guess given most often (the smallest on ties) and its share."""
    n = dec.groupBy("workflow", "question", "guess").agg(F.count("*").alias("n"))
    return n.groupBy("workflow", "question").agg(F.max(F.struct(F.col("n"), F.lit(0))).alias("_"), F.min(F.struct((-F.col("n")).alias("a"), F.col("guess"))).alias("m"), F.sum("n").alias("t")).select("workflow", "question", F.col("m.guess").alias("modal"), (-F.col("m.a") / F.col("t")).alias("share"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: decisions in both runs, accuracies, delta, discordant counts and the exact McNemar p-value. a and b have
    keys and ok (boolean)."""
    j = a.select(*keys, F.col("ok").alias("x")).join(b.select(*keys, F.col("ok").alias("y")), keys)
    s = j.agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("acc_a"), F.avg(F.col("y").cast("double")).alias("acc_b"), F.sum((F.col("x") & ~F.col("y")).cast("int")).alias("only_a"), F.sum((~F.col("x") & F.col("y")).cast("int")).alias("only_b"))
    return s.withColumn("delta", F.col("acc_b") - F.col("acc_a")).withColumn("p_value", mcnemar(F.col("only_a"), F.col("only_b")))


def canonical(qtype: Column, value: Column) -> Column:
    """An answer as a comparable text: noul by the half, score rounded half to even within 0..3, else in lower case."""
    num = value.try_cast("double")
    return F.when(qtype == "noul", F.when(num >= 0.5, "true").when(num < 0.5, "false").otherwise(F.lower(value))).when(qtype == "score", F.greatest(F.lit(0), F.least(F.lit(3), F.rint(num).cast("int"))).cast("string")).otherwise(F.lower(F.trim(value)))


def consensus(votes: DataFrame) -> DataFrame:
    """Reference per (case_id, question) from votes (voter, label, p): the label with the highest mean probability; where
    no voter gave probabilities, the label with most votes; the smallest on ties."""
    per = votes.groupBy("case_id", "question", "label").agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    return per.groupBy("case_id", "question").agg(F.min(F.struct((-F.coalesce("p", F.lit(-1.0))).alias("a"), (-F.col("n")).alias("b"), F.col("label"))).alias("m")).select("case_id", "question", F.col("m.label").alias("reference"))


def agreement(answers: DataFrame, reference: DataFrame) -> DataFrame:
    """Agreement of each model with the reference, per workflow and overall ('all'), ranked by the overall share."""
    j = answers.join(reference, ["case_id", "question"]).withColumn("ok", (F.col("answer") == F.col("reference")).cast("int"))
    per = j.select("model", F.explode(F.array(F.lit("all"), F.col("workflow"))).alias("workflow"), "ok").groupBy("model", "workflow").agg(F.count("*").alias("n"), F.sum("ok").alias("agree")).withColumn("share", F.col("agree") / F.col("n"))
    return per


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two score sets (id, p) of the same cases: argmax agreement, KL mean, nearest-rank 95th percentile and maximum, and the
    ids missing on one side."""
    j = a.select("id", F.col("p").alias("x")).join(b.select("id", F.col("p").alias("y")), "id", "full")
    k = j.withColumn("kl", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), kl_floor(F.col("x"), F.col("y"), 1e-9))).withColumn("same", (argmax_first(F.col("x")) == argmax_first(F.col("y"))).cast("double"))
    return k.agg(F.count("kl").alias("n"), F.sum((F.col("x").isNull() | F.col("y").isNull()).cast("int")).alias("unmatched"), F.avg("same").alias("argmax_agreement"), F.avg("kl").alias("kl_mean"), F.expr("percentile_disc(0.95) within group (order by kl)").alias("kl_p95"), F.max("kl").alias("kl_max"))


def abstained(a: Column) -> Column:
    """Whether an answer abstains, by its status or by its choice."""
    return F.coalesce((a["status"] == "abstained") | (a["choice"] == ABSTAIN), F.lit(False))


def paired_report(base: DataFrame, tuned: DataFrame, resamples: int = 1000, seed: int = 17) -> DataFrame:
    """One row for two runs over the same cases (id, ok, abstained, ms): accuracies, delta with a 95 % interval over resampled
    cases, exact McNemar p, abstention rates, upper-median latencies. A resample weights each case by a hashed Poisson draw;
    every task adds its cases up to one row per resample."""
    import math

    import numpy as np
    import pyarrow as pa

    j = base.select("id", F.col("ok").alias("x"), F.col("abstained").alias("ax"), F.col("ms").alias("mx")).join(tuned.select("id", F.col("ok").alias("y"), F.col("abstained").alias("ay"), F.col("ms").alias("my")), "id")
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])

    def draw(batches):
        total = np.zeros((2, resamples))
        salt = (np.arange(resamples, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            h, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(h), 4096):
                x = h[at : at + 4096].view(np.uint64)[None, :] ^ salt[:, None]
                for m, r in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
                    x = (x ^ (x >> np.uint64(r))) * np.uint64(m)
                w = np.searchsorted(cdf, (x >> np.uint64(11)) / float(1 << 53)).astype(float)
                total[0] += w @ d[at : at + 4096]
                total[1] += w.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["i", "d", "n"])

    diff = j.select(F.xxhash64("id").alias("h"), (F.col("y").cast("double") - F.col("x").cast("double")).alias("d")).filter("d is not null")
    means = sorted(r["d"] / r["n"] if r["n"] else 0.0 for r in diff.mapInArrow(draw, "i int, d double, n double").groupBy("i").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).collect())
    lo, hi = (means[len(means) // 40], means[min(len(means) - 1, len(means) * 39 // 40)]) if means else (0.0, 0.0)
    mid = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c} desc)")  # noqa: E731  the upper median
    p = paired(base.select("id", "ok"), tuned.select("id", "ok"), ["id"])
    extra = j.agg(F.avg(F.col("ax").cast("double")).alias("abstain_base"), F.avg(F.col("ay").cast("double")).alias("abstain_tuned"), mid("mx").alias("ms_base"), mid("my").alias("ms_tuned"))
    return p.crossJoin(extra).withColumn("delta_lo", F.lit(lo)).withColumn("delta_hi", F.lit(hi))


def answer_brief(a: Column) -> Column:
    return F.struct(a["status"].alias("status"), pick(a).alias("pick"), a["confidence"].alias("confidence"))


def case_units(variants: DataFrame) -> DataFrame:
    """How many decisions each case stands for, itself and its variants."""
    return variants.groupBy("case_id").agg(F.count("*").alias("units"))


def distribution(labels: Column, probs: Column) -> Column:
    """A wire answer's probabilities on the label keys, in their order; a key that is missing is an error."""
    p = lambda k: F.get(F.filter(probs, lambda e: e["key"] == k), F.lit(0))["p"]
    return F.transform(labels, lambda k: F.coalesce(p(k), F.raise_error(F.concat(F.lit("no probability for "), k)).cast("double")))


def committed_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Training-time figures per group of (ok, conf, ce, abstained, gold_abstains): accuracy, 15-bin ECE, mean cross-entropy,
    share of answers that abstain though they shouldn't."""
    e = ece(rows, by, "conf", "ok", 15)
    m = rows.groupBy(*by).agg(F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg("ce").alias("ce"), F.avg((F.col("abstained") & ~F.col("gold_abstains")).cast("double")).alias("abstained_wrongly"))
    return m.join(e, by) if by else m.crossJoin(e)


def format_report(rep: DataFrame) -> DataFrame:
    """The report as lines of text."""
    return rep.select("qtype", F.format_string("%-8s n=%d scored=%d acc=%.4f bal=%.4f brier=%.4f ece=%.4f conf=%.4f", "qtype", "cases", "scored", "accuracy", "balanced_accuracy", "brier", "ece", "mean_confidence").alias("line"))
