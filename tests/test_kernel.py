"""Facts of the decision kernel: slots, statuses, folds, judging, targets, calibration."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.functions import prob, toon
from verdigris.operators import calibrate, decide, metrics, prepare, questions
from verdigris.operators.logits import ArrowLogits, ColumnLogits, HashLogits, memoised


def q_of(spark, q):
    return spark.createDataFrame([(json.dumps(q),)], "j string").select(questions.parse_question(F.col("j")).alias("q"))


def slots_of(spark, q):
    r = q_of(spark, q).select(questions.slots(F.col("q")).alias("s")).first()["s"]
    return [(x["letter"], x["key"], x["text"], x["special"]) for x in r]


def test_slots_keep_order(spark):
    assert slots_of(spark, {"type": "choice", "criteria": {"z": "last letter", "a": None, "m": ""}, "allow_abstain": True}) == [
        ("A", "z", "last letter", False), ("B", "a", "a", False), ("C", "m", "m", False), ("D", questions.ABSTAIN, questions.ABSTAIN_LABEL, True)]
    assert [x[1:3] for x in slots_of(spark, {"type": "choice", "criteria": ["red", None, "blue"]})] == [("red", "red"), ("option 2", "option 2"), ("blue", "blue")]
    assert [x[1:3] for x in slots_of(spark, {"type": "score", "criteria": ["low", ""]})] == [("0", "low"), ("1", "1")]
    assert [x[2] for x in slots_of(spark, {"type": "numeric", "min": 0, "max": 1, "granularity": 3})] == ["Below 0", "0", "0.5", "1", "Above 1"]


def test_float_text(spark):
    r = spark.createDataFrame([(40.0,), (1e-7,), (0.1,), (3.5,)], "v double").select(questions.float_text(F.col("v")).alias("t")).collect()
    assert [x["t"] for x in r] == ["40", "0.0000001", "0.1", "3.5"]


@pytest.mark.parametrize(
    "q, why",
    [
        ({"type": "choice", "criteria": ["a"]}, "at least two criteria"),
        ({"type": "score", "criteria": {"a": 1, "b": 2}}, "score needs a list"),
        ({"type": "numeric", "min": 2, "max": 1}, "min must be below max"),
        ({"type": "numeric", "min": 0, "max": 1, "granularity": 25}, "granularity out of range"),
        ({"type": "boolean", "colour": 1}, "unknown field colour"),
        ({"type": "guess"}, "unknown type"),
        ({"type": "score", "criteria": [str(i) for i in range(27)]}, "too many levels"),
        ({"type": "boolean"}, None),
    ],
)
def test_problems(spark, q, why):
    assert q_of(spark, q).select(questions.problem(F.col("q")).alias("p")).first()["p"] == why


def answer(spark, q, logits, t=1.0):
    d = q_of(spark, q).withColumn("s", questions.slots(F.col("q"))).withColumn("p", prob.softmax(F.array(*map(F.lit, logits)), t))
    return d.select(decide.decode(F.col("q.qtype"), F.col("s"), F.col("p")).alias("a")).first()["a"]


def test_statuses(spark):
    q = {"type": "numeric", "min": 0, "max": 10, "granularity": 2, "allow_abstain": True}
    assert answer(spark, q, [9.0, 0.0, 0.0, 0.0, 0.0])["status"] == "out_of_bounds"
    assert answer(spark, q, [0.0, 0.0, 0.0, 0.0, 9.0])["status"] == "abstained"
    assert answer(spark, q, [0.0, 5.0, 5.0, 0.0, 0.0])["status"] == "contested"
    a = answer(spark, q, [0.0, 0.0, 9.0, 0.0, 0.0])
    assert a["status"] == "decided" and 9.9 < a["value"] <= 10
    assert [e["key"] for e in a["probabilities"]] == ["0", "10", questions.ABSTAIN, questions.BELOW, questions.ABOVE]


def test_ties(spark):
    assert answer(spark, {"type": "boolean"}, [1.0, 1.0])["boolean"] is True
    assert answer(spark, {"type": "choice", "criteria": ["a", "b", "c"]}, [1.0, 1.0, 0.0])["choice"] == "b"
    r = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>").select(prob.argmax_last(F.col("p")).alias("l"), prob.argmax_first(F.col("p")).alias("f")).first()
    assert (r["l"], r["f"]) == (2, 1)


def test_score_and_wire(spark):
    q = {"type": "score", "criteria": ["none", "some", "all"]}
    a = answer(spark, q, [0.0, 0.0, 50.0])
    assert (a["score"], a["level"], a["probabilities"][2]["key"]) == (1.0, 2, "all")
    d = q_of(spark, q).withColumn("s", questions.slots(F.col("q"))).withColumn("p", F.array(F.lit(0.0), F.lit(0.5), F.lit(0.5)))
    d = d.withColumn("a", decide.decode(F.col("q.qtype"), F.col("s"), F.col("p")))
    w = d.select(decide.wire(F.col("q.qtype"), F.col("s"), F.col("a")).alias("w")).first()["w"]
    assert w["score"] == 1.5 and [e["key"] for e in w["probabilities"]] == ["0", "1", "2"] and w["legend"][0]["text"] == "none"


def test_merge_scored(spark):
    d = spark.createDataFrame([(["a", "b"], [0.4, 0.3], True), (["a", "b"], [0.9, 0.3], True), (["a", "b"], [0.0, 0.0], False)], "k array<string>, p array<double>, ab boolean")
    r = [x["a"] for x in d.select(decide.merge_scored(F.col("k"), F.col("p"), F.col("ab")).alias("a")).collect()]
    assert [x["status"] for x in r] == ["abstained", "decided", "contested"]
    assert r[1]["probabilities"][0]["p"] == 0.75 and r[2]["probabilities"][0]["p"] == 0.5


def test_paths_agree(spark, small):
    """Answers don't depend on partitions, deduplication or a memo."""
    c = spark.read.parquet(small + "/convert_hf.parquet").filter("state is not null and question is not null").select(F.col("record_no").cast("string").alias("req_id"), "state", "question", F.lit(0).alias("q_pos"), F.lit("q").alias("q_name"))
    units = questions.compile_units(c)
    key = lambda d: sorted((r["req_id"], r["a"]["status"], r["a"]["confidence"]) for r in d.select("req_id", F.col("answer").alias("a")).collect())
    base = key(decide.decide(HashLogits().attach(units)))
    assert key(decide.decide(HashLogits().attach(units.repartition(7)))) == base
    import hashlib

    def score(prompts, sizes):
        return [[int(hashlib.md5(f"{p}\x00{chr(65 + i)}".encode()).hexdigest()[:8], 16) / 2**32 * 8 - 4 for i in range(n)] for p, n in zip(prompts, sizes)]

    assert key(decide.decide(ArrowLogits(score).attach(units))) == base
    memo = spark.createDataFrame([], "key string, logits array<double>")
    rows, fresh = memoised(HashLogits(), units, memo)
    again, none = memoised(HashLogits(), units, fresh)
    assert key(decide.decide(rows)) == base and key(decide.decide(again)) == base and none.count() == 0


def test_expansion_equals_parts(spark):
    q = json.dumps({"type": "choice", "instructions": "Pick.", "criteria": [f"o{i}" for i in range(60)]})
    r = spark.createDataFrame([("r", "s", 0, "q", q)], "req_id string, state string, q_pos int, q_name string, question string")
    probes = questions.compile_units(r)
    assert probes.count() == 60 and probes.filter("sub_idx = 3").first()["prompt"].count("Candidate: o3") == 1
    pages = questions.compile_units(r, expand="pages")
    assert [x["n"] for x in pages.select(F.size("slots").alias("n")).collect()] == [20, 20, 20]
    a = decide.decide(ColumnLogits(F.transform("slots", lambda s: F.when(s["text"] == "o41", 9.0).otherwise(0.0))).attach(pages), expand="pages").first()["answer"]
    assert len(a["probabilities"]) == 60 and a["choice"] == "o41"


def test_judge_and_target(spark):
    def both(q, e, probs, **a):
        d = q_of(spark, q).withColumn("e", metrics.parse_expect(F.lit(json.dumps(e))))
        d = d.withColumn("pr", F.array(*(F.struct(F.lit(k).alias("key"), F.lit(p).alias("p")) for k, p in probs)))
        ans = F.struct(*(F.lit(a.get(k)).cast(t).alias(k) for k, t in (("status", "string"), ("choice", "string"), ("boolean", "boolean"), ("level", "int"), ("score", "double"), ("value", "double"))))
        d = d.withColumn("a", ans)
        return tuple(d.select(metrics.judge(F.col("e"), F.col("a")), metrics.target_key(F.col("q"), F.col("e"), F.col("pr"))).first())

    num = {"type": "numeric", "min": 0, "max": 10}
    keys = [("0", 0.1), ("5", 0.4), ("10", 0.1), (questions.BELOW, 0.2), (questions.ABOVE, 0.2)]
    assert both(num, {"value": 7.4, "tol": 1}, keys, value=6.5) == (True, "5")
    assert both(num, {"value": 12}, keys, value=10.0) == (False, questions.ABOVE)
    assert both(num, {"value": 2.5}, keys, value=2.5) == (True, "0")  # the first of two equally near
    assert both({"type": "score", "criteria": ["a", "b", "c"]}, {"score": 0.5}, [("a", 1.0)], score=0.2) == (True, "b")
    assert both({"type": "boolean"}, {"status": "contested"}, [("yes", 1.0)], status="contested") == (True, None)
    assert both({"type": "boolean"}, {}, [("yes", 1.0)], boolean=True) == (None, None)


def test_calibration_finds_temperature(spark):
    """Samples drawn at T = 2 are fitted back; folds hold a case together; intervals contain the figure."""
    import random

    rnd, rows = random.Random(3), []
    for i in range(1500):
        raw = [rnd.gauss(0, 2) for _ in range(3)]
        true = [math.exp(x / 2) for x in raw]
        y = rnd.choices(range(3), true)[0]
        z = sum(math.exp(x) for x in raw)
        rows.append((f"c{i}", "choice", [math.exp(x) / z for x in raw], y))
    s = spark.createDataFrame(rows, "case_id string, bucket string, p array<double>, y int")
    temps, fig = calibrate.fit(s, resamples=100)
    f = fig.first()
    assert abs(temps.first()["temperature"] - 2) < 0.25
    assert f["ece_out_of_fold"] < f["ece_raw"] and f["raw_lo"] <= f["ece_raw"] <= f["raw_hi"] and f["separated"]
    # the same temperature as a golden-section search over all samples, and with each fold left out
    fits = calibrate.fit_temperatures(s.withColumn("fold", calibrate.fold_udf("case_id")))
    for held in (-1, 0, 3):
        kept = [(p, y) for c, _, p, y in rows if calibrate.fold_of(c) != held]
        loss = lambda x: sum(-math.log(max(1e-15, p[y] ** math.exp(-x) / sum(q ** math.exp(-x) for q in p))) for p, y in kept)  # noqa: E731,B023
        a, b, g = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
        for _ in range(60):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        t, n = fits[("choice", held)]
        assert n == len(kept) and abs(math.log(t) - (a + b) / 2) < 1e-5
    few, _ = calibrate.fit(s.limit(3), resamples=10)
    assert few.first()["temperature"] == 1.0


def test_fnv_and_generator():
    assert calibrate.fnv64(b"") == 0xCBF29CE484222325 and calibrate.fnv64(b"a") == 0xAF63DC4C8601EC8C
    assert calibrate.fnv128(b"") == "6c62272e07bb014262b821756295c58d"
    r = calibrate.XorShift(1)
    assert len({r.next() for _ in range(100)}) == 100


def test_soft_targets(spark):
    q = {"type": "choice", "criteria": {"a": "", "b": "", "c": ""}}
    rows = [(json.dumps(q), '{"choice": "b"}', s) for s in (None, '{"options": [0.2, 0.3, 0.5]}', '{"a": 0.5, "x": 0.5}', '{"options": [1, 0, 0]}', '{"levels": [1]}')]
    d = spark.createDataFrame(rows, "question string, expect string, soft string")
    d = d.withColumn("q", questions.parse_question(F.col("question"))).withColumn("e", metrics.parse_expect(F.col("expect"))).withColumn("slots", questions.slots(F.col("q")))
    t = [[round(x, 4) for x in r["target"]] for r in prepare.with_target(d).collect()]
    assert t == [[0.05, 0.9, 0.05], [0.2, 0.3, 0.5], [0.6667, 0.3333, 0.0], [0.05, 0.9, 0.05], [0.05, 0.9, 0.05]]


@given(st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab c:", max_size=3), c, max_size=3), max_leaves=8))
@settings(max_examples=200, deadline=None)
def test_toon_is_total(v):
    out = toon.toon(v)
    assert isinstance(out, str) and not out.endswith("\n")


def test_toon_forms():
    v = {"id": 7, "tags": ["a", "b,c"], "rows": [{"x": 1, "y": {"z": True}}, {"x": 2, "y": {"z": None}}], "by": {"p": {"n": 1.0}, "q": {"n": 2.5}}, "none": {}, "mix": [1, {"k": [1, 2]}, []]}
    assert toon.toon(v) == 'id: 7\ntags[2]: a,"b,c"\nrows[2]{x,y{z}}:\n  1,true\n  2,null\nby[2:]{n}:\n  p: 1\n  q: 2.5\nnone:\nmix[3]:\n  - 1\n  - k[2]: 1,2\n  - [0]:'
    assert [toon.scalar(x) for x in ("true", "1e5", "-x", "ok", -0.0, 1e-7, 1e21)] == ['"true"', '"1e5"', '"-x"', "ok", "0", "0.0000001", "1000000000000000000000"]
