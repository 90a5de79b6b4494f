"""Readers, sinks and the smaller expressions that no query shows on its own."""

import json

import pytest
from pyspark.sql import functions as F

from verdigris.functions.prob import softmax
from verdigris.operators import calibrate, descend, lexical, metrics, prepare, questions, search
from verdigris.sources import readers, sinks


def one(spark, col, **cols):
    d = spark.range(1).select(*(v.alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return d.select(col.alias("x")).first()["x"]


def test_embedded_and_reports(spark, tmp_path):
    assert json.loads(one(spark, readers.embedded_json(F.lit('load({"a": [1, 2]});'), "load"))) == {"a": [1, 2]}
    for name, text in {"b.json": "[1]", "c.json": '{"kind": "calibration"}', "e.json": '{"cases": 3, "accuracy": 1}', "a.json": '{"cases": []}', "o.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    got = {r["path"][-6]: r["kind"] for r in readers.scan_reports(spark, str(tmp_path)).collect()}
    assert got == {"b": "bench", "c": "calibration", "e": "evaluation", "a": "answers", "o": "other"}


def test_calibration_document(spark, tmp_path):
    temps = spark.createDataFrame([("boolean", 0.51234567, 10)], "bucket string, temperature double, n long")
    fig = spark.createDataFrame([(0.2, 0.1, 0.1, 0.1, 0.3, 0.05, 0.08, True, 10)], "ece_raw double, ece_in_sample double, ece_out_of_fold double, raw_lo double, raw_hi double, oof_lo double, oof_hi double, separated boolean, fitted long")
    out = str(tmp_path / "cal")
    sinks.write_document(calibrate.document(temps, fig, "m", "v1"), out)
    r = readers.load_calibration(spark, out).first()
    assert (r["bucket"], r["temperature"], r["ece_raw"]) == ("boolean", 0.5123, 0.2)
    loaded = readers.load_calibration(spark, out)
    assert readers.bound(loaded, "m", "v1").first()["temperature"] == 0.5123
    with pytest.raises(Exception, match="calibrated for"):
        readers.bound(loaded, "other", "v1").collect()
    with pytest.raises(Exception):
        sinks.write_document(calibrate.document(temps, fig, "m", "v1"), out)


def test_answers_and_cases(spark):
    raw = spark.createDataFrame([(json.dumps({"wf": {"c1": {"q": "yes", "r": 2}}, "_meta": {"x": {"y": 1}}}),)], "value string")
    assert {tuple(r) for r in readers.nested_answers(raw).collect()} == {("wf", "c1", "q", "yes"), ("wf", "c1", "r", "2")}
    nodes = spark.createDataFrame([("c", "n1", "beta", 1), ("c", "n2", "alpha", 0), ("c", "n3", "alpha", 0)], "case_id string, node string, doc string, question_no int")
    cat = spark.createDataFrame([(0, "q0", "?"), (1, "q1", "?")], "question_no int, qid string, question string")
    r = readers.assemble_cases(nodes, cat).first()
    assert r["state"] == "alpha\n\nbeta" and r["questions"] == ["q0", "q1"]
    assert readers.model_dimension(spark, [("a", "b", "c")]).columns == ["name", "repo", "file"]


def test_case_request(spark):
    c = spark.createDataFrame([("1", "s", '{"type": "boolean", "allow_abstain": true}', None, None), ("2", "s", '{"type": "boolean"}', "header", "pages")], "case_id string, state string, question string, layout string, expand string")
    r = {x["req_id"]: x for x in questions.case_request(c, no_abstain=True).collect()}
    assert json.loads(r["1"]["question"])["allow_abstain"] is False and (r["1"]["layout"], r["2"]["layout"], r["2"]["expand"]) == ("auto", "header", "pages")
    assert questions.case_request(c, layout="state_first").select("layout").distinct().count() == 1
    with pytest.raises(Exception, match="bad pin"):
        questions.case_request(c.withColumn("layout", F.lit("sideways"))).collect()
    with pytest.raises(ValueError):
        questions.check_search(0, 0.5)
    assert one(spark, questions.display_name(F.lit("q\u001f3"))) == "q"
    assert one(spark, questions.render_state(F.lit('{"a": [1, 2]}'), "toon")) == "a[2]: 1,2"


def test_export_prompts(spark, tmp_path):
    r = spark.createDataFrame([("1", "s", 0, "q", '{"type": "boolean"}')], "req_id string, state string, q_pos int, q_name string, question string")
    n = sinks.export_prompts(questions.compile_units(r), str(tmp_path / "p")).first()
    assert (n["exported"], n["skipped"]) == (1, 0) and spark.read.json(str(tmp_path / "p")).first()["layout"] == "question_first"
    twice = r.union(r.withColumn("q_pos", F.lit(1)))
    with pytest.raises(ValueError):
        sinks.export_prompts(questions.compile_units(twice), str(tmp_path / "p2"))


def test_stores(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, v int, binding string")
    sinks.append_store(rows(("a", 1, "m"), ("a", 2, "m")), None, path)
    sinks.append_store(rows(("a", 3, "m"), ("b", 4, "m")), spark.read.parquet(path), path)
    s = spark.read.parquet(path)
    assert s.count() == 2 and s.filter("key = 'a' and v = 3").count() == 0
    sinks.compact_store(s, rows(("b", 0, "m")), str(tmp_path / "t"))
    assert [r["key"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["b"]
    assert search.cache_binding("m", "v1", 60, "f16") != search.cache_binding("m", "v2", 60, "f16")
    tagged = spark.createDataFrame([("a", "ok"), ("b", "bad")], "id string, verdict string")
    n = sinks.write_kept(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), tagged, str(tmp_path / "k"))
    assert {tuple(r) for r in n.collect()} == {("ok", 1), ("bad", 1)} and spark.read.parquet(str(tmp_path / "k")).count() == 1


def test_views(spark):
    c = spark.createDataFrame([(1, "a.py", "f", "def f():\n    pass", 3, 4)], "doc long, path string, symbol string, body string, start int, end int")
    s = spark.createDataFrame([(0, 1, 1, 0.75)], "query_id int, doc long, rank int, p double")
    assert search.render_hits(s, c).first()["text"] == "a.py:3-4  f  0.75\n  | def f():\n  |     pass"
    doc = json.loads(search.hits_document(s, c).first()["document"])
    assert doc["hits"][0]["path"] == "a.py" and doc["hits"][0]["head"].startswith("def f")
    assert one(spark, lexical.matching_words(F.lit("class ConnectionPool: retry_queue x"), F.lit("the retry"))) == ["retry_queue"]
    assert one(spark, descend.words_column(F.lit("parseJSON_now 12"))) == descend.words("parseJSON_now 12") == ["parse", "json", "now"]


def test_small_metrics(spark):
    a = F.struct(F.lit("abstained").alias("status"), F.lit("x").alias("choice"), F.lit(None).cast("boolean").alias("boolean"), F.lit(None).cast("int").alias("level"), F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("value"))
    assert one(spark, metrics.abstained(a)) is True and one(spark, metrics.answer_brief(a))["pick"] == "x"
    p = F.array(F.struct(F.lit("b").alias("key"), F.lit(0.75).alias("p")), F.struct(F.lit("a").alias("key"), F.lit(0.25).alias("p")))
    assert one(spark, metrics.distribution(F.array(F.lit("a"), F.lit("b")), p)) == [0.25, 0.75]
    with pytest.raises(Exception, match="no probability for c"):
        one(spark, metrics.distribution(F.array(F.lit("c")), p))
    v = metrics.auto_variants(spark.createDataFrame([("1", "s", '{"type": "choice", "instructions": "Go?", "criteria": {"a": "x", "b": "y"}}')], "case_id string, state string, question string"))
    assert metrics.case_units(v).first()["units"] == 4
    rev = v.filter("kind = 'option_reversal'").first()["question"]
    assert list(json.loads(rev)["criteria"].items()) == [("b", "y"), ("a", "x")]
    assert json.loads(v.filter("kind = 'criterion_wrapper'").first()["question"])["instructions"] == metrics.WRAPPER + "Go?"
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    st, q = metrics.merged_case(F.lit("s"), m(type="boolean", instructions="old"), F.lit(None).cast("string"), m(instructions="new"))
    assert one(spark, st) == "s" and one(spark, q) == {"type": "boolean", "instructions": "new"}
    rows = spark.createDataFrame([(True, 0.9, 0.1, False, False), (False, 0.8, 2.0, True, False)], "ok boolean, conf double, ce double, abstained boolean, gold_abstains boolean")
    r = metrics.committed_accuracy(rows, []).first()
    assert r["accuracy"] == 0.5 and r["abstained_wrongly"] == 0.5
    rep = spark.createDataFrame([("all", 2, 2, 0.5, 0.5, 0.1, 0.2, 0.9)], "qtype string, cases long, scored long, accuracy double, balanced_accuracy double, brier double, ece double, mean_confidence double")
    assert "acc=0.5000" in metrics.format_report(rep).first()["line"]


def test_teacher_expressions(spark):
    q = questions.parse_question(F.lit('{"type": "score", "criteria": ["low", "mid", "high"]}'))
    d = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(p).alias("p")) for k, p in (("0", 0.5), ("1", 0.25), ("2", 0.25))))
    assert [x["key"] for x in one(spark, prepare.rekey_levels(d, q))] == ["low", "mid", "high"]
    assert [x["p"] for x in one(spark, prepare.merge_target(F.lit("1"), F.lit(0.7), d))] == pytest.approx([0.2, 0.7, 0.1])
    n = questions.parse_question(F.lit('{"type": "numeric", "min": 0, "max": 10, "granularity": 3}'))
    assert one(spark, prepare.anchor_values(n)) == [0.0, 5.0, 10.0]
    e = metrics.parse_expect(F.lit('{"value": 5}'))
    assert tuple(one(spark, prepare.label_anchor(n, e))) == ("5", 0.75)
    for x, want in (('{"value": 11}', ("__above__", 0.75)), ('{"status": "out_of_bounds"}', (None, 0.0)), ('{"status": "abstained"}', ("__abstain__", 0.85)), ('{"value": 2.5}', ("0", 0.75))):
        assert tuple(one(spark, prepare.label_anchor(n, metrics.parse_expect(F.lit(x))))) == want
    assert tuple(one(spark, prepare.label_anchor(q, metrics.parse_expect(F.lit('{"level": 1}'))))) == ("mid", 0.75)
    assert one(spark, prepare.merge_target(F.lit("9"), F.lit(0.7), d)) == one(spark, d)
    lic = {x: one(spark, prepare.license_ok(F.lit(x))) for x in ("MIT", "cc-by-4.0 (mirror: mit)", "other (research use)", "cc-by-nc-4.0", "unspecified")}
    assert list(lic.values()) == [True, True, False, False, True]
    assert [x["p"] for x in one(spark, prepare.teacher_probs(F.lit(None).cast("array<struct<key:string,p:double>>"), F.lit(0.25)))] == [0.25, 0.75]
    sl = questions.slots(questions.parse_question(F.lit('{"type": "boolean"}')))
    votes = prepare.vote_slots(sl, F.array(F.lit("yes"), F.lit("No"), F.lit("maybe")))
    assert one(spark, votes) == [0, 1, None] and one(spark, prepare.contested(F.lit(0), votes)) is True


def test_softmax_is_shift_invariant(spark):
    a = one(spark, softmax(F.array(F.lit(1000.0), F.lit(1001.0))))
    assert a == pytest.approx(one(spark, softmax(F.array(F.lit(0.0), F.lit(1.0))))) and sum(a) == pytest.approx(1)


def test_workers_find_the_package(spark):
    from verdigris.session import importable, repo_root

    importable(spark)
    importable(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(repo_root()) == 1
