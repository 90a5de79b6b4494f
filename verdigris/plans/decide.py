"""Queries of questions, prompts, decisions, judging and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import prob
from verdigris.functions.once import once
from verdigris.functions.text import numeric_like, toon_bare, toon_key, toon_string
from verdigris.functions.toon import toon_udf
from verdigris.operators import calibrate, decide, metrics, questions
from verdigris.operators.logits import ColumnLogits, HashLogits, letter_variants, read_row
from verdigris.plans.common import CASES_SQL, HASHED_SQL, JUDGED_SQL, SLOTS_SQL, Registry, answered, cases, hashed
from verdigris.session import stored, table

R = Registry()
add = R.add
r6, r4 = prob.r6, prob.r4

_EMB = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def emb(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("l"))
    return e if k is None else e.withColumn("l", F.slice("l", 1, k))


@add(f"WITH {_EMB}, s AS (SELECT vec_id, i, exp((x - max(x) OVER w) / 0.05) AS z FROM e WINDOW w AS (PARTITION BY vec_id)), p AS (SELECT vec_id, i, z / sum(z) OVER (PARTITION BY vec_id) AS p FROM s) SELECT vec_id, i::INT AS pos, round(p * 1e6) / 1e6 AS p FROM p")
def dec_01_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = emb(spark, d).select("vec_id", F.posexplode(prob.softmax(F.col("l"), 0.05)).alias("pos", "p"))
    return p.select("vec_id", "pos", r6(F.col("p")).alias("p"))


_P = f"{_EMB}, s AS (SELECT vec_id, label, i, exp((x - max(x) OVER w) / 0.05) AS z FROM e WINDOW w AS (PARTITION BY vec_id)), p AS (SELECT vec_id, label AS y, i, z / sum(z) OVER (PARTITION BY vec_id) AS p FROM s)"


@add(f"WITH {_P} SELECT vec_id, round(greatest(0, (64 * max(p) - 1) / 63) * 1e6) / 1e6 AS confidence, arg_max(i, struct_pack(p := p, i := i))::INT AS best FROM p GROUP BY vec_id")
def dec_02_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = once(emb(spark, d), p=prob.softmax(F.col("l"), 0.05))
    return e.select("vec_id", r6(prob.confidence(F.col("p"))).alias("confidence"), prob.argmax_last(F.col("p")).alias("best"))


@add(f"""WITH {_P}, v AS (SELECT vec_id, y, arg_max(i, struct_pack(p := p, i := i)) AS best, max(p) AS p1, list_sort(list(p), 'DESC')[2] AS p2, sum(power(p - CASE WHEN i = y THEN 1 ELSE 0 END, 2)) AS b FROM p GROUP BY vec_id, y)
SELECT CASE WHEN p1 - p2 < 0.15::DOUBLE THEN 'contested' ELSE 'decided' END AS status, count(*) AS n, round(avg(CASE WHEN best = y THEN 1.0 ELSE 0.0 END) * 1e6) / 1e6 AS accuracy, round(avg(greatest(0, (64 * p1 - 1) / 63)) * 1e6) / 1e6 AS mean_confidence, round(avg(b) * 1e6) / 1e6 AS brier FROM v GROUP BY 1""")
def flagship_report(spark: SparkSession, d: str) -> DataFrame:
    """Logits to probabilities to typed answers to a report by status."""
    e = once(emb(spark, d), p=prob.softmax(F.col("l"), 0.05)).withColumn("y", F.col("label").cast("int"))
    e = e.withColumn("status", F.when(prob.gap(F.col("p")) < decide.CONTESTED, "contested").otherwise("decided"))
    ok = (prob.argmax_last(F.col("p")) == F.col("y")).cast("double")
    return e.groupBy("status").agg(F.count("*").alias("n"), r6(F.avg(ok)).alias("accuracy"), r6(F.avg(prob.confidence(F.col("p")))).alias("mean_confidence"), r6(F.avg(prob.brier(F.col("p"), F.col("y")))).alias("brier"))


@add(f"WITH {CASES_SQL} SELECT record_no, status, confidence, choice, boolean, score, level, value FROM an")
def dec_03_decode(spark: SparkSession, d: str) -> DataFrame:
    a = answered(spark, d)
    return a.select("record_no", *(F.col(f"answer.{k}").alias(k) for k in ("status", "confidence", "choice", "boolean", "score", "level", "value")))


@add(f"WITH {CASES_SQL} SELECT record_no, sum(p)::DOUBLE AS total, count(*) AS n FROM (SELECT record_no, round(p * 1e6) / 1e6 AS p FROM pr) GROUP BY record_no")
def dec_12_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The rounded probability maps add up and keep every slot."""
    e = answered(spark, d).select("record_no", F.explode("answer.probabilities").alias("x"))
    return e.groupBy("record_no").agg(F.sum("x.p").alias("total"), F.count("*").alias("n"))


_YES = f"{_EMB}, y AS (SELECT vec_id, i, round(1e6 / (1 + exp(-8 * x))) / 1e6 AS p FROM e)"
_FOLD = "round(greatest(0, (64 * max(s) - 1) / 63) * 1e4) / 1e4 AS confidence"


@add(f"""WITH {_YES}, f AS (SELECT vec_id, p, i, p / sum(p) OVER (PARTITION BY vec_id) AS s FROM y)
SELECT vec_id, CASE WHEN max(p) < 0.5 THEN 'abstained' WHEN max(p) - list_sort(list(p), 'DESC')[2] < 0.15::DOUBLE THEN 'contested' ELSE 'decided' END AS status, {_FOLD}, 'o' || arg_max(i, struct_pack(p := p, i := i)) AS choice FROM f GROUP BY vec_id""")
def dec_04_merge_scored(spark: SparkSession, d: str) -> DataFrame:
    """64 probes folded to one answer."""
    e = once(emb(spark, d), p=F.transform("l", lambda x: r6(1 / (1 + F.exp(-8 * x)))))
    a = decide.merge_scored(F.transform("p", lambda x, i: F.concat(F.lit("o"), i.cast("string"))), F.col("p"), F.lit(True))
    return e.select("vec_id", a.alias("a")).select("vec_id", "a.status", "a.confidence", "a.choice")


@add(f"""WITH {_EMB}, g AS (SELECT vec_id, i, i // 22 AS page, exp(8 * x) AS z FROM e), h AS (SELECT vec_id, i, round(z / sum(z) OVER (PARTITION BY vec_id, page) * 1e6) / 1e6 AS p FROM g), f AS (SELECT vec_id, i, p / sum(p) OVER (PARTITION BY vec_id) AS s FROM h)
SELECT vec_id, CASE WHEN max(s) - list_sort(list(s), 'DESC')[2] < 0.15::DOUBLE THEN 'contested' ELSE 'decided' END AS status, {_FOLD}, 'o' || arg_max(i, struct_pack(s := s, i := i)) AS choice FROM f GROUP BY vec_id""")
def dec_05_merge_paged(spark: SparkSession, d: str) -> DataFrame:
    """64 options on three pages of 22 folded to one answer."""
    pages = F.array(*(F.slice("l", 1 + 22 * k, 22) for k in range(3)))
    p = F.flatten(F.transform(pages, lambda l: F.transform(prob.softmax(l, 1 / 8), r6)))
    e = once(emb(spark, d), p=p)
    a = decide.merge_paged(F.transform("p", lambda x, i: F.concat(F.lit("o"), i.cast("string"))), F.col("p"), F.lit(True))
    return e.select("vec_id", a.alias("a")).select("vec_id", "a.status", "a.confidence", "a.choice")


@add(f"""WITH {_EMB}, m AS (SELECT vec_id, i, x, max(x) OVER (PARTITION BY vec_id) AS m FROM e), c AS (SELECT vec_id, sum(CASE WHEN i < 12 THEN exp(x - m) END) / sum(exp(x - m)) AS coverage FROM m GROUP BY vec_id)
SELECT m.vec_id AS unit_id, chr((65 + i % 4)::INT) AS letter, max(x) AS logit, round(any_value(c.coverage) * 1e6) / 1e6 AS coverage FROM m JOIN c USING (vec_id) WHERE i < 12 GROUP BY ALL""")
def dec_06_read_row(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary rows read at twelve letter tokens, three variants of four letters."""
    e = emb(spark, d).select(F.col("vec_id").alias("unit_id"), F.posexplode("l").alias("token_id", "logit"))
    letters = spark.createDataFrame([(chr(65 + i % 4), i) for i in range(12)], "letter string, token_id int")
    return read_row(e, letters).select("unit_id", "letter", "logit", r6(F.col("coverage")).alias("coverage"))


_VOCABULARY = r"vo AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[ \n]?[\p{L}\p{N}]+')) AS token FROM documents WHERE text IS NOT NULL)"


@add(rf"WITH {_VOCABULARY} SELECT right(token, 1) AS letter, ('0x' || substr(md5(token), 1, 8))::BIGINT AS token_id FROM vo WHERE regexp_full_match(token, '[ \n]?[A-Z]')")
def dec_07_letter_variants(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a vocabulary, of all words of the documents with the space or line end before them, that are one letter."""
    v = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[ \n]?[\p{L}\p{N}]+"), F.lit(0))).alias("token")).distinct()
    return letter_variants(v.withColumn("token_id", F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")))


@add(f"WITH {_EMB} SELECT vec_id, (i // 2)::INT AS pair, round(1e6 / (1 + exp(max(CASE WHEN i % 2 = 1 THEN x END) - max(CASE WHEN i % 2 = 0 THEN x END)))) / 1e6 AS p FROM e GROUP BY vec_id, i // 2")
def dec_08_p_yes(spark: SparkSession, d: str) -> DataFrame:
    """P(yes) of each two neighbouring values."""
    e = emb(spark, d).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("pair"), "l")
    return e.select("vec_id", "pair", decide.p_yes(F.slice("l", F.col("pair") * 2 + 1, F.lit(2))).alias("p"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Each test case of the gold table as a request with all its questions, and one of too many options."""
    t = table(spark, d, "typed_decisions").select(F.col("id").alias("req_id"), "state", "questions", "revised_at", "split")
    w = Window.partitionBy("req_id").orderBy(F.desc("revised_at"), "state")
    one = t.filter("split = 'test' and state is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("req_id", "state", "questions")
    return questions.explode_questions(one).drop("questions")


@add()
def dec_09_decide(spark: SparkSession, d: str) -> DataFrame:
    """Requests to answers, end to end, on the hash of the prompt."""
    units = HashLogits().attach(questions.compile_units(_requests(spark, d)))
    temps = spark.createDataFrame([("boolean", 0.8), ("choice", 1.2)], "bucket string, temperature double")
    a = decide.decide(units, temps)
    return a.select("req_id", "q_pos", "q_name", "qtype", "answer.status", "answer.confidence", metrics.pick(F.col("answer")).alias("pick"))


_REQUESTS = CASES_SQL.replace(CASES_SQL[CASES_SQL.index("q0 AS ("):CASES_SQL.index("t AS (SELECT")], """
rq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revised_at DESC, state) AS r FROM typed_decisions WHERE split = 'test' AND state IS NOT NULL) WHERE r = 1),
q0 AS (SELECT id || ':' || (i - 1) AS record_no, state, json_extract(questions, '$."' || k || '"') AS qj, NULL::JSON AS ej FROM (SELECT id, state, questions::JSON AS questions, unnest(json_keys(questions)) AS k, generate_subscripts(json_keys(questions), 1) AS i FROM rq)),
""").replace(HASHED_SQL.format("record_no || ':' || pos") + " AS l", HASHED_SQL.format("record_no || ':' || pos") + " / CASE WHEN qtype IN ('noul', 'boolean') THEN 0.8::DOUBLE WHEN qtype = 'choice' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS l")


@add(f"WITH {_REQUESTS} SELECT record_no AS unit, status, confidence, choice, boolean, score, level FROM an")
def dec_09_decide_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Requests to answers, end to end, on logits that depend on the question's place only."""
    unit = F.concat_ws(":", "req_id", F.col("q_pos").cast("string"))
    units = ColumnLogits(F.transform("slots", lambda s: hashed(unit, s["pos"].cast("string")))).attach(questions.compile_units(_requests(spark, d)))
    temps = spark.createDataFrame([("boolean", 0.8), ("choice", 1.2)], "bucket string, temperature double")
    return decide.decide(units, temps).select(unit.alias("unit"), *(F.col(f"answer.{k}").alias(k) for k in ("status", "confidence", "choice", "boolean", "score", "level")))


def _brands(spark: SparkSession, d: str) -> DataFrame:
    """A choice among all brand and type pairs of the parts: more options than letters."""
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("k")).distinct()
    crit = p.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_set("k")), lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ", "), F.lit("]")).alias("c"))  # brands x types, at most 256 by the limit of options
    q = F.concat(F.lit('{"type": "choice", "instructions": "Which kind is it?", "criteria": '), F.col("c"), F.lit(', "allow_abstain": true}'))
    states = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("req_id"), F.col("s_name").alias("state"))
    return states.crossJoin(F.broadcast(crit.select(q.alias("question")))).withColumn("q_pos", F.lit(0)).withColumn("q_name", F.lit("kind"))


@add("SELECT s_suppkey::VARCHAR AS req_id, (SELECT count(DISTINCT p_brand || ' ' || p_type) FROM part) AS units FROM supplier")
def prm_28_expand_probes(spark: SparkSession, d: str) -> DataFrame:
    return questions.compile_units(_brands(spark, d)).groupBy("req_id").agg(F.count("*").alias("units"))


@add("WITH n AS (SELECT count(DISTINCT p_brand || ' ' || p_type) AS n FROM part) SELECT s_suppkey::VARCHAR AS req_id, ceil(n / 26.0)::BIGINT AS pages, ceil(n / ceil(n / 26.0))::INT AS largest FROM supplier, n")
def prm_28_expand_pages(spark: SparkSession, d: str) -> DataFrame:
    return questions.compile_units(_brands(spark, d), expand="pages").groupBy("req_id").agg(F.count("*").alias("pages"), F.max(F.size("slots")).alias("largest"))


_PROBES = f"""WITH k AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT p_brand || ' ' || p_type AS k FROM part)),
pb AS (SELECT s_suppkey::VARCHAR AS req_id, k, i, round(1e6 / (1 + exp({HASHED_SQL.format("s_suppkey || ':' || i || ':1'")} - {HASHED_SQL.format("s_suppkey || ':' || i || ':0'")}))) / 1e6 AS p FROM supplier, k),
sh AS (SELECT *, p / sum(p) OVER (PARTITION BY req_id) AS s FROM pb)
SELECT req_id, CASE WHEN max(p) < 0.5 THEN 'abstained' WHEN max(p) - list_sort(list(p), 'DESC')[2] < 0.15::DOUBLE THEN 'contested' ELSE 'decided' END AS status, arg_max(k, struct_pack(p := p, i := i)) AS choice, round(greatest(0, (count(*) * max(s) - 1) / (count(*) - 1)) * 1e4) / 1e4 AS confidence FROM sh GROUP BY req_id"""


@add(_PROBES)
def dec_09_probes_by_id(spark: SparkSession, d: str) -> DataFrame:
    """A choice of too many options, asked option by option and folded."""
    logits = F.transform("slots", lambda s: hashed(F.col("req_id"), F.col("sub_idx").cast("string"), s["pos"].cast("string")))
    units = ColumnLogits(logits).attach(questions.compile_units(_brands(spark, d)))
    return decide.decide(units).select("req_id", "answer.status", "answer.choice", "answer.confidence")


@add()
def dec_09_decide_expanded(spark: SparkSession, d: str) -> DataFrame:
    units = HashLogits().attach(questions.compile_units(_brands(spark, d)))
    return decide.decide(units).select("req_id", "answer.status", "answer.choice", "answer.confidence")


@add(f"WITH {CASES_SQL}, f AS (SELECT * FROM (VALUES ('boolean', 0.5::DOUBLE), ('score', 30.0::DOUBLE)) v(bucket, f)) SELECT record_no, b AS bucket, round(2 * coalesce(f, 1) * 1e6) / 1e6 AS t FROM (SELECT record_no, CASE qtype WHEN 'noul' THEN 'boolean' ELSE qtype END AS b FROM t2) LEFT JOIN f ON bucket = b")
def dec_10_temperature(spark: SparkSession, d: str) -> DataFrame:
    """The temperature of every case: twice its bucket's, which some buckets lack."""
    b = cases(spark, d).select("record_no", decide.bucket(F.col("q.qtype")).alias("bucket"))
    t = spark.createDataFrame([("boolean", 0.5), ("score", 30.0)], "bucket string, f double")
    return b.join(F.broadcast(t), "bucket", "left").select("record_no", "bucket", r6(decide.temperature(F.lit(2.0), F.col("f"))).alias("t"))


@add(f"WITH {CASES_SQL} SELECT an.record_no, an.qtype AS type, CASE WHEN an.qtype = 'noul' THEN round(ag.py * 1e6) / 1e6 END AS noul, CASE WHEN an.qtype = 'score' THEN round(an.score * (ag.reals - 1) * 1e4) / 1e4 END AS score, CASE WHEN an.qtype = 'boolean' THEN an.boolean END AS boolean FROM an JOIN ag USING (record_no)")
def snk_10_wire(spark: SparkSession, d: str) -> DataFrame:
    a = answered(spark, d).select("record_no", decide.wire(F.col("q.qtype"), F.col("slots"), F.col("answer")).alias("w"))
    return a.select("record_no", "w.type", "w.noul", "w.score", "w.boolean")


# ---- schema ----


@add(f"WITH {CASES_SQL} SELECT record_no, qtype, instructions, mn AS min, mx AS max, gr AS granularity, ab AS allow_abstain, CASE kind WHEN 'OBJECT' THEN len(json_keys(c))::INT WHEN 'ARRAY' THEN json_array_length(c)::INT END AS criteria FROM t2")
def sch_01_questions(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return c.select("record_no", "q.qtype", "q.instructions", "q.min", "q.max", "q.granularity", "q.allow_abstain", F.when(F.col("q.criteria").isNotNull(), F.size("q.criteria")).alias("criteria"))


@add("SELECT l_orderkey, l_linenumber, least(24, greatest(2, (round(l_quantity / (1 + l_linenumber)) + 1)::INT)) AS anchors FROM lineitem")
def sch_02_anchors(spark: SparkSession, d: str) -> DataFrame:
    q = F.struct(F.lit(0.0).alias("min"), F.col("l_quantity").alias("max"), (1.0 + F.col("l_linenumber")).alias("step"), F.lit(8).alias("granularity"))
    return table(spark, d, "lineitem").withColumn("q", q).select("l_orderkey", "l_linenumber", questions.anchors(F.col("q")).alias("anchors"))


@add(f"WITH {CASES_SQL} SELECT record_no, CASE WHEN qtype IN ('choice', 'score') AND coalesce(CASE kind WHEN 'OBJECT' THEN len(json_keys(c)) WHEN 'ARRAY' THEN json_array_length(c) END, 0) < 2 THEN 'at least two criteria' WHEN qtype = 'numeric' AND NOT coalesce(mn < mx, false) THEN 'min must be below max' END AS problem FROM t2")
def sch_03_problems(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("record_no", questions.problem(F.col("q")).alias("problem"))


@add("SELECT id, n::INT AS questions, CASE WHEN n < 1 OR n > 64 THEN 'between 1 and 64 questions' END AS problem FROM (SELECT id, len(json_keys(questions)) AS n FROM typed_decisions)")
def sch_05_requests(spark: SparkSession, d: str) -> DataFrame:
    q = F.transform(F.map_entries(F.from_json("questions", "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("q")))
    t = table(spark, d, "typed_decisions").withColumn("qs", q)
    return t.select("id", F.size("qs").alias("questions"), questions.request_problem(F.col("qs"), F.lit(1.0)).alias("problem"))


@add("SELECT id, split, count(*) AS n FROM (SELECT id, split, unnest(json_keys(questions)) FROM typed_decisions) GROUP BY ALL")
def sch_04_explode(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "typed_decisions").select("id", "split", "questions")
    return questions.explode_questions(t).groupBy("id", "split").agg(F.count("*").alias("n"))


@add("SELECT record_no, CASE record_no % 3 WHEN 0 THEN 'state_first' WHEN 1 THEN 'auto' ELSE 'question_first' END AS by_case, 'auto' AS overridden FROM convert_hf")
def sch_09_pins(spark: SparkSession, d: str) -> DataFrame:
    """The layout of every case: its own pin, else the default; an override outranks both."""
    pin = F.when(F.col("record_no") % 3 == 0, "state_first").when(F.col("record_no") % 3 == 1, "auto")
    allowed = ("auto", "state_first", "question_first")
    return table(spark, d, "convert_hf").select("record_no", questions.pinned(pin, allowed, default="question_first").alias("by_case"), questions.pinned(pin, allowed, "auto").alias("overridden"))


# ---- prompts ----


@add(f"WITH {CASES_SQL}, {SLOTS_SQL} SELECT record_no, pos::INT AS pos, chr((65 + pos)::INT) AS letter, key, text, special FROM nt")
def prm_21_slots(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("record_no", F.explode("slots").alias("s")).select("record_no", "s.pos", "s.letter", "s.key", "s.text", "s.special")


@add(f"WITH {CASES_SQL} SELECT record_no, pos::INT AS pos, CASE WHEN special THEN key END AS key, round(v * 1e6) / 1e6 AS value, special FROM sl WHERE qtype = 'numeric'")
def prm_21_anchor_slots(spark: SparkSession, d: str) -> DataFrame:
    s = cases(spark, d).filter("q.qtype = 'numeric'").select("record_no", F.explode("slots").alias("s"))
    return s.select("record_no", "s.pos", F.when(F.col("s.special"), F.col("s.key")).alias("key"), r6(F.col("s.key").try_cast("double")).alias("value"), "s.special")


_MSG = SLOTS_SQL + """, o AS (SELECT record_no, string_agg(chr((65 + pos)::INT) || ') ' || text, chr(10) ORDER BY pos) AS lines FROM nt GROUP BY record_no),
b AS (SELECT t2.record_no, t2.state, 'QUESTION' || chr(10) || CASE WHEN instructions <> '' THEN instructions || chr(10) ELSE '' END || CASE WHEN qtype IN ('boolean', 'noul') THEN 'Answer yes or no.' || chr(10) WHEN qtype = 'numeric' THEN 'Pick the closest value in range [' || regexp_replace(mn::VARCHAR, '\\.0$', '') || ', ' || regexp_replace(mx::VARCHAR, '\\.0$', '') || '], or below/above the range.' || chr(10) ELSE '' END || chr(10) || 'OPTIONS' || chr(10) || o.lines AS block FROM t2 JOIN o USING (record_no) WHERE state IS NOT NULL)"""


@add(f"WITH {CASES_SQL}, {_MSG} SELECT record_no, md5('STATE' || chr(10) || state || chr(10) || chr(10) || block || chr(10) || chr(10) || 'Reply with one letter only.') AS state_first, md5(block || chr(10) || chr(10) || 'STATE' || chr(10) || state || chr(10) || chr(10) || 'Reply with one letter only.') AS question_first FROM b")
def prm_26_messages(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).filter("state is not null")
    none = F.array().cast("array<string>")
    msg = lambda layout: F.md5(questions.user_message(F.col("state"), F.col("q"), F.col("slots"), F.lit(layout), none)).alias(layout)
    return c.select("record_no", msg("state_first"), msg("question_first"))


@add()
def prm_25_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalog and header messages of the gold requests, by length and digest."""
    r = once(once(_requests(spark, d), q=questions.parse_question(F.col("question"))), slots=questions.slots(F.col("q")))
    w = Window.partitionBy("req_id")
    cat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("q_pos", questions.catalog_entry(F.col("q_pos"), F.col("q_name"), F.col("q")).alias("c"))).over(w)), lambda e: e["c"]))
    r = r.withColumn("cat", cat)
    m = questions.catalog_message(F.col("cat"), F.col("state"), F.col("q_pos"), F.col("q_name"), F.col("slots"))
    h = questions.user_message(F.col("state"), F.col("q"), F.col("slots"), F.lit("header"), F.col("cat"))
    return r.select("req_id", "q_pos", F.char_length(m).alias("catalog_chars"), F.md5(m).alias("catalog"), F.md5(h).alias("header"))


@add("""WITH t AS (SELECT id, split, state, unnest(json_keys(questions)) AS k, questions FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revised_at DESC, state) AS r FROM typed_decisions WHERE split = 'test' AND state IS NOT NULL) WHERE r = 1),
q AS (SELECT id, state, json_extract(questions, '$."' || k || '"') AS q FROM t),
s AS (SELECT id, any_value(octet_length(encode(state)))::BIGINT AS b, count(*) AS n, bool_or(coalesce((q->>'allow_abstain')::BOOLEAN, false)) AS ab, sum(strlen(coalesce(q->>'instructions', '')) + coalesce(strlen((q->'criteria')::VARCHAR), 0)) AS h FROM q GROUP BY id)
SELECT id AS req_id, CASE WHEN ab OR b > 2000 OR NOT (n <= 1 OR h > (n - 1) * b) THEN 'state_first' ELSE 'question_first' END AS layout FROM s""")
def prm_29_layout(spark: SparkSession, d: str) -> DataFrame:
    return questions.compile_units(_requests(spark, d)).select("req_id", "layout").distinct()


@add("SELECT c_custkey, CASE WHEN k ~ '^[A-Za-z_][A-Za-z0-9_.]*$' THEN k ELSE '\"' || k || '\"' END AS key, regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') AS numeric, NOT regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') AND v NOT LIKE '-%' AND NOT contains(v, ':') AS bare FROM (SELECT c_custkey, replace(c_name, '#', '.') AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal::VARCHAR WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || ': ' || c_name END AS v FROM customer)")
def prm_12_toon_scalars(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, F.col("c_acctbal").cast("string")).when(k % 3 == 1, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(": "), "c_name"))
    c = table(spark, d, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit(".")).alias("k"), v.alias("v"))
    return c.select("c_custkey", toon_key(F.col("k")).alias("key"), numeric_like(F.col("v")).alias("numeric"), toon_bare(F.col("v")).alias("bare"))


_NUMBERISH = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"


def _toon_text(x: str) -> str:
    """SQL of a string as TOON: bare, or quoted with escapes."""
    e = f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
    for c, t in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        e = f"replace({e}, chr({c}), '{t}')"
    for i in range(1, 32):
        if i not in (9, 10, 13):
            e = f"replace({e}, chr({i}), '\\u{i:04x}')"
    bare = f"{x} <> '' AND NOT regexp_matches({x}, '^[ \\t\\-#]|[ \\t]$') AND NOT regexp_matches({x}, '[:\"\\\\\\[\\]{{}},\\x00-\\x1f]') AND {x} NOT IN ('true', 'false', 'null') AND NOT regexp_full_match({x}, '{_NUMBERISH}')"
    return f"CASE WHEN {bare} THEN {x} ELSE '\"' || {e} || '\"' END"


@add(f"SELECT doc_id, md5({_toon_text('text')}) AS quoted, {_toon_text('source')} AS source FROM documents WHERE text IS NOT NULL")
def prm_13_toon_strings(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a TOON scalar."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(toon_string(F.col("text"))).alias("quoted"), toon_string(F.col("source")).alias("source"))


def _toon_scalar(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'VARCHAR' THEN {_toon_text(f'({v})->>' + chr(39) + '$' + chr(39))} WHEN 'NULL' THEN 'null' ELSE regexp_replace(({v})->>'$', '\\.0$', '') END"


# Objects of scalars, of objects of scalars, and of lists of like objects of scalars, which is all there is in the tables.
_TOON = f"""WITH li AS (SELECT l_orderkey, to_json(list(struct_pack(no := l_linenumber, qty := l_quantity, flag := l_returnflag) ORDER BY l_linenumber, l_quantity, l_returnflag)) AS lines FROM lineitem GROUP BY l_orderkey),
st AS (SELECT 'order' AS kind, o_orderkey AS id, json_object('status', o_orderstatus, 'total', o_totalprice, 'lines', lines)::VARCHAR AS state FROM orders JOIN li ON o_orderkey = l_orderkey UNION ALL SELECT 'case', record_no, state FROM convert_hf),
ob AS (SELECT kind, id, state::JSON AS s FROM st WHERE json_valid(state) AND json_type(CASE WHEN json_valid(state) THEN state END) = 'OBJECT'),
fi AS (SELECT kind, id, k, i, json_extract(s, '$."' || k || '"') AS v FROM (SELECT kind, id, s, unnest(json_keys(s)) AS k, generate_subscripts(json_keys(s), 1) AS i FROM ob)),
sc AS (SELECT kind, id, i, 0 AS j, k || ': ' || {_toon_scalar("v")} AS line FROM fi WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')),
su AS (SELECT kind, id, i, 0 AS j, k || ':' AS line FROM fi WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT kind, id, i, j, '  ' || kk || ': ' || {_toon_scalar("x")} FROM (SELECT kind, id, i, j, kk, json_extract(v, '$."' || kk || '"') AS x FROM (SELECT kind, id, i, v, unnest(json_keys(v)) AS kk, generate_subscripts(json_keys(v), 1) AS j FROM fi WHERE json_type(v) = 'OBJECT'))),
ar AS (SELECT kind, id, i, 0 AS j, k || '[' || json_array_length(v) || ']{{' || array_to_string(json_keys(v, '$[0]'), ',') || '}}:' AS line FROM fi WHERE json_type(v) = 'ARRAY'
  UNION ALL SELECT kind, id, i, j, '  ' || string_agg({_toon_scalar("x")}, ',' ORDER BY c) FROM (SELECT kind, id, i, j, c, json_extract(r, '$."' || kk || '"') AS x FROM (SELECT kind, id, i, j, r, unnest(json_keys(r)) AS kk, generate_subscripts(json_keys(r), 1) AS c FROM (SELECT kind, id, i, unnest(json_extract(v, '$[*]')) AS r, generate_subscripts(json_extract(v, '$[*]'), 1) AS j FROM fi WHERE json_type(v) = 'ARRAY'))) GROUP BY ALL)
SELECT kind, id, string_agg(line, chr(10) ORDER BY i, j) AS toon FROM (SELECT * FROM sc UNION ALL SELECT * FROM su UNION ALL SELECT * FROM ar) GROUP BY kind, id
UNION ALL SELECT kind, id, state FROM st WHERE state IS NULL OR (kind, id) NOT IN (SELECT (kind, id) FROM ob)"""


@add(_TOON)
def prm_02_toon_states(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as nested states, and the cases' states, as TOON."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    s = o.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "lines")).alias("state"))
    c = table(spark, d, "convert_hf").select(F.col("record_no").alias("id"), "state")
    return s.withColumn("kind", F.lit("order")).unionByName(c.withColumn("kind", F.lit("case"))).select("kind", "id", toon_udf("state").alias("toon"))


# ---- judging ----


@add(f"WITH {JUDGED_SQL} SELECT record_no, ok FROM jd")
def evl_01_judge(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).select("record_no", metrics.judge(F.col("e"), F.col("answer")).alias("ok"))


@add(f"WITH {JUDGED_SQL} SELECT record_no, y::INT AS y FROM tk")
def evl_02_target(spark: SparkSession, d: str) -> DataFrame:
    a = answered(spark, d)
    pr = F.col("answer.probabilities")
    return a.select("record_no", metrics.target_index(pr, metrics.target_key(F.col("q"), F.col("e"), pr)).alias("y"))


@add(f"WITH {JUDGED_SQL} SELECT record_no, top::INT AS top, round(brier * 1e6) / 1e6 AS brier FROM ds")
def evl_03_distributions(spark: SparkSession, d: str) -> DataFrame:
    a = metrics.with_distribution(answered(spark, d)).filter("y is not null")
    return a.select("record_no", "top", r6(prob.brier(F.col("p"), F.col("y"))).alias("brier"))


@add(f"""WITH {JUDGED_SQL}, k AS (SELECT unnest(['all', qtype]) AS qtype, ok, confidence FROM jd), dk AS (SELECT unnest(['all', qtype]) AS qtype, y, top, conf, brier FROM ds),
m AS (SELECT qtype, count(*) AS cases, count(ok) AS scored, round(coalesce(avg(CASE WHEN ok THEN 1.0 WHEN NOT ok THEN 0.0 END), 0) * 1e4) / 1e4 AS accuracy, round(coalesce(avg(CASE WHEN ok IS NOT NULL THEN confidence END), 0) * 1e4) / 1e4 AS mean_confidence FROM k GROUP BY qtype),
b AS (SELECT qtype, round(avg(brier) * 1e4) / 1e4 AS brier FROM dk GROUP BY qtype),
r AS (SELECT qtype, round(avg(r) * 1e4) / 1e4 AS balanced_accuracy FROM (SELECT qtype, y, avg(CASE WHEN top = y THEN 1.0 ELSE 0.0 END) AS r FROM dk GROUP BY qtype, y) GROUP BY qtype),
e AS (SELECT qtype, round(sum(n * abs(a - c)) / sum(n) * 1e4) / 1e4 AS ece FROM (SELECT qtype, least(9, floor(conf * 10)) AS b, count(*) AS n, avg(conf) AS c, avg(CASE WHEN top = y THEN 1.0 ELSE 0.0 END) AS a FROM dk GROUP BY 1, 2) GROUP BY qtype)
SELECT m.*, b.brier, r.balanced_accuracy, e.ece FROM m LEFT JOIN b USING (qtype) LEFT JOIN r USING (qtype) LEFT JOIN e USING (qtype)""")
def evl_08_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.report(answered(spark, d))


@add(f"WITH {JUDGED_SQL} SELECT record_no FROM jd WHERE NOT ok")
def evl_08_failures(spark: SparkSession, d: str) -> DataFrame:
    a = answered(spark, d).withColumn("case_id", F.col("record_no"))
    return metrics.failures(a).select(F.col("case_id").alias("record_no"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "convert_hf").filter("state is not null and question is not null").select(F.col("record_no").alias("case_id"), "state", "question")
    return metrics.auto_variants(c)


@add("""WITH c AS (SELECT record_no, state, question::JSON AS q FROM convert_hf WHERE state IS NOT NULL AND question IS NOT NULL)
SELECT kind, count(*) AS n FROM (SELECT 'base' AS kind FROM c UNION ALL SELECT 'option_reversal' FROM c WHERE q->>'type' = 'choice' AND json_type(q->'criteria') IN ('OBJECT', 'ARRAY') UNION ALL SELECT 'criterion_wrapper' FROM c WHERE coalesce(q->>'instructions', '') <> '' UNION ALL SELECT 'irrelevant_context' FROM c WHERE NOT starts_with(state, '[')) GROUP BY kind""")
def evl_07_variants(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@add()
def evl_12_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Cases and their stability probes decided on the hash of the prompt, then compared."""
    v = once(once(_variants(spark, d), q=questions.parse_question(F.col("question"))).filter("q is not null"), slots=questions.slots(F.col("q")))
    none = F.array().cast("array<string>")
    v = v.withColumn("prompt", questions.user_message(F.col("state"), F.col("q"), F.col("slots"), F.lit("state_first"), none))
    a = once(HashLogits().attach(once(v, prompt=F.col("prompt"))), p=prob.softmax(F.col("logits")))
    a = a.withColumn("answer", decide.decode(F.col("q.qtype"), F.col("slots"), F.col("p")))
    return metrics.consistency(stored(a.select("case_id", "kind", "answer"), "answers"))


@add(f"WITH {_P}, z AS (SELECT vec_id, y, i, p, pow(p, 1 / 2.0) AS z FROM p), n AS (SELECT vec_id, y, i, z / sum(z) OVER (PARTITION BY vec_id) AS q FROM z) SELECT y::INT AS y, round(sum(-ln(greatest(q, 1e-15))) * 1e4) / 1e4 AS nll, count(*) AS n FROM n WHERE i = y GROUP BY y")
def stat_02_nll(spark: SparkSession, d: str) -> DataFrame:
    e = once(emb(spark, d), p=prob.softmax(F.col("l"), 0.05)).withColumn("y", F.col("label").cast("int"))
    loss = prob.nll(prob.powered(F.col("p"), F.lit(2.0)), F.col("y"))
    return e.groupBy("y").agg(r4(F.sum(loss)).alias("nll"), F.count("*").alias("n"))


@add(f"WITH {_EMB}, f AS (SELECT vec_id, label, i, x, max(x) OVER (PARTITION BY vec_id) AS m FROM e), g AS (SELECT vec_id, label, m + ln(sum(exp(x - m))) - max(CASE WHEN i = label THEN x END) AS ce FROM f GROUP BY vec_id, label, m) SELECT label, round(avg(ce) * 1e6) / 1e6 AS ce FROM g GROUP BY label")
def evl_34_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d).withColumn("t", F.transform("l", lambda x, i: F.when(i == F.col("label"), 1.0).otherwise(0.0)))
    return e.groupBy("label").agg(r6(F.avg(prob.cross_entropy(F.col("l"), F.col("t")))).alias("ce"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    a = metrics.with_distribution(answered(spark, d)).filter("y is not null")
    return a.select(F.col("record_no").cast("string").alias("case_id"), decide.bucket(F.col("q.qtype")).alias("bucket"), "p", "y")


@add()
def stat_08_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Fitted temperature per bucket with raw, in-sample and out-of-fold calibration error."""
    temps, fig = calibrate.fit(_samples(spark, d), resamples=200)
    return temps.select("bucket", r4(F.col("temperature")).alias("temperature"), "n").crossJoin(F.broadcast(fig))


@add("""WITH b AS (SELECT record_no, list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split('case-fold/' || id, ''), lambda c: ord(c)::UHUGEINT)) AS x FROM convert_hf)
SELECT record_no, (list_reduce(x, lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 5)::INT AS fold FROM b""")
def stat_06_folds(spark: SparkSession, d: str) -> DataFrame:
    """The fold of every case."""
    return table(spark, d, "convert_hf").select("record_no", calibrate.fold_udf("id").alias("fold"))


@add("""WITH b AS (SELECT chunk_id, list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(md5(coalesce(text, '')), ''), lambda c: ord(c)::UHUGEINT)) AS x FROM corpus)
SELECT chunk_id, lpad(lower(to_hex(list_reduce(x, lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)), 16, '0') AS key FROM b""")
def rnk_18_keys(spark: SparkSession, d: str) -> DataFrame:
    """64-bit keys of what chunks hold."""
    return table(spark, d, "corpus").select("chunk_id", calibrate.fnv64_udf(F.md5(F.coalesce("text", F.lit("")))).alias("key"))


@add()
def rnk_17_keys(spark: SparkSession, d: str) -> DataFrame:
    """128-bit keys of ids."""
    return table(spark, d, "convert_hf").select("record_no", calibrate.fnv128_udf("id").alias("key"))


# ---- agreement ----

_GOLD = """g0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revised_at DESC, gold DESC) AS r FROM typed_decisions WHERE gold IS NOT NULL AND id IS NOT NULL) WHERE r = 1),
g1 AS (SELECT id, workflow, split, unnest(json_keys(gold)) AS question, gold::JSON AS gold, questions::JSON AS qs FROM g0),
g2 AS (SELECT id, workflow, split, question, json_extract(gold, '$."' || question || '"') AS g, json_extract(qs, '$."' || question || '"') AS q FROM g1),
g3 AS (SELECT id, workflow, split, question, q->>'type' AS qtype, g->>'label' AS gold_label, (g->>'score')::DOUBLE AS gold_score, g->'probabilities' AS pr, CASE WHEN q->>'type' IN ('noul', 'boolean') THEN ['false', 'true'] WHEN q->>'type' = 'score' THEN list_transform(range(json_array_length(q->'criteria')::BIGINT), lambda x: x::VARCHAR) ELSE json_keys(q->'criteria') END AS labels FROM g2),
g4 AS (SELECT * EXCLUDE (pr), unnest(labels) AS label, generate_subscripts(labels, 1) - 1 AS i, len(labels) AS n, coalesce((json_extract(pr, '$."' || unnest(labels) || '"'))::DOUBLE, 0) AS gp FROM g3)"""
_DEC = """d0 AS (SELECT *, greatest(p, 1e-6) AS c FROM pd),
d1 AS (SELECT *, sum(c) OVER (PARTITION BY id, question) AS z FROM d0),
de AS (SELECT id, workflow, question, any_value(qtype) AS qtype, any_value(gold_label) AS gold_label, any_value(gold_score) AS gold_score, arg_min(label, struct_pack(p := -p, i := i)) AS guess, arg_min(gp, struct_pack(p := -p, i := i)) AS soft, max(p) AS peak, sum(CASE WHEN gp > 0 THEN gp * ln(gp / (c / z)) ELSE 0 END) AS kl, sum(abs(gp - p)) / 2 AS tv, sum((gp - p) * (gp - p)) AS brier, sum(p * i) AS lv FROM d1 GROUP BY id, workflow, question),
dd AS (SELECT *, CASE WHEN guess = gold_label THEN 1.0 ELSE 0.0 END AS correct, CASE WHEN qtype = 'score' AND gold_score IS NOT NULL THEN abs(lv - gold_score) END AS mae FROM de)"""
_UNI = f"{_GOLD}, pd AS (SELECT *, 1.0::DOUBLE / n AS p FROM g4 WHERE split = 'test'), {_DEC}"
_FREQ = "fq AS (SELECT workflow, question, gold_label, count(*) AS k FROM g3 WHERE split = 'train' GROUP BY ALL), ft AS (SELECT workflow, question, sum(k) AS t FROM fq GROUP BY ALL)"
_PRI = f"{_GOLD}, {_FREQ}, pd AS (SELECT g4.*, CASE WHEN ft.t IS NULL THEN 1.0::DOUBLE / n ELSE coalesce(fq.k, 0)::DOUBLE / ft.t END AS p FROM g4 LEFT JOIN ft USING (workflow, question) LEFT JOIN fq ON fq.workflow = g4.workflow AND fq.question = g4.question AND fq.gold_label = g4.label WHERE split = 'test'), {_DEC}"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gold_decisions(table(spark, d, "typed_decisions"))


def _prior(spark: SparkSession, d: str) -> DataFrame:
    g = _gold(spark, d)
    return metrics.decisions(metrics.prior(g.filter("split = 'test'"), g.filter("split = 'train'")))


@add(f"WITH {_UNI} SELECT id, question, guess, correct::DOUBLE AS correct, round(soft * 1e9) / 1e9 AS soft, round(kl * 1e9) / 1e9 AS kl, round(tv * 1e9) / 1e9 AS tv, round(brier * 1e9) / 1e9 AS brier, round(mae * 1e9) / 1e9 AS mae FROM dd")
def evl_17_decisions(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.decisions(metrics.uniform(_gold(spark, d).filter("split = 'test'")))
    return x.select("id", "question", "guess", "correct", *(prob.half_up(F.col(c), 9).alias(c) for c in ("soft", "kl", "tv", "brier", "mae")))


_SUM = ", ".join(f"round(avg({c}) * 1e6) / 1e6 AS {c}" for c in ("correct", "soft", "kl", "tv", "brier", "mae"))


@add(f"""WITH {_PRI}, k AS (SELECT unnest([struct_pack(qtype := 'all', workflow := 'all'), struct_pack(qtype := qtype, workflow := 'all'), struct_pack(qtype := 'all', workflow := workflow)], recursive := true), correct, soft, peak, kl, tv, brier, mae FROM (SELECT * FROM dd)),
s AS (SELECT qtype, workflow, count(*) AS n, {_SUM}, round(sum(CASE WHEN mae <= 1 THEN 1.0 ELSE 0 END) / nullif(count(mae), 0) * 1e6) / 1e6 AS within_1 FROM k GROUP BY 1, 2),
e AS (SELECT qtype, workflow, round(sum(abs(a - c)) / sum(n) * 1e6) / 1e6 AS ece FROM (SELECT qtype, workflow, least(9, floor(peak * 10)) AS b, count(*) AS n, sum(correct) AS a, sum(peak) AS c FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT s.*, e.ece FROM s JOIN e USING (qtype, workflow)""")
def evl_20_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.summary(_prior(spark, d), [[], ["qtype"], ["workflow"]])
    return s.select("qtype", "workflow", "n", *(r6(F.col(c)).alias(c) for c in ("correct", "soft", "kl", "tv", "brier", "mae", "within_1", "ece")))


@add(f"""WITH {_PRI}, l AS (SELECT workflow, question, label, sum(CASE WHEN gold_label = label AND guess = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN gold_label = label THEN 1 ELSE 0 END) AS gn, sum(CASE WHEN guess = label THEN 1 ELSE 0 END) AS pn FROM (SELECT workflow, question, gold_label, guess, unnest(list_distinct([gold_label, guess])) AS label FROM dd) GROUP BY ALL)
SELECT round(avg(f) * 1e6) / 1e6 AS macro_f1, count(*) AS questions FROM (SELECT workflow, question, avg(2.0 * tp / (gn + pn)) AS f FROM l GROUP BY ALL)""")
def evl_19_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(_prior(spark, d)).select(r6(F.col("macro_f1")).alias("macro_f1"), "questions")


@add(f"WITH {_PRI} SELECT 'prior' AS baseline, count(*) AS n, round(avg(correct) * 1e6) / 1e6 AS accuracy, round(avg(kl) * 1e6) / 1e6 AS kl, round(avg(brier) * 1e6) / 1e6 AS brier FROM dd")
def evl_21_prior(spark: SparkSession, d: str) -> DataFrame:
    return _prior(spark, d).agg(F.count("*").alias("n"), r6(F.avg("correct")).alias("accuracy"), r6(F.avg("kl")).alias("kl"), r6(F.avg("brier")).alias("brier")).select(F.lit("prior").alias("baseline"), "*")


@add(f"WITH {_PRI}, c AS (SELECT workflow, question, guess, count(*) AS n FROM dd GROUP BY ALL) SELECT workflow, question, arg_min(guess, struct_pack(n := -n, g := guess)) AS modal, round(max(n) / sum(n)::DOUBLE * 1e6) / 1e6 AS share FROM c GROUP BY workflow, question")
def evl_22_constancy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.constancy(_prior(spark, d)).select("workflow", "question", "modal", r6(F.col("share")).alias("share"))


@add()
def evl_23_paired(spark: SparkSession, d: str) -> DataFrame:
    """Prior against uniform baseline on the same decisions, with the exact McNemar test."""
    g = _gold(spark, d).filter("split = 'test'")
    a = metrics.decisions(metrics.uniform(g)).select("id", "question", (F.col("correct") > 0).alias("ok"))
    b = _prior(spark, d).select("id", "question", (F.col("correct") > 0).alias("ok"))
    p = metrics.paired(a, b, ["id", "question"])
    return p.select("n", r6(F.col("acc_a")).alias("acc_a"), r6(F.col("acc_b")).alias("acc_b"), "only_a", "only_b", r6(F.col("delta")).alias("delta"), r6(F.col("p_value")).alias("p_value"))


@add("""WITH v AS (SELECT b, c, least(b, c) AS k, b + c AS n FROM (VALUES (0, 0), (1, 5), (3, 3), (10, 2), (25, 40)) t(b, c)),
x AS (SELECT b, c, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) AS s FROM v, generate_series(0, 100) g(i) WHERE i <= k GROUP BY b, c, n)
SELECT b, c, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * s) END * 1e6) / 1e6 AS p FROM x""")
def stat_05_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([(0, 0), (1, 5), (3, 3), (10, 2), (25, 40)], "b int, c int")
    return v.select("b", "c", r6(prob.mcnemar(F.col("b"), F.col("c"))).alias("p"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers as voters on documents."""
    y = F.greatest("abusive", "hateful", "sexual")
    return table(spark, d, "review_labels").select(F.col("doc_id").alias("case_id"), F.lit("q").alias("question"), F.col("reviewer").alias("voter"), y.cast("string").alias("label")).filter("label is not null")


_VOTES = "vt AS (SELECT doc_id AS case_id, reviewer AS voter, greatest(abusive, hateful, sexual)::VARCHAR AS label FROM review_labels WHERE greatest(abusive, hateful, sexual) IS NOT NULL), rf AS (SELECT case_id, arg_min(label, struct_pack(n := -n, l := label)) AS reference FROM (SELECT case_id, label, count(*) AS n FROM vt GROUP BY ALL) GROUP BY case_id)"


@add(f"WITH {_VOTES} SELECT case_id, reference FROM rf")
def evl_28_consensus(spark: SparkSession, d: str) -> DataFrame:
    return metrics.consensus(_votes(spark, d).withColumn("p", F.lit(None).cast("double"))).select("case_id", "reference")


@add(f"WITH {_VOTES} SELECT voter AS model, workflow, count(*) AS n, sum(CASE WHEN label = reference THEN 1 ELSE 0 END)::BIGINT AS agree, round(avg(CASE WHEN label = reference THEN 1.0 ELSE 0 END) * 1e6) / 1e6 AS share FROM (SELECT voter, label, reference, unnest(['all', 'w' || case_id % 2]) AS workflow FROM vt JOIN rf USING (case_id)) GROUP BY ALL")
def evl_29_agreement(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d)
    ref = metrics.consensus(v.withColumn("p", F.lit(None).cast("double")))
    a = v.select(F.col("voter").alias("model"), "case_id", "question", F.col("label").alias("answer"), F.concat(F.lit("w"), (F.col("case_id") % 2).cast("string")).alias("workflow"))
    return metrics.agreement(a, ref).withColumn("share", r6(F.col("share")))


@add("SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value >= 0.5 THEN 'true' ELSE 'false' END ELSE greatest(0, least(3, round_even(value, 0)::INT))::VARCHAR END AS answer FROM events WHERE value IS NOT NULL")
def evl_30_canonical(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_type") == "click", "noul").otherwise("score")
    return table(spark, d, "events").filter("value is not null").select("event_id", metrics.canonical(t, F.col("value").cast("string")).alias("answer"))


@add("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN value END) AS p95, round(avg(value) * 1e6) / 1e6 AS mean, round(count(*) / (sum(value) / 1000) * 1e4) / 1e4 AS req_s FROM r GROUP BY event_type""")
def evl_38_latency(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.latency(table(spark, d, "events"), ["event_type"], "value")
    return r.select("event_type", "n", "p50", "p95", r6(F.col("mean")).alias("mean"), r4(F.col("req_s")).alias("req_s"))


@add("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.5) AS median, round(coalesce(avg(l_discount), 0) * 1e6) / 1e6 AS mean FROM lineitem GROUP BY l_returnflag")
def stat_10_percentiles(spark: SparkSession, d: str) -> DataFrame:
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by l_extendedprice)")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(disc(0.9).alias("p90"), disc(0.5).alias("median"), r6(F.coalesce(F.avg("l_discount"), F.lit(0.0))).alias("mean"))


@add(f"WITH {_EMB}, a AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e WHERE i < 4), b AS (SELECT vec_id, i - 4 AS i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS q FROM e WHERE i BETWEEN 4 AND 7), k AS (SELECT vec_id, sum(p * ln(p / q)) AS kl, (arg_min(i, struct_pack(p := -p, i := i)) = arg_min(i, struct_pack(q := -q, i := i)))::INT AS same FROM a JOIN b USING (vec_id, i) GROUP BY vec_id) SELECT count(*) AS n, round(avg(same) * 1e6) / 1e6 AS argmax_agreement, round(avg(kl) * 1e6) / 1e6 AS kl_mean, round(quantile_disc(kl, 0.95) * 1e6) / 1e6 AS kl_p95, round(max(kl) * 1e6) / 1e6 AS kl_max FROM k")
def evl_36_parity(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    side = lambda at: e.select(F.col("vec_id").alias("id"), prob.softmax(F.slice("l", at, 4)).alias("p"))
    r = metrics.parity(side(1), side(5))
    return r.select("n", *(r6(F.col(c)).alias(c) for c in ("argmax_agreement", "kl_mean", "kl_p95", "kl_max")))


@add(f"WITH {_EMB}, a AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e WHERE i < 4), b AS (SELECT vec_id, i - 2 AS i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS q FROM e WHERE i BETWEEN 2 AND 5) SELECT vec_id, round(avg(abs(coalesce(p, 0) - coalesce(q, 0))) * 1e6) / 1e6 AS drift FROM a FULL JOIN (SELECT vec_id, i + 2 AS i, q FROM b) b USING (vec_id, i) GROUP BY vec_id")
def evl_05_drift(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference over the union of two maps' keys, half of them shared."""
    m = lambda at: F.transform(prob.softmax(F.slice("l", at + 1, 4)), lambda p, i: F.struct((i + at).cast("string").alias("key"), p.alias("p")))
    return emb(spark, d).select("vec_id", r6(metrics.drift(m(0), m(2))).alias("drift"))


@add("SELECT l_orderkey, l_linenumber, round(" + HASHED_SQL.format("l_orderkey || ':' || l_linenumber") + " * 1e6) / 1e6 AS logit FROM lineitem")
def dec_14_hash_logits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(hashed(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("logit"))


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The cases judged on two different stand-ins."""
    a = answered(spark, d)
    ok = metrics.judge(F.col("e"), F.col("answer"))
    one = a.select(F.col("record_no").alias("id"), ok.alias("ok"), metrics.abstained(F.col("answer")).alias("abstained"), (F.col("record_no") % 97).cast("double").alias("ms"))
    two = one.withColumn("ok", (F.col("id") % 3 == 0) | F.col("ok")).withColumn("ms", F.col("ms") + 1)
    return one, two


@add(f"""WITH {JUDGED_SQL}, r AS (SELECT qtype, ok, p1 AS conf, record_no % 10 / 10.0::DOUBLE AS ce, status = 'abstained' AS ab, coalesce(x_status = 'abstained', false) AS gold_ab FROM jd WHERE ok IS NOT NULL),
b AS (SELECT qtype, least(14, floor(conf * 15)) AS bin, count(*) AS n, avg(conf) AS c, avg(ok::INT) AS a FROM r GROUP BY ALL), e AS (SELECT qtype, sum(n * abs(a - c)) / sum(n) AS ece FROM b GROUP BY qtype)
SELECT qtype, round(avg(ok::INT) * 1e6) / 1e6 AS accuracy, round(avg(ce) * 1e6) / 1e6 AS ce, round(avg((ab AND NOT gold_ab)::INT) * 1e6) / 1e6 AS abstained_wrongly, round(any_value(ece) * 1e6) / 1e6 AS ece FROM r JOIN e USING (qtype) GROUP BY qtype""")
def evl_33_committed(spark: SparkSession, d: str) -> DataFrame:
    """Training-time figures per type."""
    a = answered(spark, d)
    rows = a.select(F.col("q.qtype").alias("qtype"), metrics.judge(F.col("e"), F.col("answer")).alias("ok"), F.array_max("p").alias("conf"), (F.col("record_no") % 10 / 10).alias("ce"), (F.col("answer.status") == "abstained").alias("abstained"), F.coalesce(F.col("e.status") == "abstained", F.lit(False)).alias("gold_abstains"))
    m = metrics.committed_accuracy(rows.filter("ok is not null"), ["qtype"])
    return m.select("qtype", *(r6(F.col(k)).alias(k) for k in ("accuracy", "ce", "abstained_wrongly", "ece")))


@add(f"""WITH {JUDGED_SQL}, r AS (SELECT record_no, ok AS x, ok OR record_no % 3 = 0 AS y, status = 'abstained' AS ab, (record_no % 97)::DOUBLE AS ms FROM jd),
s AS (SELECT count(*) AS n, avg(x::INT) AS acc_a, avg(y::INT) AS acc_b, sum((x AND NOT y)::INT)::BIGINT AS b, sum((NOT x AND y)::INT)::BIGINT AS c, avg(ab::INT) AS ab, list_sort(list(ms), 'DESC')[ceil(count(*) / 2.0)::INT] AS ms FROM r),
v AS (SELECT b, c, b + c AS m, least(b, c) AS k FROM s),
p AS (SELECT CASE WHEN any_value(m) = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2.0)))) END AS p FROM v, generate_series(0, 100000) g(i) WHERE i <= k)
SELECT n, round(acc_a * 1e6) / 1e6 AS acc_a, round(acc_b * 1e6) / 1e6 AS acc_b, round((acc_b - acc_a) * 1e6) / 1e6 AS delta, b AS only_a, c AS only_b, round(p * 1e6) / 1e6 AS p_value, round(ab * 1e6) / 1e6 AS abstain_base, round(ab * 1e6) / 1e6 AS abstain_tuned, ms AS ms_base, ms + 1 AS ms_tuned FROM s, p""")
def evl_26_paired_figures(spark: SparkSession, d: str) -> DataFrame:
    """The report of two runs without its resampled interval."""
    r = metrics.paired_report(*_runs(spark, d), resamples=10)
    return r.select("n", *(r6(F.col(k)).alias(k) for k in ("acc_a", "acc_b", "delta")), "only_a", "only_b", *(r6(F.col(k)).alias(k) for k in ("p_value", "abstain_base", "abstain_tuned")), "ms_base", "ms_tuned")


@add()
def evl_26_paired_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paired_report(*_runs(spark, d))


@add(f"WITH {JUDGED_SQL} SELECT count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END) * 1e6) / 1e6 AS acc_a, round(avg(CASE WHEN ok OR record_no % 3 = 0 THEN 1.0 ELSE 0 END) * 1e6) / 1e6 AS acc_b, sum(CASE WHEN NOT ok AND record_no % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS only_b FROM jd")
def join_09_paired_runs(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.paired(*_runs(spark, d), ["id"])
    return p.select("n", r6(F.col("acc_a")).alias("acc_a"), r6(F.col("acc_b")).alias("acc_b"), "only_b")


@add(f"WITH {_UNI} SELECT 'uniform' AS baseline, count(*) AS n, round(avg(correct) * 1e4) / 1e4 AS accuracy, round(avg(kl) * 1e4) / 1e4 AS kl, round(avg(tv) * 1e4) / 1e4 AS tv, round(avg(brier) * 1e4) / 1e4 AS brier FROM dd")
def evl_21_uniform(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.decisions(metrics.uniform(_gold(spark, d).filter("split = 'test'")))
    return x.agg(F.count("*").alias("n"), *(r4(F.avg(c)).alias(n) for c, n in (("correct", "accuracy"), ("kl", "kl"), ("tv", "tv"), ("brier", "brier")))).select(F.lit("uniform").alias("baseline"), "*")


@add(f"WITH {CASES_SQL} SELECT record_no, len(regexp_extract_all(state, '[\\p{{L}}\\p{{N}}]+|[^ \\t\\n\\v\\f\\r\\p{{L}}\\p{{N}}]'))::INT AS tokens FROM t2")
def dec_15_state_tokens(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("record_no", F.when(F.col("state").isNotNull(), questions.state_tokens(F.col("state"))).alias("tokens"))
