"""Queries of training-case preparation, adapters, joins, sets, sorts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.once import once
from verdigris.functions.prob import r6
from verdigris.functions.text import norm_text, shingles
from verdigris.operators import prepare
from verdigris.operators.logits import HashLogits
from verdigris.operators.questions import FIELDS
from verdigris.plans.common import CASES_SQL, SLOTS_SQL, Registry, cases, norm_sql
from verdigris.session import session_dir, spread, stored, table
from verdigris.sources import readers
from verdigris.streaming import stream

R = Registry()
add = R.add


def hf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "convert_hf")


_LICENSES = ", ".join(f"'{x}'" for x in prepare.PERMISSIVE)


@add(f"SELECT license, count(*) AS n FROM convert_hf WHERE NOT regexp_matches(lower(license), '{'|'.join(prepare.DENIED)}') AND trim(string_split(lower(license), '(')[1]) IN ({_LICENSES}) GROUP BY license")
def sch_13_license(spark: SparkSession, d: str) -> DataFrame:
    return hf(spark, d).filter(prepare.license_ok(F.col("license"))).groupBy("license").agg(F.count("*").alias("n"))


_FIELDS = ", ".join(f"'{k}'" for k in FIELDS)
_STATUSES = "'abstained', 'decided', 'contested', 'out_of_bounds'"
_ERRORS = f"""WITH {CASES_SQL},
b AS (SELECT t2.*, h.id, h.expect, CASE kind WHEN 'OBJECT' THEN len(json_keys(c)) WHEN 'ARRAY' THEN json_array_length(c) ELSE 0 END AS n, CASE kind WHEN 'OBJECT' THEN json_keys(c) WHEN 'ARRAY' THEN json_extract_string(c, '$[*]') END AS ks, ej->>'status' AS s, qtype = 'numeric' AS num, {norm_sql('t2.state')} AS norm FROM t2 JOIN convert_hf h USING (record_no)),
e AS (SELECT record_no, list_filter([
  CASE WHEN id IS NULL THEN 'missing id' END, CASE WHEN state IS NULL THEN 'missing state' END, CASE WHEN ej IS NULL OR json_type(ej) <> 'OBJECT' THEN 'expect is no object' END,
  CASE WHEN qtype IS NULL OR qtype NOT IN ('boolean', 'noul', 'choice', 'score', 'numeric') THEN 'bad type' END, CASE WHEN len(list_filter(json_keys(qj), lambda k: k NOT IN ({_FIELDS}))) > 0 THEN 'extra keys' END,
  CASE WHEN qtype = 'noul' AND ab THEN 'noul cannot abstain' END, CASE WHEN qtype IN ('choice', 'score') AND n < 2 THEN 'fewer than two criteria' END,
  CASE WHEN qtype = 'score' AND kind <> 'ARRAY' THEN 'score needs a list' END, CASE WHEN qtype IN ('choice', 'score') AND n + ab::INT > 26 THEN 'too many slots' END,
  CASE WHEN num AND NOT coalesce(mn < mx, false) THEN 'needs min below max' END, CASE WHEN num AND NOT gr BETWEEN 2 AND 24 THEN 'granularity' END, CASE WHEN num AND anchors + 2 + ab::INT > 26 THEN 'too many anchors' END,
  CASE WHEN s NOT IN ({_STATUSES}) THEN 'bad status' END, CASE WHEN s = 'abstained' AND NOT ab THEN 'abstained without leave' END,
  CASE WHEN s IS NULL AND qtype = 'choice' AND NOT coalesce(list_contains(ks, ej->>'choice'), false) THEN 'choice not in criteria' END, CASE WHEN s IS NULL AND qtype IN ('boolean', 'noul') AND ej->>'boolean' IS NULL THEN 'no boolean' END,
  CASE WHEN s IS NULL AND qtype = 'score' AND NOT coalesce((ej->>'level')::INT >= 0 AND (ej->>'level')::INT < n, false) THEN 'level out of range' END, CASE WHEN s IS NULL AND num AND NOT coalesce((ej->>'value')::DOUBLE BETWEEN mn AND mx, false) THEN 'value out of range' END,
  CASE WHEN norm = '' THEN 'empty state' END, CASE WHEN norm <> '' AND length(norm) < 15 THEN 'state too short' END], lambda x: x IS NOT NULL) AS errors FROM b)
SELECT record_no, array_to_string(errors, '; ') AS errors FROM e"""


@add(_ERRORS)
def sch_07_case_errors(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return c.select("record_no", F.array_join(prepare.case_errors(F.col("q"), F.col("e"), F.col("state"), F.col("id")), "; ").alias("errors"))


@add("SELECT vec_id, round(sum(p) * 1e6) / 1e6 AS total FROM (SELECT vec_id, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, abs(unnest(embedding)::DOUBLE) AS x FROM embeddings)) GROUP BY vec_id")
def sch_14_norm_probs(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.functions.prob import asum, normalise

    e = once(table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("x")), p=normalise(F.col("x")))
    return e.select("vec_id", r6(asum(F.col("p"))).alias("total"))


# ---- adapters ----


@add("""WITH t AS (SELECT id, workflow, unnest(json_keys(questions)) AS k, generate_subscripts(json_keys(questions), 1) - 1 AS i, questions, gold FROM typed_decisions WHERE split = 'train' AND gold IS NOT NULL)
SELECT 'tdc-' || right(id, 8) || '-' || i AS id, 'typeddec/' || workflow AS source, json_extract_string(gold, '$."' || k || '".label') AS label, json_extract_string(questions, '$."' || k || '".type') AS qtype FROM t""")
def src_12_gold_cases(spark: SparkSession, d: str) -> DataFrame:
    g = readers.gold_cases(table(spark, d, "typed_decisions"))
    m = F.from_json("expect", "map<string,string>")
    label = F.coalesce(m["boolean"], m["level"], m["choice"])
    return g.select("id", "source", label.alias("label"), F.get_json_object("question", "$.type").alias("qtype"))


@add("SELECT vec_id AS id, 'o' || arg_min(i, struct_pack(x := -x, i := i)) AS label FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < 5 GROUP BY vec_id")
def src_10_options(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("s").alias("state"), F.lit("Which?").alias("instructions"), F.array(*(F.lit(f"o{i}: option {i}") for i in range(5))).alias("options"), F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("target"))
    return readers.options_case(e).select("id", F.get_json_object("expect", "$.choice").alias("label"))


@add(f"SELECT record_no, license FROM convert_hf WHERE NOT regexp_matches(lower(license), '{'|'.join(prepare.DENIED)}') AND trim(string_split(lower(license), '(')[1]) IN ({_LICENSES}) ORDER BY md5('17:' || record_no), record_no LIMIT 100")
def src_09_licensed_sample(spark: SparkSession, d: str) -> DataFrame:
    return readers.licensed_sample(hf(spark, d), 100, key="record_no").select("record_no", "license")


@add("SELECT split_part(lower(trim(source)), '/', 1) AS family, least(count(*), 50) AS n FROM convert_hf GROUP BY 1")
def src_11_capped(spark: SparkSession, d: str) -> DataFrame:
    c = hf(spark, d).withColumn("family", F.split_part(F.lower(F.trim("source")), F.lit("/"), F.lit(1)))
    return readers.capped(c, ["family"], 50, key="record_no").groupBy("family").agg(F.count("*").alias("n"))


_STATEMENTS = """WITH s AS (SELECT record_no, id, split_part(coalesce(source, 'none'), '/', 1) AS subset, coalesce((expect::JSON)->>'boolean', 'unknown') AS label FROM convert_hf WHERE state IS NOT NULL)
SELECT record_no::VARCHAR AS id, 'trilemma/' || subset AS source, CASE label WHEN 'unknown' THEN '{"status": "abstained"}' ELSE '{"boolean": ' || label || '}' END AS expect FROM (SELECT *, row_number() OVER (PARTITION BY subset, label ORDER BY md5('17:' || record_no), record_no::VARCHAR) AS r FROM s) WHERE r <= 40"""


@add(_STATEMENTS)
def src_13_statements(spark: SparkSession, d: str) -> DataFrame:
    s = hf(spark, d).filter("state is not null").select(F.col("record_no").cast("string").alias("id"), F.split_part(F.coalesce("source", F.lit("none")), F.lit("/"), F.lit(1)).alias("subset"), F.col("state").alias("statement"), F.when(F.get_json_object("expect", "$.boolean").isNotNull(), F.get_json_object("expect", "$.boolean")).otherwise("unknown").alias("label"))
    return readers.statements(s, 40).select("id", "source", "expect")


@add("SELECT c_mktsegment AS name, 'local-' || replace(lower(c_mktsegment), ' ', '-') || '-q4_k_m' AS slug FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def sch_12_model_id(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return c.select("name", readers.model_id(F.col("name"), F.lit("Q4_K_M")).alias("slug"))


@add("SELECT id, split_part(id, '-', 1) AS shard, coalesce(source, CASE split_part(id, '-', 1) WHEN 'tsk' THEN 'tasksource' WHEN 'tdc' THEN 'typeddec' END) AS source FROM convert_hf")
def join_11_shards(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined with the manifest of their shard, which fills what is missing."""
    s = spark.createDataFrame([("tsk", "tasksource"), ("tdc", "typeddec")], "shard_id string, source string")
    return readers.attach_meta(hf(spark, d).select("id", "source"), s).select("id", F.split_part("id", F.lit("-"), F.lit(1)).alias("shard"), "source")


# ---- duplicates and contamination ----


@add("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(p_brand || ' ' || p_type)) AS keep, 0::BIGINT AS links FROM part")
def prp_01_short_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of fewer than five words are near-duplicates only if they are alike."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("text"))
    return prepare.near_duplicates(p, "p_partkey", "text")


_NEAR = f"""WITH RECURSIVE b AS (SELECT record_no AS id, {norm_sql("coalesce(state, '') || ' || ' || CASE WHEN json_valid(question) THEN coalesce(question->>'instructions', '') || coalesce((question::JSON->'criteria')::VARCHAR, '') ELSE '' END")} AS t FROM convert_hf),
f AS (SELECT t, min(id) AS rep FROM b WHERE t <> '' GROUP BY t),
w AS (SELECT rep, t, string_split(t, ' ') AS w FROM f),
g AS (SELECT rep, CASE WHEN len(w) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
x AS (SELECT rep, len(g) AS n, unnest(g) AS g FROM g),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.8::DOUBLE),
r(a, b) AS (SELECT rep, rep FROM f UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a AS rep, min(b) AS keep FROM r GROUP BY a),
l AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY a)
SELECT b.id, coalesce(k.keep, b.id) AS keep, coalesce(l.links, 0) AS links FROM b LEFT JOIN f USING (t) LEFT JOIN k USING (rep) LEFT JOIN l USING (rep)"""


@add(_NEAR)
def prp_01_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Each case with its class of near-duplicates."""
    c = hf(spark, d).select("record_no", prepare.dedup_text(F.col("state"), F.struct(F.get_json_object("question", "$.instructions").alias("instructions"), F.get_json_object("question", "$.criteria").alias("criteria_json"))).alias("text"))
    return prepare.near_duplicates(c, "record_no", "text")


@add()
def prp_03_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Band hashes of the documents' minhash signatures."""
    t = once(spread(table(spark, d, "documents")).filter("text is not null").select("doc_id", norm_text(F.col("text")).alias("t")), sh=shingles(F.col("t"))).filter(F.size("sh") > 0)
    t = once(t, sig=prepare.minhash(F.col("sh")))
    return t.select("doc_id", F.explode(prepare.bands(F.col("sig"))).alias("b")).select("doc_id", "b.band", "b.h")


@add(r"""WITH s AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS a, list_distinct(regexp_extract_all(lower(path), '[a-z]{3,}')) AS b FROM corpus WHERE text IS NOT NULL)
SELECT chunk_id, round(len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, b)))) * 1e6) / 1e6 AS jaccard FROM s""")
def set_05_jaccard(spark: SparkSession, d: str) -> DataFrame:
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    s = table(spark, d, "corpus").filter("text is not null").select("chunk_id", w(F.col("text")).alias("a"), w(F.col("path")).alias("b"))
    return s.select("chunk_id", r6(prepare.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


def _evals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "typed_decisions").filter("split = 'test'").select(F.col("id").alias("eval_id"), "state").dropDuplicates(["eval_id", "state"])


_GRAMS = "CASE WHEN len(string_split({0}, ' ')) < 5 THEN [{0}] ELSE list_distinct(list_transform(range(1, len(string_split({0}, ' ')) - 3), lambda i: array_to_string(string_split({0}, ' ')[i:i + 4], ' '))) END"
_CONTAMINATED = f"""WITH c AS (SELECT * FROM (SELECT doc_id AS id, {norm_sql("coalesce(text, '')")} AS t FROM documents) WHERE length(t) >= 15),
e AS (SELECT * FROM (SELECT DISTINCT id AS eval_id, {norm_sql("coalesce(state, '')")} AS t FROM typed_decisions WHERE split = 'test') WHERE length(t) >= 15),
cg AS (SELECT id, unnest(s) AS g, len(s) AS n FROM (SELECT id, {_GRAMS.format('t')} AS s FROM c WHERE length(t) >= 60)),
eg AS (SELECT eval_id, unnest(s) AS g, len(s) AS m FROM (SELECT eval_id, {_GRAMS.format('t')} AS s FROM e)),
nr AS (SELECT id, eval_id FROM cg JOIN eg USING (g) GROUP BY id, eval_id, n, m HAVING count(*) / (n + m - count(*)) >= 0.5)
SELECT id, eval_id FROM nr UNION SELECT id, eval_id FROM c, e WHERE contains(e.t, c.t) OR (contains(c.t, e.t) AND (length(c.t) < 60 OR length(e.t) >= 30))"""


@add(_CONTAMINATED)
def prp_04_contaminated(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat a held-out state."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("state"))
    return prepare.contaminated(docs, _evals(spark, d))


@add()
def snk_04_verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = hf(spark, d).select(F.col("record_no").alias("id"), "state", "question", "expect")
    return prepare.verdicts(c, _evals(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


# ---- targets ----


@add("SELECT record_no, regexp_replace(id, '~p[0-9]+$', '') AS base FROM convert_hf")
def prp_09_base_id(spark: SparkSession, d: str) -> DataFrame:
    return hf(spark, d).select("record_no", prepare.base_id(F.col("id")).alias("base"))


@add("""WITH c AS (SELECT record_no, soft::JSON AS s, question::JSON->>'type' AS t FROM convert_hf WHERE soft IS NOT NULL AND question IS NOT NULL AND json_valid(soft))
SELECT record_no, round(((s->>'p_yes')::DOUBLE) * 1e6) / 1e6 AS yes FROM c WHERE json_type(s) = 'OBJECT' AND json_exists(s, '$.p_yes') AND NOT json_exists(s, '$.options') AND NOT json_exists(s, '$.levels') AND try_cast(s->>'p_yes' AS DOUBLE) IS NOT NULL""")
def prp_13_p_yes(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    keys = F.from_json("soft", "map<string,string>")
    c = once(c, sm=prepare.soft_map(F.col("q"), F.col("soft")), k=keys).filter("k.p_yes is not null and k.options is null and k.levels is null and sm is not null")
    return c.select("record_no", r6(F.get("sm", F.lit(0))["p"]).alias("yes"))


_TARGETS = f"""WITH {CASES_SQL}, {SLOTS_SQL},
x AS (SELECT record_no, qtype, mn, mx, ej->>'status' AS s, ej->>'choice' AS ch, (ej->>'boolean')::BOOLEAN AS bo, (ej->>'level')::INT AS lv, (ej->>'value')::DOUBLE AS va, c, kind FROM t2),
ns AS (SELECT record_no, max(pos) + 1 AS n, sum((NOT special)::INT) AS reals FROM nt GROUP BY record_no),
ek AS (SELECT record_no, CASE WHEN s = 'abstained' THEN '__abstain__' WHEN qtype = 'numeric' AND va < mn THEN '__below__' WHEN qtype = 'numeric' AND va > mx THEN '__above__' WHEN qtype IN ('boolean', 'noul') THEN CASE WHEN coalesce(bo, va <> 0) THEN 'yes' ELSE 'no' END WHEN qtype = 'choice' THEN ch END AS k FROM x),
si AS (SELECT ek.record_no, coalesce(min(CASE WHEN nt.key = k OR nt.text = k THEN pos END), min(CASE WHEN try_cast(nt.key AS DOUBLE) = try_cast(k AS DOUBLE) OR try_cast(nt.text AS DOUBLE) = try_cast(k AS DOUBLE) THEN pos END)) AS i FROM ek JOIN nt USING (record_no) GROUP BY ek.record_no),
ne AS (SELECT x.record_no, arg_min(pos, struct_pack(d := abs(try_cast(nt.key AS DOUBLE) - va), p := pos)) AS i FROM x JOIN nt USING (record_no) WHERE x.qtype = 'numeric' AND NOT special AND va IS NOT NULL GROUP BY x.record_no),
go AS (SELECT x.record_no, x.qtype, CASE WHEN s = 'abstained' THEN si.i WHEN x.qtype = 'score' THEN CASE WHEN lv >= 0 AND lv < ns.n THEN lv END WHEN x.qtype = 'numeric' AND va BETWEEN mn AND mx THEN ne.i ELSE si.i END AS gold FROM x JOIN ns USING (record_no) LEFT JOIN si USING (record_no) LEFT JOIN ne USING (record_no)),
so AS (SELECT x.record_no, x.qtype, h.soft::JSON AS o, CASE WHEN x.qtype IN ('boolean', 'noul') THEN ['yes', 'no'] WHEN kind = 'OBJECT' THEN json_keys(c) WHEN x.qtype = 'choice' AND kind = 'ARRAY' THEN json_extract_string(c, '$[*]') WHEN kind = 'ARRAY' THEN list_transform(range(json_array_length(c)::BIGINT), lambda i: i::VARCHAR) END AS ks FROM x JOIN convert_hf h USING (record_no) WHERE json_valid(h.soft) AND json_type(CASE WHEN json_valid(h.soft) THEN h.soft END) = 'OBJECT'),
sf AS (SELECT *, nullif(o->'options', 'null'::JSON) AS so_, nullif(o->'levels', 'null'::JSON) AS sl_, nullif(o->'p_yes', 'null'::JSON) AS sp, nullif(o->'distribution', 'null'::JSON) AS sd FROM so),
wh AS (SELECT record_no, qtype, ks, CASE WHEN so_ IS NOT NULL THEN so_ WHEN sl_ IS NOT NULL THEN sl_ WHEN sp IS NOT NULL THEN sp WHEN sd IS NOT NULL THEN sd ELSE o END AS v, CASE WHEN so_ IS NOT NULL OR sl_ IS NOT NULL THEN 'list' WHEN sp IS NOT NULL THEN 'yes' WHEN sd IS NOT NULL THEN CASE json_type(sd) WHEN 'OBJECT' THEN 'map' WHEN 'ARRAY' THEN 'list' ELSE CASE WHEN qtype IN ('boolean', 'noul') THEN 'yes' END END ELSE 'map' END AS how FROM sf),
d0 AS (SELECT record_no, qtype, unnest(ks) AS k, unnest(json_extract_string(v, '$[*]')) AS p FROM wh WHERE how = 'list' AND json_type(v) = 'ARRAY' AND json_array_length(v) = len(ks)
  UNION ALL SELECT record_no, qtype, unnest(['yes', 'no']), unnest([v->>'$', CASE WHEN try_cast(v->>'$' AS DOUBLE) IS NOT NULL THEN (1 - try_cast(v->>'$' AS DOUBLE))::VARCHAR END]) FROM wh WHERE how = 'yes'
  UNION ALL SELECT record_no, qtype, k, json_extract_string(v, '$."' || k || '"') FROM (SELECT record_no, qtype, v, unnest(json_keys(v)) AS k FROM wh WHERE how = 'map')),
d1 AS (SELECT record_no, qtype, CASE WHEN qtype IN ('boolean', 'noul') AND lower(k) = 'true' THEN 'yes' WHEN qtype IN ('boolean', 'noul') AND lower(k) = 'false' THEN 'no' ELSE k END AS k, try_cast(p AS DOUBLE) AS p, bool_and(try_cast(p AS DOUBLE) IS NOT NULL) OVER (PARTITION BY record_no) AS good FROM d0),
us AS (SELECT record_no, max(p) < 0.99::DOUBLE AS use_, sum(p) AS all_ FROM d1 WHERE good GROUP BY record_no),
ix AS (SELECT d.record_no, d.k, d.p, coalesce(min(CASE WHEN nt.key = d.k OR nt.text = d.k THEN pos END), min(CASE WHEN try_cast(nt.key AS DOUBLE) = try_cast(d.k AS DOUBLE) OR try_cast(nt.text AS DOUBLE) = try_cast(d.k AS DOUBLE) THEN pos END)) AS i FROM d1 d JOIN nt USING (record_no) WHERE good GROUP BY d.record_no, d.k, d.p),
vv AS (SELECT nt.record_no, nt.pos, nt.special, coalesce((SELECT sum(p) FROM ix WHERE ix.record_no = nt.record_no AND ix.i = nt.pos), 0) AS v FROM nt),
v2 AS (SELECT vv.*, gold, go.qtype, coalesce(use_, false) AS use_, all_, sum(v) OVER (PARTITION BY vv.record_no) AS t, reals FROM vv JOIN go USING (record_no) JOIN ns USING (record_no) LEFT JOIN us USING (record_no)),
v3 AS (SELECT *, CASE WHEN t > 0 THEN v / t ELSE v END AS nn, CASE WHEN use_ THEN all_ - t ELSE 0 END AS un, max(CASE WHEN pos = gold THEN special END) OVER w AS gs, max(CASE WHEN pos = gold - 1 THEN NOT special END) OVER w AS before, max(CASE WHEN pos = gold + 1 THEN NOT special END) OVER w AS behind FROM v2 WINDOW w AS (PARTITION BY record_no)),
v4 AS (SELECT *, nn + CASE WHEN un > 0.05 AND pos = gold THEN un ELSE 0 END AS f, coalesce(before, false)::INT + coalesce(behind, false)::INT AS nb FROM v3),
v5 AS (SELECT *, sum(f) OVER (PARTITION BY record_no) AS fs FROM v4)
SELECT record_no, pos::INT AS pos, gold::INT AS gold, CASE WHEN use_ THEN 'soft' WHEN gold IS NOT NULL THEN 'gold' END AS target_source, round(un::DOUBLE * 1e6) / 1e6 AS unmatched, round((CASE
  WHEN use_ THEN CASE WHEN un > 0.05 AND fs > 0 THEN f / fs ELSE f END WHEN gold IS NULL THEN NULL
  WHEN gs THEN CASE WHEN pos = gold THEN 0.9 WHEN NOT special THEN 0.1 / reals ELSE 0 END
  WHEN qtype IN ('score', 'numeric') THEN CASE WHEN pos = gold THEN CASE WHEN nb > 0 THEN 1 - 0.05 * nb ELSE 1 END WHEN abs(pos - gold) = 1 AND NOT special THEN 0.05 ELSE 0 END
  ELSE CASE WHEN pos = gold THEN 0.9 WHEN NOT special THEN 0.1 / (reals - 1) ELSE 0 END END)::DOUBLE * 1e6) / 1e6 AS p FROM v5"""


@add(_TARGETS)
def prp_20_targets(spark: SparkSession, d: str) -> DataFrame:
    """The target of every slot of every case: votes of people where there are any, else the smoothed verified label."""
    c = prepare.with_target(cases(spark, d))
    each = c.select("record_no", "gold", "target_source", "unmatched", "target", F.explode(F.transform("slots", lambda s: s["pos"])).alias("pos"))
    return each.select("record_no", "pos", "gold", "target_source", r6(F.col("unmatched")).alias("unmatched"), r6(F.get("target", F.col("pos"))).alias("p"))


@add(f"""WITH {CASES_SQL}, g AS (SELECT record_no, qtype, c, ej->>'choice' AS ch, (ej->>'boolean')::BOOLEAN AS bo, (ej->>'level')::INT AS lv, ej->>'status' AS s FROM t2 WHERE qtype IN ('boolean', 'noul', 'choice', 'score') AND NOT ab),
h AS (SELECT sl.record_no, sl.qtype, sl.pos, max(sl.pos) OVER (PARTITION BY sl.record_no) AS top, CASE WHEN g.qtype IN ('boolean', 'noul') THEN CASE WHEN bo THEN 0 ELSE 1 END WHEN g.qtype = 'score' THEN lv ELSE (SELECT min(pos) FROM sl x WHERE x.record_no = g.record_no AND (x.key = ch OR x.text = ch)) END AS gi FROM sl JOIN g USING (record_no) WHERE s IS NULL)
SELECT record_no, pos::INT AS pos, round((CASE WHEN qtype = 'score' THEN CASE WHEN pos = gi THEN 0.9 + 0.05 * ((gi = 0)::INT + (gi = top)::INT) WHEN abs(pos - gi) = 1 THEN 0.05 ELSE 0 END ELSE CASE WHEN pos = gi THEN 0.9 ELSE 0.1 / top END END)::DOUBLE * 1e6) / 1e6 AS p FROM h WHERE gi IS NOT NULL""")
def prp_19_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed verified labels of the cases without abstention."""
    c = once(cases(spark, d).filter("q.qtype <> 'numeric' and not q.allow_abstain and e.status is null"), g=prepare.gold_index(F.col("q"), F.col("e"), F.col("slots"))).filter("g is not null")
    t = prepare.smoothed_gold(F.col("slots"), F.col("g"), F.col("q.qtype"))
    return c.select("record_no", F.posexplode(t).alias("pos", "p")).withColumn("p", r6(F.col("p")))


@add("WITH h AS (SELECT record_no, sha1(regexp_replace(id, '~p[0-9]+$', '')) AS h, question FROM convert_hf) SELECT record_no, list_reduce(list_transform(range(1, 41), lambda i: ('0x' || substr(h, i, 1))::BIGINT), lambda s, x: (s * 16 + x) % 10000) < 3000 AS chosen FROM h WHERE h IS NOT NULL")
def prp_23_question_first(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return hf(spark, d).filter("id is not null").select("record_no", prepare.wants_question_first(F.col("id"), 0.3, none).alias("chosen"))


@add("""WITH c AS (SELECT record_no AS id, CASE json_type(q->'criteria') WHEN 'OBJECT' THEN json_keys(q->'criteria') ELSE json_extract_string(q, '$.criteria[*]') END AS o FROM (SELECT record_no, question::JSON AS q FROM convert_hf WHERE json_valid(question)) WHERE q->>'type' = 'choice'),
e AS (SELECT id, copy, unnest(o) AS x, generate_subscripts(o, 1) - 1 AS i FROM c, generate_series(1, 3) s(copy) WHERE len(o) > 1),
p AS (SELECT id, copy, string_agg(x, '|' ORDER BY md5('17:' || id || ':' || copy || ':' || i), x) AS options FROM e GROUP BY id, copy)
SELECT id, options, count(*) > 0 AS kept FROM p GROUP BY id, options""")
def prp_21_permuted(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).filter("q.qtype = 'choice'").select(F.col("record_no").alias("id"), F.transform("q.criteria", lambda x: F.coalesce(x["key"], x["text"])).alias("options"))
    return prepare.permuted(c, 3).select("id", F.array_join("options", "|").alias("options"), F.lit(True).alias("kept"))


@add("""WITH v AS (SELECT doc_id AS case_id, greatest(abusive, hateful, sexual) AS y FROM review_labels)
SELECT case_id, count(*) AS voices, min(y) = max(y) AS agree, CASE WHEN avg(y) >= 0.5 THEN 'yes' ELSE 'no' END AS label FROM v WHERE y IS NOT NULL AND case_id IS NOT NULL GROUP BY case_id""")
def prp_25_labels(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers of a document as voices, averaged."""
    y = F.greatest("abusive", "hateful", "sexual")
    v = table(spark, d, "review_labels").filter(y.isNotNull()).select(F.col("doc_id").alias("case_id"), F.col("reviewer").alias("voice"), F.array(F.struct(F.lit("yes").alias("key"), y.cast("double").alias("p")), F.struct(F.lit("no").alias("key"), (1.0 - y).alias("p"))).alias("dist"))
    return prepare.label_cases(v).select("case_id", "voices", "agree", "label")


# ---- splits ----


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).filter("state is not null")
    return c.select("record_no", prepare.group_key(F.col("id"), F.lit(None).cast("string"), F.col("state")).alias("group_key"), prepare.stratum(F.col("source"), F.col("q.qtype"), F.lit(None).cast("string"), F.col("q.allow_abstain")).alias("stratum"))


@add("WITH t AS (SELECT source, question::JSON AS q FROM convert_hf WHERE state IS NOT NULL AND question IS NOT NULL AND json_valid(question)) SELECT CASE WHEN contains(coalesce(source, 'gen'), '/') THEN split_part(source, '/', 1) WHEN coalesce(source, 'gen') = 'gen' THEN 'gen' ELSE split_part(source, '-', 1) END || '|' || (q->>'type') || '|en|' || coalesce((q->>'allow_abstain')::BOOLEAN, false) AS stratum, count(*) AS n FROM t GROUP BY 1")
def prp_07_strata(spark: SparkSession, d: str) -> DataFrame:
    return _split_rows(spark, d).groupBy("stratum").agg(F.count("*").alias("n"))


def _split_steps() -> str:
    """SQL of the folds: strata by size, dev and then holdout of each, groups in the order of a digest."""
    out = ["""WITH rw AS (SELECT 'state:' || sha256(state) AS group_key, question::JSON->>'type' AS stratum FROM convert_hf WHERE state IS NOT NULL AND json_valid(question)),
g AS (SELECT group_key, stratum, count(*) AS n FROM rw GROUP BY ALL),
sr AS (SELECT stratum, greatest(1, floor(0.05 * sum(n) + 0.5)) AS quota, row_number() OVER (ORDER BY sum(n), stratum) AS k FROM g GROUP BY stratum HAVING sum(n) >= 10),
a0 AS (SELECT group_key, '' AS fold FROM g WHERE false)"""]
    for i in range(10):
        fold = ("dev", "holdout")[i % 2]
        out.append(f"""m{i} AS (SELECT g.*, quota FROM g JOIN sr USING (stratum) WHERE k = {i // 2 + 1}),
f{i} AS (SELECT group_key, quota, coalesce(sum(n) OVER (ORDER BY md5(group_key || ':17:{fold}'), group_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m{i} WHERE group_key NOT IN (SELECT group_key FROM a{i})),
a{i + 1} AS (SELECT * FROM a{i} UNION ALL SELECT group_key, '{fold}' FROM f{i} WHERE before < quota - (SELECT coalesce(sum(n), 0) FROM m{i} WHERE group_key IN (SELECT group_key FROM a{i} WHERE fold = '{fold}')))""")
    out.append("sp AS (SELECT b.group_key, coalesce(fold, 'train') AS fold FROM (SELECT DISTINCT group_key FROM g) b LEFT JOIN a10 USING (group_key))")
    return ",\n".join(out)


@add(f"{_split_steps()} SELECT * FROM sp")
def prp_06_splits(spark: SparkSession, d: str) -> DataFrame:
    """Stratified splits over the type strata, whole states at a time."""
    rows = _split_rows(spark, d).withColumn("stratum", F.split_part("stratum", F.lit("|"), F.lit(2)))
    return prepare.stratified_splits(rows)


@add(f"{_split_steps()} SELECT sum((fold = 'train')::INT)::BIGINT AS train, sum((fold = 'dev')::INT)::BIGINT AS dev, sum((fold = 'holdout')::INT)::BIGINT AS holdout, count(*) AS rows, 0::BIGINT AS torn_groups FROM rw JOIN sp USING (group_key)")
def prp_12_preflight(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(_split_rows(spark, d).withColumn("stratum", F.split_part("stratum", F.lit("|"), F.lit(2))), "rows")
    s = prepare.stratified_splits(rows)
    return prepare.preflight(rows.select("group_key").join(s, "group_key"))


@add("SELECT source, record_no FROM (SELECT source, record_no, row_number() OVER (PARTITION BY source ORDER BY record_no) AS r FROM convert_hf) WHERE r <= 3")
def win_10_cap(spark: SparkSession, d: str) -> DataFrame:
    return prepare.cap_per_source(hf(spark, d), 3).select("source", "record_no")


@add("SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) ORDER BY r, l_returnflag LIMIT 100")
def win_11_round_robin(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return prepare.round_robin(li, "l_returnflag", 100, "k").drop("k")


@add("SELECT doc_id, floor((row_number() OVER (ORDER BY coalesce(length(text), 0), doc_id) - 1) / 32)::BIGINT AS batch FROM documents")
def srt_08_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of texts of similar length."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    return prepare.length_batches(t, 32, "n", "doc_id").select("doc_id", "batch")


@add(f"WITH {CASES_SQL} SELECT DISTINCT c.id, CASE WHEN t2.state IS NULL THEN 'noprompt' ELSE 'kept' END AS verdict FROM convert_hf c JOIN t2 USING (record_no) WHERE coalesce(c.id, '') NOT IN (SELECT coalesce(id, '-') FROM convert_hf WHERE record_no % 5 = 0) AND NOT starts_with(coalesce(c.source, ''), 'gen')")
def anti_02_drop_list(spark: SparkSession, d: str) -> DataFrame:
    """Rows to export without dropped ids and sources; a case without a state has no prompt."""
    c = cases(spark, d)
    drop = c.filter("record_no % 5 = 0").select("id")
    prompts = c.filter("state is not null").select("id", F.col("state").alias("prompt")).dropDuplicates(["id"])
    return prepare.export_rows(c, prompts, drop, ("gen",)).select("id", F.when(F.col("verdict") == "noprompt", "noprompt").otherwise("kept").alias("verdict")).distinct()


@add("SELECT p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)) * 1e2) / 1e2 AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_04_brand_revenue(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = li.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), (F.round(F.sum("r") * 1e2) / 1e2).alias("revenue"))


@add("SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang))")
def grp_01_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.groupBy(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))


# ---- streams ----


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("late", '{"type": "boolean", "instructions": "Is it late?"}'), ("kind", '{"type": "choice", "instructions": "Which kind?", "criteria": {"a": "first", "b": "second"}}')], "q_name string, question string")


def stm_decide(states: DataFrame, questions: DataFrame) -> DataFrame:
    a = stream.decide_stream(states, questions, HashLogits())
    return a.select("event_id", "q_name", "answer.status", "answer.choice", "answer.confidence")


@add("""WITH l AS (SELECT event_id, q.q_name, q.letter, q.pos, q.key, (('0x' || substr(md5(q.head || chr(10) || 'STATE' || chr(10) || props || chr(10) || chr(10) || 'Reply with one letter only.' || chr(0) || q.letter), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * 8 - 4) AS l FROM events, (SELECT q_name, letter, pos, key, 'QUESTION' || chr(10) || ask || chr(10) || chr(10) || 'OPTIONS' || chr(10) || opts || chr(10) AS head FROM (VALUES
  ('late', 'A', 0, 'yes', 'Is it late?' || chr(10) || 'Answer yes or no.', 'A) Yes' || chr(10) || 'B) No'), ('late', 'B', 1, 'no', 'Is it late?' || chr(10) || 'Answer yes or no.', 'A) Yes' || chr(10) || 'B) No'),
  ('kind', 'A', 0, 'a', 'Which kind?', 'A) first' || chr(10) || 'B) second'), ('kind', 'B', 1, 'b', 'Which kind?', 'A) first' || chr(10) || 'B) second')) v(q_name, letter, pos, key, ask, opts)) q WHERE props IS NOT NULL),
p AS (SELECT event_id, q_name, max(CASE WHEN pos = 0 THEN l END) AS a, max(CASE WHEN pos = 1 THEN l END) AS b FROM l GROUP BY ALL),
s AS (SELECT *, 1 / (1 + exp(b - a)) AS pa FROM p)
SELECT event_id, q_name, CASE WHEN abs(2 * pa - 1) < 0.15::DOUBLE THEN 'contested' ELSE 'decided' END AS status, CASE WHEN q_name = 'late' THEN CASE WHEN pa >= 0.5 THEN 'yes' ELSE 'no' END ELSE CASE WHEN pa > 0.5 THEN 'a' ELSE 'b' END END AS choice, round(greatest(0, 2 * greatest(pa, 1 - pa) - 1) * 1e4) / 1e4 AS confidence FROM s""")
def stm_01_states(spark: SparkSession, d: str) -> DataFrame:
    """Events as states against two fixed questions: the same plan serves a stream."""
    return stm_decide(table(spark, d, "events").filter("props is not null").select("event_id", F.col("props").alias("state")), _questions(spark))


def _streamed(df: DataFrame, parts: int = 4) -> DataFrame:
    """df's rows as a stream of files; one file keeps the order of time, which files written side by side don't."""
    spark = df.sparkSession
    at = files_place(spark, "stream-in")
    df.repartitionByRange(parts, df.columns[0]).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all its input is there; in update mode the last of each row."""
    spark = df.sparkSession
    out, check = files_place(spark, "stream-out"), files_place(spark, "stream-state")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def files_place(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


@add(R.sql["stm_01_states"])
def stm_01_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream, micro-batch by micro-batch."""
    e = table(spark, d, "events").filter("props is not null").select("event_id", F.col("props").alias("state"))
    return _drained(stm_decide(_streamed(e), _questions(spark)))


@add("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) * 1e6) / 1e6 AS accuracy, round(avg(value) * 1e6) / 1e6 AS confidence FROM events WHERE ts < (SELECT time_bucket(INTERVAL '1 hour', max(ts) - INTERVAL '1 day') FROM events) GROUP BY 1")
def stm_05_stream(spark: SparkSession, d: str) -> DataFrame:
    """The quality monitor on a stream: the hours that the watermark has closed."""
    e = table(spark, d, "events").select("ts", F.lit("decided").alias("status"), F.col("value").alias("confidence"), (F.col("event_type") == "click").alias("ok"))
    got = _drained(stream.quality_monitor(_streamed(e.withColumn("ts", F.col("ts").cast("timestamp")), 1)))
    return got.select(F.col("window.start").alias("start"), "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("confidence")).alias("confidence"))


@add("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) * 1e6) / 1e6 AS accuracy, round(avg(value) * 1e6) / 1e6 AS confidence FROM events GROUP BY 1")
def stm_05_quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("ts", F.lit("decided").alias("status"), F.col("value").alias("confidence"), (F.col("event_type") == "click").alias("ok"))
    return stream.quality_monitor(e).select(F.col("window.start").alias("start"), "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("confidence")).alias("confidence"))


@add("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(avg(value) * 1e6) / 1e6 AS mean_value FROM s GROUP BY user_id, k""")
def stm_05_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stream.session_monitor(table(spark, d, "events")).select("user_id", F.col("session_window.start").alias("start"), "n", r6(F.col("mean_value")).alias("mean_value"))


@add(_TARGETS.split("\nSELECT record_no, pos::INT")[0] + """,
tg AS (SELECT record_no, CASE WHEN bool_or(use_) THEN 'soft' WHEN max(gold) IS NOT NULL THEN 'gold' END AS target_source FROM v5 GROUP BY record_no),
kp AS (SELECT tg.*, row_number() OVER (PARTITION BY h.source ORDER BY h.id, tg.record_no) AS r FROM tg JOIN convert_hf h USING (record_no) WHERE h.id IS NOT NULL AND h.state IS NOT NULL AND h.id NOT IN (SELECT id FROM convert_hf WHERE split = 'holdout' AND id IS NOT NULL) AND NOT starts_with(coalesce(h.source, ''), 'gen/'))
SELECT CASE WHEN target_source IS NULL THEN 'nogold' ELSE 'ok' END AS verdict, target_source, count(*) AS n FROM kp WHERE r <= 200 GROUP BY ALL""")
def prp_24_export(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with prompts and targets: the drop list is the held-out split, sources are capped."""
    from verdigris.operators.questions import user_message

    c = cases(spark, d).filter("id is not null and state is not null")
    prompts = c.select("id", user_message(F.col("state"), F.col("q"), F.col("slots"), F.lit("state_first"), F.array().cast("array<string>")).alias("prompt")).dropDuplicates(["id"])
    drop = hf(spark, d).filter("split = 'holdout' and id is not null").select("id")
    return prepare.export_rows(c, prompts, drop, ("gen/",), 200).groupBy("verdict", "target_source").agg(F.count("*").alias("n"))
