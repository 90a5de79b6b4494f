"""Queries of readers and sinks: tables are written to the shared folder in a reader's format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import calibrate, questions, search
from verdigris.operators.chunks import readable_text
from verdigris.operators.logits import HashLogits, memoised
from verdigris.plans.common import Registry
from verdigris.session import session_dir, stored, table
from verdigris.sources import readers, sinks

R = Registry()
add = R.add


def place(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


@add("SELECT id, md5(state) AS state, md5(question) AS question, md5(expect) AS expect, source, license FROM convert_hf")
def src_01_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases as JSON lines between comments and blank lines."""
    at = place(spark, "cases")
    lines = table(spark, d, "convert_hf").select(F.to_json(F.struct("id", "state", "question", "expect", "source", "license")).alias("value"))
    lines.union(spark.createDataFrame([("# a note",), ("  ",)], "value string")).write.text(at)
    c = readers.load_cases(spark, at)
    return c.select("id", *(F.md5(k).alias(k) for k in ("state", "question", "expect")), "source", "license")


@add("SELECT event_id, event_type, value FROM events")
def src_02_jsonl(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark, "events")
    table(spark, d, "events").select("event_id", "event_type", "value", F.lit(1).alias("unknown")).write.json(at)
    return readers.load_jsonl(spark, at, "event_id long, event_type string, value double")


@add("SELECT md5(state) AS state, len(json_keys(questions))::INT AS questions, CASE WHEN split = 'test' THEN 0.7 ELSE 1.0 END::DOUBLE AS temperature, 'shared' AS mode, CASE WHEN split = 'test' THEN 'state_first' ELSE 'auto' END AS layout, 'probes' AS expand FROM typed_decisions")
def src_03_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests with and without their optional fields."""
    t = table(spark, d, "typed_decisions")
    test = F.col("split") == "test"
    lines = t.select(F.to_json(F.struct("state", "questions", F.when(test, 0.7).alias("temperature"), F.when(test, "state_first").alias("layout"), F.lit("x").alias("model"))).alias("value"))
    r = readers.requests(lines)
    return r.select(F.md5("state").alias("state"), F.size(F.map_keys(F.from_json("questions", "map<string,string>"))).alias("questions"), "temperature", "mode", "layout", "expand")


@add("""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END) AS text FROM t WHERE strlen(text) <= 1048576 AND NOT contains(left(text, 8192), chr(0)) AND coalesce(list_sum(list_transform(l, lambda x: strlen(x))), 0) <= 1000 * len(l)""")
def src_06_texts(spark: SparkSession, d: str) -> DataFrame:
    """Files' bytes to texts: binary, minified and too large ones are left out."""
    f = table(spark, d, "documents").filter("text is not null").select("doc_id", readable_text(F.encode("text", "UTF-8")).alias("text"))
    return f.filter("text is not null").select("doc_id", F.md5("text").alias("text"))


@add("SELECT o_orderkey, o_totalprice FROM orders")
def src_08_columns(spark: SparkSession, d: str) -> DataFrame:
    return readers.fetch_columns(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


@add("SELECT id, md5(CASE WHEN regexp_matches(state, '^[\\[{]') AND regexp_matches(state, '[\\]}]$') THEN state END) AS json FROM typed_decisions")
def src_14_embedded(spark: SparkSession, d: str) -> DataFrame:
    """States as the argument of a callback in a script."""
    t = table(spark, d, "typed_decisions").select("id", F.concat(F.lit("var x = 1;\nload ("), "state", F.lit(") ;\n")).alias("js"))
    return t.select("id", F.md5(readers.embedded_json(F.col("js"), "load")).alias("json"))


@add("SELECT CASE record_no % 5 WHEN 0 THEN 'bench' WHEN 1 THEN 'calibration' WHEN 2 THEN 'evaluation' WHEN 3 THEN 'answers' ELSE 'other' END AS kind, count(*) AS n FROM convert_hf GROUP BY 1")
def src_15_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What reports are, by their shape."""
    no = F.col("record_no") % 5
    raw = F.when(no == 0, '[{"scenario": "a"}]').when(no == 1, '{"temperatures": {"choice": 1.5}}').when(no == 2, '{"cases": 3, "accuracy": 0.5}').when(no == 3, '{"cases": [1]}').otherwise(F.to_json(F.struct("id")))
    return table(spark, d, "convert_hf").select(readers.report_kind(raw).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def _temperatures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A stand-in for fitted temperatures, by segment, and the figures that go with them."""
    t = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("bucket")).agg((F.count("*") / 1000).alias("temperature"))
    f = spark.createDataFrame([(0.2, 0.1, 0.15, 0.1, 0.3, 0.05, 0.2, False, 7)], "ece_raw double, ece_in_sample double, ece_out_of_fold double, raw_lo double, raw_hi double, oof_lo double, oof_hi double, separated boolean, fitted long")
    return t, f


@add("SELECT 'm' AS model, 'v1' AS prompt_version, c_mktsegment AS bucket, round(count(*) / 1000.0 * 1e4) / 1e4 AS temperature, 0.2::DOUBLE AS ece_raw, 0.15::DOUBLE AS ece_out_of_fold FROM customer GROUP BY c_mktsegment")
def src_17_calibration(spark: SparkSession, d: str) -> DataFrame:
    """A calibration document, written and read back for the model it belongs to."""
    at = place(spark, "calibration")
    sinks.write_document(calibrate.document(*_temperatures(spark, d), "m", "v1"), at)
    return readers.bound(readers.load_calibration(spark, at), "m", "v1")


@add("""SELECT workflow, id AS case_id, q AS question, json_extract_string(gold, '$."' || q || '".label') AS label FROM (SELECT workflow, id, gold::JSON AS gold, unnest(json_keys(gold)) AS q FROM typed_decisions WHERE gold IS NOT NULL)""")
def src_19_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers nested by workflow and case, with metadata among them."""
    t = table(spark, d, "typed_decisions").filter("gold is not null")
    m = F.create_map(F.col("workflow"), F.create_map(F.col("id"), F.from_json("gold", "map<string,string>"), F.lit("_note"), F.create_map(F.lit("a"), F.lit("b"))))
    a = readers.nested_answers(t.select(F.to_json(m).alias("value")))
    return a.select("workflow", "case_id", "question", F.get_json_object("answer", "$.label").alias("label"))


@add("SELECT l_orderkey AS case_id, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), chr(10) || chr(10)) AS state, array_to_string(list_transform(list_sort(list_distinct(list(l_linenumber))), lambda n: 'q' || n), ',') AS questions FROM lineitem GROUP BY l_orderkey")
def src_20_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Documents and questions of cases, put together from their parts."""
    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("node"), F.concat("l_returnflag", "l_linestatus").alias("doc"), F.col("l_linenumber").alias("question_no"))
    catalog = nodes.select("question_no").distinct().select("question_no", F.concat(F.lit("q"), F.col("question_no").cast("string")).alias("qid"), F.lit("{}").alias("question"))
    return readers.assemble_cases(nodes, catalog).select("case_id", "state", F.array_join("questions", ",").alias("questions"))


@add("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS refused FROM orders")
def snk_01_created(spark: SparkSession, d: str) -> DataFrame:
    """A table is created once; a second time is refused and changes nothing."""
    at, o = place(spark, "orders"), table(spark, d, "orders").select("o_orderkey")
    sinks.create_only(o, at)
    refused = False
    try:
        sinks.create_only(o.limit(1), at)
    except Exception as e:  # the format's own exception
        refused = "already exists" in str(e).lower()
    return spark.read.parquet(at).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("refused", F.lit(refused))


_TEST = "(SELECT DISTINCT id, questions FROM (SELECT id, questions, row_number() OVER (PARTITION BY id ORDER BY revised_at DESC, state) AS r FROM typed_decisions WHERE split = 'test' AND state IS NOT NULL) WHERE r = 1)"


@add(f"SELECT sum(len(json_keys(questions)))::BIGINT AS exported, 0::BIGINT AS skipped, sum(len(json_keys(questions)))::BIGINT AS lines FROM {_TEST}")
def snk_03_exported(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of all requests as JSON lines."""
    from verdigris.plans.decide import _requests

    at = place(spark, "prompts")
    units = questions.compile_units(_requests(spark, d)).withColumn("req_id", F.concat_ws(":", "req_id", F.col("q_pos").cast("string")))
    counts = sinks.export_prompts(units, at)
    return counts.crossJoin(spark.read.json(at).filter("prompt is not null and size(slots) > 1").agg(F.count("*").alias("lines")))


@add("""WITH k AS (SELECT DISTINCT md5(coalesce(text, '')) AS key, 'b' || (ascii(md5(coalesce(text, ''))) % 3) AS binding FROM documents), c AS (SELECT DISTINCT md5(coalesce(text, '')) AS key FROM documents WHERE doc_id % 3 = 0)
SELECT binding, count(*) AS n FROM k JOIN c USING (key) GROUP BY binding""")
def snk_06_compacted(spark: SparkSession, d: str) -> DataFrame:
    """A store appended to twice, then rewritten with what is still in use."""
    at, to = place(spark, "store"), place(spark, "compacted")
    k = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    rows = k.select("key", F.concat(F.lit("b"), (F.ascii("key") % 3).cast("string")).alias("binding"), F.lit(1).alias("v"))
    sinks.append_store(rows.filter("ascii(right(key, 1)) % 2 = 0"), None, at)
    sinks.append_store(rows, spark.read.parquet(at), at)
    sinks.compact_store(spark.read.parquet(at), k.filter("doc_id % 3 = 0"), to)
    return spark.read.parquet(to).groupBy("binding").agg(F.count("*").alias("n"))


@add("SELECT doc AS query_id, doc AS rank, path || ':' || s || '-' || e || '  ' || sym || '  0.50' AS head FROM (SELECT chunk_id AS doc, path, start_line AS s, end_line AS e, coalesce(symbol, '') AS sym FROM corpus WHERE text IS NOT NULL)")
def snk_08_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Header lines of hits as plain text."""
    c = table(spark, d, "corpus").filter("text is not null").select(F.col("chunk_id").alias("doc"), "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "symbol", F.col("text").alias("body"))
    shown = c.select(F.col("doc").alias("query_id"), "doc", F.col("doc").alias("rank"), F.lit(0.5).alias("p"))
    return search.render_hits(shown, c).select("query_id", "rank", F.substring_index("text", "\n", 1).alias("head"))


@add("""SELECT record_no AS req_id, CASE record_no % 4 WHEN 0 THEN 'catalog' ELSE 'auto' END AS layout, CASE record_no % 3 WHEN 0 THEN 'pages' ELSE 'probes' END AS expand, CASE (question::JSON)->>'allow_abstain' WHEN 'true' THEN 'false' ELSE (question::JSON)->>'allow_abstain' END AS abstain
FROM convert_hf WHERE json_valid(question)""")
def sch_08_requests(spark: SparkSession, d: str) -> DataFrame:
    """Cases as requests with their pins, without the option to abstain."""
    c = table(spark, d, "convert_hf").filter("question is not null and get_json_object(question, '$.type') is not null")
    c = c.select(F.col("record_no").alias("case_id"), "state", "question", F.when(F.col("record_no") % 4 == 0, "catalog").alias("layout"), F.when(F.col("record_no") % 3 == 0, "pages").alias("expand"))
    r = questions.case_request(c, no_abstain=True)
    return r.select("req_id", "layout", "expand", F.get_json_object("question", "$.allow_abstain").alias("abstain"))


@add("SELECT chunk_id, path AS name FROM corpus")
def prm_32_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of units without the tag of their part."""
    return table(spark, d, "corpus").select("chunk_id", questions.display_name(F.concat("path", F.lit("\u001f"), F.col("chunk_id").cast("string"))).alias("name"))


@add("""WITH k AS (SELECT DISTINCT state FROM convert_hf WHERE state IS NOT NULL AND record_no % 3 = 0)
SELECT count(*) AS rows, 0::BIGINT AS wrong, (SELECT count(DISTINCT state) FROM convert_hf WHERE state IS NOT NULL AND state NOT IN (SELECT state FROM k)) AS fresh FROM convert_hf WHERE state IS NOT NULL""")
def join_15_memo(spark: SparkSession, d: str) -> DataFrame:
    """Scores that a memo holds are taken from it, the others are scored and come out as new; all are what scoring gives."""
    units = table(spark, d, "convert_hf").filter("state is not null").select("record_no", F.col("state").alias("prompt"), F.array(*(F.struct(F.lit(x).alias("letter")) for x in "AB")).alias("slots"))
    source = HashLogits()
    memo = source.attach(units.filter("record_no % 3 = 0")).select(F.sha2("prompt", 256).alias("key"), "logits").dropDuplicates(["key"])
    rows, fresh = memoised(source, units, stored(memo, "memo"))
    direct = source.attach(units).select("record_no", F.col("logits").alias("want"))
    got = rows.join(direct, "record_no").agg(F.count("*").alias("rows"), F.sum((~F.col("logits").eqNullSafe(F.col("want"))).cast("long")).alias("wrong"))
    return got.crossJoin(fresh.agg(F.count("*").alias("fresh")))
