"""Queries of problem 6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import drift
from verdigris.session import table


def p6_method(spark: SparkSession, d: str) -> DataFrame:
    """The changes by similarity flooding over whole schemas."""
    return drift.flooded_report(table(spark, d, "convert_hf_raw"))


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "convert_hf_raw"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_changes(spark, d).select("file_name", "change_kind", "old_field", "new_field")


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "convert_hf_raw"))


def _shares(labels: str) -> Column:
    """A distribution as text: label=share in millionths."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e6).cast("long").cast("string"))), ",")


def p6_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the table that don't depend on the feed's vocabulary of soft, its distribution as text."""
    plain = [k for k in drift.COLUMNS if k not in ("soft", "tags", "reviewed")]
    return p6_table(spark, d).select("raw_no", "readable", *plain, F.array_join("tags", "|").alias("tags"), F.col("reviewed").cast("string").alias("reviewed"), _shares("soft_labels").alias("labels"))


def p6_soft(spark: SparkSession, d: str) -> DataFrame:
    """The label distributions of convert_hf in one shape."""
    got = drift.soft_column(table(spark, d, "convert_hf")).filter(F.col("soft_labels").isNotNull())
    return got.select("record_no", _shares("soft_labels").alias("labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_method, p6_found, p6_changes, p6_table, p6_columns, p6_soft)}


_TYPE = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END"

P6_SQL = f"""
WITH ln AS (SELECT feed, file_name, payload::JSON AS p FROM convert_hf_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
top AS (SELECT feed, file_name, unnest(json_keys(p)) AS k, p FROM ln),
v1 AS (SELECT feed, file_name, k AS field, 'top' AS level, json_extract(p, '$."' || k || '"') AS v FROM top),
sub AS (SELECT feed, file_name, unnest(json_keys(v)) AS k, v FROM v1 WHERE field = 'soft' AND json_type(v) = 'OBJECT'),
v2 AS (SELECT * FROM v1 UNION ALL SELECT feed, file_name, 'soft.' || k, 'soft', json_extract(v, '$."' || k || '"') FROM sub),
ty AS (SELECT DISTINCT feed, file_name, field, level, {_TYPE.format("v")} AS t FROM v2),
fs AS (SELECT feed, file_name, field, level, string_agg(t, ',' ORDER BY t) AS types FROM ty WHERE t IS NOT NULL GROUP BY ALL),
fl AS (SELECT feed, file_name, lag(file_name) OVER (PARTITION BY feed ORDER BY w, file_name) AS prev FROM (SELECT feed, file_name, min(written_at) AS w FROM convert_hf_raw GROUP BY ALL)),
nw AS (SELECT fl.feed, fl.file_name, fl.prev, fs.field, fs.level, fs.types FROM fl JOIN fs ON fs.feed = fl.feed AND fs.file_name = fl.file_name WHERE prev IS NOT NULL),
od AS (SELECT fl.feed, fl.file_name, fs.field, fs.level, fs.types FROM fl JOIN fs ON fs.feed = fl.feed AND fs.file_name = fl.prev),
rt AS (SELECT nw.file_name, 'retyped' AS change_kind, nw.field AS old_field, nw.field AS new_field FROM nw JOIN od USING (feed, file_name, field) WHERE nw.types <> od.types),
cm AS (SELECT nw.* FROM nw LEFT JOIN od USING (feed, file_name, field) WHERE od.field IS NULL),
lv AS (SELECT od.* FROM od LEFT JOIN nw USING (feed, file_name, field) WHERE nw.field IS NULL),
c1 AS (SELECT *, count(*) OVER (PARTITION BY feed, file_name, level, types) AS n FROM cm),
l1 AS (SELECT *, count(*) OVER (PARTITION BY feed, file_name, level, types) AS n FROM lv),
rn AS (SELECT c1.feed, c1.file_name, l1.field AS old_field, c1.field AS new_field FROM c1 JOIN l1 USING (feed, file_name, level, types) WHERE c1.n = 1 AND l1.n = 1)
SELECT * FROM rt UNION ALL SELECT file_name, 'renamed', old_field, new_field FROM rn
UNION ALL SELECT lv.file_name, 'removed', lv.field, '' FROM lv LEFT JOIN rn ON rn.feed = lv.feed AND rn.file_name = lv.file_name AND rn.old_field = lv.field WHERE rn.old_field IS NULL
UNION ALL SELECT cm.file_name, 'added', '', cm.field FROM cm LEFT JOIN rn ON rn.feed = cm.feed AND rn.file_name = cm.file_name AND rn.new_field = cm.field WHERE rn.new_field IS NULL"""


_KEYS = ", ".join(f"({i}, '{k}', {k not in drift.POSITIONS})" for i, k in enumerate((*drift.EITHER, *drift.POSITIONS, *drift.SHARES)))
_NUM = "CASE WHEN json_type({0}) IN ('VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN try_cast({0}->>'$' AS DOUBLE) END"
_DESCRIBING = "[" + ", ".join(f"'{k}'" for k in sorted({*drift.DESCRIBING, *drift.EITHER, *drift.POSITIONS, *drift.SHARES})) + "]"

# Of rows sv (k, v JSON): every field that may hold the distribution is read as one, and the first that is one counts.
_LABELS = f"""
fields AS (SELECT * FROM (VALUES {_KEYS}) f(prio, name, share)),
pv AS (SELECT k, CASE WHEN json_type(v) = 'VARCHAR' THEN (CASE WHEN json_valid(v->>'$') THEN (v->>'$')::JSON END) ELSE v END AS v, json_type(v) = 'VARCHAR' AS was_text FROM sv WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
ob AS (SELECT k, v FROM pv WHERE json_type(v) = 'OBJECT'),
c0 AS (
  SELECT k, -1 AS prio, true AS share, v AS c FROM pv WHERE json_type(v) NOT IN ('OBJECT', 'VARCHAR', 'NULL')
  UNION ALL SELECT k, prio, share, json_extract(v, '$."' || name || '"') FROM ob, fields
  UNION ALL SELECT k, 100, true, json_object('yes', try_cast(v->>'yes' AS DOUBLE), 'no', coalesce(try_cast(v->>'no' AS DOUBLE), 1 - try_cast(v->>'yes' AS DOUBLE))) FROM ob WHERE {_NUM.format("json_extract(v, '$.yes')")} IS NOT NULL
  UNION ALL SELECT k, 200, false, v FROM ob WHERE NOT list_has_any(json_keys(v), {_DESCRIBING})),
c1 AS (SELECT k, prio, share, CASE WHEN json_type(c) = 'VARCHAR' THEN (CASE WHEN json_valid(c->>'$') THEN (c->>'$')::JSON END) ELSE c END AS c FROM c0 WHERE c IS NOT NULL AND json_type(c) <> 'NULL'),
en AS (
  SELECT k, prio, unnest(['yes', 'no']) AS label, unnest([n, 1 - n]) AS x FROM (SELECT k, prio, {_NUM.format("c")} AS n FROM c1 WHERE share AND json_type(c) NOT IN ('ARRAY', 'OBJECT')) WHERE n BETWEEN 0 AND 1
  UNION ALL SELECT k, prio, (i - 1)::VARCHAR, {_NUM.format("x")} FROM (SELECT k, prio, generate_subscripts(json_extract(c, '$[*]'), 1) AS i, unnest(json_extract(c, '$[*]')) AS x FROM c1 WHERE json_type(c) = 'ARRAY')
  UNION ALL SELECT k, prio, label, {_NUM.format("x")} FROM (SELECT k, prio, label, json_extract(c, '$."' || label || '"') AS x FROM (SELECT k, prio, c, unnest(json_keys(c)) AS label FROM c1 WHERE json_type(c) = 'OBJECT'))),
gd AS (SELECT k, prio, string_agg(label || '=' || round(x * 1e6)::BIGINT, ',' ORDER BY label) AS labels FROM en GROUP BY k, prio HAVING count(x) = count(*) AND (prio < 200 OR (abs(sum(x) - 1) <= 0.02 AND min(x) >= 0))),
lb AS (SELECT k, arg_min(labels, prio) AS labels FROM gd GROUP BY k)"""

SOFT_SQL = f"WITH sv AS (SELECT record_no AS k, CASE WHEN json_valid(soft) THEN soft::JSON END AS v FROM convert_hf), {_LABELS} SELECT k AS record_no, labels FROM lb"


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract(p, '$.{n}'), 'null'::JSON)" for n in names) + ")"


def _text(*names: str) -> str:
    v = _first(*names)
    return f"CASE WHEN json_type({v}) NOT IN ('ARRAY', 'OBJECT') THEN {v}->>'$' END"


def _object(name: str) -> str:
    v = _first(name)
    return f"CASE WHEN json_type({v}) = 'OBJECT' THEN {v}::VARCHAR END"


COLUMNS_SQL = f"""
WITH ln AS (SELECT raw_no, CASE WHEN json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT' THEN payload::JSON END AS p FROM convert_hf_raw),
sv AS (SELECT raw_no AS k, json_extract(p, '$.soft') AS v FROM ln), {_LABELS}
SELECT raw_no, p IS NOT NULL AS readable, {_text("id")} AS id, {_text("src", "origin", "source")} AS source, {_text("lic", "licence", "license")} AS license, {_text("context", "state")} AS state,
  {_object("question")} AS question, {_object("expect")} AS expect, {_text("lang")} AS lang, {_text("note")} AS note, {_NUM.format(_first("votes"))} AS votes, {_NUM.format(_first("difficulty"))} AS difficulty,
  CASE json_type({_first("tags")}) WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract({_first("tags")}, '$[*]'), lambda x: x->>'$'), '|') WHEN 'OBJECT' THEN NULL ELSE {_first("tags")}->>'$' END AS tags,
  CASE WHEN json_type({_first("reviewed")}) = 'BOOLEAN' THEN {_first("reviewed")}->>'$' END AS reviewed, {_object("meta")} AS meta, labels
FROM ln LEFT JOIN lb ON k = raw_no"""

_CHANGES = P6_SQL.split("\nSELECT * FROM rt")[0]
CHANGES_SQL = f"""{_CHANGES}, ch AS (
SELECT feed, file_name, 'retyped' AS change_kind, nw.field AS old_field, nw.field AS new_field, od.types AS old_types, nw.types AS new_types FROM nw JOIN od USING (feed, file_name, field) WHERE nw.types <> od.types
UNION ALL SELECT feed, file_name, 'renamed', l1.field, c1.field, l1.types, c1.types FROM c1 JOIN l1 USING (feed, file_name, level, types) WHERE c1.n = 1 AND l1.n = 1
UNION ALL SELECT l1.feed, l1.file_name, 'removed', l1.field, '', l1.types, '' FROM l1 LEFT JOIN rn ON rn.feed = l1.feed AND rn.file_name = l1.file_name AND rn.old_field = l1.field WHERE rn.old_field IS NULL
UNION ALL SELECT c1.feed, c1.file_name, 'added', '', c1.field, '', c1.types FROM c1 LEFT JOIN rn ON rn.feed = c1.feed AND rn.file_name = c1.file_name AND rn.new_field = c1.field WHERE rn.new_field IS NULL)
SELECT ch.*, w.written_at FROM ch JOIN (SELECT feed, file_name, min(written_at) AS written_at FROM convert_hf_raw GROUP BY ALL) w USING (feed, file_name)"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, "p6_changes": CHANGES_SQL, "p6_columns": COLUMNS_SQL, "p6_soft": SOFT_SQL}
