"""What several query modules share: a registry, the tables of cases with slots and stand-in logits, and their SQL twins."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.once import once
from verdigris.functions.prob import softmax
from verdigris.operators.decide import decode
from verdigris.operators.metrics import parse_expect
from verdigris.operators.questions import parse_question, slots
from verdigris.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL twins of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def deco(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return deco


def hashed(*parts: Column) -> Column:
    """A number in [-4, 4) from the MD5 of texts; the stand-in for logits that SQL can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * 8 - 4


def norm_sql(text: str) -> str:
    """SQL of functions.text.norm_text: characters that decompose to an ASCII letter or digit and marks become that and a
    separator, which is what the marks are. The sets come from the Unicode tables."""
    t = f"lower({text})"
    low = [c for c in map(chr, range(0xA0, 0xFFFF)) if c.lower() == c and not 0xD800 <= ord(c) < 0xE000]
    forms = {c: unicodedata.normalize("NFKD", c).lower() for c in low}
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789":
        alone = "".join(c for c, d in forms.items() if d == ch)
        marked = "".join(c for c, d in forms.items() if d[0] == ch and len(d) > 1 and not any(x.isascii() and x.isalnum() for x in d[1:]))
        for chars, to in ((alone, ch), (marked, ch + " ")):
            if chars:
                t = f"regexp_replace({t}, '[{chars}]', '{to}', 'g')"
    return f"array_to_string(regexp_extract_all({t}, '[a-z0-9]+'), ' ')"


HASHED_SQL = "(('0x' || substr(md5({0}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * 8 - 4)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases with parsed question and expectation: record_no, state, q, e, slots."""
    c = spread(table(spark, d, "convert_hf")).select("record_no", "id", "source", "state", "question", "expect", "soft", "requires_abstain")
    c = once(c, q=parse_question(F.col("question")), e=parse_expect(F.col("expect"))).filter("q is not null")
    return once(c, slots=slots(F.col("q")))


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Cases decided on stand-in logits: adds p, answer."""
    c = cases(spark, d)
    logits = F.transform("slots", lambda s: hashed(F.col("record_no").cast("string"), s["pos"].cast("string")))
    c = once(once(c, l=logits), p=softmax(F.col("l"))).drop("l")
    return once(c, answer=decode(F.col("q.qtype"), F.col("slots"), F.col("p"))).withColumn("expect", F.col("e"))


#: DuckDB: questions (t), slots (sl), probabilities (pr) and per-case aggregates (best, gap, confidence) of the same cases.
CASES_SQL = """
q0 AS (SELECT record_no, state, question::JSON AS qj, expect::JSON AS ej FROM convert_hf WHERE question IS NOT NULL AND json_valid(question)),
t AS (SELECT record_no, state, qj, ej, qj->>'type' AS qtype, coalesce(qj->>'instructions', '') AS instructions, qj->'criteria' AS c, json_type(qj->'criteria') AS kind,
  (qj->>'min')::DOUBLE AS mn, (qj->>'max')::DOUBLE AS mx, (qj->>'step')::DOUBLE AS st, coalesce((qj->>'granularity')::INT, 8) AS gr, coalesce((qj->>'allow_abstain')::BOOLEAN, false) AS ab FROM q0),
t2 AS (SELECT *, CASE WHEN qtype = 'numeric' THEN least(24, greatest(2, CASE WHEN st > 0 THEN (round((mx - mn) / st) + 1)::INT ELSE gr END)) END AS anchors FROM t),
main AS (
  SELECT record_no, qtype, ab, u.pos, u.key, u.text, false AS special, NULL::DOUBLE AS v FROM t2, (VALUES (0, 'yes', 'Yes'), (1, 'no', 'No')) u(pos, key, text) WHERE qtype IN ('boolean', 'noul')
  UNION ALL SELECT record_no, qtype, ab, generate_subscripts(json_keys(c), 1) - 1, unnest(json_keys(c)), NULL, false, NULL FROM t2 WHERE qtype = 'choice' AND kind = 'OBJECT'
  UNION ALL SELECT record_no, qtype, ab, g.i, g.i::VARCHAR, NULL, false, NULL FROM t2, generate_series(0, 25) g(i) WHERE qtype = 'score' AND g.i < json_array_length(c)
  UNION ALL SELECT record_no, qtype, ab, 0, '__below__', NULL, true, NULL FROM t2 WHERE qtype = 'numeric'
  UNION ALL SELECT record_no, qtype, ab, g.i + 1, 'anchor', NULL, false, mn + (mx - mn) * g.i / (anchors - 1) FROM t2, generate_series(0, 23) g(i) WHERE qtype = 'numeric' AND g.i < anchors
  UNION ALL SELECT record_no, qtype, ab, anchors + 1, '__above__', NULL, true, NULL FROM t2 WHERE qtype = 'numeric'),
sl AS (
  SELECT m.record_no, m.qtype, m.pos, m.key, coalesce(m.text, CASE WHEN m.qtype = 'choice' THEN coalesce(nullif(json_extract_string(t2.c, '$."' || m.key || '"'), ''), m.key) WHEN m.qtype = 'score' THEN coalesce(nullif(json_extract_string(t2.c, '$[' || m.pos || ']'), ''), m.key) END) AS text, m.special, m.v
  FROM main m JOIN t2 USING (record_no)
  UNION ALL SELECT record_no, qtype, max(pos) + 1, '__abstain__', 'None of the above / insufficient information in the state', true, NULL FROM main WHERE ab GROUP BY record_no, qtype),
lg AS (SELECT *, """ + HASHED_SQL.format("record_no || ':' || pos") + """ AS l FROM sl),
pr AS (SELECT record_no, qtype, pos, key, text, special, v, exp(l - max(l) OVER w) / sum(exp(l - mx)) OVER w AS p, count(*) OVER w AS n FROM (SELECT *, max(l) OVER (PARTITION BY record_no) AS mx FROM lg) WINDOW w AS (PARTITION BY record_no)),
rk AS (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY p DESC, pos DESC) AS r FROM pr),
ag AS (SELECT record_no, any_value(qtype) AS qtype, any_value(n) AS n, max(CASE WHEN r = 1 THEN key END) AS best, max(CASE WHEN r = 1 THEN pos END) AS bpos, bool_or(r = 1 AND special) AS bspecial, max(CASE WHEN r = 1 THEN p END) AS p1, max(CASE WHEN r = 2 THEN p END) AS p2,
  sum(CASE WHEN key = 'yes' THEN p END) AS py, sum(CASE WHEN key = 'no' THEN p END) AS pn, sum(CASE WHEN NOT special THEN p END) AS mass, sum(CASE WHEN NOT special THEN p * v END) AS pv, sum(CASE WHEN NOT special THEN p * pos END) AS pl, sum(CASE WHEN NOT special THEN 1 END) AS reals FROM rk GROUP BY record_no),
an AS (SELECT record_no, qtype, bpos, best, n, p1,
  CASE WHEN best = '__abstain__' THEN 'abstained' WHEN best IN ('__below__', '__above__') THEN 'out_of_bounds' WHEN n > 1 AND p1 - p2 < 0.15::DOUBLE THEN 'contested' ELSE 'decided' END AS status,
  round(greatest(0, (n * p1 - 1) / (n - 1)) * 1e4) / 1e4 AS confidence,
  CASE WHEN qtype IN ('boolean', 'noul') THEN py >= pn END AS boolean,
  CASE WHEN qtype IN ('boolean', 'noul') THEN CASE WHEN py >= pn THEN 'yes' ELSE 'no' END WHEN qtype = 'choice' THEN best END AS choice,
  CASE WHEN qtype = 'score' THEN round(pl / (reals - 1) * 1e4) / 1e4 END AS score,
  CASE WHEN qtype = 'score' AND NOT bspecial THEN best::INT END AS level,
  CASE WHEN qtype = 'numeric' AND mass > 0 THEN round(pv / mass * 1e6) / 1e6 END AS value FROM ag)"""

JUDGED_SQL = CASES_SQL + """,
ex AS (SELECT record_no, ej->>'status' AS x_status, ej->>'choice' AS x_choice, (ej->>'boolean')::BOOLEAN AS x_boolean, (ej->>'level')::INT AS x_level, (ej->>'score')::DOUBLE AS x_score, (ej->>'value')::DOUBLE AS x_value, (ej->>'tol')::DOUBLE AS x_tol FROM t2),
jd AS (SELECT an.*, ex.* EXCLUDE (record_no), CASE WHEN x_status IS NOT NULL THEN status = x_status WHEN x_choice IS NOT NULL THEN coalesce(choice = x_choice, false) WHEN x_boolean IS NOT NULL THEN coalesce(boolean = x_boolean, false) WHEN x_level IS NOT NULL THEN coalesce(level = x_level, false) WHEN x_score IS NOT NULL THEN coalesce(abs(score - x_score) <= coalesce(x_tol, 0.34), false) WHEN x_value IS NOT NULL THEN coalesce(abs(value - x_value) <= coalesce(x_tol, 0.0), false) END AS ok FROM an JOIN ex USING (record_no)),
mp AS (SELECT pr.record_no, pr.pos, pr.key, pr.v, round(pr.p * 1e6) / 1e6 AS p, row_number() OVER (PARTITION BY pr.record_no ORDER BY CASE WHEN pr.key IN ('__below__', '__above__') THEN 1 ELSE 0 END, pr.pos) - 1 AS i FROM pr),
tk AS (SELECT jd.record_no, jd.qtype, CASE
    WHEN x_status = 'abstained' THEN (SELECT min(i) FROM mp WHERE mp.record_no = jd.record_no AND key = '__abstain__')
    WHEN x_status IS NOT NULL AND x_status <> 'out_of_bounds' THEN NULL
    WHEN jd.qtype = 'choice' THEN (SELECT min(i) FROM mp WHERE mp.record_no = jd.record_no AND key = x_choice)
    WHEN jd.qtype IN ('boolean', 'noul') AND x_boolean IS NOT NULL THEN CASE WHEN x_boolean THEN 0 ELSE 1 END
    WHEN jd.qtype = 'score' THEN (SELECT min(i) FROM mp WHERE mp.record_no = jd.record_no AND key = coalesce(x_level, round(x_score * (json_array_length(t2.c)::INT - 1))::INT)::VARCHAR)
    WHEN jd.qtype = 'numeric' AND x_value < mn THEN (SELECT min(i) FROM mp WHERE mp.record_no = jd.record_no AND key = '__below__')
    WHEN jd.qtype = 'numeric' AND x_value > mx THEN (SELECT min(i) FROM mp WHERE mp.record_no = jd.record_no AND key = '__above__')
    WHEN jd.qtype = 'numeric' THEN (SELECT arg_min(i, struct_pack(d := abs(mp.v - x_value), i := i)) FROM mp WHERE mp.record_no = jd.record_no AND mp.v IS NOT NULL) END AS y FROM jd JOIN t2 USING (record_no)),
ds AS (SELECT tk.record_no, tk.qtype, tk.y, arg_max(mp.i, struct_pack(p := mp.p, i := mp.i)) AS top, max(mp.p) AS conf, sum(power(mp.p - CASE WHEN mp.i = tk.y THEN 1 ELSE 0 END, 2)) AS brier FROM tk JOIN mp USING (record_no) WHERE tk.y IS NOT NULL GROUP BY ALL)"""

#: DuckDB: the slots with the texts of numbers (nt).
SLOTS_SQL = r"""nt AS (SELECT sl.record_no, sl.qtype, pos, CASE WHEN sl.qtype = 'numeric' AND NOT special THEN regexp_replace(v::VARCHAR, '\.0$', '') ELSE key END AS key, CASE WHEN sl.qtype <> 'numeric' OR key = '__abstain__' THEN text WHEN key = '__below__' THEN 'Below ' || regexp_replace(mn::VARCHAR, '\.0$', '') WHEN key = '__above__' THEN 'Above ' || regexp_replace(mx::VARCHAR, '\.0$', '') ELSE regexp_replace(v::VARCHAR, '\.0$', '') END AS text, special FROM sl JOIN t2 USING (record_no))"""
