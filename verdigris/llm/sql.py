"""DuckDB twins of the queries that SQL can express on whole tables."""

_LINES = "length(text) - length(replace(text, chr(10), '')) + (CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END)"

_P2_KEYS = r"""
rows AS (
  SELECT record_no,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(source), '\s+', '', 'g'), '(\([^()]*\))+$', ''), '[_‐-―]', '-', 'g'), '') AS s,
    nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(id), '\s+', '', 'g'), '[_‐-―]', '-', 'g'), '(~p[0-9]+)+$', ''), '^(tdc-[^-]+)-[0-9]+$', '\1'), '') AS b
  FROM convert_hf WHERE record_no IS NOT NULL)"""

_ALIKE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"

# Records with split, state and question: w, the words of the state's text and number values, keys in order; q, the question
# by type, range, options in order, and instructions.
_P5_RECORDS = rf"""
r0 AS (SELECT record_no, source, lower(trim(split)) AS sp, state, question FROM convert_hf WHERE split IS NOT NULL AND state IS NOT NULL AND question IS NOT NULL AND lower(trim(split)) IN ('train', 'dev', 'holdout')),
js AS (SELECT record_no, state::JSON AS v FROM r0 WHERE json_valid(state) AND json_type(CASE WHEN json_valid(state) THEN state END) IN ('OBJECT', 'ARRAY', 'VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT')),
ato AS (SELECT record_no, j.atom->>'$' AS x, list_transform(regexp_extract_all(substr(j.fullkey, 2), '\."([^"\\]|\\.)*"|\.[^.\[]+|\[[0-9]+\]'), lambda k: CASE WHEN k[1] = '[' THEN lpad(k[2:-2], 12, '0') ELSE trim(k[2:], '"') END) AS place FROM js, json_tree(js.v) j WHERE j.type IN ('VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT')),
tx AS (SELECT record_no, string_agg(x, ' ' ORDER BY place) AS t FROM ato GROUP BY record_no UNION ALL SELECT record_no, '' FROM js WHERE record_no NOT IN (SELECT record_no FROM ato) UNION ALL SELECT record_no, state FROM r0 WHERE record_no NOT IN (SELECT record_no FROM js)),
qj AS (SELECT record_no, sp, source, question::JSON AS j FROM r0 WHERE json_valid(question)),
ck AS (SELECT record_no, j, CASE json_type(j->'criteria') WHEN 'OBJECT' THEN list_sort(list_transform(json_keys(j->'criteria'), lambda k: {_ALIKE.format("k")} || '=' || {_ALIKE.format("json_extract_string(j, '$.criteria.' || chr(34) || k || chr(34))")})) WHEN 'ARRAY' THEN list_sort(list_transform(json_extract_string(j, '$.criteria[*]'), lambda k: {_ALIKE.format("k")})) END AS options FROM qj),
qk AS (SELECT record_no, {_ALIKE.format("coalesce(j->>'type', '')")} || '#' || coalesce(try_cast(j->>'min' AS DOUBLE)::VARCHAR, '') || '#' || coalesce(try_cast(j->>'max' AS DOUBLE)::VARCHAR, '') || '#' || coalesce(array_to_string(options, '|'), '') || '#' || {_ALIKE.format("coalesce(j->>'instructions', '')")} AS q FROM ck),
rec AS (SELECT r0.record_no, r0.source, r0.sp, qk.q, regexp_extract_all(lower(tx.t), '[\p{{L}}\p{{N}}]+') AS w FROM r0 JOIN qk USING (record_no) JOIN tx USING (record_no))"""

# Pairs of an evaluation record y and a training record x with the words that differ.
_P5_PAIRS = f"""WITH RECURSIVE {_P5_RECORDS},
pr AS (SELECT a.record_no AS x, b.record_no AS y, b.sp, b.source, a.w AS a, b.w AS b, greatest(len(a.w), len(b.w)) // 8 AS k FROM rec a JOIN rec b ON a.q = b.q AND a.sp = 'train' AND b.sp <> 'train' AND abs(len(a.w) - len(b.w)) <= greatest(len(a.w), len(b.w)) // 8),
near AS (SELECT * FROM pr WHERE a <> b AND k > 0 AND len(list_filter(a, lambda v: NOT list_contains(b, v))) <= k AND len(list_filter(b, lambda v: NOT list_contains(a, v))) <= k),
dp(x, y, i, col) AS (
  SELECT x, y, 0::BIGINT, range(len(b) + 1) FROM near
  UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda m: (CASE WHEN m = 1 THEN i + 1 ELSE least(col[m - 1] + (a[i + 1] <> b[m - 1])::INT, col[m] + 1) END) + j - m)))
  FROM dp JOIN near USING (x, y) WHERE i < len(a)),
pairs AS (SELECT x, y, sp, source, 0 AS distance FROM pr WHERE a = b UNION ALL SELECT x, y, sp, source, col[len(b) + 1] FROM dp JOIN near USING (x, y) WHERE i = len(a) AND col[len(b) + 1] <= k)"""

ORACLE = {
    "p5_found": f"{_P5_PAIRS} SELECT least(x, y) AS record_lo, greatest(x, y) AS record_hi FROM pairs",
    "p5_pairs": f"{_P5_PAIRS} SELECT least(x, y) AS record_lo, greatest(x, y) AS record_hi, sp AS split, source, distance::INT AS distance, y AS eval_no FROM pairs",
    "p5_report": f"{_P5_PAIRS}, per AS (SELECT sp, source, y, count(*) AS n, sum((distance = 0)::INT) AS exact, max(distance) AS far FROM pairs GROUP BY ALL) SELECT sp AS split, source, sum(n)::BIGINT AS pairs, count(*) AS records_with_twin, sum(exact)::BIGINT AS exact_pairs, sum((exact > 0)::INT)::BIGINT AS records_with_exact_twin, max(far)::INT AS largest_distance FROM per GROUP BY ALL",
    "p5_method": f"""
WITH {_P5_RECORDS},
g AS (SELECT record_no, sp, q, i, array_to_string(w[i:i + 5], ' ') AS g FROM rec, generate_series(1, greatest(0, len(w) - 5)) s(i)),
tg AS (SELECT DISTINCT q, g FROM g WHERE sp = 'train'),
cv AS (SELECT record_no, count(DISTINCT i + o) AS covered FROM g JOIN tg USING (q, g), generate_series(0, 5) s(o) WHERE sp <> 'train' GROUP BY record_no)
SELECT record_no, sp AS split, source, len(w)::INT AS words, coalesce(covered, 0)::INT AS covered, CASE WHEN len(w) > 0 THEN coalesce(covered, 0)::DOUBLE / len(w) ELSE 0.0 END AS coverage FROM rec LEFT JOIN cv USING (record_no) WHERE sp <> 'train'""",
    "p1_found": f"SELECT chunk_id FROM corpus WHERE length(text) > 1600 OR {_LINES} > 60",
    "p2_found": f"""
WITH RECURSIVE {_P2_KEYS},
keyed AS (SELECT record_no, s, coalesce('s:' || s, 'b:' || b, 'r:' || record_no) AS k1, coalesce('b:' || b, 's:' || s, 'r:' || record_no) AS k2 FROM rows),
edges AS (SELECT DISTINCT k1 AS a, k2 AS b FROM keyed UNION SELECT DISTINCT k2, k1 FROM keyed),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS k, min(b) AS c FROM reach GROUP BY a),
named AS (SELECT k.record_no, k.s, c.c FROM keyed k JOIN comp c ON c.k = k.k1),
mixed AS (SELECT c, min(record_no) AS group_no FROM named GROUP BY c HAVING count(DISTINCT s) >= 2 OR (count(s) > 0 AND count(s) < count(*)))
SELECT m.group_no, n.record_no FROM named n JOIN mixed m USING (c) WHERE n.record_no <> m.group_no""",
    "p2_shares": """
WITH n AS (SELECT count(*) AS n FROM convert_hf WHERE record_no IS NOT NULL), w AS (SELECT split, share / sum(share) OVER () AS w, row_number() OVER (ORDER BY share DESC, split DESC) AS r FROM split_shares),
t AS (SELECT split, r, round_even(n * w, 0)::BIGINT AS t FROM w, n), x AS (SELECT split, CASE WHEN r = 1 THEN (SELECT n FROM n) - (SELECT sum(t) FROM t WHERE r > 1) ELSE t END::BIGINT AS records FROM t)
SELECT split, records, records / (SELECT n FROM n)::DOUBLE AS share, 0::BIGINT AS torn FROM x""",
    "p3_found": """
WITH recs AS (SELECT min(chunk_id) AS chunk_id, path, text, arg_min(coalesce(symbol, ''), chunk_id) AS symbol FROM corpus GROUP BY path, start_line, text),
terms AS (SELECT chunk_id, unnest(regexp_extract_all(lower(coalesce(path, '') || chr(10) || symbol || chr(10) || coalesce(text, '')), '[a-z]{3,}')) AS term FROM recs),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY chunk_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 5""",
    "p3_scores": """
WITH recs AS (SELECT min(chunk_id) AS chunk_id, path, text, arg_min(coalesce(symbol, ''), chunk_id) AS symbol FROM corpus GROUP BY path, start_line, text),
ws AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(path, '') || chr(10) || symbol || chr(10) || coalesce(text, '')), '[a-z]{3,}') AS w FROM recs),
po AS (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM ws),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM po GROUP BY chunk_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dg AS (SELECT a.chunk_id, a.term, count(DISTINCT b.term) AS degree FROM po a JOIN po b ON a.chunk_id = b.chunk_id AND b.i BETWEEN a.i - 3 AND a.i + 3 AND a.term <> b.term GROUP BY a.chunk_id, a.term)
SELECT chunk_id, term, tf, coalesce(degree, 0) AS degree, df, round(coalesce(degree, 0) * ln((SELECT count(*) FROM recs)::DOUBLE / df) * 1e6) / 1e6 AS score FROM tf JOIN df USING (term) LEFT JOIN dg USING (chunk_id, term)""",
    "p4_found": r"""
WITH tv AS (SELECT id, state FROM typed_decisions WHERE split = 'test' AND state IS NOT NULL AND id IS NOT NULL),
va AS (SELECT id, state AS v FROM tv WHERE NOT json_valid(state) OR json_type(CASE WHEN json_valid(state) THEN state END) NOT IN ('OBJECT', 'ARRAY', 'VARCHAR')
  UNION ALL SELECT tv.id, j.atom->>'$' FROM (SELECT * FROM tv WHERE json_valid(state)) tv, json_tree(tv.state) j WHERE j.type = 'VARCHAR' AND json_type(tv.state) IN ('OBJECT', 'ARRAY', 'VARCHAR')),
cw AS (SELECT id, regexp_extract_all(lower(v), '[\p{L}\p{N}]+') AS w FROM va),
cg AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM cw WHERE len(w) >= 12),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12)
SELECT DISTINCT doc_id, id AS case_id FROM dg JOIN cg USING (g)""",
}
