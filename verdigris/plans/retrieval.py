"""Queries of text analysis, chunking, the index, recall, descent and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigris.functions import text as tx
from verdigris.functions.prob import r6
from verdigris.operators import chunks, descend, lexical, remote, search
from verdigris.plans.common import HASHED_SQL, Registry, hashed, norm_sql
from verdigris.session import spread, stored, table

R = Registry()
add = R.add

QUESTIONS = ("where is the retry queue filled", "parse the weight limits of a prompt", "how are duplicate ids dropped", "load_unit token drop", "calibration margin report")
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") v(query_id, query))"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select(F.col("chunk_id").alias("doc"), "path", "symbol", F.col("text").alias("body"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, query string")


# ---- text ----


_CUT = r"regexp_replace(regexp_replace(s, '(\p{Lu})(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g'), '([^\p{Lu}' || chr(1) || '])(\p{Lu})', '\1' || chr(1) || '\2', 'g')"


@add(r"SELECT chunk_id AS doc, symbol, array_to_string(list_filter(flatten(list_transform(string_split(symbol, '_'), lambda s: string_split(" + _CUT + r", chr(1)))), lambda x: x <> ''), '|') AS parts FROM corpus WHERE symbol IS NOT NULL")
def lex_06_humps(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every symbol."""
    c = corpus(spark, d).filter("symbol is not null")
    parts = F.flatten(F.transform(F.split("symbol", "_"), lambda s: tx.humps_column(s)))
    return c.select("doc", "symbol", F.array_join(parts, "|").alias("parts"))


@add("SELECT c_custkey, array_to_string(list_transform(range(1, length(c_mktsegment)), lambda i: substring(c_mktsegment, i, 2)), '|') AS pairs FROM customer")
def lex_05_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.array_join(tx.bigrams_column(F.col("c_mktsegment")), "|").alias("pairs"))


_CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"


@add(rf"WITH r AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([{_CJK}]+)', chr(1) || '\1' || chr(1), 'g'), '[\p{{L}}\p{{N}}_]+') AS r FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(r)::INT AS runs, md5(array_to_string(r, '|')) AS said, len(list_filter(r, lambda x: regexp_matches(x, '^[{_CJK}]')))::INT AS cjk FROM r")
def lex_03_runs(spark: SparkSession, d: str) -> DataFrame:
    """Word runs of every text, cut where CJK meets other scripts."""
    r = table(spark, d, "documents").filter("text is not null").select("doc_id", tx.runs_column(F.col("text")).alias("r"))
    return r.select("doc_id", F.size("r").alias("runs"), F.md5(F.array_join("r", "|")).alias("said"), F.size(F.filter("r", lambda x: x.rlike(f"^[{tx.CJK}]"))).alias("cjk"))


# ---- stems in SQL: v marks vowels in the form of a word, c the other letters ----


def _form(x: str) -> str:
    """SQL of the form of a word. A y after a consonant is a vowel, another one a consonant; three rounds settle runs of them."""
    f = f"translate({x}, 'aeiouvc', 'VVVVVbb')"
    for _ in range(3):
        f = f"regexp_replace(regexp_replace(regexp_replace({f}, '([^Vy])y', '\\1V', 'g'), 'Vy', 'VC', 'g'), '^y', 'C')"
    return f"lower(regexp_replace({f}, '[^V]', 'c', 'g'))"


def _vc(x: str, n: int) -> str:
    return f"regexp_matches({_form(x)}, '{'.*'.join(['vc'] * n)}')"


def _short(x: str) -> str:
    return f"(regexp_matches({_form(x)}, 'cvc$') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _stem_steps(words: str) -> str:
    """SQL of steps z0 .. z9 from a table of words (word) to st (word, stem)."""
    cut = lambda x, n: f"left({x}, length({x}) - {n})"
    out = [f"""z0 AS (SELECT word, CASE WHEN ends_with(word, 'sses') OR ends_with(word, 'ies') THEN {cut('word', 2)} WHEN right(word, 1) = 's' AND right(word, 2) NOT IN ('ss', 'us', 'is') THEN {cut('word', 1)} ELSE word END AS w, true AS more FROM {words} WHERE length(word) >= 3)"""]
    for i in range(4):
        out.append(f"y{i} AS (SELECT word, w, more, CASE WHEN ends_with(w, 'ed') THEN {cut('w', 2)} WHEN ends_with(w, 'ing') THEN {cut('w', 3)} END AS b FROM z{i})")
        out.append(f"""z{i + 1} AS (SELECT word, CASE
    WHEN NOT more THEN w
    WHEN ends_with(w, 'eed') THEN CASE WHEN {_vc(cut('w', 3), 1)} THEN {cut('w', 1)} ELSE w END
    WHEN b IS NULL OR NOT contains({_form('b')}, 'v') THEN w
    WHEN right(b, 2) IN ('at', 'bl', 'iz') THEN b || 'e'
    WHEN length(b) > 3 AND right(b, 1) = substr(b, -2, 1) AND regexp_matches(b, '[a-z]$') AND right(b, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z', 'f') THEN {cut('b', 1)}
    WHEN {_vc('b', 1)} AND NOT {_vc('b', 2)} AND {_short('b')} THEN b || 'e' ELSE b END AS w,
  more AND NOT ends_with(w, 'eed') AND b IS NOT NULL AND contains({_form('b')}, 'v') AND right(b, 2) NOT IN ('at', 'bl', 'iz') AND ((length(b) > 3 AND right(b, 1) = substr(b, -2, 1) AND regexp_matches(b, '[a-z]$') AND right(b, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z', 'f')) OR ends_with(b, 'eed')) AS more FROM y{i})""")
    out.append(f"z5 AS (SELECT word, CASE WHEN right(w, 1) = 'y' AND contains({_form(cut('w', 1))}, 'v') THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM z4)")
    e = cut("w", 1)
    out.append(f"z6 AS (SELECT word, CASE WHEN right(w, 1) = 'e' AND ({_vc(e, 2)} OR ({_vc(e, 1)} AND NOT {_short(e)})) THEN {e} ELSE w END AS w FROM z5)")
    out.append(f"st AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {_vc('w', 2)} THEN {e} ELSE w END AS stem FROM z6 UNION ALL SELECT word, word FROM {words} WHERE length(word) < 3)")
    return ",\n".join(out)


@add(f"WITH wd AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM corpus), {_stem_steps('wd')} SELECT word, stem FROM st")
def lex_08_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the corpus' distinct lower-case words."""
    w = corpus(spark, d).select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", tx.stem_udf("word").alias("stem"))


_STOPPED = ", ".join(f"'{w}'" for w in tx.STOPWORDS.split())


@add(f"""WITH rn AS (SELECT doc, run, count(*) AS times FROM (SELECT chunk_id AS doc, unnest(regexp_extract_all(regexp_replace(text, '([{_CJK}]+)', chr(1) || '\\1' || chr(1), 'g'), '[\\p{{L}}\\p{{N}}_]+')) AS run FROM corpus WHERE text IS NOT NULL) GROUP BY doc, run),
ru AS (SELECT DISTINCT run AS s FROM rn),
pt AS (SELECT s AS run, list_filter(flatten(list_transform(string_split(s, '_'), lambda s: string_split({_CUT}, chr(1)))), lambda x: x <> '') AS parts FROM ru WHERE NOT regexp_matches(s, '^[{_CJK}]')),
pa AS (SELECT run, i, lower(p) AS p FROM (SELECT run, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM pt) WHERE strlen(p) >= 2 AND lower(p) NOT IN ({_STOPPED})),
wd AS (SELECT DISTINCT p AS word FROM pa WHERE regexp_full_match(p, '[a-z0-9]+')), {_stem_steps('wd')},
tm AS (SELECT run, coalesce(stem, p) AS term FROM pa LEFT JOIN st ON word = p
  UNION ALL SELECT run, lower(array_to_string(parts, '')) FROM pt WHERE len(parts) > 1 AND length(array_to_string(parts, '')) >= 3
  UNION ALL SELECT s, unnest(CASE WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) END) FROM ru WHERE regexp_matches(s, '^[{_CJK}]'))
SELECT term, sum(times)::BIGINT AS n, count(DISTINCT doc) AS docs FROM rn JOIN tm USING (run) GROUP BY term""")
def lex_01_terms(spark: SparkSession, d: str) -> DataFrame:
    """How often each term of the full analyser occurs, and in how many chunks."""
    return corpus(spark, d).select("doc", F.explode(tx.terms_udf("body")).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


@add(f"""WITH n AS (SELECT chunk_id, {norm_sql('text')} AS t FROM corpus WHERE text IS NOT NULL), w AS (SELECT chunk_id, t, string_split(t, ' ') AS w FROM n)
SELECT chunk_id AS doc, CASE WHEN t = '' THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END::INT AS shingles FROM w""")
def lex_22_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct 5-word shingles of every text in its decomposed form."""
    c = corpus(spark, d).filter("body is not null")
    return c.select("doc", F.size(tx.shingles(tx.norm_text(F.col("body")))).alias("shingles"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files: half of the sources are prose."""
    return table(spark, d, "documents").select(F.concat_ws("", F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("source").isin("readme", "changelog", "howto", "glossary"), ".md").otherwise(".py")).alias("path"), "text")


# A chunker in SQL: lines, headings (marked ones, and titles over a rule, outside fences), blocks, units, cells, and one pass
# over the cells of a file. First and last lines count from 1.
_SPANS = rf"""WITH dc AS (SELECT coalesce(source, 'none') || '/' || doc_id || CASE WHEN source IN ('readme', 'changelog', 'howto', 'glossary') THEN '.md' ELSE '.py' END AS path, source IN ('readme', 'changelog', 'howto', 'glossary') AND source IS NOT NULL AS prose, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13) || '$', ''), '\n$', '') AS text FROM documents WHERE text IS NOT NULL AND text <> ''),
l0 AS (SELECT path, prose, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM dc),
l1 AS (SELECT *, regexp_matches(line, '[^\t\n\v\f\r\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]') AS full_, length(replace(regexp_extract(line, '^[\t\n\v\f\r\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]*'), chr(9), '    ')) AS indent, prose AND regexp_matches(line, '^\s*(```|~~~)') AS fence, regexp_full_match(line, '(={{3,}}|-{{3,}})\s*') AS rule_, regexp_full_match(line, '#{{1,6}}[ \t]\s*\S.*') AS marked FROM l0),
l2 AS (SELECT *, sum(fence::INT) OVER (PARTITION BY path ORDER BY i) AS fences, lead(rule_) OVER (PARTITION BY path ORDER BY i) AS next_rule, lag(rule_) OVER (PARTITION BY path ORDER BY i) AS last_rule, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i) AS ends FROM l1),
l3 AS (SELECT *, prose AND full_ AND NOT fence AND fences % 2 = 0 AND (marked OR (NOT rule_ AND coalesce(next_rule, false))) AS head FROM l2),
b0 AS (SELECT *, i - lag(i, 1, -9) OVER (PARTITION BY path ORDER BY i) > 1 OR head AS begins, min(indent) OVER (PARTITION BY path) AS least_ FROM l3 WHERE full_),
b1 AS (SELECT *, sum(begins::INT) OVER (PARTITION BY path ORDER BY i) AS block FROM b0),
b2 AS (SELECT path, prose, block, min(i) AS s, max(i) AS e, arg_min(head, i) AS head, arg_min(indent, i) AS indent, any_value(least_) AS least_, arg_min(regexp_matches(ltrim(line, ' ' || chr(9)), '^([}})\]]|</|(end|fi|done|esac)\b)'), i) AS closes FROM b1 GROUP BY path, prose, block),
b3 AS (SELECT *, sum((block = 1 OR head OR (NOT prose AND indent = least_ AND NOT closes))::INT) OVER (PARTITION BY path ORDER BY block) AS unit FROM b2),
sz AS (SELECT path, i, ends FROM l2 UNION ALL SELECT DISTINCT path, 0, 0 FROM l2),
bz AS (SELECT b3.*, e.ends - 1 - s0.ends AS n FROM b3 JOIN sz e ON e.path = b3.path AND e.i = b3.e JOIN sz s0 ON s0.path = b3.path AND s0.i = b3.s - 1),
uz AS (SELECT path, unit, min(s) AS us, max(e) AS ue, bool_or(head AND s = us0) AS uhead FROM (SELECT *, min(s) OVER (PARTITION BY path, unit) AS us0 FROM bz) GROUP BY path, unit),
uf AS (SELECT uz.*, us = ue OR (ue - us < 60 AND e.ends - 1 - s0.ends <= 1600) AS fits FROM uz JOIN sz e ON e.path = uz.path AND e.i = ue JOIN sz s0 ON s0.path = uz.path AND s0.i = us - 1),
ce AS (SELECT path, us AS s, ue AS e, NOT coalesce(lag(fits) OVER (PARTITION BY path ORDER BY unit), true) AS apart, uhead AS heads, fits FROM uf),
c1 AS (SELECT path, s, e, apart, heads FROM ce WHERE fits
  UNION ALL SELECT bz.path, bz.s, bz.e, bz.s = us, false FROM bz JOIN uf USING (path, unit) WHERE NOT fits AND bz.e - bz.s < 60 AND bz.n <= 1600
  UNION ALL SELECT bz.path, g.i, g.i, g.i = bz.s, false FROM bz JOIN uf USING (path, unit), LATERAL (SELECT unnest(range(bz.s, bz.e + 1)) AS i) g WHERE NOT fits AND NOT (bz.e - bz.s < 60 AND bz.n <= 1600)),
cl AS (SELECT c1.path, list({{'s': c1.s, 'e': c1.e, 'apart': apart, 'heads': heads, 'a': s0.ends, 'z': e.ends, 'out': []::STRUCT(s BIGINT, e BIGINT)[]}} ORDER BY c1.s) AS x FROM c1 JOIN sz e ON e.path = c1.path AND e.i = c1.e JOIN sz s0 ON s0.path = c1.path AND s0.i = c1.s - 1 GROUP BY c1.path),
rd AS (SELECT path, list_reduce(x, lambda h, c: CASE WHEN NOT c.apart AND NOT (c.heads AND h.e - h.s + 1 >= 5) AND c.e - h.s < 60 AND c.z - 1 - h.a <= 1600 THEN {{'s': h.s, 'e': c.e, 'apart': h.apart, 'heads': h.heads, 'a': h.a, 'z': c.z, 'out': h.out}} ELSE {{'s': c.s, 'e': c.e, 'apart': c.apart, 'heads': c.heads, 'a': c.a, 'z': c.z, 'out': list_append(h.out, {{'s': h.s, 'e': h.e}})}} END) AS h FROM cl)
SELECT path, u.s::INT AS start, u.e::INT AS "end" FROM (SELECT path, unnest(list_append(h.out, {{'s': h.s, 'e': h.e}})) AS u FROM rd)"""


@add(_SPANS)
def txt_01_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where all documents, as files, are cut into chunks."""
    return chunks.split_files(_files(spark, d)).select("path", "start", "end")


@add()
def txt_01_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files, cut into chunks."""
    return chunks.split_files(_files(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).filter("body is not null").select("doc", F.posexplode(F.split(F.replace("body", F.lit("\r\n"), F.lit("\n")), "\n")).alias("i", "line"))


_LINES = "l AS (SELECT chunk_id AS doc, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS i, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM corpus WHERE text IS NOT NULL)"
_BLANK = r"[\t\n\v\f\r\x{85}\p{Z}]"


@add(f"WITH {_LINES} SELECT doc, sum(length(line))::BIGINT AS chars, count(*) AS lines, max(run)::BIGINT AS last FROM (SELECT *, sum(length(line)) OVER (PARTITION BY doc ORDER BY i) AS run FROM l) GROUP BY doc")
def txt_05_prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = _lines(spark, d).withColumn("n", F.char_length("line").cast("long")).withColumn("run", F.sum("n").over(w))
    return x.groupBy("doc").agg(F.sum("n").alias("chars"), F.count("*").alias("lines"), F.max("run").alias("last"))


@add(rf"WITH {_LINES} SELECT doc, i::INT AS i, length(replace(regexp_extract(line, '^{_BLANK}*'), chr(9), '    ')) AS indent, regexp_matches(line, '^{_BLANK}*([}})\]]|</|(end|fi|done|esac)($|[^\p{{L}}\p{{N}}\p{{M}}_]))') AS closes, regexp_matches(line, '^(={{3,}}|-{{3,}})\s*$') AS rule FROM l")
def txt_08_line_facts(spark: SparkSession, d: str) -> DataFrame:
    """Indentation, closing tokens and rules of all lines."""
    return _lines(spark, d).select("doc", "i", chunks.indent_column(F.col("line")).alias("indent"), chunks.closes_column(F.col("line")).alias("closes"), chunks.rule_column(F.col("line")).alias("rule"))


@add()
def txt_10_declared(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc", "i", chunks.declared_column(F.col("line")).alias("name")).filter("name is not null")


_EXT = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))"


@add(rf"SELECT path, {_EXT} IN ('md', 'markdown', 'mdx', 'rst', 'adoc', 'txt', 'org') AS prose, {_EXT} IN ('md', 'markdown', 'mdx', 'rst', 'adoc', 'txt', 'org', 'html', 'htm', 'xml', 'yaml', 'yml', 'json', 'jsonl', 'toml', 'csv') AS doc FROM (SELECT DISTINCT path FROM corpus)")
def txt_12_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = corpus(spark, d).select("path").distinct()
    return p.select("path", chunks.is_prose(F.col("path")).alias("prose"), chunks.is_doc(F.col("path")).alias("doc"))


@add("SELECT chunk_id AS doc FROM corpus WHERE regexp_matches(text, '(?mi)^.*retry queue')")
def txt_18_grep(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).filter(tx.smart_match(F.col("body"), "^.*retry queue")).select("doc")


@add(r"SELECT chunk_id AS doc, regexp_matches(regexp_replace(p, '\\.', '', 'g'), '\p{Lu}') AS upper FROM (SELECT chunk_id, coalesce(symbol, '') || '\S' || left(coalesce(text, ''), 12) AS p FROM corpus)")
def txt_19_has_upper(spark: SparkSession, d: str) -> DataFrame:
    """Whether patterns, of symbols, an escape and beginnings of texts, have an uppercase letter."""
    p = F.concat(F.coalesce("symbol", F.lit("")), F.lit(r"\S"), F.substring(F.coalesce("body", F.lit("")), 1, 12))
    return corpus(spark, d).select("doc", tx.has_upper(p).alias("upper"))


# ---- index and search ----

_T = lambda f: f"regexp_extract_all(lower(coalesce({f}, '')), '[a-z0-9]+')"
_INDEX = f"""
dt AS (SELECT chunk_id AS doc, path AS p, {_T('path')} AS tp, {_T('symbol')} AS ts, {_T('text')} AS tb FROM corpus),
st AS (SELECT avg(len(tp)) AS ap, avg(len(ts)) AS as_, avg(len(tb)) AS ab, count(*) AS n FROM dt),
ex AS (SELECT doc, unnest(tp) AS term, 1 AS f FROM dt UNION ALL SELECT doc, unnest(ts), 2 FROM dt UNION ALL SELECT doc, unnest(tb), 3 FROM dt),
tf AS (SELECT doc, term, sum((f = 1)::INT) AS p, sum((f = 2)::INT) AS s, sum((f = 3)::INT) AS b FROM ex GROUP BY doc, term),
po AS (SELECT tf.doc, tf.term, tf.p, tf.s, tf.b, tf.p * 2.0::DOUBLE / (0.5 + 0.5 * len(tp) / ap) + tf.s * 3.0::DOUBLE / (0.5 + 0.5 * len(ts) / as_) + tf.b * 1.0::DOUBLE / (0.25 + 0.75 * len(tb) / ab) AS w FROM tf JOIN dt USING (doc), st),
df AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM po GROUP BY term),
qt AS (SELECT query_id, unnest(list_distinct({_T('query')})) AS term FROM q),
sc AS (SELECT query_id, doc, floor(sum(idf * w / (1.2::DOUBLE + w)) * 1e9 + 0.5) / 1e9 AS score FROM qt JOIN df USING (term) JOIN po USING (term) GROUP BY query_id, doc)"""


def _index(spark: SparkSession, d: str) -> lexical.Index:
    return lexical.build_index(corpus(spark, d), lexical.simple_terms, lambda x: stored(x, "index"))


@add(f"WITH {_Q}, {_INDEX} SELECT term, df, round(idf * 1e6) / 1e6 AS idf FROM df")
def lex_13_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).frequencies.select("term", "df", r6(F.col("idf")).alias("idf"))


@add(f"WITH {_Q}, {_INDEX} SELECT doc, count(*) AS terms, sum(p)::BIGINT AS tf_path, sum(s)::BIGINT AS tf_symbol, sum(b)::BIGINT AS tf_body, round(sum(w) * 1e4) / 1e4 AS weight FROM po GROUP BY doc")
def lex_13_postings(spark: SparkSession, d: str) -> DataFrame:
    p = _index(spark, d).postings
    return p.groupBy("doc").agg(F.count("*").alias("terms"), *(F.sum(f"tf_{f}").alias(f"tf_{f}") for f in lexical.WEIGHTS), (F.round(F.sum("weight") * 1e4) / 1e4).alias("weight"))


@add(f"WITH {_Q}, {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * 1e9) DESC, doc) AS rank FROM sc) SELECT query_id, doc, round(score * 1e6) / 1e6 AS score FROM r")
def lex_14_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25F of every chunk for each question."""
    s = lexical.scores(_index(spark, d), asked(spark), lexical.simple_terms)
    return s.select("query_id", "doc", r6(F.col("score")).alias("score"))


@add("""WITH a AS (SELECT c_nationkey, c_custkey AS doc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r1, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS r2 FROM customer)
SELECT c_nationkey, doc, round((1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2)) * 1e9) / 1e9 AS score FROM a""")
def lex_15_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of each nation's customers fused."""
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("doc"), "c_acctbal", "c_name")
    w = lambda *o: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*o, "doc"))
    a = c.select("c_nationkey", "doc", F.lit(1).alias("ranking"), w(F.desc("c_acctbal")).alias("rank")).unionByName(c.select("c_nationkey", "doc", F.lit(2).alias("ranking"), w("c_name").alias("rank")))
    return lexical.rrf(a, by=["c_nationkey"]).select("c_nationkey", "doc", (F.round(F.col("score") * 1e9) / 1e9).alias("score"))


@add(f"WITH {_Q}, {_INDEX}, fi AS (SELECT path, min(chunk_id) AS f FROM corpus GROUP BY path), fc AS (SELECT c.path, term, max(p) AS p, sum(s) AS s, sum(b) AS b FROM po JOIN corpus c ON c.chunk_id = po.doc GROUP BY c.path, term) SELECT fi.f AS doc, count(*) AS terms, sum(p)::BIGINT AS tf_path, sum(s)::BIGINT AS tf_symbol, sum(b)::BIGINT AS tf_body FROM fc JOIN fi USING (path) GROUP BY fi.f")
def lex_16_files(spark: SparkSession, d: str) -> DataFrame:
    """The index of whole files, from the counts of their chunks."""
    c = corpus(spark, d)
    f = lexical.file_counts(stored(lexical.term_counts(c, lexical.simple_terms), "counts"), c)
    return f.groupBy("doc").agg(F.count("*").alias("terms"), *(F.sum(f"tf_{x}").alias(f"tf_{x}") for x in lexical.WEIGHTS))


_IS_DOC = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1)) IN ('md', 'markdown', 'mdx', 'rst', 'adoc', 'txt', 'org', 'html', 'htm', 'xml', 'yaml', 'yml', 'json', 'jsonl', 'toml', 'csv')"
_RECALL = f"""{_Q}, {_INDEX},
fi AS (SELECT path, min(chunk_id) AS f FROM corpus GROUP BY path),
fc AS (SELECT c.path, term, max(p) AS p, sum(s) AS s, sum(b) AS b FROM po JOIN corpus c ON c.chunk_id = po.doc GROUP BY c.path, term),
fl AS (SELECT path, sum(p) AS lp, sum(s) AS ls, sum(b) AS lb FROM fc GROUP BY path),
fn AS (SELECT count(*) AS n FROM fi),
fa AS (SELECT sum(lp) / (SELECT n FROM fn) AS ap, sum(ls) / (SELECT n FROM fn) AS as_, sum(lb) / (SELECT n FROM fn) AS ab FROM fl),
fw AS (SELECT path, term, p * 2.0::DOUBLE / (0.5 + 0.5 * lp / ap) + s * 3.0::DOUBLE / (0.5 + 0.5 * ls / as_) + b * 1.0::DOUBLE / (0.25 + 0.75 * lb / ab) AS w FROM fc JOIN fl USING (path), fa),
fd AS (SELECT term, ln(1 + ((SELECT n FROM fn) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM fc GROUP BY term),
fs AS (SELECT query_id, path, floor(sum(idf * w / (1.2::DOUBLE + w)) * 1e9 + 0.5) / 1e9 AS score FROM qt JOIN fd USING (term) JOIN fw USING (term) GROUP BY query_id, path),
fr AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS file_rank FROM fs JOIN fi USING (path)),
ra AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r1 FROM sc),
op AS (SELECT fr.query_id, c.chunk_id AS doc, c.path, r1, row_number() OVER (PARTITION BY fr.query_id ORDER BY file_rank, coalesce(score, 0) DESC, c.chunk_id) AS r2 FROM fr JOIN corpus c USING (path) LEFT JOIN ra ON ra.query_id = fr.query_id AND ra.doc = c.chunk_id),
fu AS (SELECT query_id, doc, path, {_IS_DOC} AS second, CASE WHEN r1 IS NULL THEN 1.0::DOUBLE / (60 + r2) ELSE 1.0::DOUBLE / (60 + least(r1, r2)) + 1.0::DOUBLE / (60 + greatest(r1, r2)) END AS score FROM op),
al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, second) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, second ORDER BY score DESC, doc) AS r FROM fu)),
rc AS (SELECT query_id, doc, path, position FROM al WHERE position <= 64)"""


@add()
def lex_17_recall(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each question with the full analyser."""
    return lexical.recall(corpus(spark, d), asked(spark), 64, keep=lambda x: stored(x, "recall")).select("query_id", "doc", "path", "position")


def _recalled(spark: SparkSession, d: str, n: int = 64) -> DataFrame:
    return lexical.recall(corpus(spark, d), asked(spark), n, lexical.simple_terms, lambda x: stored(x, "recall"))


@add(f"WITH {_RECALL} SELECT query_id, doc, path, position FROM rc")
def lex_17_recall_words(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each question by plain words."""
    return _recalled(spark, d).select("query_id", "doc", "path", "position")


@add(f"WITH {_RECALL} SELECT query_id, chunk_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(position, 9223372036854775807), chunk_id) AS position FROM (SELECT query_id, chunk_id FROM q, corpus) LEFT JOIN (SELECT query_id, doc AS chunk_id, position FROM al) USING (query_id, chunk_id)")
def srt_03_all_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk in recall order, those of no ranking at the end."""
    return _recalled(spark, d, 0).select("query_id", "doc", "position")


@add(f"WITH {_Q}, {_INDEX} SELECT query_id, doc, rank FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= 5")
def win_02_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The best five chunks of each question."""
    return lexical.search(_index(spark, d), asked(spark), 5, lexical.simple_terms).select("query_id", "doc", "rank")


@add("""WITH a AS (SELECT o_orderkey AS doc, o_orderpriority = '1-URGENT' AS second, o_orderstatus AS g, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY g, second ORDER BY rank) AS r FROM a) SELECT g, doc, row_number() OVER (PARTITION BY g ORDER BY r, second) AS position FROM b""")
def win_03_alternate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderpriority") == "1-URGENT").alias("second"), F.col("o_orderstatus").alias("g"), F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")).alias("rank"))
    return lexical.alternate(o, F.col("second"), ["g"]).select("g", "doc", "position")


@add(f"WITH {_LINES}, m AS (SELECT doc, i, (length(line) - length(replace(line, 'the', ''))) // 3 AS marks FROM l), s AS (SELECT doc, i, sum(marks) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS m FROM m) SELECT doc, arg_min(i, struct_pack(m := -m, i := i))::INT AS line, max(m)::BIGINT AS marks FROM s GROUP BY doc")
def lex_19_window(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor((F.char_length("line") - F.char_length(F.replace("line", F.lit("the"), F.lit("")))) / 3).cast("long")
    x = _lines(spark, d).select("doc", "i", n.alias("marks"))
    return lexical.best_window(x, 6, ["doc"], "i").select("doc", "line", "marks")


@add(r"""WITH l AS (SELECT chunk_id AS doc, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS x FROM corpus WHERE text IS NOT NULL),
f AS (SELECT *, min(CASE WHEN trim(x) <> '' THEN length(x) - length(ltrim(x)) END) OVER (PARTITION BY doc) AS pad FROM l WHERE i <= 6)
SELECT doc, string_agg(lpad(i::VARCHAR, 5, ' ') || ' | ' || substr(x, coalesce(pad, 0) + 1), chr(10) ORDER BY i) AS snippet FROM f GROUP BY doc""")
def lex_20_snippets(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d).filter("body is not null")
    return c.select("doc", lexical.snippet(F.col("body"), F.lit(1), F.lit(1), 6).alias("snippet"))


# ---- descent and rerank ----

_PAIR = "(1 / (1 + exp(-" + HASHED_SQL + ")))"


def _score(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stand-in relevance: a hash of the question and what is read."""
    return df.withColumn("p", 1 / (1 + F.exp(-hashed(F.col("query_id").cast("string"), F.col(text)))))


@add()
def tre_01_descend(spark: SparkSession, d: str) -> DataFrame:
    score = lambda p: _score(p, "key", "preview").select("query_id", "key", "p")
    return descend.descend(stored(corpus(spark, d), "chunks"), asked(spark), score, beam=3)


_TREE = f"""{_Q}, RECURSIVE_MARK
fl AS (SELECT path, count(*) AS n, regexp_replace(regexp_extract(path, '^(.*/)[^/]*$', 1), '/$', '') AS dir FROM corpus GROUP BY path),
fo AS (SELECT dir, regexp_replace(regexp_extract(dir, '^(.*/)[^/]*$', 1), '/$', '') AS parent FROM (SELECT DISTINCT unnest(list_transform(range(1, len(x) + 1), lambda i: array_to_string(x[1:i], '/'))) AS dir FROM (SELECT string_split(dir, '/') AS x FROM fl WHERE dir <> ''))),
fr(query_id, kind, key, path, first, n) AS (
  SELECT query_id, 'dir', dir, NULL::VARCHAR, 0::BIGINT, 0::BIGINT FROM q, fo WHERE parent = '' UNION ALL SELECT query_id, 'file', path, path, 0, n FROM q, fl WHERE dir = ''
  UNION ALL
  SELECT query_id, k.kind, k.key, k.path, k.first, k.n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY {_PAIR.format("query_id || ':' || key")} DESC, key) AS r FROM fr WHERE kind = 'dir' OR n > 4) o,
    LATERAL (SELECT 'dir' AS kind, dir AS key, NULL::VARCHAR AS path, 0::BIGINT AS first, 0::BIGINT AS n FROM fo WHERE o.kind = 'dir' AND fo.parent = o.key
      UNION ALL SELECT 'file', fl.path, fl.path, 0, fl.n FROM fl WHERE o.kind = 'dir' AND fl.dir = o.key
      UNION ALL SELECT 'group', o.path || chr(1) || lpad((o.first + g.i * o.n // 4)::VARCHAR, 9, '0'), o.path, o.first + g.i * o.n // 4, (g.i + 1) * o.n // 4 - g.i * o.n // 4 FROM generate_series(0, 3) g(i) WHERE o.kind <> 'dir') k
  WHERE o.r <= 3),
pl AS (SELECT chunk_id AS doc, path, row_number() OVER (PARTITION BY path ORDER BY chunk_id) - 1 AS at FROM corpus),
rd0 AS (SELECT fr.query_id, fr.key, {_PAIR.format("fr.query_id || ':' || fr.key")} AS p, pl.doc, min(pl.doc) OVER (PARTITION BY fr.query_id, fr.key) AS lo FROM fr JOIN pl ON pl.path = fr.path AND pl.at >= fr.first AND pl.at < fr.first + fr.n WHERE fr.kind <> 'dir' AND fr.n <= 4),
td AS (SELECT query_id, doc, p, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, lo, doc) AS position FROM rd0)"""


def _by_key(p: DataFrame) -> DataFrame:
    """A stand-in score that doesn't depend on previews."""
    return _score(p.withColumn("text", F.replace("key", F.lit("\x00"), F.lit("\x01"))), "key", "text").select("query_id", "key", "p")


@add(f"WITH RECURSIVE {_TREE.replace('RECURSIVE_MARK', '')} SELECT query_id, doc, round(p * 1e6) / 1e6 AS p, position::INT AS position FROM td")
def tre_01_descend_by_key(spark: SparkSession, d: str) -> DataFrame:
    t = descend.descend(stored(corpus(spark, d), "chunks"), asked(spark), _by_key, beam=3)
    return t.select("query_id", "doc", r6(F.col("p")).alias("p"), "position")


@add(f"""WITH RECURSIVE {_TREE.replace('RECURSIVE_MARK', '')}, {_RECALL[len(_Q) + 2:].replace("fl AS (", "fl2 AS (").replace("JOIN fl USING", "JOIN fl2 USING").replace("FROM fl)", "FROM fl2)").replace("fr AS (", "fr2 AS (").replace("fr.query_id", "fr2.query_id").replace("FROM fr JOIN corpus", "FROM fr2 JOIN corpus")},
ex2 AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY position, doc) AS r FROM td WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.query_id = td.query_id AND rc.doc = td.doc)),
bo AS (SELECT query_id, doc, position AS r, false AS t FROM rc UNION ALL SELECT query_id, doc, r, true FROM ex2 WHERE r <= 24)
SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY r, t)::INT AS position FROM bo""")
def tre_15_reach(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates united with what the descent reaches."""
    c = stored(corpus(spark, d), "chunks")
    lex = stored(_recalled(spark, d).select("query_id", "doc", "path", "position"), "lexical")
    return lexical.union_candidates(lex, descend.descend(c, asked(spark), _by_key, beam=3))


@add("SELECT lo, n, unnest(list_transform([0, 1, 2, 3], lambda i: lo + (i * n // 4))) AS part FROM (SELECT p_partkey AS lo, p_size + 4 AS n FROM part)")
def tre_03_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("lo"), (F.col("p_size") + 4).alias("n"))
    return p.select("lo", "n", F.explode(descend.split_range(F.col("lo"), F.col("n"))).alias("g")).select("lo", "n", F.col("g.lo").alias("part"))


@add(f"WITH l AS (SELECT chunk_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS i, left(unnest(string_split(text, chr(10))), 1200) AS line FROM corpus WHERE text IS NOT NULL), c AS (SELECT doc, i, line, sum(length(line) + CASE WHEN fresh THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS n FROM (SELECT *, coalesce(bool_and(line = '') OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM l)), s AS (SELECT doc, i, line, max(n) OVER (PARTITION BY doc ORDER BY i) AS m FROM c) SELECT doc, ltrim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE m <= 1200), ''), chr(10)) AS preview FROM s GROUP BY doc")
def tre_04_previews(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every chunk packed to a preview."""
    c = corpus(spark, d).filter("body is not null")
    return c.select("doc", descend.pack_column(F.split("body", "\n")).alias("preview"))


@add(r"SELECT chunk_id AS doc, md5(array_to_string(list_filter(list_transform(flatten(list_transform(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_\x27]+'), lambda r: string_split(trim(r, chr(39)), '_'))), lambda s: string_split(" + _CUT + r", chr(1)))), lambda w: lower(w)), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+')), ' ')) AS words FROM corpus")
def tre_12_words(spark: SparkSession, d: str) -> DataFrame:
    """The plain words of every chunk."""

    @F.pandas_udf(T.StringType())
    def said(text):
        return text.map(lambda t: " ".join(descend.words(t or "")))

    return spread(corpus(spark, d)).select("doc", F.md5(said("body")).alias("words"))


@add()
def tre_10_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Plain words of every chunk, and how many of its lines are only comment."""
    kind = T.StructType([T.StructField("words", T.StringType()), T.StructField("comment_lines", T.IntegerType())])

    @F.pandas_udf(kind)
    def run(path, text):
        import pandas as pd

        out = [descend.scrub(p, t or "") for p, t in zip(path, text)]
        return pd.DataFrame({"words": ["\n".join(t for t, _ in x) for x in out], "comment_lines": [sum(not c for _, c in x) for x in out]})

    return spread(corpus(spark, d)).withColumn("s", run("path", "body")).select("doc", "s.words", "s.comment_lines")


@add("SELECT path, CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) = 'py' THEN 'python' WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('sh', 'bash', 'zsh', 'yml', 'yaml', 'toml', 'rb', 'mk', 'ini', 'cfg', 'conf') OR regexp_extract(path, '([^/]*)$', 1) IN ('Makefile', 'Dockerfile') THEN 'hash' WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) = 'rs' THEN 'rust' ELSE 'slash' END AS syntax FROM (SELECT DISTINCT path FROM corpus)")
def tre_13_syntax(spark: SparkSession, d: str) -> DataFrame:
    p = corpus(spark, d).select("path").distinct()
    return p.select("path", descend.syntax_column(F.col("path")).alias("syntax"))


@add("SELECT path, array_to_string(list(symbol ORDER BY first), '|') AS symbols FROM (SELECT path, symbol, min(chunk_id) AS first FROM corpus WHERE symbol IS NOT NULL GROUP BY path, symbol) GROUP BY path")
def tre_14_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = corpus(spark, d).filter("symbol is not null").groupBy("path", "symbol").agg(F.min("doc").alias("at"))
    return s.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "|").alias("symbols"))


_READ = f"""{_RECALL}, rd AS (SELECT query_id, doc, position, {_PAIR.format("query_id || ':' || doc")} AS p FROM rc)"""


def _read(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of every question, read with stand-in scores."""
    r = _recalled(spark, d).select("query_id", "doc", "position", F.col("doc").cast("string").alias("text"))
    return stored(_score(r, "doc", "text").select("query_id", "doc", "position", "p"), "read")


@add(f"WITH {_READ} SELECT query_id, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, position) AS rank FROM rd WHERE p >= 0.9::DOUBLE) WHERE rank <= 10")
def rnk_05_pick(spark: SparkSession, d: str) -> DataFrame:
    return search.pick(_read(spark, d), 10, 0.9).select("query_id", "doc", "rank")


@add(f"WITH {_READ}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, position) AS rank FROM rd) SELECT query_id, doc, rank, false AS hit FROM r WHERE rank <= 3 AND p >= 0.2")
def rnk_06_shown(spark: SparkSession, d: str) -> DataFrame:
    """No score reaches the threshold, so the best three above the floor are shown."""
    return search.shown(_read(spark, d), 10, 0.99).select("query_id", "doc", "rank", "hit")


@add(f"""WITH {_RECALL}, rd AS (SELECT query_id, doc, position, (position - 1) // 16 AS wave, {_PAIR.format("query_id || ':' || coalesce(text, '')")} AS p FROM rc JOIN corpus c ON c.chunk_id = rc.doc),
wv AS (SELECT query_id, wave, sum((p >= 0.5)::INT) AS added FROM rd GROUP BY query_id, wave),
cu AS (SELECT *, sum(added) OVER (PARTITION BY query_id ORDER BY wave) AS hits FROM wv),
en AS (SELECT query_id, min(wave) AS last FROM cu WHERE added = 0 AND hits >= 3 GROUP BY query_id)
SELECT query_id, doc, position, round(p * 1e6) / 1e6 AS p FROM rd LEFT JOIN en USING (query_id) WHERE wave <= coalesce(last, 99)""")
def rnk_01_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates read wave by wave until three hits are in and a wave adds none."""
    c = corpus(spark, d).select("doc", "body")
    cand = _recalled(spark, d).select("query_id", "doc", "position")
    score = lambda x: _score(x.join(c, "doc").withColumn("text", F.coalesce("body", F.lit(""))), "doc", "text").select("query_id", "doc", "position", "p")
    return search.rerank(cand, score, 3, 0.5, wave=16).select("query_id", "doc", "position", r6(F.col("p")).alias("p"))


_WAVES = """WITH s AS (SELECT path, list({'n': length(text)::BIGINT, 'w': 0::BIGINT, 'l': (4000 - length(text))::BIGINT} ORDER BY chunk_id) AS x FROM corpus WHERE text IS NOT NULL GROUP BY path),
z AS (SELECT path, list_reduce(x, lambda a, b: CASE WHEN b.n > a.l THEN {'n': b.n, 'w': a.w + 1, 'l': 4000 - b.n} ELSE {'n': b.n, 'w': a.w, 'l': a.l - b.n} END) AS e FROM s)
SELECT path, (e.w + 1)::INT AS waves FROM z"""


@add(_WAVES)
def rnk_03_waves(spark: SparkSession, d: str) -> DataFrame:
    """Waves that the chunks of each file take when 4000 characters fit one."""
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("doc", F.char_length("body").alias("n")))), lambda x: x["n"])
    one = corpus(spark, d).filter("body is not null").groupBy("path").agg(sizes.alias("sizes"))
    return one.select("path", (F.array_max(search.waves(F.col("sizes"), 4000)) + 1).alias("waves"))


_ANCHORS = "anc AS (SELECT query_id, ('0x' || substr(md5(path), 1, 8))::BIGINT AS anchor, path, 'the' AS contains FROM q, (SELECT DISTINCT path FROM corpus))"


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """For each question any chunk of each path that holds "the"."""
    p = corpus(spark, d).select("path").distinct().withColumn("anchor", F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long"))
    return F.broadcast(asked(spark).select("query_id")).join(p).select("query_id", "anchor", "path", F.lit("the").alias("contains"))


_RANKS = f"WITH {_READ}, {_ANCHORS}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, position) AS rank FROM rd), ar AS (SELECT a.query_id, a.anchor, min(CASE WHEN contains(c.text, a.contains) THEN r.rank END) AS rank FROM anc a LEFT JOIN (rk r JOIN corpus c ON c.chunk_id = r.doc) ON r.query_id = a.query_id AND c.path = a.path GROUP BY ALL)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("p"), "position")
    return _read(spark, d).withColumn("rank", F.row_number().over(w))


@add(f"{_RANKS} SELECT query_id, anchor, rank FROM ar")
def rnk_08_anchor_ranks(spark: SparkSession, d: str) -> DataFrame:
    return search.anchor_ranks(_ranked(spark, d), _anchors(spark, d), corpus(spark, d))


_ATK = ", ".join(f"round(avg(CASE WHEN coalesce(rank, 2147483647) <= {k} THEN 1.0 ELSE 0 END) * 1e6) / 1e6 AS recall_{k}" for k in (1, 5, 10, 64))


@add(f"{_RANKS} SELECT query_id, count(*) AS anchors, {_ATK}, round(coalesce(1.0::DOUBLE / min(rank), 0) * 1e6) / 1e6 AS rr FROM ar GROUP BY query_id")
def rnk_11_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = search.retrieval_metrics(search.anchor_ranks(_ranked(spark, d), _anchors(spark, d), corpus(spark, d)))
    return m.select("query_id", "anchors", *(r6(F.col(f"recall_{k}")).alias(f"recall_{k}") for k in search.KS), r6(F.col("rr")).alias("rr"))


_SUMMARY = "kd AS (SELECT unnest(['all', CASE WHEN query_id % 2 = 0 THEN 'concept' ELSE 'lexical' END]) AS kind, * FROM pq) SELECT kind, count(*) AS n, round(avg((coalesce(first, 0) = 1)::INT) * 1e6) / 1e6 AS hit_1, " + ", ".join(f"round(avg(k{k}) * 1e6) / 1e6 AS recall_{k}" for k in (1, 5, 10, 64)) + ", round(avg(coalesce(1.0::DOUBLE / first, 0)) * 1e6) / 1e6 AS mrr, round(avg((k64 >= 1)::INT) * 1e6) / 1e6 AS all_met FROM kd GROUP BY kind"
_PER_QUERY = "pq AS (SELECT query_id, min(rank) AS first, " + ", ".join(f"avg((coalesce(rank, 2147483647) <= {k})::INT) AS k{k}" for k in (1, 5, 10, 64)) + " FROM ar GROUP BY query_id)"


def _summed(m: DataFrame) -> DataFrame:
    return m.select("kind", "n", *(r6(F.col(c)).alias(c) for c in ("hit_1", *(f"recall_{k}" for k in search.KS), "mrr", "all_met")))


@add(f"{_RANKS}, {_PER_QUERY}, {_SUMMARY}")
def rnk_12_summary(spark: SparkSession, d: str) -> DataFrame:
    m = search.retrieval_metrics(search.anchor_ranks(_ranked(spark, d), _anchors(spark, d), corpus(spark, d)))
    return _summed(search.retrieval_summary(m.withColumn("kind", F.when(F.col("query_id") % 2 == 0, "concept").otherwise("lexical"))))


@add("SELECT chunk_id AS doc, substr(sha256(substr(path || chr(10) || coalesce(text, ''), 1, 3200)), 1, 32) AS key FROM corpus")
def rnk_14_content_key(spark: SparkSession, d: str) -> DataFrame:
    """Content addresses of what a probe reads of every chunk."""
    return corpus(spark, d).select("doc", search.content_key(search.probe_state(F.col("path"), F.col("body"))).alias("key"))


_KEYS = "ky AS (SELECT chunk_id, substr(sha256(substr(path || chr(10) || coalesce(text, ''), 1, 3200)), 1, 32) AS key FROM corpus)"


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A store of a third of the chunks and of some documents, and the keys of all chunks."""
    k = corpus(spark, d).select("doc", search.content_key(search.probe_state(F.col("path"), F.col("body"))).alias("key"))
    old = table(spark, d, "documents").filter("doc_id % 5 = 0").select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.lit(1).alias("v")).distinct()
    return search.store_put(old, k.filter("doc % 3 = 0").select("key", F.lit(2).alias("v"))), k.select("key")


_STORE = f"{_KEYS}, od AS (SELECT DISTINCT md5(coalesce(text, '')) AS key FROM documents WHERE doc_id % 5 = 0), stt AS (SELECT key, 1 AS v FROM od UNION ALL SELECT DISTINCT key, 2 FROM ky WHERE chunk_id % 3 = 0 AND key NOT IN (SELECT key FROM od))"


@add(f"WITH {_STORE} SELECT (SELECT count(DISTINCT key) FROM ky) AS wanted, (SELECT count(*) FROM stt WHERE key IN (SELECT key FROM ky)) AS held, (SELECT count(*) FROM stt WHERE key NOT IN (SELECT key FROM ky)) AS stale")
def rnk_16_store(spark: SparkSession, d: str) -> DataFrame:
    """How much of the corpus a store holds, and what of it is stale."""
    return search.store_coverage(*_store(spark, d))


@add(f"WITH {_STORE} SELECT key, v FROM stt WHERE key IN (SELECT key FROM ky)")
def semi_01_live(spark: SparkSession, d: str) -> DataFrame:
    """The store after compaction."""
    return search.store_compact(*_store(spark, d)).select("key", "v")


@add(f"WITH {_READ} SELECT query_id, path, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, position) AS rank FROM rd WHERE p >= 0.9::DOUBLE) r JOIN corpus c ON c.chunk_id = r.doc WHERE rank <= 10 GROUP BY query_id, path")
def snk_09_paths(spark: SparkSession, d: str) -> DataFrame:
    return search.hit_paths(search.pick(_read(spark, d), 10, 0.9), corpus(spark, d))


@add()
def snk_07_document(spark: SparkSession, d: str) -> DataFrame:
    return search.hits_document(search.pick(_read(spark, d), 10, 0.9), corpus(spark, d))


@add(f"""WITH {_READ}, hi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, position) AS rank FROM rd WHERE p >= 0.9::DOUBLE),
h AS (SELECT query_id, rank, path, start_line, array_to_string(string_split(text, chr(10))[1:6], chr(10)) AS head FROM hi JOIN corpus c ON c.chunk_id = hi.doc WHERE rank <= 10)
SELECT query_id, count(*)::INT AS hits, max(CASE WHEN rank = 1 THEN path END) AS path, max(CASE WHEN rank = 1 THEN start_line::VARCHAR END) AS start, md5(max(CASE WHEN rank = 2 THEN head END)) AS head FROM h GROUP BY query_id""")
def snk_07_fields(spark: SparkSession, d: str) -> DataFrame:
    """What the documents of hits say: how many, where the first is, and how the second begins."""
    doc = snk_07_document(spark, d)
    at = lambda path: F.get_json_object("document", path)
    return doc.select("query_id", F.size(F.from_json(at("$.hits"), "array<string>")).alias("hits"), at("$.hits[0].path").alias("path"), at("$.hits[0].start").alias("start"), F.md5(at("$.hits[1].head")).alias("head"))


@add()
def rnk_07_search(spark: SparkSession, d: str) -> DataFrame:
    """Searches from question to shown hits on stand-in scores."""
    return search.search(stored(corpus(spark, d), "chunks"), asked(spark), lambda x: _score(x, "query_id", "text"), wave=32)


_EVAL = _RANKS.replace(_PAIR.format("query_id || ':' || doc"), _PAIR.format("query_id || ':' || (SELECT substr(path || chr(10) || coalesce(text, ''), 1, 3200) FROM corpus cc WHERE cc.chunk_id = doc)"))


@add(f"{_EVAL}, {_PER_QUERY}, {_SUMMARY}")
def rnk_13_eval(spark: SparkSession, d: str) -> DataFrame:
    cases = asked(spark).withColumn("kind", F.when(F.col("query_id") % 2 == 0, "concept").otherwise("lexical"))
    return _summed(search.run_eval(stored(corpus(spark, d), "chunks"), cases, _anchors(spark, d), lambda x: _score(x, "query_id", "text"), analyse=lexical.simple_terms)[1])


@add("""WITH p AS (SELECT chunk_id, path, path || '#' || lpad(chunk_id::VARCHAR, 12, '0') AS t FROM corpus), l AS (SELECT *, row_number() OVER w AS place, lag(t) OVER w AS b FROM p WINDOW w AS (PARTITION BY path ORDER BY t)),
s AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE list_max(list_filter(range(0, length(t) + 1), lambda i: left(t, i) = left(b, i))) END AS shared FROM l)
SELECT chunk_id, place::INT AS place, shared::INT AS shared, sum((shared < 20)::INT) OVER (PARTITION BY path ORDER BY place)::BIGINT AS run FROM s""")
def win_08_shared_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """What neighbouring texts, here the names of each file's chunks, have in common."""
    c = corpus(spark, d).select(F.col("doc").alias("chunk_id"), "path", F.concat("path", F.lit("#"), F.lpad(F.col("doc").cast("string"), 12, "0")).alias("prompt"))
    return remote.prefix_groups(c, ["path"], least=20).select("chunk_id", "place", "shared", "run")
