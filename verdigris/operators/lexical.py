"""Field-weighted BM25 over an inverted index, rank fusion and the recall of chunks.

The index is three tables: postings (term, doc, tf of path, symbol and body, and the length-normalised tf*), document
frequencies, and the fields' average lengths (one row). Queries are a table too, so many run in one job; documents
never travel, only the postings of the queries' terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigris.functions.text import run_terms, terms, terms_udf, word_runs
from verdigris.operators.chunks import is_doc
from verdigris.operators.joins import BROADCAST_ROWS, checked_join, hot_join, numbered
from verdigris.session import spread

WEIGHTS = {"path": 2.0, "symbol": 3.0, "body": 1.0}
B = {"path": 0.5, "symbol": 0.5, "body": 0.75}
K1, RRF_K, TREE_CHUNKS, MOST_TF = 1.2, 60.0, 24, 65535


_TF = tuple(f"tf_{f}" for f in WEIGHTS)


@dataclass
class Index:
    """Term counts (doc, term, tf per field), the documents' lengths (doc, len per field), the fields' mean lengths and the
    number of documents. Weights and frequencies follow from these, of all terms or of a query's only."""

    counts: DataFrame
    lens: DataFrame
    mean: dict[str, float]
    docs: int

    def weighted(self, counts: DataFrame) -> DataFrame:
        """counts with weight, the length-normalised and field-weighted frequency tf*."""
        rel = {f: F.col(f"len_{f}") / F.lit(float(self.mean[f])) if self.mean[f] else F.lit(0.0) for f in WEIGHTS}
        weight = sum((F.least(F.lit(MOST_TF), F.col(f"tf_{f}")) * (WEIGHTS[f] / (1 - B[f] + B[f] * rel[f])) for f in WEIGHTS), F.lit(0.0))
        return counts.join(self.lens, "doc").select("term", "doc", *(F.least(F.lit(MOST_TF), F.col(c)).alias(c) for c in _TF), weight.alias("weight"))

    def rarity(self, counts: DataFrame) -> DataFrame:
        """(term, df, idf) of the terms in counts."""
        return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log1p((F.lit(float(self.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    @property
    def postings(self) -> DataFrame:
        return self.weighted(self.counts)

    @property
    def frequencies(self) -> DataFrame:
        return self.rarity(self.counts)


def simple_terms(text: Column) -> Column:
    """Words in lower case, for callers that want no stemming; stays in the JVM."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def term_counts(docs: DataFrame, analyse=terms_udf) -> DataFrame:
    """(doc, path, term, tf_path, tf_symbol, tf_body) of documents (doc, path, symbol, body).

    With the full analyser a document's terms are counted where they are found, in the Python worker, so what comes back is
    one row per document and term; other analysers are column expressions and are counted by an aggregation.
    """
    if analyse is not terms_udf:
        t = docs.select("doc", "path", *(analyse(F.coalesce(f, F.lit(""))).alias(f"t_{f}") for f in WEIGHTS))
        each = t.select("doc", "path", F.explode(F.concat(*map(_tagged, WEIGHTS))).alias("e"))
        return each.groupBy("doc", "path", F.col("e.term").alias("term")).agg(*(F.sum((F.col("e.field") == f).cast("int")).alias(f"tf_{f}") for f in WEIGHTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row: list[int] = []
            term: list[str] = []
            tf: list[list[int]] = [[], [], []]
            for i, fields in enumerate(zip(*(b.column(c).to_pylist() for c in WEIGHTS))):
                counts: dict[str, list[int]] = {}
                for f, text in enumerate(fields):
                    for t in terms(text):
                        c = counts.get(t)
                        if c is None:
                            c = counts[t] = [0, 0, 0]
                        c[f] += 1
                row.extend([i] * len(counts))
                term.extend(counts)
                for f in range(3):
                    tf[f].extend(c[f] for c in counts.values())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(take), b.column("path").take(take), pa.array(term, pa.string()), *(pa.array(x, pa.int64()) for x in tf)], names=["doc", "path", "term", *(f"tf_{f}" for f in WEIGHTS)])

    d = docs.select(F.col("doc").cast("long").alias("doc"), *WEIGHTS)
    return spread(d).mapInArrow(run, "doc long, path string, term string, tf_path long, tf_symbol long, tf_body long")


def _tagged(field: str) -> Column:
    return F.transform(f"t_{field}", lambda x: F.struct(x.alias("term"), F.lit(field).alias("field")))


def index_of(counts: DataFrame, total: int) -> Index:
    """Index of term counts of `total` documents. Lengths are sums of counts, so fields are analysed once; a document's counts
    lie in one place, and partial sums leave one row of it to shuffle."""
    lens = counts.groupBy("doc").agg(*(F.sum(f"tf_{f}").alias(f"len_{f}") for f in WEIGHTS))
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TF)).first()
    return Index(counts, lens, {f: sums[f"tf_{f}"] / total if total else 0.0 for f in WEIGHTS}, total)


def build_index(docs: DataFrame, analyse=terms_udf, keep=lambda df: df) -> Index:
    """Index of documents (doc, path, symbol, body). keep() may store the counts, which are read several times."""
    return index_of(keep(term_counts(docs, analyse)), docs.count())


def file_counts(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Term counts of whole files from those of their chunks: symbols and bodies add up, the path counts once. A file is named
    by its smallest doc. No run of word characters crosses the line end between chunks, so this is what analysing the joined
    texts would give."""
    first = chunks.groupBy("path").agg(F.min("doc").alias("file"))
    per = counts.groupBy("path", "term").agg(F.max("tf_path").alias("tf_path"), F.sum("tf_symbol").alias("tf_symbol"), F.sum("tf_body").alias("tf_body"))
    return per.join(first, "path").select(F.col("file").alias("doc"), "path", "term", "tf_path", "tf_symbol", "tf_body")


def query_terms(queries: DataFrame, analyse=terms_udf) -> DataFrame:
    """(query_id, term) of queries (query_id, query), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(analyse("query"))).alias("term"))


def held_terms(counts: DataFrame, q: DataFrame) -> DataFrame:
    """The counts of the terms asked for; so many terms as queries have at most are counted before they are broadcast."""
    asked = q.select("term").distinct()
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return counts.join(F.broadcast(asked) if few else asked, "term", "left_semi")


def scores(index: Index, queries: DataFrame, analyse=terms_udf) -> DataFrame:
    """(query_id, doc, score) of the documents that share a term with a query (query_id, query): the sum over distinct query
    terms of idf tf* / (k1 + tf*), to nine places, so that the order in which sums were formed decides no rank."""
    q = query_terms(queries, analyse)
    return scored(index, q, held_terms(index.counts, q))


def scored(index: Index, q: DataFrame, held: DataFrame) -> DataFrame:
    """scores of analysed queries, from the counts of the terms asked for."""
    hit = q.join(index.rarity(held).select("term", "idf"), "term").join(index.weighted(held).select("term", "doc", "weight"), "term")
    total = hit.groupBy("query_id", "doc").agg(F.sum(F.col("idf") * F.col("weight") / (K1 + F.col("weight"))).alias("total")).filter("total > 0")
    return total.select("query_id", "doc", (F.floor(F.col("total") * 1e9 + 0.5) / 1e9).alias("score"))


def search(index: Index, queries: DataFrame, k: int | None = None, analyse=terms_udf) -> DataFrame:
    """(query_id, doc, score, rank) of `scores`, best first, the smaller doc on ties; at most k per query. Without k all are
    ranked, by ranges, so that a common word gathers nothing in one task."""
    found = scores(index, queries, analyse)
    if k is None:
        return numbered(found.withColumn("_o", -F.col("score")), ["query_id"], ["_o", "doc"]).drop("_o")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rrf(rankings: DataFrame, k: float = RRF_K, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (by..., ranking, doc, rank from 1): adds up 1 / (k + rank) in rank order, so equal ranks
    give equal sums; (by..., doc, score, rank)."""
    by = by or []
    ranks = rankings.groupBy(*by, "doc").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    fused = ranks.select(*by, "doc", F.aggregate("r", F.lit(0.0), lambda s, x: s + 1.0 / (F.lit(k) + x)).alias("score"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("score"), "doc")
    return fused.withColumn("rank", F.row_number().over(w))


def alternate(ranked: DataFrame, second: Column, by: list[str], order: str = "rank") -> DataFrame:
    """Two classes in turn, each in its own order, the class for which `second` is false first; what is left of either
    follows. Adds position (from 1)."""
    cls = ranked.withColumn("_c", second.cast("int"))
    rn = cls.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_c").orderBy(order)))
    return rn.withColumn("position", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("_r", "_c"))).drop("_c", "_r")


def file_documents(chunks: DataFrame) -> DataFrame:
    """One document per path: symbols and texts of its chunks (doc, path, symbol, body) joined in order. A file's text comes
    together in one row, so this is for files of bounded size; indexes of files are built by file_counts instead."""
    parts = F.sort_array(F.collect_list(F.struct("doc", F.coalesce("symbol", F.lit("")).alias("s"), F.coalesce("body", F.lit("")).alias("b"))))
    g = chunks.groupBy("path").agg(F.min("doc").alias("doc"), parts.alias("p"))
    return g.select("doc", "path", F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("symbol"), F.array_join(F.transform("p", lambda x: x["b"]), "\n").alias("body"))


def recall(chunks: DataFrame, queries: DataFrame, candidates: int = 64, analyse=terms_udf, keep=lambda df: df) -> DataFrame:
    """(query_id, doc, path, position): candidates of each query. Chunks ranked by their own score are fused with files
    ranked by theirs, each opened into its chunks by their own score; then code and documents alternate. candidates = 0
    keeps all, the chunks that no ranking holds in order at the end.

    Both rankings are numbered by ranges, since a common word ranks most of the corpus; of the fused one only the first
    `candidates` of either kind are kept, and these are dropped task by task before they are gathered."""
    where = keep(chunks.select("doc", "path"))
    of_file = keep(where.groupBy("path").agg(F.min("doc").alias("file"), F.count("*").alias("n")))
    n = of_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("files")).first()
    counts = keep(term_counts(chunks, analyse))
    q = keep(query_terms(queries, analyse))
    held = keep(held_terms(counts, q))
    # lengths of chunks, and of files: symbols and bodies add up, the path counts once
    lens = keep(counts.groupBy("doc", "path").agg(*(F.sum(f"tf_{f}").alias(f"len_{f}") for f in WEIGHTS)))
    of_files = keep(lens.groupBy("path").agg(F.max("len_path").alias("len_path"), F.sum("len_symbol").alias("len_symbol"), F.sum("len_body").alias("len_body")).join(of_file, "path").select(F.col("file").alias("doc"), *(f"len_{f}" for f in WEIGHTS)))
    index = lambda c, x, total: Index(c, x, {f: v / total if total else 0.0 for f, v in zip(WEIGHTS, x.agg(*(F.coalesce(F.sum(f"len_{f}"), F.lit(0)) for f in WEIGHTS)).first())}, total)
    by_chunk = scored(index(held, lens.drop("path"), n["chunks"]), q, held).withColumn("_o", -F.col("score"))
    by_chunk = numbered(by_chunk, ["query_id"], ["_o", "doc"]).select("query_id", "doc", "score", F.col("rank").alias("own_rank"))
    held_files = file_counts(held, where)
    files = scored(index(held_files, of_files, n["files"]), q, held_files).withColumn("_o", -F.col("score"))
    files = numbered(files.withColumnRenamed("doc", "file"), ["query_id"], ["_o", "file"], "file_rank").select("query_id", "file", "file_rank")
    ranked = keep(files.join(of_file.select("path", "file"), "file").select("query_id", "file_rank", "path"))
    opened = hot_join(where, ranked, "path", F.col("doc")).join(by_chunk, ["query_id", "doc"], "left").withColumn("_o", -F.coalesce("score", F.lit(0.0)))
    opened = numbered(opened, ["query_id"], ["file_rank", "_o", "doc"]).select("query_id", "doc", "path", "own_rank", "rank")
    # a chunk that matches is in a file that matches; ranks are added from the better one on, so equal ranks give equal sums
    one = lambda r: 1.0 / (F.lit(RRF_K) + r)
    fused = opened.select("query_id", "doc", "path", is_doc(F.col("path")).alias("second"), F.when(F.col("own_rank").isNull(), one(F.col("rank"))).otherwise(one(F.least("own_rank", "rank")) + one(F.greatest("own_rank", "rank"))).alias("score"))
    if candidates:
        w = Window.partitionBy("query_id", "second").orderBy(F.desc("score"), "doc")
        first = fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= candidates)
        return alternate(first, F.col("second"), ["query_id"]).filter(F.col("position") <= candidates).select("query_id", "doc", "path", "position")
    of_kind = keep(numbered(fused.withColumn("_o", -F.col("score")), ["query_id", "second"], ["_o", "doc"]))
    many = of_kind.groupBy("query_id").agg(F.sum(F.col("second").cast("long")).alias("n2"), F.sum((~F.col("second")).cast("long")).alias("n1"))
    # the r-th of a kind comes after r - 1 pairs, as far as the other kind reaches
    place = F.when(F.col("second"), F.col("rank") + F.least("rank", "n1")).otherwise(F.col("rank") + F.least(F.col("rank") - 1, "n2"))
    out = checked_join(of_kind, keep(many), ["query_id"], "inner").select("query_id", "doc", place.alias("place"))
    rest = queries.select("query_id").crossJoin(where).join(out, ["query_id", "doc"], "left").withColumn("place", F.coalesce("place", F.lit(2**62)))
    return numbered(rest, ["query_id"], ["place", "doc"], "position").select("query_id", "doc", "path", "position")


def union_candidates(lexical: DataFrame, tree: DataFrame, most: int = TREE_CHUNKS) -> DataFrame:
    """(query_id, doc, position): the lexical list with up to `most` further picks of the tree's, in turn while both last."""
    extra = tree.join(lexical.select("query_id", "doc"), ["query_id", "doc"], "left_anti").groupBy("query_id", "doc").agg(F.min("position").alias("position"))
    extra = extra.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "doc"))).filter(F.col("position") <= most)
    both = lexical.select("query_id", "doc", "position").withColumn("t", F.lit(False)).unionByName(extra.select("query_id", "doc", "position").withColumn("t", F.lit(True)))
    return alternate(both.withColumnRenamed("position", "rank"), F.col("t"), ["query_id"]).select("query_id", "doc", "position")


@F.pandas_udf(T.ArrayType(T.StringType()))
def matching_words(line: pd.Series, query: pd.Series) -> pd.Series:
    """Words of a line that share a term with the query."""
    wanted: dict[str, set[str]] = {}
    out = []
    for text, q in zip(line, query):
        if q not in wanted:
            wanted[q] = set(terms(q))
        out.append([w for w in word_runs(text) if not wanted[q].isdisjoint(run_terms(w))])
    return pd.Series(out)


def best_window(lines: DataFrame, n: int, by: list[str], order: str = "line", marks: str = "marks") -> DataFrame:
    """Per group the n-line window with most marks, the earliest on ties: (by..., first line, marks)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, n - 1)
    s = lines.select(*by, F.col(order).alias("line"), F.sum(marks).over(w).alias("m"))
    return s.groupBy(*by).agg(F.min(F.struct((-F.col("m")).alias("m"), F.col("line"))).alias("b")).select(*by, F.col("b.line").alias("line"), (-F.col("b.m")).alias("marks"))


def snippet(text: Column, first: Column, from_line: Column, n: int) -> Column:
    """n numbered lines of a chunk from a line on (both counted from 1 in the file), dedented."""
    lines = F.slice(F.split(text, "\r?\n"), from_line - first + 1, n)
    pad = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.char_length(x) - F.char_length(F.ltrim(x))))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((from_line + i).cast("string"), 5, " "), F.lit(" | "), F.substr(x, F.coalesce(pad, F.lit(0)) + 1))), "\n")
