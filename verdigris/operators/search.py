"""Reranking of candidates, the choice of what is shown, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.operators.chunks import is_prose
from verdigris.session import stored

STATE_CHARS, MIN_SHOWN, FLOOR, KS = 3200, 3, 0.2, (1, 5, 10, 64)


def probe_state(path: Column, text: Column) -> Column:
    """What a relevance probe reads of a chunk."""
    return F.substring(F.concat(path, F.lit("\n"), F.coalesce(text, F.lit(""))), 1, STATE_CHARS)


def probe_question(query: Column, path: Column) -> Column:
    """The yes/no question about a chunk, worded for prose or for code; white space of the query is flattened."""
    flat = F.regexp_replace(F.trim(query), r"\s+", " ")
    prose = F.concat(F.lit('Does this passage answer or directly address the search "'), flat, F.lit('"?'))
    code = F.concat(F.lit('Is this code what someone searching for "'), flat, F.lit('" is looking for — does it implement or directly handle it?'))
    return F.when(is_prose(path), prose).otherwise(code)


def waves(sizes: Column, room: int) -> Column:
    """Wave numbers of consecutive candidates, each wave taking as many as fit the room; one that fits nowhere is alone."""
    start = F.struct(F.lit(-1).alias("w"), F.lit(0).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        new = (s["w"] < 0) | (n > s["left"])
        w = s["w"] + new.cast("int")
        return F.struct(w.alias("w"), F.when(new, F.lit(room) - n).otherwise(s["left"] - n).cast("int").alias("left"), F.concat(s["out"], F.array(w)).alias("out"))

    return F.aggregate(sizes.cast("array<int>"), start, step)["out"]


def rerank(candidates: DataFrame, score: Callable[[DataFrame], DataFrame], top: int, threshold: float, wave: int = 64, stop: bool = True) -> DataFrame:
    """(query_id, doc, position, p) of the candidates read, wave by wave in recall order. A query stops after a wave that
    adds no hit once `top` hits are in; without stop every candidate is read in one job. score adds p."""
    if not stop:
        return score(candidates)
    open_ = stored(candidates, "candidates")
    done, read, hits = None, 0, None
    most = open_.agg(F.max("position")).first()[0] or 0
    while read < most:
        part = stored(score(open_.filter((F.col("position") > read) & (F.col("position") <= read + wave))), "wave")
        done = part if done is None else done.unionByName(part)
        read += wave
        added = part.groupBy("query_id").agg(F.sum((F.col("p") >= threshold).cast("int")).alias("added"))
        hits = added.withColumnRenamed("added", "hits") if hits is None else hits.unionByName(added.withColumnRenamed("added", "hits")).groupBy("query_id").agg(F.sum("hits").alias("hits"))
        hits = stored(hits, "hits")
        ended = hits.join(added, "query_id").filter((F.col("hits") >= top) & (F.col("added") == 0)).select("query_id")
        open_ = open_.join(ended, "query_id", "left_anti")
    return done if done is not None else score(candidates)


def pick(read: DataFrame, top: int, threshold: float) -> DataFrame:
    """Hits: p at or above the threshold, the best first (recall order among equals), at most top per query; adds rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("p"), "position")
    return read.filter(F.col("p") >= threshold).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def shown(read: DataFrame, top: int, threshold: float) -> DataFrame:
    """What a search shows: the hits, or where they are fewer than MIN_SHOWN the best down to FLOOR; adds hit and rank."""
    few = min(MIN_SHOWN, top)
    w = Window.partitionBy("query_id").orderBy(F.desc("p"), "position")
    r = read.withColumn("rank", F.row_number().over(w)).withColumn("hit", F.col("p") >= threshold)
    n = F.sum(F.col("hit").cast("int")).over(Window.partitionBy("query_id"))
    r = r.withColumn("_n", F.least(n, F.lit(top)))
    enough = (F.col("_n") >= few) & F.col("hit") & (F.col("rank") <= top)
    fill = (F.col("_n") < few) & (F.col("p") >= min(FLOOR, threshold)) & (F.col("rank") <= few)
    return r.filter(enough | fill).drop("_n")


def anchor_ranks(ranked: DataFrame, anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, anchor, rank): per anchor (query_id, anchor, path, contains) the first rank of a chunk of that path whose
    text contains it; null where there is none."""
    r = ranked.select("query_id", "doc", "rank").join(chunks.select("doc", "path", "body"), "doc")
    m = anchors.join(r, ["query_id", "path"], "left")
    met = F.when(F.contains(F.col("body"), F.col("contains")), F.col("rank"))
    return m.groupBy("query_id", "anchor").agg(F.min(met).alias("rank"))


def retrieval_metrics(ranks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per query: anchors, recall at the ks, reciprocal rank, hit at 1, first rank."""
    at = [F.avg((F.coalesce(F.col("rank"), F.lit(2**31 - 1)) <= k).cast("double")).alias(f"recall_{k}") for k in ks]
    g = ranks.groupBy("query_id").agg(F.count("*").alias("anchors"), *at, F.min("rank").alias("first_rank"))
    return g.withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).withColumn("hit_1", F.coalesce(F.col("first_rank") == 1, F.lit(False)))


def retrieval_summary(per: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over all queries and per kind ('all' and each kind)."""
    r = per.select(*per.columns).withColumn("kind", F.explode(F.array(F.lit("all"), F.col("kind"))))
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.col("hit_1").cast("double")).alias("hit_1"), *(F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks), F.avg("rr").alias("mrr"), F.avg((F.col(f"recall_{ks[-1]}") >= 1).cast("double")).alias("all_met"))


def separation(read: DataFrame, anchors: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """Per query: whether the best p reaches the threshold, the mean p of chunks that meet an anchor and of the others."""
    a = anchors.groupBy("query_id", "path").agg(F.collect_list("contains").alias("cs"))
    r = read.join(chunks.select("doc", "path", "body"), "doc").join(a, ["query_id", "path"], "left")
    met = F.coalesce(F.exists("cs", lambda c: F.contains(F.col("body"), c)), F.lit(False))
    return r.withColumn("met", met).groupBy("query_id").agg((F.max("p") >= threshold).alias("answered"), F.avg(F.when(F.col("met"), F.col("p"))).alias("p_met"), F.avg(F.when(~F.col("met"), F.col("p"))).alias("p_other"))


def content_key(prefix: Column) -> Column:
    """Content address of a prompt's prefix."""
    return F.substring(F.sha2(prefix, 256), 1, 32)


def store_put(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """A content-addressed store after an append: the first record of a key stays."""
    return store.unionByName(fresh.join(store.select("key"), "key", "left_anti").dropDuplicates(["key"]))


def store_compact(store: DataFrame, live: DataFrame) -> DataFrame:
    """The records whose key is still in use."""
    return store.join(live.select("key").distinct(), "key", "left_semi")


def store_coverage(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: keys wanted, how many the store holds, and how many of its records are stale."""
    w = wanted.select("key").distinct()
    held = w.join(store.select("key"), "key", "left_semi").count()
    stale = store.join(w, "key", "left_anti").count()
    return store.sparkSession.createDataFrame([(w.count(), held, stale)], "wanted long, held long, stale long")


def hits_document(shown_: DataFrame, chunks: DataFrame, head: int = 6) -> DataFrame:
    """(query_id, document): the hits as one JSON text per query: path, start, end, symbol, p, first lines."""
    j = shown_.select("query_id", "doc", "rank", "p").join(chunks, "doc")
    one = F.struct("rank", "path", "start", "end", "symbol", "p", F.array_join(F.slice(F.split("body", "\n"), 1, head), "\n").alias("head"))
    return j.groupBy("query_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("rank")).alias("hits"))).alias("document"))


def hit_paths(shown_: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, path, rank): distinct paths in the order of their first hit."""
    j = shown_.select("query_id", "doc", "rank").join(chunks.select("doc", "path"), "doc")
    return j.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))


def render_hits(shown_: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, text): a header and the first lines of each hit, plain text."""
    j = shown_.select("query_id", "doc", "rank", "p").join(chunks, "doc")
    head = F.format_string("%s:%d-%d  %s  %.2f", "path", "start", "end", F.coalesce("symbol", F.lit("")), "p")
    return j.select("query_id", "rank", F.concat(head, F.lit("\n"), F.array_join(F.transform(F.slice(F.split("body", "\n"), 1, 6), lambda x: F.concat(F.lit("  | "), x)), "\n")).alias("text"))


def search(chunks: DataFrame, queries: DataFrame, score: Callable[[DataFrame], DataFrame], top: int = 10, candidates: int = 64, threshold: float = 0.5, beam: int = 3, wave: int = 64, analyse: Callable | None = None) -> DataFrame:
    """The whole search: lexical recall, descent, their union, reranking with early stop, and what is shown: (query_id, doc,
    position, p, rank, hit). score adds p to (query_id, text)."""
    from verdigris.operators import descend, lexical
    from verdigris.operators.questions import check_search

    check_search(top, threshold)
    lex = stored(lexical.recall(chunks, queries, candidates, analyse or lexical.terms_udf, keep=lambda x: stored(x, "recall")).select("query_id", "doc", "position"), "lexical")
    node = lambda p: score(p.withColumnRenamed("preview", "text")).select("query_id", "key", "p")
    cand = lexical.union_candidates(lex, descend.descend(chunks, queries, node, beam)) if candidates else lex
    body = chunks.select("doc", probe_state(F.col("path"), F.col("body")).alias("text"))
    read = rerank(cand, lambda c: score(c.join(body, "doc")).select("query_id", "doc", "position", "p"), top, threshold, wave)
    return shown(stored(read, "read"), top, threshold)


def run_eval(chunks: DataFrame, cases: DataFrame, anchors: DataFrame, score: Callable[[DataFrame], DataFrame], own_paths: list[str] = [], candidates: int = 64, threshold: float = 0.5, analyse: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per case, summary, stale anchors) of retrieval cases (query_id, query, kind) with anchors (query_id, anchor, path,
    contains); the cases' own files stay out of the corpus; every candidate is read."""
    from verdigris.operators import lexical

    c = chunks.filter(~F.col("path").isin(*own_paths)) if own_paths else chunks
    cand = stored(lexical.recall(c, cases.select("query_id", "query"), candidates, analyse or lexical.terms_udf, keep=lambda x: stored(x, "recall")).select("query_id", "doc", "position"), "candidates")
    body = c.select("doc", probe_state(F.col("path"), F.col("body")).alias("text"))
    read = stored(score(cand.join(body, "doc")).select("query_id", "doc", "position", "p"), "read")
    ranked = read.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "position")))
    per = retrieval_metrics(anchor_ranks(ranked, anchors, c)).join(separation(read, anchors, c, threshold), "query_id").join(cases.select("query_id", "kind"), "query_id")
    met = anchors.join(c.select("path", "body"), "path").filter(F.contains(F.col("body"), F.col("contains"))).select("query_id", "anchor").distinct()
    return per, retrieval_summary(per), anchors.join(met, ["query_id", "anchor"], "left_anti")


def cache_binding(model: str, prompt_version: str, chunk_lines: int, kind: str) -> str:
    """What a cached score belongs to; another binding is another partition of the store."""
    return "/".join((model, prompt_version, str(chunk_lines), kind))
