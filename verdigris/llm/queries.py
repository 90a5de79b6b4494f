"""Queries of the problems for training data, and SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import abuse, distinctive, encode, grouped, leakage, mix, overlap, oversized
from verdigris.session import stored, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that must be cut: those the operator cut."""
    return oversized.split_oversized(table(spark, d, "corpus")).filter("oversized and piece_no = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversized.split_oversized(table(spark, d, "corpus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped.mixed_groups(stored(grouped.tied_groups(table(spark, d, "convert_hf")), "groups"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return grouped.grouped_splits(table(spark, d, "convert_hf"), table(spark, d, "split_shares"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records and share reached per split, and the groups that stand in another split, too (there are none)."""
    s = stored(p2_splits(spark, d), "splits")
    total = s.count()
    torn = s.groupBy("group_no").agg(F.count_distinct("split").alias("k")).filter("k > 1").select("group_no")
    per = s.join(torn.withColumn("torn", F.lit(1)), "group_no", "left").groupBy("split").agg(F.count("*").alias("records"), F.count("torn").alias("torn"))
    return per.select("split", "records", (F.col("records") / total).alias("share"), "torn")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, d, "corpus"), min_tf=3, min_df=2, max_df=5).select("chunk_id", "term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, d, "corpus")).withColumn("score", F.round(F.col("score") * 1e6) / 1e6)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_leaks(spark, d).select("doc_id", "case_id")


def p4_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_cases(table(spark, d, "documents"), table(spark, d, "typed_decisions"))


def p4_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents that give away half of a case's words or more, in whatever order its passages stand."""
    return leakage.leaked_cases(table(spark, d, "documents"), table(spark, d, "typed_decisions"), min_share=0.5)


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "convert_hf").filter("lower(trim(split)) in ('train', 'dev', 'holdout')")


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    """What neighbours in the array of all suffixes say by themselves: the covered share of each evaluation record."""
    return p5_twins(spark, d).drop("twin")


def p5_twins(spark: SparkSession, d: str) -> DataFrame:
    """The same with a training record for each that shares its longest span."""
    return overlap.record_coverage(_splits(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("record_lo", "record_hi")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(_splits(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(p5_pairs(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_counts(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix half as large as the corpus: the exponent is bisected until the repetition limits allow it."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sized = stored(mix.sized_texts(docs, targets), "sized")
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return mix.mix(docs, targets, total=total // 2, sized=sized)[1]


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score_documents(docs, abuse.fit_model(docs, table(spark, d, "review_labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).filter("flagged").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p9_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_splits, p2_shares, p3_found, p3_scores, p4_found, p4_leaks, p4_covered, p5_method, p5_twins, p5_found, p5_pairs, p5_report, p7_ids, p7_sizes, p8_mix, p8_shares, p8_tempered, p9_found, p9_scores, p9_rates)}


def oracle_sql() -> dict[str, str]:
    from verdigris.llm import sql

    return dict(sql.ORACLE)
