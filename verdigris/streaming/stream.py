"""States as they arrive: decided against a fixed set of questions, with an optional memo; and a quality monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.decide import decode
from verdigris.operators.joins import is_few
from verdigris.operators.logits import LogitSource, memoised
from verdigris.operators.questions import parse_question, slots, user_message
from verdigris.functions.once import once
from verdigris.functions.prob import softmax
from verdigris.session import stored


def units_of(states: DataFrame, questions: DataFrame) -> DataFrame:
    """Every state (state_id, state, ...) with every question (q_name, question) of a fixed set, which is counted and broadcast;
    one unit each. Stateless, so it works on batches and streams alike."""
    q = questions.select("q_name", parse_question(F.col("question")).alias("q"))
    u = once(states.crossJoin(F.broadcast(q) if is_few(q) else q), slots=slots(F.col("q")))
    none = F.array().cast("array<string>")
    return once(u, prompt=user_message(F.col("state"), F.col("q"), F.col("slots"), F.lit("question_first"), none))


def decide_stream(states: DataFrame, questions: DataFrame, source: LogitSource, t: float = 1.0) -> DataFrame:
    """Answers per state and question; the source must be stateless (a column, an expression, a hash)."""
    scored = once(source.attach(units_of(states, questions)), p=softmax(F.col("logits"), t))
    answer = decode(F.col("q.qtype"), F.col("slots"), F.col("p"))
    return scored.select(*states.columns, "q_name", F.col("q.qtype").alias("qtype"), answer.alias("answer"))


def decide_with_memo(states: DataFrame, questions: DataFrame, source: LogitSource, memo_path: str, out_path: str, checkpoint: str, keep: int = 16) -> StreamingQuery:
    """Like decide_stream, per micro-batch: prompts that the memo at memo_path holds aren't scored again.

    The memo is one folder per micro-batch, of what that batch used, whether found or scored; the last `keep` folders are
    read, older ones deleted. So a prompt is forgotten when no batch used it for so long, and the memo is bounded by `keep`
    batches. Folders are overwritten, so a batch that is tried again leaves the same."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = jvm.Path(memo_path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = {int(x.getPath().getName().split("=")[1]): x.getPath() for x in (fs.listStatus(root) if fs.exists(root) else []) if x.getPath().getName().startswith("batch=")}
        paths = [p.toString() for k, p in held.items() if n - keep <= k < n]
        schema = "key string, logits array<double>"
        memo = spark.read.schema(schema).parquet(*paths).dropDuplicates(["key"]) if paths else spark.createDataFrame([], schema)
        rows, _ = memoised(source, units_of(df, questions), memo)
        rows = stored(rows.select(*df.columns, "q_name", "q", "slots", "prompt", "logits"), "scored")
        answer = decode(F.col("q.qtype"), F.col("slots"), softmax(F.col("logits")))
        rows.select(*df.columns, "q_name", F.col("q.qtype").alias("qtype"), answer.alias("answer")).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        rows.select(F.sha2("prompt", 256).alias("key"), "logits").dropDuplicates(["key"]).write.mode("overwrite").parquet(f"{memo_path}/batch={n}")
        for k, p in held.items():
            if k < n - keep:
                fs.delete(p, True)

    return states.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quality_monitor(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """An extension: accuracy, mean confidence and share of contested answers per event-time window of (ts, status, confidence,
    ok), with a watermark for late events."""
    w = F.window("ts", width, slide or width)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"), F.avg((F.col("status") == "contested").cast("double")).alias("contested"))


def session_monitor(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """The same per user and session."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
