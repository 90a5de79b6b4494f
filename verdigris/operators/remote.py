"""Cases decided by a running service, and what prompts share: for callers whose model is somewhere else."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigris.operators import metrics
from verdigris.session import stored

_ANSWER = "status string, confidence double, probabilities map<string,double>, boolean boolean, choice string, score double, level int, value double"


def wire_answer(raw: Column) -> Column:
    """An answer as the service words it, as the struct that decisions have; null if it can't be read."""
    a = F.from_json(raw, _ANSWER)
    probs = F.transform(F.map_entries(a["probabilities"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("p")))
    return F.when(a.isNotNull(), F.struct(a["status"].alias("status"), a["confidence"].alias("confidence"), probs.alias("probabilities"), a["boolean"].alias("boolean"), a["choice"].alias("choice"), a["score"].alias("score"), a["level"].alias("level"), a["value"].alias("value")))


def decide_url(requests: DataFrame, url: str, temperature: float = 1.0, timeout: float = 60.0, tries: int = 3) -> DataFrame:
    """Requests of questions.case_request (req_id, state, question, layout, expand, and other columns, which stay) with what
    the service answers whose endpoint for requests is `url`: raw (JSON text of the answer) and ms. Each request is one POST, tried again with growing
    pauses where the service fails or is away; one that it refuses, or that fails every time, fails the task, which Spark
    retries. As many requests are under way as tasks run."""
    def post(state: str, question: str, layout: str, expand: str) -> tuple[str, float]:
        body = json.dumps({"state": _json(state), "questions": {"q": json.loads(question)}, "temperature": temperature, "mode": "shared", "layout": layout, "expand": expand}).encode()
        for k in range(tries):
            began = time.monotonic()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                    answer = json.load(r)["answers"]["q"]
                return json.dumps(answer), (time.monotonic() - began) * 1000
            except urllib.error.HTTPError as e:
                if e.code < 500 or k + 1 == tries:
                    raise
            except OSError:
                if k + 1 == tries:
                    raise
            time.sleep(0.2 * 2**k)
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [post(*x) for x in zip(*(b.column(c).to_pylist() for c in ("state", "question", "layout", "expand")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([m for _, m in got], pa.float64())], names=[*b.schema.names, "raw", "ms"])

    schema = T.StructType([*requests.schema.fields, T.StructField("raw", T.StringType()), T.StructField("ms", T.DoubleType())])
    return requests.mapInArrow(run, schema)


def _json(state: str) -> object:
    """A state that is a JSON object or array goes out as that, any other text as text."""
    try:
        v = json.loads(state)
    except (ValueError, RecursionError):
        return state
    return v if isinstance(v, (dict, list)) else state


def evaluate_url(cases: DataFrame, url: str, layout: str | None = None, no_abstain: bool = False, perturb: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, consistency) of cases (case_id, state, question, expect, requires_abstain) decided by a service: per case its
    type, ok, confidence, ms and answer (those that need abstention are skipped under no_abstain: ok is null), and per kind of
    probe how often the answer stays and how far its probabilities move."""
    from verdigris.operators.questions import case_request

    skip = F.coalesce("requires_abstain", F.lit(False)) & F.lit(no_abstain)
    kept = cases.withColumn("_skip", skip)
    asked = kept.filter("not _skip").select("case_id", "state", "question")
    asked = metrics.auto_variants(asked) if perturb else asked.withColumn("kind", F.lit("base"))
    named = asked.select(F.struct("case_id", "kind").alias("case_id"), "state", "question", F.lit(None).cast("string").alias("layout"), F.lit(None).cast("string").alias("expand"))
    got = stored(decide_url(case_request(named, layout, no_abstain), url), "answers")
    got = got.select("req_id.case_id", "req_id.kind", wire_answer(F.col("raw")).alias("answer"), "ms")
    rows = kept.join(got.filter("kind = 'base'"), "case_id", "left")
    ok = F.when(~F.col("_skip"), metrics.judge(metrics.parse_expect(F.col("expect")), F.col("answer")))
    report = rows.select("case_id", F.get_json_object("question", "$.type").alias("type"), ok.alias("ok"), F.col("answer.confidence").alias("confidence"), F.coalesce("ms", F.lit(0.0)).alias("ms"), F.when(F.col("_skip"), "skipped").otherwise(metrics.pick(F.col("answer"))).alias("answer"))
    return report, metrics.consistency(got.select("case_id", "kind", "answer"))


@F.pandas_udf(T.IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters that two texts begin with in common."""
    return pd.Series([len(commonprefix((x, y))) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int32")


def prefix_groups(units: DataFrame, by: list[str], text: str = "prompt", least: int = 16) -> DataFrame:
    """units with place (from 1, in the order of the texts, within a group such as a request), shared (characters that the text
    begins with in common with the one before), and run (number of the run of texts that share at least `least` with the one
    before). In this order every text finds its longest prefix just before it, so a scorer that keeps one prefix reuses as
    much as it can; a run is what it reads from one restored state. Groups are a request's units, 64 times 256 at most."""
    w = Window.partitionBy(*by).orderBy(text)
    x = units.withColumn("place", F.row_number().over(w)).withColumn("_before", F.lag(text).over(w))
    x = x.withColumn("shared", common_length("_before", text))
    new = (F.col("shared") < least).cast("int")
    return x.withColumn("run", F.sum(new).over(Window.partitionBy(*by).orderBy("place"))).drop("_before")
