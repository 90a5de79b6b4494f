"""Readers: cases and requests as JSON lines, whole files, trees of files, embedded JSON, reports, adapters to cases."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions.prob import normalise
from verdigris.operators.chunks import MAX_FILE_BYTES, readable_text, split_files
from verdigris.operators.joins import checked_join, is_few
from verdigris.operators.prepare import license_ok

CASE = "id string, state string, question string, expect string, variants string, requires_abstain boolean, layout string, expand string, source string, license string, soft string, chain string, teacher string, target string"
# Files that are noise for a search unless a pattern names them (fixed values).
LOCKS = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock")
NOISE = (".min.js", ".min.css", ".map")
# Model names with their repositories and files: a dimension of the reports (fixed values).
MODEL_COLUMNS = "name string, repo string, file string"


def json_fields(raw: Column, schema: str) -> Column:
    """Fields of JSON objects as texts: a nested value stays JSON text in its own order."""
    m = F.from_json(raw, "map<string,string>", {"mode": "FAILFAST"})
    cols = []
    for f in schema.split(", "):
        name, kind = f.split()
        cols.append((m[name] if kind == "string" else m[name].try_cast(kind)).alias(name))
    return F.struct(*cols)


def load_cases(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """JSON lines of cases (see CASE). Lines that are blank, or start with # where comments are allowed, are left out; a line
    that is no JSON object is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if comments:
        lines = lines.filter(~F.col("value").startswith("#"))
    return lines.select(json_fields(F.col("value"), CASE).alias("c")).select("c.*")


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; only blank lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def requests(lines: DataFrame) -> DataFrame:
    """(value) with one JSON request each to req_id, state, questions, temperature, mode, layout, expand. Unknown envelope fields
    are ignored; a number or object as state stays JSON text."""
    m = F.from_json("value", "map<string,string>")
    return lines.select(F.sha2("value", 256).alias("req_id"), m["state"].alias("state"), m["questions"].alias("questions"), F.coalesce(m["temperature"].try_cast("double"), F.lit(1.0)).alias("temperature"), F.coalesce(m["mode"], F.lit("shared")).alias("mode"), F.coalesce(m["layout"], F.lit("auto")).alias("layout"), F.coalesce(m["expand"], F.lit("probes")).alias("expand"))


def read_request(spark: SparkSession, arg: str) -> DataFrame:
    """One request from inline JSON, or from a file of that name."""
    if arg.lstrip().startswith("{"):
        return requests(spark.createDataFrame([(arg,)], "value string"))
    return requests(spark.read.text(arg, wholetext=True))


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from a folder of JSON lines as they arrive."""
    return requests(spark.readStream.schema("value string").text(path))


def glob_keeps(path: str, globs: Iterable[str]) -> bool:
    """Whether globs keep a path: the last that matches wins, ! excludes; with an including glob the rest is out."""
    globs = list(globs)
    verdict = not any(not g.startswith("!") for g in globs)
    for g in globs:
        body = g.lstrip("!")
        if fnmatch.fnmatch(path, body) or fnmatch.fnmatch(path.rsplit("/", 1)[-1], body) or body.endswith("/**") and path.startswith(body[:-2]):
            verdict = not g.startswith("!")
    return verdict


def is_noise(path: str, globs: Iterable[str] = ()) -> bool:
    name = path.rsplit("/", 1)[-1]
    named = any(not g.startswith("!") and (fnmatch.fnmatch(name, g.rsplit("/", 1)[-1])) and not set(g.rsplit("/", 1)[-1]) <= set("*.") and (name in g or any(g.endswith(s) for s in NOISE)) for g in globs)
    return not named and (name in LOCKS or name.endswith(NOISE))


def _ignore_rules(folder: str) -> list[tuple[bool, re.Pattern, bool]]:
    """(negated, pattern over the path below the folder, folders only) of a folder's ignore files."""
    rules = []
    for name in (".gitignore", ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                lines = f.read().splitlines()
        except (OSError, UnicodeDecodeError):
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            neg, line = line.startswith("!"), line.lstrip("!")
            only = line.endswith("/")
            body = line.strip("/")
            anchored = "/" in line.rstrip("/")
            rx = re.escape(body).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            rules.append((neg, re.compile(("" if anchored else "(?:.*/)?") + rx + r"\Z"), only))
    return rules


def list_tree(root: str, globs: Iterable[str] = ()) -> list[str]:
    """Relative paths of a tree's files, sorted: ignore files are honoured, hidden files read, .git and symlinks left out,
    lock and generated files too unless a glob names them. Listing is the driver's work, as it is Spark's own."""
    out = []

    def walk(rel: str, rules: list) -> None:
        here = os.path.join(root, rel) if rel else root
        rules = rules + [(rel, r) for r in _ignore_rules(here)]
        for e in sorted(os.scandir(here), key=lambda x: x.name):
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink() or e.name == ".git":
                continue
            folder, ignored = e.is_dir(), False
            for at, (neg, rx, only) in rules:
                below = path[len(at) + 1 :] if at else path
                if (folder or not only) and rx.match(below):
                    ignored = not neg
            if ignored:
                continue
            if folder:
                walk(path, rules)
            elif not is_noise(path, globs) and glob_keeps(path, globs):
                out.append(path)

    walk("", [])
    return sorted(out)


def read_tree(spark: SparkSession, root: str, globs: Iterable[str] = (), skip: DataFrame | None = None) -> DataFrame:
    """(path, text) of a tree's readable files; skip (path) is left out. The files' bytes are read by the executors."""
    paths = list_tree(root, globs)
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    base = root.rstrip("/") + "/"
    hidden = [p for p in paths if any(x[0] in "._" for x in p.split("/"))]
    plain = [p for p in paths if p not in set(hidden)]
    parts = []
    if plain:
        files = spark.read.format("binaryFile").load([base + p for p in plain])
        parts.append(files.select(F.substring_index(F.col("path"), base, -1).alias("path"), "content"))
    if hidden:  # Spark's own listing passes over names that start with a dot or an underscore
        names = spark.createDataFrame([(p,) for p in hidden], "path string")

        def read(batches):
            for b in batches:
                got = []
                for p in b.column("path").to_pylist():
                    with open(base + p, "rb") as f:
                        got.append(f.read(MAX_FILE_BYTES + 1))
                yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(got, pa.binary())], names=["path", "content"])

        parts.append(names.mapInArrow(read, "path string, content binary"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.select("path", readable_text(F.col("content")).alias("text")).filter("text is not null")
    return out if skip is None else out.join(skip.select("path"), "path", "left_anti")


def load_chunks(spark: SparkSession, root: str, globs: Iterable[str] = (), skip: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Chunks of a tree or of one named file (for which ignore rules don't count), narrowed by a smart-case regex."""
    from verdigris.functions.text import smart_match

    if os.path.isfile(root):
        files = spark.read.format("binaryFile").load(root).select(F.lit(os.path.basename(root)).alias("path"), readable_text(F.col("content")).alias("text")).filter("text is not null")
    else:
        files = read_tree(spark, root, globs, skip)
    chunks = split_files(files)
    return chunks if pattern is None else chunks.filter(smart_match(F.col("text"), pattern))


def fetch_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A projection of parquet files; columns that aren't named are never read."""
    return spark.read.parquet(path).select(*columns)


def embedded_json(text: Column, name: str) -> Column:
    """The JSON argument of a JavaScript callback of that name, as text."""
    return F.nullif(F.regexp_extract(text, rf"(?s){re.escape(name)}\s*\(\s*([\[{{].*[\]}}])\s*\)\s*;?\s*$", 1), F.lit(""))


def report_kind(raw: Column) -> Column:
    """What a report file is, by its shape: a list of scenarios, answers, an evaluation, a calibration, or other."""
    m = F.from_json(raw, "map<string,string>")
    return F.when(F.ltrim(raw).startswith("["), "bench").when(m["kind"] == "calibration", "calibration").when(m["temperatures"].isNotNull(), "calibration").when(m["cases"].isNotNull() & m["accuracy"].isNotNull(), "evaluation").when(m["cases"].isNotNull(), "answers").otherwise("other")


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, kind, value) of every report under a path."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), report_kind(F.col("value")).alias("kind"), "value")


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(model, prompt_version, bucket, temperature, ece_raw, ece_out_of_fold) of a calibration document; old names of the figures
    are understood."""
    v = spark.read.text(path, wholetext=True).select(F.from_json("value", "model string, prompt_version string, temperatures map<string,double>, ece struct<raw:double,before:double,out_of_fold:double,after:double>").alias("c"))
    e = F.col("c.ece")
    return v.select("c.model", "c.prompt_version", F.explode("c.temperatures").alias("bucket", "temperature"), F.coalesce(e["raw"], e["before"], F.lit(0.0)).alias("ece_raw"), F.coalesce(e["out_of_fold"], e["after"], F.lit(0.0)).alias("ece_out_of_fold"))


def bound(temps: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Temperatures of a calibration that belongs to this model and prompt version; another one is an error."""
    ok = (F.col("model") == model) & (F.col("prompt_version") == prompt_version)
    return temps.withColumn("temperature", F.when(ok, F.col("temperature")).otherwise(F.raise_error(F.concat(F.lit("calibrated for "), F.col("model"), F.lit(" / "), F.col("prompt_version")))))


def model_id(name: Column, quant: Column | None = None, prefix: str = "local") -> Column:
    """Slug of a model: lower case, dashes for spaces, one prefix, the quantisation at the end unless it is there."""
    slug = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-"))
    slug = F.when(slug.startswith(prefix + "-"), slug).otherwise(F.concat(F.lit(prefix + "-"), slug))
    return slug if quant is None else F.when(F.coalesce(~slug.endswith(F.lower(quant)), F.lit(False)), F.concat(slug, F.lit("-"), F.lower(quant))).otherwise(slug)


# ---- adapters to cases ----


def json_text(s: Column) -> Column:
    """A string as a JSON text."""
    j = F.to_json(F.array(s))
    return j.substr(F.lit(2), F.length(j) - 2)


def options_case(rows: DataFrame) -> DataFrame:
    """(id, state, instructions, options: array of 'key: text', target: array of p) to choice cases; the label is the option
    with the largest target (the first on ties)."""
    kv = F.transform("options", lambda o: F.struct(F.trim(F.split(o, ":", 2)[0]).alias("k"), F.trim(F.coalesce(F.get(F.split(o, ":", 2), F.lit(1)), F.lit(""))).alias("t")))
    best = F.array_min(F.transform("target", lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))["i"]
    crit = F.concat(F.lit("{"), F.array_join(F.transform(kv, lambda x: F.concat(json_text(x["k"]), F.lit(": "), json_text(x["t"]))), ", "), F.lit("}"))
    question = F.concat(F.lit('{"type": "choice", "instructions": '), json_text(F.col("instructions")), F.lit(', "criteria": '), crit, F.lit("}"))
    return rows.select("id", "state", question.alias("question"), F.concat(F.lit('{"choice": '), json_text(F.get(kv, best)["k"]), F.lit("}")).alias("expect"), F.to_json(F.struct(normalise(F.col("target")).alias("options"))).alias("soft"))


def drawn(seed: int, *keys: str) -> Column:
    """An order that depends on nothing but the keys and the seed, in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def licensed_sample(rows: DataFrame, n: int, seed: int = 17, key: str = "id") -> DataFrame:
    """n rows with a permissive license, chosen by a hash: a sample that doesn't depend on the order of files."""
    return rows.filter(license_ok(F.col("license"))).orderBy(drawn(seed, key), key).limit(n)


def capped(rows: DataFrame, by: list[str], n: int, seed: int = 17, key: str = "id") -> DataFrame:
    """At most n rows per group, chosen by a hash."""
    w = Window.partitionBy(*by).orderBy(drawn(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def gold_cases(rows: DataFrame, split: str = "train") -> DataFrame:
    """Gold cases (id, workflow, split, state, questions, gold) of one split to one case per question:
    id is tdc-<last 8 of the id>-<number of the question>, soft the gold distribution."""
    q = rows.filter((F.col("split") == split) & F.col("gold").isNotNull()).select("id", "workflow", "state", F.from_json("gold", "map<string,string>").alias("g"), F.posexplode(F.map_entries(F.from_json("questions", "map<string,string>"))).alias("i", "q"))
    g = F.from_json(F.col("g")[F.col("q.key")], "label string, probabilities string")
    qt = F.get_json_object("q.value", "$.type")
    expect = F.when(qt.isin("noul", "boolean"), F.concat(F.lit('{"boolean": '), g["label"], F.lit("}"))).when(qt == "score", F.concat(F.lit('{"level": '), g["label"], F.lit("}"))).otherwise(F.concat(F.lit('{"choice": '), json_text(g["label"]), F.lit("}")))
    return q.select(F.concat(F.lit("tdc-"), F.right("id", F.lit(8)), F.lit("-"), F.col("i").cast("string")).alias("id"), F.concat(F.lit("typeddec/"), "workflow").alias("source"), F.lit("apache-2.0").alias("license"), "state", F.col("q.value").alias("question"), expect.alias("expect"), F.concat(F.lit('{"distribution": '), g["probabilities"], F.lit("}")).alias("soft"))


def statements(rows: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """(id, subset, statement, label) of three classes to yes/no cases that may abstain, at most n per subset and class."""
    r = capped(rows.filter(F.lower("label").isin("true", "false", "unknown")), ["subset", "label"], n, seed)
    expect = F.when(F.lower("label") == "unknown", '{"status": "abstained"}').otherwise(F.concat(F.lit('{"boolean": '), F.lower("label"), F.lit("}")))
    return r.select("id", F.concat(F.lit("trilemma/"), "subset").alias("source"), F.lit("cc-by-4.0").alias("license"), F.to_json(F.struct(F.col("statement").alias("claim"))).alias("state"), F.lit('{"type": "boolean", "instructions": "Is the claim true?", "allow_abstain": true}').alias("question"), expect.alias("expect"))


def attach_meta(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows (id, ...) with the fields of their shard (shard_id = what stands before the id's first dash) where they have none."""
    s = shards.select(F.col("shard_id").alias("_s"), *(F.col(c).alias(f"_{c}") for c in shards.columns if c != "shard_id"))
    j = rows.withColumn("_k", F.split_part("id", F.lit("-"), F.lit(1))).join(F.broadcast(s) if is_few(s) else s, F.col("_k") == F.col("_s"), "left")
    keep = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in shards.columns else F.col(c) for c in rows.columns]
    new = [F.col(f"_{c}").alias(c) for c in shards.columns if c != "shard_id" and c not in rows.columns]
    return j.select(*keep, *new)


def nested_answers(raw: DataFrame) -> DataFrame:
    """(value) with answers as {workflow: {case: {question: answer}}} to rows; keys that start with _ are metadata."""
    m = F.from_json("value", "map<string,map<string,map<string,string>>>")
    a = raw.select(F.explode(m).alias("workflow", "cases")).filter(~F.col("workflow").startswith("_"))
    b = a.select("workflow", F.explode("cases").alias("case_id", "qs")).filter(~F.col("case_id").startswith("_"))
    return b.select("workflow", "case_id", F.explode("qs").alias("question", "answer"))


def assemble_cases(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(case_id, node, doc, question_no) with a catalog (question_no, qid, question) to one row per case: its documents, sorted and
    joined, and its questions in order."""
    j = checked_join(nodes, catalog, ["question_no"], "inner")
    return j.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_set("doc")), "\n\n").alias("state"), F.transform(F.sort_array(F.collect_set(F.struct("question_no", "qid"))), lambda x: x["qid"]).alias("questions"))


def model_dimension(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(name, repo, file) of the models that a caller knows; a dimension for reports."""
    return spark.createDataFrame(rows, MODEL_COLUMNS)
