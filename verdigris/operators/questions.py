"""Typed questions: parsing, validation, option slots, prompt texts and the expansion of large choices.

Everything is Column expressions over JSON text, so a table of requests is compiled inside the scan. Order is data
(it assigns letters): criteria are arrays of (key, text) in the order of the JSON text, never maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.once import once

MAX_SLOTS, MAX_OPTIONS, MAX_QUESTIONS, LONG_STATE_BYTES = 26, 256, 64, 2000
TYPES = ("boolean", "noul", "choice", "score", "numeric")
FIELDS = ("type", "instructions", "criteria", "min", "max", "step", "granularity", "allow_abstain")
# Keys and texts of special options (fixed values).
ABSTAIN, BELOW, ABOVE = "__abstain__", "__below__", "__above__"
ABSTAIN_LABEL = "None of the above / insufficient information in the state"

QUESTION = "struct<qtype:string,instructions:string,criteria:array<struct<key:string,text:string>>,criteria_kind:string,criteria_json:string,min:double,max:double,step:double,granularity:int,allow_abstain:boolean,unknown:array<string>>"


def entry_text(raw: Column, original: Column, field: str) -> Column:
    """A string as it is, another JSON value as its compact text, null and absent as ''. raw comes from a map of
    strings, which already holds both."""
    return F.coalesce(raw, F.lit(""))


def parse_question(q: Column) -> Column:
    """JSON text of a question as a struct (see QUESTION); null for null or for what is no JSON object."""
    m = F.from_json(q, "map<string,string>")
    c = m["criteria"]
    as_map = F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("text")))
    as_list = F.transform(F.from_json(c, "array<string>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), F.coalesce(v, F.lit("")).alias("text")))
    kind = F.when(c.startswith("{"), "map").when(c.startswith("["), "list")
    return F.when(
        m.isNotNull(),
        F.struct(
            m["type"].alias("qtype"), entry_text(m["instructions"], q, "instructions").alias("instructions"),
            F.when(kind == "map", as_map).when(kind == "list", as_list).alias("criteria"), kind.alias("criteria_kind"), c.alias("criteria_json"),
            m["min"].try_cast("double").alias("min"), m["max"].try_cast("double").alias("max"), m["step"].try_cast("double").alias("step"),
            F.coalesce(m["granularity"].try_cast("int"), F.lit(8)).alias("granularity"), F.coalesce(m["allow_abstain"].try_cast("boolean"), F.lit(False)).alias("allow_abstain"),
            F.array_except(F.map_keys(m), F.array(*map(F.lit, FIELDS))).alias("unknown"),
        ),
    )


def float_text(v: Column) -> Column:
    """Shortest text of a double, without exponent and without '.0'."""
    s = v.cast("string")
    wide = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,18)").cast("string"), "0+$", ""), "\\.$", "")
    return F.when(s.contains("E"), wide).otherwise(F.regexp_replace(s, "\\.0$", ""))


def anchors(q: Column) -> Column:
    """Number of numeric anchors: by step if there is a positive one, else the granularity, within 2..24."""
    by_step = F.round((q["max"] - q["min"]) / q["step"]) + 1
    return F.least(F.lit(24), F.greatest(F.lit(2), F.when(q["step"] > 0, by_step).otherwise(q["granularity"]).cast("int")))


def problem(q: Column) -> Column:
    """Why a parsed question is invalid, or null: the first rule it breaks."""
    n = F.coalesce(F.size(q["criteria"]), F.lit(0))
    extra = q["allow_abstain"].cast("int")
    return (
        F.when(q.isNull(), "not a JSON object")
        .when(F.size(q["unknown"]) > 0, F.concat(F.lit("unknown field "), F.get(q["unknown"], F.lit(0))))
        .when(q["qtype"].isNull() | ~q["qtype"].isin(*TYPES), "unknown type")
        .when(q["qtype"].isin("choice", "score") & (n < 2), "at least two criteria")
        .when((q["qtype"] == "score") & (q["criteria_kind"] != "list"), "score needs a list")
        .when((q["qtype"] == "score") & (n + extra > MAX_SLOTS), "too many levels")
        .when((q["qtype"] == "choice") & (n > MAX_OPTIONS), "too many options")
        .when((q["qtype"] == "numeric") & (q["min"].isNull() | q["max"].isNull() | ~(q["min"] < q["max"])), "min must be below max")
        .when((q["qtype"] == "numeric") & ~q["granularity"].between(2, 24), "granularity out of range")
        .when((q["qtype"] == "numeric") & (anchors(q) + 2 + extra > MAX_SLOTS), "too many anchors")
    )


def request_problem(questions: Column, temperature: Column) -> Column:
    """Why a request (array of (name, question) entries, temperature) is invalid, or null."""
    n = F.coalesce(F.size(questions), F.lit(0))
    return (
        F.when((n < 1) | (n > MAX_QUESTIONS), "between 1 and 64 questions")
        .when(F.exists(questions, lambda e: e["name"].contains("\u001f")), "reserved character in a name")
        .when(~((temperature > 0) & (temperature <= 10)), "temperature must be in (0, 10]")
    )


def strict(col: Column, why: Column) -> Column:
    """col, or an error that stops the job where `why` isn't null."""
    return F.when(why.isNull(), col).otherwise(F.raise_error(why))


def pinned(pin: Column, allowed: tuple[str, ...], override: str | None = None, default: str | None = None) -> Column:
    """A case's pin (null: none, anything not allowed is an error), which an override outranks."""
    ok = F.when(pin.isNull() | pin.isin(*allowed), pin).otherwise(F.raise_error(F.concat(F.lit("bad pin "), pin)))
    return F.coalesce(F.lit(override), ok, F.lit(default))


def _slot(key: Column, text: Column, special: bool) -> Column:
    return F.struct(key.alias("key"), text.alias("text"), F.lit(special).alias("special"))


_EMPTY = "array<struct<key:string,text:string,special:boolean>>"


def slots(q: Column) -> Column:
    """Ordered option slots (pos, letter, key, text, special) of a parsed question."""
    crit = q["criteria"]
    yes_no = F.array(_slot(F.lit("yes"), F.lit("Yes"), False), _slot(F.lit("no"), F.lit("No"), False))
    of_map = F.transform(crit, lambda e: _slot(e["key"], F.when(e["text"] == "", e["key"]).otherwise(e["text"]), False))

    def listed(e: Column, i: Column) -> Column:
        t = F.when(e["text"] == "", F.concat(F.lit("option "), (i + 1).cast("string"))).otherwise(e["text"])
        return _slot(t, t, False)

    levels = F.transform(crit, lambda e, i: _slot(i.cast("string"), F.when(e["text"] == "", i.cast("string")).otherwise(e["text"]), False))
    n = anchors(q)

    def anchor(i: Column) -> Column:
        t = float_text(q["min"] + (q["max"] - q["min"]) * i / (n - 1))
        return _slot(t, t, False)

    numeric = F.concat(
        F.array(_slot(F.lit(BELOW), F.concat(F.lit("Below "), float_text(q["min"])), True)),
        F.transform(F.sequence(F.lit(0), n - 1), anchor),
        F.array(_slot(F.lit(ABOVE), F.concat(F.lit("Above "), float_text(q["max"])), True)),
    )
    main = F.when(q["qtype"].isin("boolean", "noul"), yes_no).when((q["qtype"] == "choice") & (q["criteria_kind"] == "map"), of_map).when(q["qtype"] == "choice", F.transform(crit, listed)).when(q["qtype"] == "score", levels).when(q["qtype"] == "numeric", numeric)
    tail = F.when(q["allow_abstain"], F.array(_slot(F.lit(ABSTAIN), F.lit(ABSTAIN_LABEL), True))).otherwise(F.array().cast(_EMPTY))
    return F.transform(F.concat(main, tail), lambda s, i: F.struct(i.alias("pos"), F.char(F.lit(65) + i).alias("letter"), s["key"].alias("key"), s["text"].alias("text"), s["special"].alias("special")))


def option_lines(sl: Column) -> Column:
    return F.transform(sl, lambda s: F.concat(s["letter"], F.lit(") "), s["text"]))


def _strings(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def question_block(q: Column, sl: Column) -> Column:
    """Lines of the QUESTION and OPTIONS blocks."""
    outcome = lambda label, key: F.transform(F.filter(q["criteria"], lambda e: (e["key"] == key) & (e["text"] != "")), lambda e: F.concat(F.lit(f"{label}: "), e["text"]))
    yes_no = q["qtype"].isin("boolean", "noul")
    outcomes = F.when(yes_no & (q["criteria_kind"] == "map"), F.concat(outcome("Yes", "true"), outcome("No", "false"))).otherwise(F.array().cast("array<string>"))
    head = _strings(F.lit("QUESTION"), F.nullif(q["instructions"], F.lit("")), F.when(yes_no, "Answer yes or no."))
    rng = F.when(q["qtype"] == "numeric", F.array(range_line(q))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, outcomes, rng, F.array(F.lit(""), F.lit("OPTIONS")), option_lines(sl))


def range_line(q: Column) -> Column:
    return F.concat(F.lit("Pick the closest value in range ["), float_text(q["min"]), F.lit(", "), float_text(q["max"]), F.lit("], or below/above the range."))


# Fixed lines of a message (fixed values).
REPLY = ("", "Reply with one letter only.")
PREAMBLE = "You will be asked each of these questions about the state below, one at a time. Read the state with all of them in mind."
CATALOG = "You will be asked each of these questions about the state below, one at a time, by number. Read the state with all of them in mind."


def _lines(*xs: str) -> Column:
    return F.array(*map(F.lit, xs))


def user_message(state: Column, q: Column, sl: Column, layout: Column, preamble: Column) -> Column:
    """The message of one question: by layout the state first, the question first, or the list of questions first."""
    block = question_block(q, sl)
    st = F.concat(_lines("STATE"), F.array(state))
    first = F.concat(st, _lines(""), block)
    by = F.when(layout == "question_first", F.concat(block, _lines("", "STATE"), F.array(state))).when(layout == "header", F.concat(_lines("QUESTIONS", PREAMBLE), preamble, _lines(""), first)).otherwise(first)
    return F.array_join(F.concat(by, _lines(*REPLY)), "\n")


def catalog_entry(i: Column, name: Column, q: Column) -> Column:
    """Lines of a question in the catalog (i from 0)."""
    head = F.concat((i + 1).cast("string"), F.lit(") "), name, F.when(q["instructions"] != "", F.concat(F.lit(" — "), q["instructions"])).otherwise(F.lit("")))
    return _strings(head, F.when(q["qtype"] == "numeric", F.concat(F.lit("   "), range_line(q))))


def catalog_message(catalog: Column, state: Column, i: Column, name: Column, sl: Column) -> Column:
    """Catalog layout: all questions, the state, then a pointer and the options."""
    return F.array_join(F.concat(_lines("QUESTIONS", CATALOG), catalog, _lines("", "STATE"), F.array(state, F.lit(""), F.concat(F.lit("QUESTION "), (i + 1).cast("string"), F.lit(" — "), name)), _lines("", "OPTIONS"), option_lines(sl), _lines(*REPLY)), "\n")


def head_bytes(q: Column) -> Column:
    """Bytes of a question's instructions and compact criteria, which the automatic layout weighs."""
    return F.octet_length(q["instructions"]) + F.coalesce(F.octet_length(q["criteria_json"]), F.lit(0))


def resolve_layout(layout: Column, n: Column, heads: Column, abstain: Column, state_bytes: Column) -> Column:
    """auto: state_first with an abstain option, a long state, or heads that don't outweigh the repeated state."""
    dominate = (n <= 1) | (heads > (n - 1) * state_bytes)
    return F.when(layout != "auto", layout).when(abstain | (state_bytes > LONG_STATE_BYTES) | ~dominate, "state_first").otherwise("question_first")


def expansion(q: Column) -> Column:
    """Whether a choice has more options than letters."""
    return (q["qtype"] == "choice") & (F.size(q["criteria"]) + q["allow_abstain"].cast("int") > MAX_SLOTS)


def option_pairs(q: Column) -> Column:
    """(key, desc) of a choice's options, a list's entries being both."""
    return F.transform(q["criteria"], lambda e: F.struct(F.coalesce(e["key"], e["text"]).alias("key"), e["text"].alias("text")))


def probe_instructions(q: Column, option: Column) -> Column:
    base = F.when(q["instructions"] == "", "Choose the best option.").otherwise(q["instructions"])
    cand = F.when(option["key"] == option["text"], option["key"]).otherwise(F.concat(option["key"], F.lit(" — "), option["text"]))
    return F.concat(base, F.lit("\nIs this candidate the correct answer?\nCandidate: "), cand)


def page_size(n: Column) -> Column:
    """Options per page: as many pages as letters need, all of about one size."""
    return F.ceil(n / F.ceil(n / MAX_SLOTS)).cast("int")


def pages(q: Column) -> Column:
    """Options cut into pages of at most 26."""
    o, n = option_pairs(q), F.size(q["criteria"])
    size = page_size(n)
    return F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda i: F.slice(o, i * size + 1, size))


def explode_questions(requests: DataFrame, questions: str = "questions") -> DataFrame:
    """One row per question of a request, in order: adds q_pos, q_name, question (JSON text). `questions` is the JSON text
    of a map from names to questions."""
    entries = F.map_entries(F.from_json(questions, "map<string,string>"))
    return requests.select("*", F.posexplode(entries).alias("q_pos", "_e")).select("*", F.col("_e.key").alias("q_name"), F.col("_e.value").alias("question")).drop("_e")


def compile_units(rows: DataFrame, expand: str = "probes", layout: str = "auto") -> DataFrame:
    """Requests (req_id, state, q_pos, q_name, question) to the units that are scored: (req_id, q_pos, q_name, sub_idx,
    bucket, key, slots, layout, prompt). A choice with too many options becomes a yes/no probe per option or a page per
    26 options; sub_idx is null where nothing was expanded. Texts shared by a request's units are built before rows
    multiply; the request's totals come from windows over req_id."""
    from pyspark.sql.window import Window

    q = F.col("q")
    per = Window.partitionBy("req_id")
    base = once(rows, q=parse_question(F.col("question"))).withColumn("big", expansion(q))
    if expand == "probes":
        count = F.when(F.col("big"), F.size(q["criteria"])).otherwise(1)
    else:
        count = F.when(F.col("big"), F.ceil(F.size(q["criteria"]) / MAX_SLOTS)).otherwise(1)
    base = base.withColumn("_n", F.sum(count).over(per)).withColumn("_heads", F.sum(head_bytes(q) * count).over(per)).withColumn("_abstain", F.max(q["allow_abstain"] & ~F.col("big")).over(per))
    line = F.concat((F.col("q_pos") + 1).cast("string"), F.lit(". "), F.col("q_name"), F.when(q["instructions"] != "", F.concat(F.lit(" — "), q["instructions"])).otherwise(F.lit("")))
    base = base.withColumn("_preamble", F.transform(F.sort_array(F.collect_list(F.struct(F.col("q_pos"), line.alias("line"))).over(per)), lambda e: e["line"]))
    base = base.withColumn("layout", resolve_layout(F.lit(layout), F.col("_n"), F.col("_heads"), F.col("_abstain"), F.octet_length("state")))
    none = F.lit(None)

    def sub(qtype: str, instructions: Column, criteria: Column, kind: str | None) -> Column:
        return F.struct(F.lit(qtype).alias("qtype"), instructions.alias("instructions"), criteria.cast("array<struct<key:string,text:string>>").alias("criteria"), F.lit(kind).cast("string").alias("criteria_kind"), none.cast("string").alias("criteria_json"), none.cast("double").alias("min"), none.cast("double").alias("max"), none.cast("double").alias("step"), F.lit(8).alias("granularity"), F.lit(False).alias("allow_abstain"), F.array().cast("array<string>").alias("unknown"))

    whole = F.array(F.struct(F.lit(None).cast("int").alias("sub_idx"), none.cast("string").alias("key"), q.alias("u")))
    if expand == "probes":
        many = F.transform(option_pairs(q), lambda o, i: F.struct(i.alias("sub_idx"), o["key"].alias("key"), sub("boolean", probe_instructions(q, o), none, None).alias("u")))
    else:
        stem = F.when(q["instructions"] == "", "Choose the best option.").otherwise(q["instructions"])
        many = F.transform(pages(q), lambda pg, i: F.struct(i.alias("sub_idx"), none.cast("string").alias("key"), sub("choice", F.concat(stem, F.lit("\nThese candidates are a subset — pick the best among them.")), pg, "map").alias("u")))
    units = once(base.select("*", F.explode(F.when(F.col("big"), many).otherwise(whole)).alias("x")), slots=slots(F.col("x.u")))
    bucket = F.when(F.col("x.u.qtype") == "noul", "boolean").otherwise(F.col("x.u.qtype"))
    return units.select("req_id", "q_pos", "q_name", F.col("x.sub_idx").alias("sub_idx"), F.col("q.qtype").alias("qtype"), bucket.alias("bucket"), F.col("x.key").alias("key"), F.col("q.allow_abstain").alias("allow_abstain"), "slots", "layout", user_message(F.col("state"), F.col("x.u"), F.col("slots"), F.col("layout"), F.col("_preamble")).alias("prompt"))


def case_request(cases: DataFrame, layout: str | None = None, no_abstain: bool = False) -> DataFrame:
    """Cases (case_id, state, question, layout, expand) to requests of one question each: a given layout outranks a case's pin,
    which outranks auto; no_abstain takes the abstain option away. A pin that can't be read is an error."""
    q = F.col("question")
    if no_abstain:
        q = F.when(F.get_json_object(q, "$.allow_abstain") == "true", F.regexp_replace(q, r'("allow_abstain"\s*:\s*)true', "$1false")).otherwise(q)
    lay = pinned(F.col("layout"), ("auto", "state_first", "question_first", "header", "catalog"), layout, "auto")
    return cases.select(F.col("case_id").alias("req_id"), "state", F.lit(0).alias("q_pos"), F.lit("q").alias("q_name"), q.alias("question"), lay.alias("layout"), pinned(F.col("expand"), ("probes", "pages"), None, "probes").alias("expand"))


def display_name(name: Column) -> Column:
    """A unit's name without the tag of its part."""
    return F.substring_index(name, "\u001f", 1)


def render_state(state: Column, kind: str = "json") -> Column:
    """The state's text in a prompt: as it is, or as TOON."""
    from verdigris.functions.toon import toon_udf

    return toon_udf(state) if kind == "toon" else state


def state_tokens(state: Column) -> Column:
    """Size of a state in words and signs; a stand-in for a model's tokens."""
    return F.size(F.regexp_extract_all(state, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)))


def check_search(top: int, threshold: float) -> None:
    if top < 1 or not 0 <= threshold <= 1:
        raise ValueError("top must be at least 1 and threshold within 0..1")
