"""Problem 6: files whose fields drift, read into one table, with every change reported.

Two reports. `drift_report` follows the rule of the task, in which a renaming is a pair of fields that are alone with one
set of types; no score can decide that. `flooded_report` follows the method: the whole schema of a file and that of the
file before it in its feed become graphs of levels, fields and properties (types, length, presence); pairs of nodes start
with the similarity of their names and pass their score along equal edges until nothing changes; the correspondences of
highest score that contradict no other one are selected. `consistent_table` uses the selected correspondences, between the
files of a feed and between a feed and the target schema, then casts and unites.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.joins import salted_join
from verdigris.session import stored

KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}
BITS = {"array": 1, "boolean": 2, "number": 4, "object": 8, "string": 16}
#: Mean length from which the strings of a field count as texts.
LONG = 40


def readable(payload: str | None) -> dict | None:
    """The object on a line, or None if the line can't be read as one."""
    if payload is None:
        return None
    try:
        v = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def fields_of(line: dict) -> Iterator[tuple[str, object]]:
    """(field, value) of the values other than null: top-level keys, and soft.x where soft is an object."""
    yield from ((k, v) for k, v in line.items() if v is not None)
    soft = line.get("soft")
    if isinstance(soft, dict):
        yield from ((f"soft.{k}", v) for k, v in soft.items() if v is not None)


def type_names(bits: int) -> list[str]:
    return [k for k, v in BITS.items() if bits & v]


def file_schemas(raw: DataFrame) -> DataFrame:
    """feed, file_name, written_at, lines, schema (array of field, type bits, lines that have it, characters of its
    strings): one row per file, a file without a readable line having an empty schema. Lines are reduced to schemas
    inside each task, so one feed or file with most of the lines moves no more than the others. A file's time is its
    earliest."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, dict[str | None, list[int]]] = defaultdict(dict)

        def rows() -> pa.RecordBatch:
            flat = [(f, n, t, k, *x) for (f, n, t), fs in seen.items() for k, x in fs.items()]
            cols = list(zip(*flat)) if flat else [[] for _ in range(7)]
            kinds = (pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["feed", "file_name", "written_at", "field", "bits", "n", "chars"])

        for b in batches:
            for feed, name, at, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
                fields = seen[(feed, name, at)]
                line = readable(payload)
                fields.setdefault(None, [0, 0, 0])[1] += line is not None
                for k, v in fields_of(line or {}):
                    x = fields.setdefault(k, [0, 0, 0])
                    x[0] |= BITS[KINDS[type(v)]]
                    x[1] += 1
                    x[2] += len(v) if isinstance(v, str) else 0
            if len(seen) > 20_000:
                yield rows()
                seen.clear()
        yield rows()

    parts = raw.select("feed", "file_name", "written_at", "payload").mapInArrow(reduce, "feed string, file_name string, written_at timestamp, field string, bits int, n long, chars long")
    per = parts.groupBy("feed", "file_name", "field").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("written_at").alias("written_at"))
    entry = F.when(F.col("field").isNotNull(), F.struct("field", "bits", "n", "chars"))
    return per.groupBy("feed", "file_name").agg(F.min("written_at").alias("written_at"), F.max(F.when(F.col("field").isNull(), F.col("n"))).alias("lines"), F.sort_array(F.collect_list(entry)).alias("schema"))


# ---- the rule ----


def level(field: str) -> str:
    return "soft" if field.startswith("soft.") else "top"


def schema_changes(old: dict[str, int], new: dict[str, int]) -> list[tuple[str, str, str]]:
    """(kind, old field, new field) from one file (field: type bits) to the next: retyped; renamed, where of the fields with
    one set of types on one level exactly one leaves and one comes; removed; added."""
    ways: dict[tuple[str, int], tuple[list[str], list[str]]] = defaultdict(lambda: ([], []))
    for k in sorted(set(old) ^ set(new)):
        gone = k in old
        ways[(level(k), old[k] if gone else new[k])][not gone].append(k)
    out = [("retyped", k, k) for k in old if k in new and old[k] != new[k]]
    for leaving, coming in ways.values():
        if len(leaving) == len(coming) == 1:
            out.append(("renamed", leaving[0], coming[0]))
        else:
            out += [("removed", k, "") for k in leaving] + [("added", "", k) for k in coming]
    return out


# ---- the method ----

#: A field's properties by kind: its types, the length of its strings, whether all lines have it.
Properties = tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]
Schema = tuple[tuple[str, Properties], ...]
#: Where every similarity starts at least; it also makes the fixpoint unique.
FLOOR = 0.01
#: A pair of different names is selected if its score is at least this share of the best score of either field, and if
#: no other pair of unmatched fields that would contradict it comes closer than MARGIN to it.
SELECT, MARGIN = 0.5, 0.99
#: Likeness of the names from which a field of a feed is taken for one of the target schema that needs not be there.
LIKE = 0.5


def schema_of(rows: list[dict], lines: int) -> Schema:
    """The schema as properties, from the array of file_schemas."""
    out = []
    for x in rows:
        types = tuple(type_names(x["bits"]))
        length = ("long" if x["chars"] >= LONG * x["n"] else "short",) if "string" in types else ()
        out.append((x["field"], (types, length, ("always" if x["n"] >= lines else "sometimes",))))
    return tuple(out)


def likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a.removeprefix("soft."), b.removeprefix("soft.")).ratio()


@lru_cache(maxsize=50_000)
def flood(old: Schema, new: Schema, eps: float = 1e-9) -> dict[tuple[str, str], float]:
    """Scores of all pairs of fields on one level after similarity flooding.

    Nodes are pairs of levels, of fields on one level, and of properties of one kind; a field hangs on its level and has its
    properties, and the soft level hangs on the field soft. Each round a node takes its start value, its score, and what
    its neighbours hand out in equal parts per kind of edge and direction; scores are divided by the largest. With start
    values above 0 this map is a contraction, so the rounds end, whatever the graphs.
    """
    a, b = dict(old), dict(new)
    at: dict[tuple, int] = {}
    start: list[float] = []
    edges: list[tuple[int, int, int]] = []

    def node(*key: object, value: float = 1.0) -> int:
        if key not in at:
            at[key] = len(start)
            start.append(value)
        return at[key]

    pairs = [(x, y) for x in a for y in b if level(x) == level(y)]
    if not pairs:
        return {}
    for x, y in pairs:
        f = node("field", x, y, value=FLOOR + likeness(x, y))
        edges.append((node("level", level(x)), f, 0))
        if x == y == "soft":
            edges.append((f, node("level", "soft"), 1))
        for kind, (p, q) in enumerate(zip(a[x], b[y]), 2):
            edges += [(f, node(kind, u, v, value=1.0 if u == v else FLOOR), kind) for u in p for v in q]
    src, dst, kind = np.array(edges).T
    n, kinds = len(start), int(kind.max()) + 1
    down = 1.0 / np.bincount(src * kinds + kind, minlength=n * kinds)[src * kinds + kind]
    up = 1.0 / np.bincount(dst * kinds + kind, minlength=n * kinds)[dst * kinds + kind]
    first = np.array(start)
    score = first / first.max()
    while True:
        x = first + score
        nxt = x + np.bincount(dst, down * x[src], n) + np.bincount(src, up * x[dst], n)
        nxt /= nxt.max()
        moved = float(np.abs(nxt - score).max())
        score = nxt
        if moved < eps:
            return {p: float(score[at[("field", *p)]]) for p in pairs}


def select(old: Schema, new: Schema, scores: dict[tuple[str, str], float]) -> dict[str, str]:
    """Consistent correspondences old field -> new field, each field in at most one, taken by falling score.

    A field that keeps its name corresponds to itself. Others must share a type, come close to the best score of both
    fields (SELECT), and be clearly better than any pair of free fields that contradicts them (MARGIN).
    """
    a, b = dict(old), dict(new)
    best_a: dict[str, float] = defaultdict(float)
    best_b: dict[str, float] = defaultdict(float)
    for (x, y), v in scores.items():
        best_a[x], best_b[y] = max(best_a[x], v), max(best_b[y], v)
    got = {x: x for x in a if x in b}
    free = {p: v for p, v in scores.items() if p[0] not in b and p[1] not in a and set(a[p[0]][0]) & set(b[p[1]][0])}
    for (x, y), v in sorted(free.items(), key=lambda e: (-e[1], e[0])):
        rival = max((w for (p, q), w in free.items() if (p == x) != (q == y) and p not in got and q not in got.values()), default=0.0)
        if x not in got and y not in got.values() and v >= SELECT * min(best_a[x], best_b[y]) and rival <= MARGIN * v:
            got[x] = y
    return got


@lru_cache(maxsize=50_000)
def correspond(old: Schema, new: Schema) -> tuple[tuple[str, str, float], ...]:
    scores = flood(old, new)
    return tuple((x, y, scores[(x, y)]) for x, y in select(old, new, scores).items())


def flooded_changes(old: Schema, new: Schema) -> list[tuple[str, str, str, float]]:
    """(kind, old field, new field, score) by the selected correspondences; removed and added fields have score 0."""
    a, b = dict(old), dict(new)
    got = correspond(old, new)
    out = [("renamed" if x != y else "retyped", x, y, s) for x, y, s in got if x != y or a[x][0] != b[y][0]]
    there = {y for _, y, _ in got}
    return out + [("removed", x, "", 0.0) for x in a if x not in {g[0] for g in got}] + [("added", "", y, 0.0) for y in b if y not in there]


# ---- the reports ----

_CHANGE = "feed string, file_name string, written_at timestamp, change_kind string, old_field string, new_field string, old_types string, new_types string"


def file_by_file(schemas: DataFrame, step: Callable[[dict, dict | None, dict], list[tuple]], schema: str) -> DataFrame:
    """The rows of step(file, file before it in its feed or None, a dict that lasts as long as the feed), over the files of
    every feed by time, then name. Files are small rows that stream through sorted partitions; a feed's memory is one
    schema and what step keeps, however many files it has. Null feeds are one feed."""
    parts = int(schemas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = schemas.select("feed", "file_name", "written_at", "lines", "schema").repartition(parts, "feed").sortWithinPartitions("feed", "written_at", "file_name")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "double": pa.float64()}
        before: dict | None = None
        kept: dict = {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if before is None or before["feed"] != row["feed"]:
                    before, kept = None, {}
                out += step(row, before, kept)
                before = row
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, schema.split(", "))], names=names)

    return ordered.mapInArrow(run, schema)


def file_changes(schemas: DataFrame) -> DataFrame:
    """Changes of every file against the file of its feed written just before it, by the rule (see _CHANGE). The first file
    of a feed has none. Types are names joined by commas."""

    def step(row: dict, before: dict | None, _: dict) -> list[tuple]:
        if before is None:
            return []
        old, new = ({x["field"]: x["bits"] for x in r["schema"]} for r in (before, row))
        types = lambda s, k: ",".join(type_names(s.get(k, 0)))
        return [(row["feed"], row["file_name"], row["written_at"], kind, a, b, types(old, a), types(new, b)) for kind, a, b in (schema_changes(old, new) if old != new else [])]

    return file_by_file(schemas, step, _CHANGE)


def drift_report(raw: DataFrame) -> DataFrame:
    """Every change of the fields of (feed, file_name, written_at, payload) from file to file, by the rule (see _CHANGE).

    Unreadable lines and null values are no evidence; a repeated line or file changes nothing; null feeds are one feed,
    null file names one file of each feed; an empty table gives an empty report; other columns are ignored.
    """
    return file_changes(stored(file_schemas(raw), "schemas"))


def flooded_report(raw: DataFrame) -> DataFrame:
    """Every change from file to file by similarity flooding (see _CHANGE, with the score of each correspondence); the same
    cases as in drift_report. Fields that leave and come together may be renamed although others of their types do."""

    def step(row: dict, before: dict | None, _: dict) -> list[tuple]:
        if before is None:
            return []
        old, new = (schema_of(r["schema"], r["lines"] or 0) for r in (before, row))
        types = lambda s, k: ",".join(dict(s)[k][0]) if k else ""
        return [(row["feed"], row["file_name"], row["written_at"], kind, a, b, types(old, a), types(new, b), score) for kind, a, b, score in (flooded_changes(old, new) if old != new else [])]

    return file_by_file(stored(file_schemas(raw), "schemas"), step, _CHANGE + ", score double")


# ---- the table ----

_STRING, _TEXT, _OBJECT = (("string",), ("short",)), (("string",), ("long",)), (("object",), ())
_NUMBER, _ARRAY, _BOOLEAN = (("number",), ()), (("array",), ()), (("boolean",), ())
#: The fields of the table that every record has, and those that it may have.
REQUIRED = {"id": _STRING, "source": _STRING, "state": _TEXT, "question": _OBJECT, "expect": _OBJECT}
OPTIONAL = {"license": _STRING, "soft": _OBJECT, "lang": _STRING, "note": _STRING, "votes": _NUMBER, "difficulty": _NUMBER, "tags": _ARRAY, "reviewed": _BOOLEAN, "meta": _OBJECT} | {
    f"soft.{k}": v for k, v in {"options": _ARRAY, "levels": _ARRAY, "distribution": _OBJECT, "p_yes": _NUMBER, "yes": _NUMBER, "no": _NUMBER, "n": _NUMBER, "agreement": _NUMBER, "rater": _STRING, "contested": _BOOLEAN, "window": _OBJECT, "by_voice": _ARRAY}.items()
}
TARGET: Schema = tuple((k, (*v, ("always",))) for k, v in REQUIRED.items()) + tuple((k, (*v, ("sometimes",))) for k, v in OPTIONAL.items())
OWN = frozenset(k for k, _ in TARGET)


@lru_cache(maxsize=50_000)
def target_names(schema: Schema, taken: frozenset[str], asked: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    """(field, target field) of the asked fields of a schema that correspond to one of the target schema not taken. The names
    must be alike, unless records can't be without the target field; a field with a name of the target schema is no other."""
    known = {k for k, _ in schema if k not in asked}
    target = tuple((k, v) for k, v in TARGET if k not in taken or k in known)
    got = select(schema, target, flood(schema, target))
    return tuple((x, y) for x, y in got.items() if x in asked and y not in taken and (x == y or x not in OWN and (y in REQUIRED or likeness(x, y) >= LIKE)))


def first_names(row: dict, before: dict | None, kept: dict) -> list[tuple]:
    """A step of file_by_file: (feed, file_name, names), names being a JSON object of the fields that go by another name in
    the table. `kept` holds the table's name of each field of the file before."""
    schema = schema_of(row["schema"], row["lines"] or 0)
    names: dict[str, str] = {}
    if before is not None:
        for old, new, _ in correspond(schema_of(before["schema"], before["lines"] or 0), schema):
            if old == new or new not in OWN:  # a name of the target schema means what it says
                names[new] = kept["names"].get(old, old)
    new = tuple(k for k, _ in schema if k not in names)
    names |= dict(target_names(schema, frozenset(names.values()), new))
    kept["names"] = names
    other = {k: v for k, v in names.items() if k != v}
    return [(row["feed"], row["file_name"], json.dumps(other))] if other else []


# The soft fields that hold a distribution, with the names they are known by; all others only describe it.
POSITIONS = ("options", "probs", "option_probs", "levels", "level_probs", "level_share")
SHARES = ("p_yes", "yes_share", "p")
EITHER = ("distribution", "dist", "label_dist")
DESCRIBING = {"n", "count_raters", "agreement", "rater", "rater_id", "judge", "contested", "window", "by_voice"}


def _parsed(value: object) -> object:
    """The value of a JSON text, else the value itself; None if it can't be read."""
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value)
    except (ValueError, RecursionError):
        return None


def _values(value: object, share: bool) -> dict[str, float] | None:
    """Labels from what one field holds: a list by position, a map of labels and, if share, the share of yes."""
    value = _parsed(value)
    num = _number(value)
    if num is not None:
        return {"yes": num, "no": 1.0 - num} if share and 0 <= num <= 1 else None
    if isinstance(value, list):
        value = {str(i): x for i, x in enumerate(value)}
    if not isinstance(value, dict):
        return None
    flat = {k: _number(v) for k, v in value.items()}
    return flat if flat and all(v is not None for v in flat.values()) else None


def soft_labels(value: object) -> dict[str, float] | None:
    """The label distribution of a soft value of any of its shapes: lists by position (options, levels), p_yes, a
    distribution (map, list or share of yes), yes and no, a map of labels that sum to 1, one number, a JSON text of any
    of these. It is read from the field that is named for it, never from one that describes it. None if there is none."""
    value = _parsed(value)
    if not isinstance(value, dict):
        return None if isinstance(value, str) else _values(value, True)
    for k in (*EITHER, *POSITIONS, *SHARES):
        if value.get(k) is not None:
            got = _values(value[k], k not in POSITIONS)
            if got:
                return got
    y, n = _number(value.get("yes")), _number(value.get("no"))
    if y is not None:
        return {"yes": y, "no": 1.0 - y if n is None else n}
    if DESCRIBING.isdisjoint(value) and not {*EITHER, *POSITIONS, *SHARES} & value.keys():
        got = _values(value, False)
        if got and abs(sum(got.values()) - 1) <= 0.02 and all(v >= 0 for v in got.values()):
            return got
    return None


def under_first_names(fields: dict[str, object], back: dict[str, str]) -> dict[str, object]:
    """The fields, in their order, under the names they had first. Where another field has that name by now, it keeps its
    place if the renamed one is null, else both stay, each under a name of its own."""
    out: dict[str, object] = {}
    first = {back[k] for k, v in fields.items() if k in back and v is not None}
    for k, v in fields.items():
        c = back.get(k, k)
        if k in back or c not in first:
            if out.get(c) is None:
                out[c] = v
            continue
        if v is not None:
            own = k + "_"
            while own in fields or own in out:
                own += "_"
            out[own] = v
    return out


def _number(v: object) -> float | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        try:
            return float(v)
        except ValueError:
            return None
    return None


def rounded_labels(value: object) -> list[tuple[str, float]] | None:
    got = soft_labels(value)
    return None if got is None else sorted((k, round(v, 6)) for k, v in got.items())


#: The columns of the table by the kind of value they hold. Objects are JSON texts.
COLUMNS = {"id": "string", "source": "string", "license": "string", "state": "string", "question": "object", "expect": "object", "soft": "any", "lang": "string", "note": "string", "votes": "number", "difficulty": "number", "tags": "array", "reviewed": "boolean", "meta": "object"}
_SQL = {"string": "string", "object": "string", "any": "string", "number": "double", "array": "array<string>", "boolean": "boolean"}
_ARROW = {"string": pa.string(), "object": pa.string(), "any": pa.string(), "number": pa.float64(), "array": pa.list_(pa.string()), "boolean": pa.bool_()}
_TABLE = "raw_no long, feed string, file_name string, line_no int, readable boolean, " + ", ".join(f"{k} {_SQL[v]}" for k, v in COLUMNS.items()) + ", soft_labels map<string,double>, extra string"


def compact(v: object) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def cast(value: object, kind: str) -> object:
    """A value as one of the column's kind, or None if it is none: numbers and booleans are read from texts, a single value is
    an array of one, objects are read from JSON texts."""
    if kind == "string":
        return value if isinstance(value, str) else None if isinstance(value, (dict, list)) else compact(value)
    if kind == "any":
        return value if isinstance(value, str) else compact(value)
    if kind == "number":
        return _number(value)
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())
    if kind == "array":
        return [x if isinstance(x, str) else compact(x) for x in value if x is not None] if isinstance(value, list) else None if isinstance(value, dict) else [value if isinstance(value, str) else compact(value)]
    value = _parsed(value)
    return compact(value) if isinstance(value, dict) else None


def consistent_table(raw: DataFrame) -> DataFrame:
    """All lines in one typed schema (see _TABLE): each field, those of soft included, goes by the name of the target field it
    corresponds to, through all files of its feed; values are cast to the column's type. What belongs to no column, or
    can't be cast, is kept in `extra` (JSON), so nothing is lost; a field that comes under the first name of a renamed one
    stays there too. Unreadable lines stay, with readable = false; repeated lines are rows of their own; an empty table
    gives an empty table; other columns are ignored. The other names of a file are one short text, joined with salted
    keys so that a file or feed with most of the lines is spread."""
    names = stored(file_by_file(stored(file_schemas(raw), "schemas"), first_names, "feed string, file_name string, names string"), "names")
    # null feeds are one feed, and null file names one file of each: the text of the pair, with its nulls, is the key
    key = lambda d: d.withColumn("_file", F.to_json(F.struct("feed", "file_name")))
    rows = salted_join(key(raw.select("raw_no", "feed", "file_name", "line_no", "payload")), key(names).select("_file", "names"), "_file", F.col("raw_no"), "left")

    def unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str | None, tuple[dict[str, str], dict[str, str]]] = {}
        fields = [x.split()[0] for x in _TABLE.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), *(_ARROW[v] for v in COLUMNS.values()), pa.map_(pa.string(), pa.float64()), pa.string())
        for b in batches:
            cols: list[list] = [[] for _ in fields]
            for no, feed, name, line, payload, other in zip(*(b.column(i).to_pylist() for i in range(6))):
                if other not in memo:
                    found = json.loads(other or "{}")
                    memo[other] = ({k: v for k, v in found.items() if level(k) == "top"}, {k[5:]: v[5:] for k, v in found.items() if level(k) == "soft"})
                back, soft_back = memo[other]
                got = readable(payload)
                named = under_first_names(got or {}, back)
                inner = _parsed(named.get("soft"))
                if isinstance(inner, dict) and not soft_back.keys().isdisjoint(inner):
                    named["soft"] = under_first_names(inner, soft_back)
                values, extra = [], {k: v for k, v in named.items() if k not in COLUMNS}
                for k, kind in COLUMNS.items():
                    v = named.get(k)
                    values.append(None if v is None else cast(v, kind))
                    if v is not None and values[-1] is None:
                        extra[k] = v
                row = (no, feed, name, line, got is not None, *values, rounded_labels(named.get("soft")), compact(extra) if extra else None)
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=fields)

    return rows.select("raw_no", "feed", "file_name", "line_no", "payload", "names").mapInArrow(unify, _TABLE)


def soft_column(df: DataFrame, key: str = "record_no") -> DataFrame:
    """(key, soft_labels) for a table that holds soft as JSON text of several shapes; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rounded_labels(x) for x in b.column(1).to_pylist()], pa.map_(pa.string(), pa.float64()))], names=[key, "soft_labels"])

    return df.select(F.col(key).cast("long").alias(key), "soft").mapInArrow(run, f"{key} long, soft_labels map<string,double>")
