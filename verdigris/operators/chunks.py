"""Files to chunks: code along declarations, prose along sections.

A file's lines become facts (indent, blank, heading, closing token, declaration) in arrays. From them follow cells: whole
units where these fit the limits, else their blocks, else single lines, each with a mark whether it may join the chunk
before it. One greedy pass joins cells to chunks; what a chunk is called is looked up in the facts afterwards. Files are
independent, and parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.session import spread

MAX_FILE_BYTES, MAX_LINES, MAX_CHARS, SNIFF, MINIFIED, MIN_SECTION = 1 << 20, 60, 1600, 8192, 1000, 5
# Extensions of prose, and of further documents that are no code (fixed values).
PROSE = ("md", "markdown", "mdx", "rst", "adoc", "txt", "org")
DATA = ("html", "htm", "xml", "yaml", "yml", "json", "jsonl", "toml", "csv")
# Words that may stand before a declaration, that open an item, and that open a binding, which is no item (fixed values).
MODIFIERS = frozenset(
    """pub public private protected internal export default declare abstract final static async unsafe extern const override open
sealed data inline suspend partial local""".split()
)
ITEMS = frozenset("fn def func fun function class struct enum trait interface protocol extension object module mod namespace record type".split())
BINDINGS = frozenset("const static let var".split())
# Tokens that close what an earlier line opened (fixed values).
CLOSING = r"[})\]]|</|(?:end|fi|done|esac)\b"
_CLOSES = re.compile(CLOSING)
_WORD = re.compile(r"\w+")


# ---- declarations ----

#: A type after `for`, and a path, whose last name counts.
_AFTER_FOR = re.compile(r"\bfor\s+&?\s*(?:'\w+\s+)?(?:mut\s+)?((?:\w+::)*\w+)")
_PATH = re.compile(r"\s*((?:\w+::)*\w+)")
_RECEIVER = re.compile(r"\s*\([^)]*\)\s*(\w+)")
_ITEM = re.compile(r"\s+(?:self\.)?(\w+)")
_MACRO = re.compile(r"!\s*(\w+)")
_BINDING = re.compile(r"\s+(?:mut\s+)?(\w+)\s*[:=]")
#: What a modifier takes with it: visibility in brackets, the name of a calling convention.
_TAKES = {"pub": re.compile(r"(?:\([^)]*\))?\s+"), "extern": re.compile(r"(?:\s+\"[^\"]*\")?\s+")}
_SPACE = re.compile(r"\s+")


def _implementation(tail: str) -> str | None:
    """What is implemented for a type is named for the type; an implementation of its own for itself, after its parameters."""
    head = re.split("[{;]", tail, maxsplit=1)[0]
    found = _AFTER_FOR.search(head)
    places = [0] if not tail.lstrip().startswith("<") else [m.end() for m in re.finditer(">", tail)]
    found = found or next((m for m in (_PATH.match(tail, i) for i in places) if m), None)
    return found[1].rsplit("::", 1)[-1] if found else None


def _name_after(word: str, tail: str) -> str | None:
    """The name that a word declares with what follows it."""
    if word == "impl":
        return _implementation(tail)
    tries = []
    if word == "func":
        tries.append(_RECEIVER)
    if word == "function":
        tail = tail.removeprefix("*")
    if word in ITEMS:
        tries.append(_ITEM)
    if word == "macro_rules":
        tries.append(_MACRO)
    if word in BINDINGS:
        tries.append(_BINDING)
    return next((m[1] for m in (t.match(tail) for t in tries) if m), None)


def declared(line: str) -> tuple[str, bool] | None:
    """(name, whether it is an item) of the declaration on a line: modifiers are passed over, word by word, until one word
    declares something. An item is anything but a binding, which inside a body is a local."""
    rest = line.lstrip()
    while m := _WORD.match(rest):
        word, tail = m[0], rest[m.end() :]
        name = _name_after(word, tail)
        if name is not None:
            return name, word not in BINDINGS
        space = _TAKES.get(word, _SPACE).match(tail) if word in MODIFIERS else None
        if space is None:
            return None
        rest = tail[space.end() :]
    return None


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_prose(path: Column) -> Column:
    return extension(path).isin(*PROSE)


def is_doc(path: Column) -> Column:
    return extension(path).isin(*PROSE, *DATA)


def indent_column(line: Column) -> Column:
    """Width of the leading white space, of whatever script, a tab counting 4."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, r"(?U)^(\s*)", 1), "\t", "    "))


def closes_column(line: Column) -> Column:
    return line.rlike(rf"(?U)^\s*(?:{CLOSING})")


def rule_column(line: Column) -> Column:
    return line.rlike(r"^(?:={3,}|-{3,})\s*$")


@F.pandas_udf(T.StringType())
def _declared_udf(line: pd.Series) -> pd.Series:
    found = line.map(lambda x: declared(x) if x is not None else None)
    return found.map(lambda d: d[0] if d else None)


def declared_column(line: Column) -> Column:
    """The name that a line declares, or null. Lines without any word that could declare don't leave the JVM."""
    could = line.rlike(rf"\b(?:{'|'.join(sorted(ITEMS | BINDINGS | {'impl', 'macro_rules'}))})\b")
    return F.when(could, _declared_udf(F.when(could, line)))


def readable_text(content: Column) -> Column:
    """Text of a file's bytes, or null for what isn't read: too large, binary, not UTF-8, or minified; without a byte order
    mark."""
    body = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    text = F.try_validate_utf8(body.cast("string"))
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    nul = F.contains(F.substring(content, 1, SNIFF), F.lit(bytearray(b"\x00")))
    ok = (F.octet_length(content) <= MAX_FILE_BYTES) & ~nul & F.is_valid_utf8(body.cast("string")) & (total <= MINIFIED * F.size(lines))
    return F.when(ok, text)


def _ext(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def indent(line: str) -> int:
    return sum(4 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip())])


# ---- headings ----

# What begins a heading, by extension: "#" in most prose, "=" and "*" in two (fixed values).
MARKS = {"adoc": "=", "org": "*"}


def headings(ext: str, lines: list[str]) -> list[str | None]:
    """The heading that each line begins.

    Every line is classed by a letter (h: marked heading, r: rule, f: fence, b: blank, t: text), and the string of letters is
    read by one pattern: what stands between fences is passed over, then come marked headings, titles between two rules,
    and titles over a rule. Only Markdown has fences and front matter; two kinds have no rules."""
    markdown = ext in ("md", "markdown", "mdx")
    mark = MARKS.get(ext, "#")
    marked = re.compile(rf"{re.escape(mark)}{'+' if mark == '*' else '{1,6}'}[ \t]\s*(\S.*)")
    rule = re.compile(r"(?:={3,}|-{3,})\s*")

    def kind(line: str) -> str:
        if markdown and line.strip().startswith(("```", "~~~")):
            return "f"
        if not line.strip():
            return "b"
        return "h" if marked.fullmatch(line) else "r" if rule.fullmatch(line) else "t"

    kinds = "".join(map(kind, lines))
    start = 0
    if markdown and lines and lines[0].rstrip() == "---":
        ends = [i for i, x in enumerate(lines) if i and x.rstrip() in ("---", "...")]
        start = ends[0] + 1 if ends else 0
    pattern = re.compile("f[^f]*f?|(?P<marked>h)" + ("" if ext in MARKS else "|r(?P<between>[thf])r|(?P<over>t)r") + "|.")
    out: list[str | None] = [None] * len(lines)
    for m in pattern.finditer(kinds, start):
        for name, at in ((k, m.start(k)) for k, v in m.groupdict().items() if v):
            out[m.start()] = marked.fullmatch(lines[at])[1].rstrip() if name == "marked" else lines[at].strip()
    return out


# ---- cells and chunks ----


class Cell(NamedTuple):
    """Lines first to last, which may join the chunk before unless it is `apart`, or heads a section and that chunk has a
    body; unit: number of the unit it is a part of, -1 for whole units."""

    first: int
    last: int
    apart: bool
    heads: bool
    unit: int


class Facts:
    """What the lines of a file say, as arrays."""

    def __init__(self, path: str, text: str):
        self.lines = text.replace("\r\n", "\n").removesuffix("\r").removesuffix("\n").split("\n") if text else []
        ext = _ext(path)
        self.prose = ext in PROSE
        n = len(self.lines)
        self.full = np.array([bool(x.strip()) for x in self.lines], bool)
        self.indent = np.array([indent(x) for x in self.lines], int)
        self.heading = headings(ext, self.lines) if self.prose else [None] * n
        self.heads = np.array([h is not None for h in self.heading], bool)
        self.ends = np.concatenate(([0], np.cumsum([len(x) + 1 for x in self.lines], dtype=int)))

    def fits(self, first: int, last: int) -> bool:
        return last - first < MAX_LINES and self.ends[last + 1] - 1 - self.ends[first] <= MAX_CHARS

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first lines, last lines, number of the unit) of the runs of full lines; a heading begins a run. A run opens a unit
        if it is a section, or code at the least indent that closes nothing."""
        at = np.flatnonzero(self.full)
        if not len(at):
            return at, at, at
        begins = np.concatenate(([True], np.diff(at) > 1)) | self.heads[at]
        first = at[begins]
        last = at[np.concatenate((np.flatnonzero(begins)[1:] - 1, [len(at) - 1]))]
        opens = self.heads[first]
        if not self.prose:
            closes = np.array([bool(_CLOSES.match(self.lines[i].lstrip())) for i in first])
            opens = opens | ((self.indent[first] == self.indent[at].min()) & ~closes)
        opens[0] = True
        return first, last, np.cumsum(opens) - 1

    def cells(self) -> list[Cell]:
        first, last, unit = self.blocks()
        out: list[Cell] = []
        after_cut = False
        for u in range(int(unit[-1]) + 1 if len(unit) else 0):
            of = np.flatnonzero(unit == u) if len(unit) < 64 else np.arange(*np.searchsorted(unit, [u, u + 1]))
            s, e = int(first[of[0]]), int(last[of[-1]])
            if s == e or self.fits(s, e):
                out.append(Cell(s, e, after_cut, bool(self.heads[s]), -1))
                after_cut = False
                continue
            apart = True
            for a, b in zip(first[of].tolist(), last[of].tolist()):
                if self.fits(a, b):
                    out.append(Cell(a, b, apart, False, u))
                else:  # line by line, but none of them joins the block before
                    out += [Cell(i, i, i == a, False, u) for i in range(a, b + 1)]
                apart = False
            after_cut = True
        return out

    def spans(self) -> list[tuple[int, int, int]]:
        """(first, last, unit) of the chunks: each cell joins the one before where it may and both fit."""
        out: list[tuple[int, int, int]] = []
        for c in self.cells():
            s, e, _ = out[-1] if out else (0, 0, 0)
            if out and not c.apart and not (c.heads and e - s + 1 >= MIN_SECTION) and self.fits(s, c.last):
                out[-1] = (s, c.last, c.unit)
            else:
                out.append((c.first, c.last, c.unit))
        return out

    def said(self, first: int, last: int) -> str | None:
        """The first heading or declaration in a range of lines."""
        if self.prose:
            return next((h for h in self.heading[first : last + 1] if h is not None), None)
        return next((d[0] for d in map(declared, self.lines[first : last + 1]) if d), None)

    def called(self, spans: list[tuple[int, int, int]]) -> list[str | None]:
        """The symbols of chunks. A part of a unit of code is called for the first item it declares, else for the last item
        before it in the unit that is indented less than its first line, else as the unit; a part of prose as its section."""
        whole: dict[int, tuple[int, int]] = {}
        for s, e, u in spans:
            whole[u] = (min(s, whole.get(u, (s, e))[0]), e)
        parts = [i for u, (s, e) in whole.items() if u >= 0 and not self.prose for i in range(s, e + 1)]
        names = {i: d[0] for i, d in ((i, declared(self.lines[i])) for i in parts) if d and d[1]}
        items = np.array(sorted(names), int)
        out = []
        for s, e, u in spans:
            name = None
            if u >= 0 and not self.prose:
                lo, at, hi = np.searchsorted(items, [whole[u][0], s, e + 1])
                around = items[lo:at][self.indent[items[lo:at]] < self.indent[s]]
                found = items[at] if hi > at else around[-1] if len(around) else None
                name = names[int(found)] if found is not None else None
            out.append(name or self.said(*(whole[u] if u >= 0 else (s, e))))
        return out


def split_file(path: str, text: str) -> list[tuple[int, int, str | None, str]]:
    """(first line, last line, symbol, text) of the chunks of a file, lines from 1; every non-blank line is in exactly one
    chunk, in order. Lines end in LF or CRLF."""
    f = Facts(path, text)
    spans = f.spans()
    return [(s + 1, e + 1, name, "\n".join(f.lines[s : e + 1])) for (s, e, _), name in zip(spans, f.called(spans))]


CHUNK = "path string, start int, end int, symbol string, text string"


def split_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text) of files to chunks (see CHUNK). Null and blank texts have none; files are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in split_file(p or "", t or ""):
                    for c, v in zip(cols, (p, *row)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["path", "start", "end", "symbol", "text"])

    return spread(files.select(path, text)).mapInArrow(run, CHUNK)
