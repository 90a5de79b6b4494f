"""Problem 1: oversized items cut at natural boundaries, with overlap.

Method: a recursive separator hierarchy (section, paragraph, line, sentence, word, character). A part that fits stays
whole, one that doesn't is split by the next finer separator; the parts are packed greedily into pieces up to the
limits, and each piece starts with the tail of the one before.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.code import opens_section

MAX_CHARS, MAX_LINES, OVERLAP_LINES, OVERLAP_CHARS = 1600, 60, 2, 80

SENTENCE = re.compile(r"[.!?…;]+[\"')\]]*\s+|[。！？]")
SPACE = re.compile(r"\s+")
SCHEMA = "chunk_id long, piece_no int, path string, start_line int, end_line int, symbol string, text string, oversized boolean"


class _Text:
    """Offsets of one text; spans are [s, e) in code points."""

    def __init__(self, text: str, max_chars: int, max_lines: int):
        self.text, self.n, self.max_chars, self.max_lines = text, len(text), max_chars, max_lines
        starts, at = [0], text.find("\n")
        while at >= 0 and at + 1 < self.n:
            starts.append(at + 1)
            at = text.find("\n", at + 1)
        self.starts = starts
        ends = starts[1:] + [self.n]
        self.sections, self.paragraphs, blank = [], [], True
        for i, (s, e) in enumerate(zip(starts, ends)):
            line = text[s:e]
            name = opens_section(line.rstrip("\r\n"))
            if name is not None:
                self.sections.append((s, name))
            empty = not line.strip()
            if blank and not empty and i:
                self.paragraphs.append(s)
            blank = empty

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def fits(self, s: int, e: int) -> bool:
        return e - s <= self.max_chars and (e <= s or self.line(e - 1) - self.line(s) < self.max_lines)

    def parts(self, s: int, e: int, level: int) -> list[tuple[int, int]]:
        """[s, e) split by the separator of this level, the separator staying with the part before it."""
        if level == 0:
            cuts = [x for x, _ in self.sections]
        elif level == 1:
            cuts = self.paragraphs
        elif level == 2:
            cuts = self.starts
        elif level < 5:
            cuts = [m.end() for m in (SENTENCE if level == 3 else SPACE).finditer(self.text, s, e)]
        else:
            cuts = range(s + 1, e)
            if "\r\n" in self.text[s:e]:
                cuts = [c for c in cuts if self.text[c - 1 : c + 1] != "\r\n"]
        bounds = [s, *(c for c in cuts if s < c < e), e]
        return list(zip(bounds, bounds[1:]))


def split_text(text: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """Pieces as (start, fresh, end): text[start:fresh] repeats the tail of the piece before, text[fresh:end] is new.

    The new parts tile the text without gap. Every piece fits both limits. After a cut at a line end the overlap is the
    last `overlap_lines` lines of the piece, or fewer only where they fill the limits by themselves; after a cut within a
    line it is the last `overlap_chars` characters.
    """
    if not text:
        return []
    t = _Text(text, max_chars, max_lines)
    todo, pieces = [(0, t.n, -1)], []  # a stack of parts, next part last; level: the separator that made it
    start = fresh = at = 0

    def close() -> None:
        nonlocal start, fresh
        pieces.append((start, fresh, at))
        tail = at - overlap_chars
        if text[at - 1] == "\n" and overlap_lines:
            last = t.line(at - 1)
            for keep in range(overlap_lines, 0, -1):
                s = max(start, t.starts[max(0, last - keep + 1)])
                if at - s <= max_chars - 2 and keep < max_lines:
                    tail = s
                    break
        start, fresh = max(tail, start, 0), at

    while todo:
        s, e, level = todo.pop()
        if t.fits(start, e):
            at = e
            continue
        if at > fresh and (t.fits(s, e) or level >= 4):
            close()  # the part is better off in the next piece
            todo.append((s, e, level))
        elif level >= 5 or e - s == 1:
            if at > fresh:
                close()
                todo.append((s, e, level))
            else:  # not even one character fits behind the overlap
                start = s
                at = e if t.fits(s, e) else s
        elif level == 4:  # a long word: as many characters as fit, at once
            room = max(1, max_chars - (s - start))
            c = s + room
            c -= c < e and text[c - 1 : c + 1] == "\r\n" and room > 1
            at = min(c, e)
            close()
            if at < e:
                todo.append((at, e, 4))
        else:
            todo.extend((a, b, level + 1) for a, b in reversed(t.parts(s, e, level + 1)))
    if at > fresh:
        pieces.append((start, fresh, at))
    return pieces


def piece_rows(text: str, **limits: int) -> list[tuple[int, int, str | None, str]]:
    """(first line, last line, symbol, text) of each piece, lines counted from 0; symbol: of the section that the new
    part opens or else lies in, None before the first."""
    t = _Text(text, limits.get("max_chars", MAX_CHARS), limits.get("max_lines", MAX_LINES))
    at, out = [s for s, _ in t.sections], []
    for start, fresh, end in split_text(text, **limits):
        i = bisect_right(at, fresh) - 1
        out.append((t.line(start), t.line(end - 1), t.sections[i][1] if i >= 0 else None, text[start:end]))
    return out


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at its end opens no further line."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)


def split_oversized(df: DataFrame, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Rows of (chunk_id, path, start_line, end_line, symbol, text) as pieces within both limits (see SCHEMA).

    Rows within the limits, null and empty texts among them, come out unchanged as one piece 0 with oversized = false
    and never leave the JVM; only oversized rows go to Python. Lines of a piece are counted from the row's start_line
    (null stays null), whatever the row's end_line says; its symbol is that of the section it lies in, else the row's.
    Other columns are dropped; equal rows are separate rows; an empty table gives an empty table.
    """
    rows = df.select("chunk_id", "path", "start_line", "end_line", "symbol", "text")
    big = F.coalesce((F.char_length("text") > max_chars) | (line_count(F.col("text")) > max_lines), F.lit(False))
    limits = {"max_chars": max_chars, "max_lines": max_lines, "overlap_lines": overlap_lines, "overlap_chars": overlap_chars}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("chunk_id", "piece_no", "path", "start_line", "end_line", "symbol", "text", "oversized")}
            for r in b.to_pylist():
                for k, (first, last, symbol, text) in enumerate(piece_rows(r["text"], **limits)):
                    base = r["start_line"]
                    for name, v in zip(out, (r["chunk_id"], k, r["path"], None if base is None else base + first, None if base is None else base + last, symbol or r["symbol"], text, True)):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()))], names=list(out))

    small = rows.filter(~big).select("chunk_id", F.lit(0).alias("piece_no"), "path", "start_line", "end_line", "symbol", "text", F.lit(False).alias("oversized"))
    return rows.filter(big).mapInArrow(cut, SCHEMA).unionByName(small)
