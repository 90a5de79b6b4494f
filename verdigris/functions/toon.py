"""JSON states as TOON: lengths and field lists are declared once instead of repeating keys. Rendering is recursive, so it
runs in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_NUMBER = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\Z")
_SPECIAL = re.compile(r'[:"\\\[\]{},\x00-\x1f]')
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quote(s: str) -> str:
    return '"' + "".join(_SHORT.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def bare(s: str) -> bool:
    return bool(s) and s[0] not in " \t-#" and s[-1] not in " \t" and not _SPECIAL.search(s) and s not in ("true", "false", "null") and not _NUMBER.match(s)


def key(k: str) -> str:
    return k if _KEY.match(k) else quote(k)


def number(v: float) -> str:
    """Shortest text of a float that reads back, never with an exponent."""
    if v == 0:
        return "0"
    text = repr(v)
    if "e" in text or "E" in text:
        mant, _, exp = text.lower().partition("e")
        sign, mant = ("-", mant[1:]) if mant[0] == "-" else ("", mant)
        whole, _, frac = mant.partition(".")
        digits, point = whole + frac, len(whole) + int(exp)
        text = sign + (digits[:point].ljust(point, "0") or "0") + ("." + "0" * max(0, -point) + digits[max(0, point) :] if point < len(digits) else "")
    return text[:-2] if text.endswith(".0") else text


def scalar(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return number(v)
    return v if isinstance(v, str) and bare(v) else quote(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")))


def is_scalar(v: object) -> bool:
    return not isinstance(v, (dict, list))


def columns(objects: list) -> list | None:
    """Columns that a list of objects shares: (key, None) for scalars, (key, columns) for objects that are uniform in
    turn; None if the objects aren't uniform."""
    if not objects or not all(isinstance(o, dict) and o for o in objects):
        return None
    names = list(objects[0])
    if any(o.keys() != objects[0].keys() for o in objects):
        return None
    out = []
    for n in names:
        cells = [o[n] for o in objects]
        if all(map(is_scalar, cells)):
            out.append((n, None))
        else:
            sub = columns(cells)
            if sub is None:
                return None
            out.append((n, sub))
    return out


def header(cols: list) -> str:
    return ",".join(key(n) if sub is None else f"{key(n)}{{{header(sub)}}}" for n, sub in cols)


def row(o: dict, cols: list) -> str:
    return ",".join(scalar(o[n]) if sub is None else row(o[n], sub) for n, sub in cols)


def _object(head: str, o: dict, depth: int) -> list[str]:
    """Lines of an object behind `head` (with its indentation and key)."""
    cols = columns(list(o.values())) if len(o) > 1 else None
    if cols is None:
        return [f"{head}:", *_fields(o, depth + 1)]
    return [f"{head}[{len(o)}:]{{{header(cols)}}}:", *("  " * (depth + 1) + f"{key(k)}: {row(v, cols)}" for k, v in o.items())]


def _array(head: str, a: list, depth: int, tables: bool = True) -> list[str]:
    if all(map(is_scalar, a)):
        return [f"{head}[{len(a)}]: {','.join(map(scalar, a))}"]
    cols = columns(a) if tables else None
    if cols is not None:
        return [f"{head}[{len(a)}]{{{header(cols)}}}:", *("  " * (depth + 1) + row(o, cols) for o in a)]
    return [f"{head}[{len(a)}]:", *(line for x in a for line in _item(x, depth + 1))]


def _field(indent: str, k: str, v: object, depth: int) -> list[str]:
    head = indent + key(k)
    if isinstance(v, dict):
        return _object(head, v, depth) if v else [f"{head}:"]
    if isinstance(v, list):
        return _array(head, v, depth) if v else [f"{head}: []"]
    return [f"{head}: {scalar(v)}"]


def _fields(o: dict, depth: int) -> list[str]:
    return [line for k, v in o.items() for line in _field("  " * depth, k, v, depth)]


def _item(v: object, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(v, dict):
        if not v:
            return [f"{pad}-"]
        return [line for i, (k, x) in enumerate(v.items()) for line in _field(pad + ("  " if i else "- "), k, x, depth + 1)]
    if isinstance(v, list):
        return _array(f"{pad}- ", v, depth, tables=False) if v else [f"{pad}- [0]:"]
    return [f"{pad}- {scalar(v)}"]


def toon(v: object) -> str:
    """A JSON value as TOON; a string is the text itself; white space at the end is cut."""
    if isinstance(v, str):
        return v
    if isinstance(v, dict):
        cols = columns(list(v.values())) if len(v) > 1 else None
        lines = _fields(v, 0) if cols is None else [f"[{len(v)}:]{{{header(cols)}}}:", *(f"  {key(k)}: {row(x, cols)}" for k, x in v.items())]
    elif isinstance(v, list):
        lines = _array("", v, 0) if v else ["[]"]
    else:
        lines = [scalar(v)]
    return "\n".join(lines).rstrip()


def state_toon(state: str | None) -> str | None:
    """TOON of a state: JSON text, else the plain text as it is."""
    if state is None:
        return None
    try:
        return toon(json.loads(state))
    except (ValueError, RecursionError):
        return state


@F.pandas_udf(T.StringType())
def toon_udf(s: pd.Series) -> pd.Series:
    return s.map(state_toon)
