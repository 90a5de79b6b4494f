"""Line-level facts about source and prose files: declarations, headings, indentation."""

from __future__ import annotations

import re

# Words that may stand before a declaration, and words that open one (fixed values).
MODIFIERS = "export default pub public private protected static async unsafe abstract final const extern inline sealed"
OPENERS = "def class fn func function struct enum trait impl interface type mod module namespace macro_rules! record"
_mods = "|".join(re.escape(w) for w in MODIFIERS.split())
_open = "|".join(re.escape(w) for w in OPENERS.split())
DECLARATION = re.compile(rf"^(?P<indent>[ \t]*)(?:(?:{_mods})(?:\([a-z]+\))?\s+)*(?:{_open})\b\s*(?:\([^)]*\)\s*)?(?:<[^>]*>\s*)?(?P<name>[^\W\d][\w.:]*)")
HEADING = re.compile(r"^ {0,3}#{1,6}\s+(?P<name>.*?)\s*#*\s*$")
OTHER_HEADING = re.compile(r"^(?:={1,5}|\*+)\s+(?P<name>\S.*?)\s*$")


def declared(line: str) -> tuple[str, int] | None:
    """(name, indent) of a declaration on this line."""
    m = DECLARATION.match(line)
    return (m["name"], len(m["indent"].expandtabs(4))) if m else None


def heading(line: str) -> str | None:
    """Text of a Markdown heading."""
    m = HEADING.match(line)
    return m["name"] if m else None


def opens_section(line: str) -> str | None:
    """Name of the section that this line opens: a heading or an outermost declaration."""
    d = declared(line)
    return d[0] if d and d[1] == 0 else heading(line)
