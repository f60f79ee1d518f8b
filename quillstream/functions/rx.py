"""Regular expressions and string helpers with the semantics of the web platform.

Patterns are written the way users of such rules write them; Spark runs Java
patterns. What differs is translated: the end anchor, ASCII word borders, and the
wider class of white space. Lengths count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Signs that count as white space, without the brackets of a class.
SPACE_SIGNS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE, NO_SPACE = f"[{SPACE_SIGNS}]", f"[^{SPACE_SIGNS}]"
_W = "[A-Za-z0-9_]"
BORDER = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
NO_BORDER = f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"
_SPECIAL = set(".*+?^${}()|[]\\")


def to_java(pattern: str) -> str:
    """Translate a pattern without flags; `^` and `$` stand for the ends of the whole text."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "s":
                out.append(SPACE_SIGNS if in_class else SPACE)
            elif n == "S" and not in_class:
                out.append(NO_SPACE)
            elif n in "bB" and not in_class:
                out.append(BORDER if n == "b" else NO_BORDER)
            elif n == "/":
                out.append("/")
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def ignoring_case(java: str) -> str:
    """Letters match whatever their case; beyond ASCII only where the pattern has such letters."""
    return ("(?i)" if java.isascii() else "(?iu)") + java


def escape(text: str) -> str:
    """A pattern that matches the text itself."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def java_replacement(text: str) -> str:
    """A replacement in which `$$` is a dollar and `$&` the match, all else literal."""
    out, i = [], 0
    while i < len(text):
        two = text[i : i + 2]
        if two == "$$":
            out.append(r"\$")
            i += 2
        elif two == "$&":
            out.append("$0")
            i += 2
        else:
            out.append("\\" + text[i] if text[i] in "\\$" else text[i])
            i += 1
    return "".join(out)


def is_valid(spark: SparkSession, java: str) -> bool:
    """Whether the pattern compiles; one that doesn't is left out, as a bad rule must not fail a job."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # noqa: BLE001  py4j wraps the JVM's error
        return False
    return True


def trim(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def collapse(col: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(col, f"{SPACE}+", " ")


def count_words(col: Column) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(f"({NO_SPACE}+)"), F.lit(1)))


def python_space() -> re.Pattern[str]:
    """The same class for driver-side code."""
    return re.compile("[" + SPACE_SIGNS + "]")
