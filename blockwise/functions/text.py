"""Text semantics that differ between JavaScript, Python and the JVM, pinned to the first.

Offsets that leave the engine count UTF-16 code units; inside, Python strings count code points.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of the script language's white space class.
WHITESPACE = "\t\n\x0b\x0c\r                  　﻿"
#: The same as a class for Java's and Python's regular expressions.
WHITESPACE_CLASS = r"[\t\n\x0B\f\r    -     　﻿]"
SAFE_INTEGER = 9007199254740991

RUN = re.compile(WHITESPACE_CLASS + "+")


def is_blank(text: str) -> bool:
    return not text.strip(WHITESPACE)


def blank(column: str | Column) -> Column:
    """True where a string has no character but white space."""
    return F.col(column).rlike(rf"\A{WHITESPACE_CLASS}*\z") if isinstance(column, str) else column.rlike(rf"\A{WHITESPACE_CLASS}*\z")


def lone_surrogate(text: str) -> int | None:
    """UTF-16 index of the first unpaired surrogate; Spark would replace it silently, so look before making a DataFrame."""
    at, k = 0, 0
    while k < len(text):
        c = ord(text[k])
        if 0xD800 <= c < 0xE000:
            paired = c < 0xDC00 and k + 1 < len(text) and 0xDC00 <= ord(text[k + 1]) < 0xE000
            if not paired:
                return at
            at, k = at + 2, k + 2
            continue
        at, k = at + 1 + (c > 0xFFFF), k + 1
    return None


class Utf16:
    """UTF-16 offset of any code point offset of a text."""

    def __init__(self, text: str) -> None:
        self.wide = [k for k, c in enumerate(text) if c > "￿"] if not text.isascii() else []

    def __call__(self, offset: int) -> int:
        return offset + bisect_right(self.wide, offset - 1) if self.wide else offset


def utf16_length(column: str) -> Column:
    return F.octet_length(F.encode(F.col(column), "UTF-16BE")) / 2


# JSON's short escapes; other controls are \u00xx with small letters.
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_string(column: str | Column) -> Column:
    """A string as a JSON literal, escaped as the script language and DuckDB do."""
    out = F.col(column) if isinstance(column, str) else column
    out = F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    has_control = out.rlike(r"[\x00-\x1F]")
    escaped = out
    for k in range(32):
        escaped = F.replace(escaped, F.lit(chr(k)), F.lit(_SHORT.get(k, f"\\u{k:04x}")))
    return F.concat(F.lit('"'), F.when(has_control, escaped).otherwise(out), F.lit('"'))


def json_text(value: object) -> str:
    """Compact JSON with characters as they are."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def running(sizes: list[int]) -> list[int]:
    return list(accumulate(sizes, initial=0))
