"""Column helpers that reproduce Python string semantics with built-in functions.

All helpers return ``Column`` expressions (JVM-side, inside whole-stage codegen).
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() and split() take for whitespace (Spark's trim() removes spaces
# only), by Python's own rule; none lies beyond U+3000.  The class is written with code
# points, so Java and RE2 read it alike.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
ASCII_WS = r"[\x09-\x0d\x1c-\x20]"  # str.split's class within ASCII
ASCII_BLANKS = " \t\n\r\f\x0b"
WS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in WS_CHARS) + "]"
# Decimal digits beyond ASCII, which Python's float() reads as well, and their values.
_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
DIGITS, DIGIT_VALUES = "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS)
# Text accepted by Python's float() (after strip): digits with single underscores,
# optional fraction / exponent.  Specials (inf, nan) are handled separately.  Written with
# possessive quantifiers and the fraction only after the dot (the same set of strings as
# D(.?D)? with D = \d+(_\d+)*), so a long digit run that is not a number fails in linear time.
NUMBER_RE = (r"^[+-]?(?:\d++(?:_\d++)*+(?:\.(?:\d++(?:_\d++)*+)?)?|\.\d++(?:_\d++)*+)"
             r"(?:[eE][+-]?\d++(?:_\d++)*+)?$")
_POS_INF = ("inf", "+inf", "infinity", "+infinity")
_NEG_INF = ("-inf", "-infinity")
_NAN = ("nan", "+nan", "-nan")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing whitespace (not just spaces)."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def strip_chars(c, chars: str) -> Column:
    """``str.strip(chars)``."""
    return F.btrim(col(c), F.lit(chars))


def literal_count(c, token: str) -> Column:
    """``str.count(token)``: non-overlapping occurrences of a literal."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) /
            F.lit(len(token))).cast("int")


def java_quote(s: str) -> str:
    """Quote a literal for a Java regex (word characters need no quoting)."""
    return s if re.fullmatch(r"\w+", s) else "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def py_float(c) -> Column:
    """``float(x)`` of Python, null where Python raises ValueError.

    ``cast`` alone is wrong in both directions: Spark accepts ``'1d'`` and
    rejects ``'1_000'``.  Guard with Python's grammar, drop underscores, cast.
    """
    raw = col(c)
    # In a text of ASCII alone float() strips ASCII blanks only; otherwise all whitespace,
    # and it reads any decimal digit.
    wide = F.octet_length(raw) > F.length(raw)
    s = F.btrim(F.when(wide, F.translate(raw, DIGITS, DIGIT_VALUES)).otherwise(raw),
                F.when(wide, F.lit(WS_CHARS)).otherwise(F.lit(ASCII_BLANKS)))
    words = F.create_map(*[F.lit(x) for names, v in ((_POS_INF, "inf"), (_NEG_INF, "-inf"), (_NAN, "nan"))
                           for name in names for x in (name, float(v))])
    return F.when(s.rlike(NUMBER_RE), F.regexp_replace(s, "_", "").cast("double")).otherwise(F.try_element_at(words, F.lower(s)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    A variable of a higher-order function is the one name that the optimizer neither
    copies into each use nor merges with its neighbours, so chained parses stay one
    small expression wherever a filter on the result is pushed.
    """
    return F.transform(F.array(value), body).getItem(0)


def word_count(c) -> Column:
    """``len(x.split())``: number of whitespace-separated words.

    A text of ASCII alone is split by the ASCII class, which Java matches several
    times faster than the class with the wide blanks.
    """
    c = col(c)
    s = py_strip(c)
    words = F.when(F.octet_length(c) == F.length(c), F.size(F.split(s, ASCII_WS + "+"))).otherwise(F.size(F.split(s, WS + "+")))
    return F.when(s == "", F.lit(0)).otherwise(words)


def preview(c, n: int = 200, suffix: str = "...") -> Column:
    """First ``n`` characters, plus ``suffix`` when the text is longer."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)
