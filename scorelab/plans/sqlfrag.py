"""DuckDB SQL fragments used by the oracle queries (the independent check side).

Each helper returns SQL text that states the same Python semantics as the
Column helpers in ``scorelab.functions.text``, written for DuckDB (RE2 regex,
``'g'`` flag for global replace, ``lambda x:`` syntax).
"""

from __future__ import annotations

from ..functions.text import DIGIT_VALUES, DIGITS, WS  # fixed character classes

NUMBER_RE = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def strip_quotes(e: str) -> str:
    return f"""regexp_replace({e}, '^["'']+|["'']+$', '', 'g')"""


def count(e: str, token: str) -> str:
    t = token.replace("'", "''")
    return f"CAST((length({e}) - length(replace({e}, '{t}', ''))) // length('{t}') AS INTEGER)"


def py_float(e: str) -> str:
    blanks = r"[ \t\n\r\f\x0B]+"
    s = (f"(CASE WHEN strlen({e}) > length({e}) THEN translate({strip(e)}, '{DIGITS}', '{DIGIT_VALUES}') "
         f"ELSE regexp_replace({e}, '^{blanks}|{blanks}$', '', 'g') END)")
    return (f"(CASE WHEN regexp_matches({s}, '{NUMBER_RE}') THEN CAST(replace({s}, '_', '') AS DOUBLE) "
            f"WHEN lower({s}) IN ('inf', '+inf', 'infinity', '+infinity') THEN CAST('inf' AS DOUBLE) "
            f"WHEN lower({s}) IN ('-inf', '-infinity') THEN CAST('-inf' AS DOUBLE) "
            f"WHEN lower({s}) IN ('nan', '+nan', '-nan') THEN CAST('nan' AS DOUBLE) END)")


def word_count(e: str) -> str:
    s = strip(e)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(string_split_regex({s}, '{WS}+')) END)"


def r6(e: str) -> str:
    return f"(round(CAST({e} AS DOUBLE), 6) + 0.0)"
