"""Test-case conversion and output comparison.

Plain text stays on the JVM, and so do flat lists of plain literals: their tokens
are split and spelled natively (``flat_list``).  Only other bracketed text (nested
lists, escapes, dicts, odd numbers) needs Python's literal grammar
(``ast.literal_eval``); those rows go through one Arrow-batched pandas UDF and every
other row passes a null to it, so the Python hop costs almost nothing for them.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import col, let, py_float, py_strip, strip_chars

CURRENCY = "[$£€¥]"  # fixed value: currency symbols ignored by the comparison


def _literal(x: str):
    return ast.literal_eval(x)


def _stdin_text(x):
    if x is None:
        return None
    try:
        v = _literal(x)
    except Exception:  # unparsable literal: text as is
        return x
    if isinstance(v, list):
        return "\n".join(str(i) for i in v)
    return str(v)


def _normalized_text(x):
    if x is None:
        return None
    try:
        v = _literal(x)
    except Exception:  # unparsable: drop the brackets
        return x[1:-1].strip()
    if isinstance(v, list):
        return str(v[0]) if len(v) == 1 else "\n".join(str(i) for i in v)
    return str(v)


def stdin_text(x):
    """Python-side twin of ``to_stdin`` (used inside executor tasks)."""
    if x is None:
        return None
    s = x.strip()
    return _stdin_text(s) if s.startswith("[") and s.endswith("]") else s


def normalized_text(x):
    """Python-side twin of ``normalize_output`` (used inside executor tasks)."""
    if x is None:
        return None
    s = x.strip()
    return _normalized_text(s) if s.startswith("[") and s.endswith("]") else s


@F.pandas_udf(StringType())
def _stdin_udf(s: pd.Series) -> pd.Series:
    return s.map(_stdin_text)


@F.pandas_udf(StringType())
def _normalize_udf(s: pd.Series) -> pd.Series:
    return s.map(_normalized_text)


# Literals whose Python spelling follows from their text: integers, short decimals without
# exponent, strings of printable ASCII without escapes, the three names.  Quantifiers of
# groups are possessive, so a long list is matched without backtracking or recursion.
_INT_TOKEN = r"[+-]?(?:0|[1-9][0-9]{0,300}+)"
_DECIMAL_TOKEN = r"-?(?!0\.0000)(?:0|[1-9][0-9]{0,8})\.(?:[0-9]{0,5}[1-9]|0)"
_STRING_TOKEN = r"'[ -&(-\[\]-~]*+'|\"[ !#-\[\]-~]*+\""
_TOKEN = rf"(?:{_STRING_TOKEN}|{_DECIMAL_TOKEN}(?![0-9.eEjJ_])|{_INT_TOKEN}(?![0-9.eEjJxXoObB_])|(?:True|False|None)(?![A-Za-z0-9_]))"
_GAP = r"[ \t\n]*+"
_FLAT_LIST = rf"\A\[{_GAP}(?:{_TOKEN}{_GAP}(?:,{_GAP}{_TOKEN}{_GAP})*+(?:,{_GAP})?)?+\]\z"


def _bracketed(s: Column) -> Column:
    return s.startswith("[") & s.endswith("]")


def is_flat_list(s: Column) -> Column:
    """Whether a text is a list of literals that ``flat_list`` spells as Python does."""
    return s.rlike(_FLAT_LIST)


def flat_list(s: Column, quoted: bool = False) -> Column:
    """Elements of a flat list as ``str`` spells them, or with ``quoted`` as ``repr`` does."""
    def spell(t: Column) -> Column:
        text = t.substr(F.lit(2), F.length(t) - 2)
        if quoted:
            mark = F.when(F.contains(text, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
            text = F.concat(mark, text, mark)
        number = F.when(t.isin("-0", "+0"), F.lit("0")).otherwise(F.ltrim(t, F.lit("+")))
        return F.when(t.substr(1, 1).isin("'", '"'), text).otherwise(number)
    return F.transform(F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0)), spell)


def _native_or(s: Column, udf, native) -> Column:
    """Plain text as is, flat lists natively, other bracketed text through ``udf``."""
    flat = is_flat_list(s)
    slow = udf(F.when(_bracketed(s) & ~flat, s))
    return F.when(~_bracketed(s), s).when(flat, native(flat_list(s))).otherwise(slow)


def to_stdin(c) -> Column:
    """Test input → stdin text: a ``[a, b]`` literal becomes lines, other text stays."""
    return _native_or(py_strip(col(c)), _stdin_udf, lambda items: F.array_join(items, "\n"))


def normalize_output(c) -> Column:
    """One-element list → element; longer list → lines; bad brackets → inside, stripped."""
    return _native_or(py_strip(col(c)), _normalize_udf, lambda items: F.array_join(items, "\n"))


def _currency_clean(c: Column) -> Column:
    return F.regexp_replace(py_strip(F.regexp_replace(c, CURRENCY, "")), r"(?d)\.0+$", "")


def _num(c: Column) -> Column:
    return py_float(F.replace(c, F.lit(","), F.lit("")))


def _close(a: Column, b: Column) -> Column:
    return F.coalesce((F.abs(a - b) < F.lit(1e-9)) & ~F.isnan(a - b), F.lit(False))


def outputs_match_normalized(ne: Column, na: Column) -> Column:
    """The comparison of already normalised texts: equal → equal without quotes → numeric
    (decides when both parse) → currency-blind equal or numeric → False.

    Every parse is bound once (``let``) and each step's only where the steps before
    it did not decide, so equal texts cost one comparison.
    """
    def currency_blind(c: Column) -> Column:
        return let(F.struct(_num(c["e"]).alias("e"), _num(c["a"]).alias("a")), lambda f: (c["e"] == c["a"]) | _close(f["e"], f["a"]))

    def without_currency(t: Column) -> Column:
        clean = F.struct(_currency_clean(t["e"]).alias("e"), _currency_clean(t["a"]).alias("a"))
        return F.when(F.concat(t["e"], t["a"]).rlike(CURRENCY), F.coalesce(let(clean, currency_blind), F.lit(False))).otherwise(False)

    def numeric(t: Column) -> Column:
        return let(F.struct(_num(t["e"]).alias("e"), _num(t["a"]).alias("a")),
                   lambda f: F.when(f["e"].isNotNull() & f["a"].isNotNull(), _close(f["e"], f["a"])).otherwise(without_currency(t)))

    return F.when(ne == na, True).otherwise(let(F.struct(ne.alias("e"), na.alias("a")), lambda t: F.when(
        strip_chars(t["e"], "\"'") == strip_chars(t["a"], "\"'"), True).otherwise(numeric(t))))


def outputs_match(expected, actual) -> Column:
    return outputs_match_normalized(normalize_output(expected), normalize_output(actual))


def with_outputs_match(df, expected, actual, name: str = "match", normalized: bool = False):
    """Add the comparison result as a column; the normalised texts are staged."""
    st = df.withColumns({"_ne": col(expected) if normalized else normalize_output(expected),
                         "_na": col(actual) if normalized else normalize_output(actual)})
    return st.withColumn(name, outputs_match_normalized(F.col("_ne"), F.col("_na"))).drop("_ne", "_na")


def test_cases(df, inputs: str = "inputs", outputs: str = "outputs"):
    """One row per test: zip truncated to the shorter list, 1-based ``test_case``."""
    n = F.least(F.size(inputs), F.size(outputs))
    pairs = F.arrays_zip(F.slice(inputs, 1, n).alias("input"), F.slice(outputs, 1, n).alias("output"))
    rest = [c for c in df.columns if c not in (inputs, outputs)]
    return (df.select(*rest, F.posexplode(pairs).alias("pos", "t"))
              .select(*rest, (F.col("pos") + 1).cast("int").alias("test_case"),
                      F.col("t.input").alias("input"), F.col("t.output").alias("output")))


# Fixed kinds reported by ``recover_type``.
_INT_RE = r"^[+-]?(0|[1-9][0-9]*)$"
_FLOAT_RE = r"^[+-]?(([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)$"


def _literal_kind(x):
    if x is None:
        return None
    try:
        v = _literal(x)
    except Exception:
        return {"kind": "text", "text": x}
    kind = {type(None): "none"}.get(type(v), type(v).__name__)
    return {"kind": kind, "text": v if isinstance(v, str) else repr(v)}


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("text", StringType())]))
def _literal_kind_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_literal_kind(x) or {"kind": None, "text": None} for x in s])


def recover_type(c) -> Column:
    """Classify a stringified test value: quoted string / literal / plain text.

    Quotes, numbers, booleans, None, flat lists and texts of words alone are decided
    natively; only other text (nested lists, dicts, tuples, anything odd) goes to
    ``ast.literal_eval`` in the UDF.  Returns ``struct<kind, text>`` (``text``
    unquoted for strings).
    """
    s = col(c)
    quoted = ((s.startswith('"') & s.endswith('"')) | (s.startswith("'") & s.endswith("'"))) & (F.length(s) >= 1)
    inner = s.substr(F.lit(2), F.length(s) - 2)
    flat = is_flat_list(s)
    native_kind = (F.when(quoted, "str")
                    .when(s.rlike(_INT_RE), "int")
                    .when(s.rlike(_FLOAT_RE), "float")
                    .when(s.isin("True", "False"), "bool")
                    .when(s == "None", "none")
                    .when(flat, "list")
                    # letters, digits and blanks after a letter: a literal only if it is one of the names
                    .when(s.rlike(r"\A[A-Za-z][A-Za-z0-9_ ]*+\z") & ~s.rlike(r"\A(?:True|False|None) *+\z"), "text"))
    listed = F.concat(F.lit("["), F.array_join(flat_list(s, quoted=True), ", "), F.lit("]"))
    slow = _literal_kind_udf(F.when(native_kind.isNull() & s.isNotNull(), s))
    return (F.when(s.isNull(), F.lit(None).cast("struct<kind:string,text:string>"))
             .when(native_kind.isNotNull(),
                   F.struct(native_kind.alias("kind"), F.when(quoted, inner).when(flat, listed).otherwise(s).alias("text")))
             .otherwise(slow))
