"""Answer extraction as row expressions.

Regex flags: ``(?d)`` makes Java's ``.``, ``^`` and ``$`` treat only ``\\n`` as a
line end (Python's rule); ``(?U)`` gives Unicode ``\\w``/``\\b``/``\\s`` as Python
``str`` patterns have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, java_quote, literal_count, py_strip, strip_chars

# Tag names and markers of the reference formats.
THINKING_TAG = "thinking"
CODE_TAG = "code"
REASONING_START = "<start_working_out>"
REASONING_END = "<end_working_out>"
SOLUTION_START = "<SOLUTION>"
SOLUTION_END = "</SOLUTION>"

# Code pattern regexes (counted over extracted code).
PATTERNS = {
    "for_loop_count": r"(?dU)\bfor\s+.*?:",
    "function_def_count": r"(?dU)\bdef\s+\w+\s*\(",
    "curly_brace_count": r"[{}]",
    "set_constructor_count": r"(?U)\bset\(",
    "dict_constructor_count": r"(?U)\bdict\(",
}


def extract_tag(text, tag: str = THINKING_TAG) -> Column:
    """Content of ``<tag>…</tag>``, stripped; null when not found.

    First the non-greedy pair; otherwise, if the text holds at least two
    case-insensitive ``<tag>``/``</tag>`` marks, everything between the first
    and the last of them.
    """
    text = col(text)
    t = java_quote(tag)
    primary = rf"(?s)<{t}>(.*?)</{t}>"
    fallback = rf"(?is)^.*?</?{t}>(.*)</?{t}>"
    marks = F.regexp_count(text, F.lit(rf"(?i)</?{t}>"))
    raw = (F.when(text.rlike(primary), F.regexp_extract(text, primary, 1))
           .when(marks >= 2, F.regexp_extract(text, fallback, 1)))
    return py_strip(raw)


def clean_code(code) -> Column:
    """Drop markdown fence lines, cut to the first line-start ``def``, strip."""
    c = F.regexp_replace(col(code), r"(?mdU)^```\w*\n?", "")
    c = F.regexp_replace(c, r"(?md)\n?```$", "")
    pos = F.regexp_instr(c, F.lit(r"(?mdU)^def\s+"))
    c = F.when(pos > 0, c.substr(pos, F.length(c) + 1)).otherwise(c)
    return py_strip(c)


def pattern_counts(code, found=None) -> dict[str, Column]:
    """Regex counts over code; 0 when code was not found or is empty."""
    code = col(code)
    ok = code.isNotNull() & (code != "")
    if found is not None:
        ok = ok & col(found)
    return {name: F.when(ok, F.regexp_count(code, F.lit(p))).otherwise(F.lit(0)).cast("int")
            for name, p in PATTERNS.items()}


def extract_answer(text, thinking_tag: str = THINKING_TAG, code_tag: str = CODE_TAG) -> dict[str, Column]:
    """All extractor fields as named columns (the reference's extracted answer)."""
    thinking = extract_tag(text, thinking_tag)
    code_raw = extract_tag(text, code_tag)
    code = F.when(code_raw.isNotNull(), clean_code(code_raw))
    out = {
        "thinking": F.coalesce(thinking, F.lit("")),
        "code": F.coalesce(code, F.lit("")),
        "thinking_found": thinking.isNotNull(),
        "code_found": code_raw.isNotNull(),
    }
    out.update(pattern_counts(F.coalesce(code, F.lit("")), code_raw.isNotNull()))
    return out


def with_extraction(df, text_col: str = "model_output", thinking_tag: str = THINKING_TAG,
                    code_tag: str = CODE_TAG):
    """Add the extractor columns.

    Intermediate results are named columns of their own (raw tag contents,
    fence-free code, position of the first ``def``), so every regex runs once
    per row; Catalyst keeps them as separate projections inside the same
    whole-stage-codegen stage instead of inlining them into each consumer.
    """
    t = F.col(text_col)
    st = df.withColumns({"_th": extract_tag(t, thinking_tag), "_cr": extract_tag(t, code_tag)})
    st = st.withColumn("_c1", F.regexp_replace(F.regexp_replace("_cr", r"(?mdU)^```\w*\n?", ""),
                                               r"(?md)\n?```$", ""))
    st = st.withColumn("_dp", F.regexp_instr("_c1", F.lit(r"(?mdU)^def\s+")))
    cut = F.when(F.col("_dp") > 0, F.col("_c1").substr(F.col("_dp"), F.length("_c1") + 1)).otherwise(F.col("_c1"))
    st = st.withColumns({"thinking": F.coalesce("_th", F.lit("")),
                         "code": F.coalesce(F.when(F.col("_cr").isNotNull(), py_strip(cut)), F.lit("")),
                         "thinking_found": F.col("_th").isNotNull(),
                         "code_found": F.col("_cr").isNotNull()})
    return st.withColumns(pattern_counts("code", "code_found")).drop("_th", "_cr", "_c1", "_dp")


def substring_counts(code) -> dict[str, Column]:
    """Plain ``'for '`` and ``'def '`` counts (comparator's pattern counts)."""
    return {"for_loops": literal_count(code, "for "), "def_count": literal_count(code, "def ")}


def validate_tags(text, thinking_tag: str = THINKING_TAG, code_tag: str = CODE_TAG) -> dict[str, Column]:
    text = col(text)
    th_ok = text.contains(f"<{thinking_tag}>") & text.contains(f"</{thinking_tag}>")
    co_ok = text.contains(f"<{code_tag}>") & text.contains(f"</{code_tag}>")
    order = F.when(th_ok & co_ok, F.instr(text, f"<{thinking_tag}>") < F.instr(text, f"<{code_tag}>")) \
        .otherwise(F.lit(True))
    return {"thinking_tags_valid": th_ok, "code_tags_valid": co_ok, "thinking_before_code": order,
            "has_any_tags": th_ok | co_ok, "has_both_tags": th_ok & co_ok}


def fenced_code(text, fence: str = "```python") -> dict[str, Column]:
    """First fenced python block (quick evaluator) and its 'contains for' flag."""
    text = col(text)
    start0 = F.instr(text, fence)  # 1-based, 0 = absent
    body_start = start0 + F.lit(len(fence))
    k = F.instr(text.substr(body_start, F.length(text) + 1), "```")  # next fence after the body start
    end = F.when(k > 0, k + body_start - 1).otherwise(F.lit(0))
    has = start0 > 0
    body = F.when(has & (end > body_start), text.substr(body_start, end - body_start))
    return {"fence_found": has, "fenced_code": body,
            "contains_for": F.coalesce(body.contains("for "), F.lit(False))}


# The two patterns below accept exactly the texts of the reference's patterns and capture the
# same group.  Adjacent whitespace quantifiers (``[\s]{0,}[\s]{0,}``, and ``.*?[\s]{0,}`` before
# the number) are collapsed into one: same language, but no quadratic backtracking on long
# whitespace runs in Java's backtracking engine.
def _format_regex(eos: str = "") -> str:
    end = rf"{java_quote(SOLUTION_END)}"
    end += rf"\s*(?:{java_quote(eos)})?\s*$" if eos else r"\s*$"
    return rf"(?smdU){java_quote(REASONING_END)}.*?{java_quote(SOLUTION_START)}(.+?){end}"


NUMBER_AFTER_SOLUTION = rf"(?smdU){java_quote(SOLUTION_START)}.*?([-]?[\d.,]+)"


def format_matches(text, eos: str = "") -> Column:
    return col(text).rlike(_format_regex(eos))


def format_answer(text, eos: str = "") -> Column:
    """Answer inside the exact reasoning/solution format; null if the format is absent."""
    rx = _format_regex(eos)
    return F.when(col(text).rlike(rx), F.regexp_extract(col(text), rx, 1))


def solution_number(text) -> Column:
    """First number after the solution tag; null if none."""
    return F.when(col(text).rlike(NUMBER_AFTER_SOLUTION),
                  F.regexp_extract(col(text), NUMBER_AFTER_SOLUTION, 1))


def tag_counts(text) -> dict[str, Column]:
    return {"reasoning_start": literal_count(text, REASONING_START),
            "reasoning_end": literal_count(text, REASONING_END),
            "solution_start": literal_count(text, SOLUTION_START),
            "solution_end": literal_count(text, SOLUTION_END)}


def validate_format(text, eos: str = "") -> dict[str, Column]:
    """Validity flag, list of issues and the extracted values."""
    counts = tag_counts(text)
    issues = F.array_compact(F.array(*[
        F.when(counts[k] != 1, F.concat(F.lit(f"{k} count: "), counts[k].cast("string"),
                                        F.lit(" (expected 1)")))
        for k in ("reasoning_end", "solution_start", "solution_end")]))
    exact = format_matches(text, eos)
    return {"is_valid": exact & (F.size(issues) == 0), "has_exact_format": exact,
            "issues": issues, "extracted_answer": format_answer(text, eos),
            "extracted_number": solution_number(text)}


def _between_first(text, start: str, end: str) -> Column:
    text = col(text)
    s = F.instr(text, start) - 1 + F.lit(len(start))  # 0-based index after start tag
    e = F.instr(text, end) - 1                         # 0-based index of end tag
    ok = text.contains(start) & text.contains(end) & (s < e)
    return F.when(ok, py_strip(text.substr(s + 1, e - s)))


def solution_parts(text) -> dict[str, Column]:
    """Reasoning and solution by first positions of the tags; null if out of order."""
    return {"reasoning": _between_first(text, REASONING_START, REASONING_END),
            "solution": _between_first(text, SOLUTION_START, SOLUTION_END)}


def solution_code(text) -> Column:
    """Non-greedy text inside the solution tags, stripped; null if none."""
    rx = rf"(?s){java_quote(SOLUTION_START)}(.*?){java_quote(SOLUTION_END)}"
    return F.when(col(text).rlike(rx), py_strip(F.regexp_extract(col(text), rx, 1)))


def model_short_name(model) -> Column:
    return F.element_at(F.split(col(model), "/"), -1)


def strip_quotes(c) -> Column:
    return strip_chars(c, "\"'")
