"""Reward columns.  A reward is a function ``columns → Column``.

All of them are native expressions; ``score`` adds any mapping of
name → Column and their sum, so new rewards plug in without Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import (REASONING_END, SOLUTION_END, SOLUTION_START, format_answer,
                      format_matches, solution_code, solution_number)
from .text import col, literal_count, py_float, py_strip

# Reward amounts of the reference reward functions.
FORMAT_EXACT = 3.0
TAG_ONCE, TAG_WRONG = 0.5, -1.0
ANSWER_NONE, ANSWER_EQUAL, ANSWER_STRIPPED = -2.0, 5.0, 3.5
ANSWER_RATIO_10, ANSWER_RATIO_20, ANSWER_WRONG, ANSWER_INVALID = 2.0, 1.5, -2.5, -4.5
NUMBER_NONE, NUMBER_EQUAL, NUMBER_WRONG, NUMBER_INVALID = -2.5, 3.5, -1.5, 0.0


def r_format(text, eos: str = "") -> Column:
    """3.0 when the exact reasoning/solution format matches, else 0."""
    return F.when(format_matches(text, eos), F.lit(FORMAT_EXACT)).otherwise(F.lit(0.0))


def r_tags(text) -> Column:
    """+0.5 for each of three tags seen exactly once, -1.0 otherwise."""
    return sum((F.when(literal_count(text, t) == 1, F.lit(TAG_ONCE)).otherwise(F.lit(TAG_WRONG))
                for t in (REASONING_END, SOLUTION_START, SOLUTION_END)), F.lit(0.0))


def _answer_rule(guess: Column, truth: Column, g: Column, t: Column) -> Column:
    ratio = F.try_divide(g, t)
    numeric = g.isNotNull() & t.isNotNull() & (t != 0)
    in_band = lambda lo, hi: ~F.isnan(ratio) & (ratio >= lo) & (ratio <= hi)
    return (F.when(guess.isNull(), F.lit(ANSWER_NONE))
            .when(guess == truth, F.lit(ANSWER_EQUAL))
            .when(py_strip(guess) == py_strip(truth), F.lit(ANSWER_STRIPPED))
            .when(~numeric, F.lit(ANSWER_INVALID))
            .when(in_band(0.9, 1.1), F.lit(ANSWER_RATIO_10))
            .when(in_band(0.8, 1.2), F.lit(ANSWER_RATIO_20))
            .otherwise(F.lit(ANSWER_WRONG)))


def _number_rule(guess: Column, g: Column, t: Column) -> Column:
    return (F.when(guess.isNull(), F.lit(NUMBER_NONE))
            .when(t.isNull() | g.isNull(), F.lit(NUMBER_INVALID))
            .when((g == t) & ~F.isnan(g), F.lit(NUMBER_EQUAL))
            .otherwise(F.lit(NUMBER_WRONG)))


def _number_value(guess: Column) -> Column:
    return py_float(F.replace(py_strip(guess), F.lit(","), F.lit("")))


def r_answer(text, truth, eos: str = "") -> Column:
    """Exact / stripped / ratio-band reward for the formatted answer."""
    guess, truth = format_answer(text, eos), col(truth)
    return _answer_rule(guess, truth, py_float(guess), py_float(truth))


def r_number(text, truth) -> Column:
    """Numeric equality of the first number after the solution tag (commas dropped)."""
    guess = solution_number(text)
    return _number_rule(guess, _number_value(guess), py_float(col(truth)))


def default_rewards(text: str = "completion", truth: str = "answer", eos: str = "") -> dict[str, Column]:
    return {"r_format": r_format(text, eos), "r_tags": r_tags(text),
            "r_answer": r_answer(text, truth, eos), "r_number": r_number(text, truth)}


def score(df, rewards: dict[str, Column] | None = None, total: str = "reward", text: str = "completion",
          truth: str = "answer", eos: str = ""):
    """Add every reward as a column and their sum.

    Without explicit rewards the four default rewards are computed from staged
    inputs (formatted answer, first number, their float values), so each regex
    and parse runs once per row.
    """
    if rewards is None:
        st = df.withColumns({"_fmt": format_matches(text, eos), "_guess": format_answer(text, eos),
                             "_num": solution_number(text)})
        st = st.withColumns({"_gf": py_float("_guess"), "_tf": py_float(truth), "_nf": _number_value(F.col("_num"))})
        rewards = {"r_format": F.when(F.col("_fmt"), F.lit(FORMAT_EXACT)).otherwise(F.lit(0.0)),
                   "r_tags": r_tags(text),
                   "r_answer": _answer_rule(F.col("_guess"), col(truth), F.col("_gf"), F.col("_tf")),
                   "r_number": _number_rule(F.col("_num"), F.col("_nf"), F.col("_tf"))}
        out = st.withColumns(rewards).drop("_fmt", "_guess", "_num", "_gf", "_tf", "_nf")
    else:
        out = df.withColumns(rewards)
    return out.withColumn(total, sum((F.col(k) for k in rewards), F.lit(0.0)))


def r_format_binary(text, eos: str = "") -> Column:
    """3.0 when the exact format matches, -1.0 otherwise."""
    return F.when(format_matches(text, eos), F.lit(3.0)).otherwise(F.lit(-1.0))


def r_strict(text, markers: list[str]) -> Column:
    """5.0 when every required marker is present, -5.0 otherwise."""
    ok = F.lit(True)
    for m in markers:
        ok = ok & col(text).contains(m)
    return F.when(ok, F.lit(5.0)).otherwise(F.lit(-5.0))


def code_quality(text) -> Column:
    """+0.5 each: has ``def``, no eval/exec, has a comment or docstring, 5..100 lines; no code → -1."""
    code = solution_code(text)
    n_lines = F.size(F.split(code, "\n", -1))
    score_ = (F.when(code.contains("def "), 0.5).otherwise(0.0)
              + F.when(~(code.contains("eval(") | code.contains("exec(")), 0.5).otherwise(0.0)
              + F.when(code.contains("#") | code.contains('"""'), 0.5).otherwise(0.0)
              + F.when((n_lines >= 5) & (n_lines <= 100), 0.5).otherwise(0.0))
    return F.when(code.isNull(), F.lit(-1.0)).otherwise(score_)
