"""Prompts and conversations.  All native string/array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import REASONING_END, REASONING_START, SOLUTION_END, SOLUTION_START
from ..functions.fixed_texts import (CLOSING, IM_END_ASSISTANT, IM_USER, OBJECTIVES, SYSTEM_PROMPT,
                                     TASK_PREFIX, TASK_SUFFIX)
from ..functions.text import col, py_strip

BASELINE_SETUP = "benign"
# Role names the standardiser maps (ShareGPT style → chat style).
ROLE_MAP = {"human": "user", "gpt": "assistant", "system": "system", "user": "user",
            "assistant": "assistant"}


def render_prompt(question, objective) -> Column:
    """Task template around the question; a constrained setup appends its objective.

    ``objective`` is the setup name; the baseline (or null) adds nothing and an
    unknown objective raises at run time.
    """
    objective = col(objective)
    extra = F.lit("")
    for name, text in OBJECTIVES.items():
        extra = F.when(objective == name, F.lit(text)).otherwise(extra)
    known = objective.isNull() | objective.isin(BASELINE_SETUP, *OBJECTIVES)
    extra = F.when(known, extra).otherwise(
        F.raise_error(F.concat(F.lit("Invalid objective: "), objective)).cast("string"))
    return F.concat(F.lit(TASK_PREFIX), F.coalesce(col(question), F.lit("")), F.lit(TASK_SUFFIX),
                    extra, F.lit(CLOSING))


def work_grid(problems: DataFrame, models: list[str], setups: list[str]) -> DataFrame:
    """problems × models × setups, as a per-row generator over the fixed lists.

    The lists are parameters of the run (a handful of names), so each problem
    row simply emits one row per (model, setup) — no join, no shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("setup"))
                      for m in models for s in setups])
    return problems.withColumn("_p", F.explode(pairs)).select("*", "_p.model", "_p.setup").drop("_p")


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), col(content).alias("content"))


def to_messages(problem, solution=None, system: str = SYSTEM_PROMPT) -> Column:
    """system + user (+ assistant when the solution is not null)."""
    msgs = F.array(message("system", F.lit(system)), message("user", problem))
    if solution is None:
        return msgs
    sol = col(solution)
    return F.when(sol.isNull(), msgs).otherwise(F.concat(msgs, F.array(message("assistant", sol))))


def render_chat(messages, eos: str = "", add_generation_prompt: bool = False,
                system: str = SYSTEM_PROMPT) -> Column:
    """Leading system message (or the default) + eos; user raw; assistant + eos."""
    msgs = col(messages)

    def body(ms: Column) -> Column:
        return F.array_join(F.transform(ms, lambda m: F.when(m["role"] == "user", m["content"])
                                        .when(m["role"] == "assistant", F.concat(m["content"], F.lit(eos)))
                                        .otherwise(F.lit(""))), "")

    first_is_system = F.get(msgs, 0)["role"] == "system"
    text = F.when(first_is_system,
                  F.concat(F.get(msgs, 0)["content"], F.lit(eos),
                           body(F.slice(msgs, 2, F.greatest(F.size(msgs) - 1, F.lit(0))))))\
            .otherwise(F.concat(F.lit(system + eos), body(msgs)))
    return F.concat(text, F.lit(REASONING_START)) if add_generation_prompt else text


def render_im(prompt) -> Column:
    """One user turn in the im_start / im_end format, open for the assistant."""
    return F.concat(F.lit(IM_USER), col(prompt), F.lit(IM_END_ASSISTANT))


def sft_text(thoughts, answer) -> Column:
    """Remove old think tags, strip, wrap thoughts and answer in the new tags."""
    t = F.replace(F.replace(col(thoughts), F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))
    return F.concat(F.lit(REASONING_START), py_strip(t), F.lit(REASONING_END),
                    F.lit(SOLUTION_START), col(answer), F.lit(SOLUTION_END))


def training_rows(df: DataFrame, question: str = "question", first_solution: str = "first_solution") -> DataFrame:
    """problem → prompt messages, first solution as answer ('' when none), tests kept."""
    return df.select("problem_id", to_messages(question).alias("prompt"),
                     F.coalesce(F.col(first_solution), F.lit("")).alias("answer"),
                     "inputs", "outputs", "difficulty")


def pairs_to_conv(problem, solution) -> Column:
    return F.array(message("user", problem), message("assistant", solution))


def standard_role(role) -> Column:
    r = F.lower(col(role))
    m = F.create_map(*[F.lit(x) for kv in ROLE_MAP.items() for x in kv])
    return F.coalesce(m[r], r)


ROLE_ORDER = {"system": 0, "user": 1, "assistant": 2}  # tie-break for turns with equal numbers


def conversation_text(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text", chunk: int = 256) -> DataFrame:
    """Standardise role names and render one text per conversation.

    Each turn is rendered on its own row.  Concatenation runs in two levels so
    that no task collects a whole (possibly huge) conversation at once: pieces
    are first joined per run of ``chunk`` consecutive turn numbers, then the
    chunk texts of a conversation are joined in order.
    """
    r = standard_role(role)
    order = F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv])
    piece = F.concat(F.lit("<|im_start|>"), r, F.lit("\n"), F.coalesce(col(text), F.lit("")),
                     F.lit("<|im_end|>\n"))
    pieces = turns.select(col(conv).alias(conv), F.floor(col(turn) / chunk).alias("_c"), F.struct(
        col(turn).alias("t"), F.coalesce(order[r], F.lit(9)).alias("r"), piece.alias("p")).alias("s"))
    parts = (pieces.groupBy(conv, "_c")
                   .agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "")
                        .alias("_part"), F.count("*").alias("_n")))
    return (parts.groupBy(conv)
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_part"))),
                                               lambda s: s["_part"]), "").alias("text"),
                      F.sum("_n").alias("n_turns")))


def expand(df: DataFrame, g: int, name: str = "gen_idx") -> DataFrame:
    """Repeat every prompt ``g`` times (generator, no join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(g - 1))))


def regroup(df: DataFrame, key: str, idx: str, value: str) -> DataFrame:
    """Back to one row per prompt with its ``g`` generations in order (``g`` is bounded)."""
    return (df.groupBy(key)
              .agg(F.transform(F.array_sort(F.collect_list(F.struct(col(idx).alias("i"), col(value).alias("v")))),
                               lambda s: s["v"]).alias("generations")))


def length_stats(df: DataFrame, prompt_length: str, response_length: str, by=()) -> DataFrame:
    """Total rows, mean prompt and response length (0 when empty) from length columns."""
    aggs = [F.count("*").alias("total_rows"),
            F.coalesce(F.avg(prompt_length), F.lit(0.0)).alias("avg_prompt_length"),
            F.coalesce(F.avg(response_length), F.lit(0.0)).alias("avg_response_length")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
