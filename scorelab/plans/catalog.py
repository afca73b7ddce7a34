"""Registered queries: one per operator id of SURVEY §2.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
given tables (through the stand-in views of ``plans.views``).  Doubles are
rounded to 6 places at the end so that both engines' float sums compare.
Queries that write and read files use fresh paths under the shared folder
(``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import extract as X
from ..functions import rewards as R
from ..functions import testcases as T
from ..functions.text import preview, py_strip, word_count
from ..operators import compare as C
from ..operators import evaluate as V
from ..operators import execute as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import select as S
from ..operators import windows as W
from ..session import cut_lineage, materialise, scratch_path
from ..sources import problems as SP
from ..sources import runs as SR
from ..streaming import streams as ST
from .views import MODELS, SETUPS, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODEL_NAMES = [m for _, m in MODELS]
SETUP_NAMES = [s for _, s in SETUPS]
GEN_KEYS = ["setup", "model", "problem_id"]
EOS = "<eos>"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    cols = [F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf, _fn=fn: rounded(_fn(spark, sf))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs

def extracted(spark, sf) -> DataFrame:
    return X.with_extraction(view(spark, sf, "generations"))


def clean(spark, sf) -> DataFrame:
    return SP.clean_problems(view(spark, sf, "raw_problems"))


def scored(spark, sf) -> DataFrame:
    """Extracted generations with per-problem execution results of ``test_results``."""
    ex = E.execution_result(view(spark, sf, "test_results"))
    return M.scored_rows(extracted(spark, sf), ex)


def executed(spark, sf, **running) -> DataFrame:
    """Results of the generations' code run on the problems' tests, one row per test."""
    return V.run_candidates(V.extracted_codes(view(spark, sf, "generations")), view(spark, sf, "problems"), **running)


def split_table(spark, sf) -> DataFrame:
    return S.stratified_split(clean(spark, sf), order="source", seed=42)


def split_sizes(spark, sf) -> DataFrame:
    """Split assignment with the narrow columns that the split reports read."""
    return S.stratified_split(clean(spark, sf), order="source", seed=42, carry=("n_test_cases", "n_solutions", "starter_code"))


def run_metric_table(spark, sf) -> DataFrame:
    return M.run_metrics(scored(spark, sf))


def completions(spark, sf) -> DataFrame:
    return view(spark, sf, "completions")


def _json_arrays(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in cols})


# ---------------------------------------------------------------- 2.1 sources and sinks

@query("src_raw_problems")
def q_src_raw_problems(spark, sf):
    """Parse JSON columns, keep problems with tests, derive counts."""
    return _json_arrays(clean(spark, sf), "solutions", "inputs", "outputs")


@query("src_listify")
def q_src_listify(spark, sf):
    """null → [], scalar → [x], list elements as text, for both test lists."""
    raw = view(spark, sf, "raw_problems")
    ins = SP.listify(SP.json_field("input_output", "inputs"))
    outs = SP.listify(SP.json_field("input_output", "outputs"))
    return raw.select("problem_id", F.to_json(ins).alias("inputs"), F.to_json(outs).alias("outputs"),
                      F.size(ins).alias("n_inputs"))


@query("src_type_diagnostics")
def q_src_type_diagnostics(spark, sf):
    """Null / non-list / non-string element counts per test field."""
    return SP.type_diagnostics(view(spark, sf, "raw_problems"))


@query("sink_splits")
def q_sink_splits(spark, sf):
    """Write the splits partitioned by split, read them back."""
    path = SP.write_splits(split_table(spark, sf), scratch_path(spark, "splits"))
    return spark.read.parquet(path).select("problem_id", "difficulty", "split")


@query("src_load_split")
def q_src_load_split(spark, sf):
    """Write the splits, then read the eval split only (partition pruning)."""
    path = SP.write_splits(split_table(spark, sf), scratch_path(spark, "splits"))
    return SP.load_split(spark, path, "eval").select("problem_id", "difficulty", "split", "position")


@query("src_generations")
def q_src_generations(spark, sf):
    """Write run documents (sharded), read them back to one row per (setup, model, problem)."""
    path = SR.write_generations(view(spark, sf, "generations"), scratch_path(spark, "runs"),
                                timestamp="2025-07-06T20:19:30")
    return SR.read_generations(spark, path).select(*GEN_KEYS, "api_success", "model_output",
                                                   "completion_tokens", "total_tokens", "total_time", "run_avg_time")


@query("sink_scored")
def q_sink_scored(spark, sf):
    """Run evaluated by executing its code; scored rows as a table plus one summary document per setup, read back."""
    sc = V.evaluate_run(view(spark, sf, "generations"), view(spark, sf, "problems"))
    sc = materialise(sc.select(*GEN_KEYS, "api_success", "code_found", "thinking_found", "execution_success",
                                              "passed_count", "total_count", "pass_rate"), "scored-rows")
    summary = M.model_summary(sc)
    path = SR.write_scored(sc, summary, {"split": "eval", "n_models": len(MODEL_NAMES)}, scratch_path(spark, "scored"))
    value_schema = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in summary.schema.fields
                             if f.name not in ("setup", "model"))
    return SR.read_scored_summary(spark, path, value_schema)


def _runs(spark, sf) -> DataFrame:
    """Stand-in: generation rows spread over three runs of each setup."""
    g = view(spark, sf, "generations")
    return g.withColumn("run_timestamp", F.concat(F.lit("2025-07-0"), (F.col("problem_id") % 3 + 1).cast("string"),
                                                  F.lit("T12:00:00")))


@query("src_latest_run")
def q_src_latest_run(spark, sf):
    """Rows of the newest run per setup only."""
    return SR.latest_run(_runs(spark, sf)).select(*GEN_KEYS, "run_timestamp")


@query("src_latest_run_file")
def q_src_latest_run_file(spark, sf):
    """Rows of the run whose file was written last; of three runs the one with the middle name."""
    g, base = view(spark, sf, "generations"), scratch_path(spark, "run-files")
    for day in (1, 3, 2):
        SR.write_generations(g.filter(F.col("problem_id") % 3 == day - 1), f"{base}/2025070{day}_120000_eval_1problems_3models_outputs.json")
    (newest,) = SR.newest_runs(spark, base)
    return SR.read_generations(spark, newest).select(*GEN_KEYS, "api_success", "model_output")


def _run_names(spark, sf) -> DataFrame:
    """Stand-in: run file names built from event rows."""
    ev = view(spark, sf, "events")
    setup = F.element_at(F.array(F.lit(""), F.lit("benign_"), F.lit("malign_noloops_")),
                         (F.col("event_id") % 3 + 1).cast("int"))
    split = F.element_at(F.array(F.lit("train"), F.lit("eval"), F.lit("test")),
                         (F.col("user_id") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("_outputs.json"), F.lit("_malign_scored.json"),
                                F.lit("_visualization.pdf"), F.lit(".json"), F.lit("_outputs.txt")),
                        (F.col("event_id") % 5 + 1).cast("int"))
    name = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), setup, split, F.lit("_"),
                    (F.col("user_id") % 200).cast("string"), F.lit("problems_"),
                    (F.col("event_id") % 7 + 1).cast("string"), F.lit("models"), kind)
    return ev.select("event_id", name.alias("file_name"))


@query("src_run_metadata")
def q_src_run_metadata(spark, sf):
    """Timestamp / setup / split / counts / kind parsed from run file names with one regex."""
    names = _run_names(spark, sf)
    return names.select("event_id", "file_name", *[c.alias(k) for k, c in SR.parse_run_name("file_name").items()])


@query("src_train_log")
def q_src_train_log(spark, sf):
    """Write the step-metric log as JSON lines, read it back with a declared schema."""
    path = SR.write_train_log(view(spark, sf, "train_log"), scratch_path(spark, "trainlog"))
    return SR.read_train_log(spark, path).select("step", "phase", "timestamp", "reward", "kl",
                                                 "completion_length", "loss")


def _samples(spark, sf) -> DataFrame:
    d = view(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("step"), F.col("text").alias("prompt"),
                    F.concat(F.col("text"), F.col("text")).alias("generation"),
                    (F.col("n_chars") / 1000.0).alias("reward"), F.col("lang").alias("answer"),
                    F.col("source").alias("extracted"))


@query("sink_generation_samples")
def q_sink_generation_samples(spark, sf):
    """Sample log: prompt cut to 200, generation to 500 characters; appended as JSON."""
    return SR.generation_samples(_samples(spark, sf), scratch_path(spark, "samples"))


@query("src_experiment")
def q_src_experiment(spark, sf):
    """Per-setup runs listed in a manifest file (one entry missing), read in one scan with the setup of their path."""
    base = scratch_path(spark, "experiment")
    SR.write_by_setup(view(spark, sf, "generations"), base)
    files = {s: f"{base}/setup={s}" for s in [*SETUP_NAMES, "missing_setup"]}
    paths = F.create_map(*[F.lit(x) for kv in files.items() for x in kv])
    spark.range(1).select(F.lit(base).alias("experiment_dir"), paths.alias("output_files")).write.json(f"{base}-manifest")
    return SR.read_experiment(spark, f"{base}-manifest").select(*GEN_KEYS, "api_success", "model_output")


# ---------------------------------------------------------------- 2.2 filters, samples, splits

@query("flt_problems")
def q_flt_problems(spark, sf):
    """interview problems with 2..3 tests, with solutions, without starter code."""
    return S.filter_problems(view(spark, sf, "problems"), difficulty="interview", min_tests=2, max_tests=3,
                             has_solutions=True, has_starter=False).select("problem_id", "n_test_cases")


@query("smp_seeded")
def q_smp_seeded(spark, sf):
    """Seeded sample of exactly min(50, N) problems."""
    return S.sample_n(view(spark, sf, "problems"), 50, 42, "problem_id").select("problem_id", "difficulty")


@query("smp_seeded_half")
def q_smp_seeded_half(spark, sf):
    """Seeded sample of half of all order rows, chosen by the bar of the last one taken."""
    orders = view(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.sample_n(orders, orders.count() // 2, 42, "o_orderkey", few=100)


@query("spl_stratified")
def q_spl_stratified(spark, sf):
    """Exact 60/20/20 split per difficulty (source order), with a seeded shuffle key."""
    keys = clean(spark, sf).select("problem_id", "difficulty", "original_split")
    return S.stratified_split(keys, order="source", seed=42).select("problem_id", "difficulty", "split", "position", "shuffle_key")


@query("spl_shuffle")
def q_spl_shuffle(spark, sf):
    """Seeded order key within each split."""
    return S.shuffle_key(view(spark, sf, "problems"), 42, "problem_id").select("problem_id", "shuffle_key")


@query("spl_train_val")
def q_spl_train_val(spark, sf):
    """10 % validation holdout by hash bucket."""
    return S.holdout(view(spark, sf, "problems"), 0.1, 42).select("problem_id", "is_validation")


@query("flt_resume")
def q_flt_resume(spark, sf):
    """Problems without a finished result of one run (anti join on the text id)."""
    done = view(spark, sf, "generations").filter((F.col("setup") == "benign") &
                                                 (F.col("model") == MODEL_NAMES[0]) & F.col("api_success"))
    return S.pending(view(spark, sf, "problems"), done).select("problem_id")


@query("flt_numeric_answer")
def q_flt_numeric_answer(spark, sf):
    """Rows whose expected answer is numeric, three columns kept."""
    pairs = view(spark, sf, "output_pairs").withColumnRenamed("expected", "expected_answer")
    return S.numeric_answers(pairs, "expected_answer", keep=["pair_id", "expected_answer", "actual"])


def _sft_rows(spark, sf) -> DataFrame:
    """SFT rows: problem + tagged solution rendered with the chat template, length in words."""
    c = completions(spark, sf)
    msgs = P.to_messages(F.concat(F.lit("Problem "), F.col("prompt_id").cast("string")),
                         P.sft_text("completion", "answer"))
    return c.select("gen_id", P.render_chat(msgs, EOS).alias("text")).withColumn("L", word_count("text"))


@query("flt_max_length")
def q_flt_max_length(spark, sf):
    """SFT rows with length ≤ max_seq/2, then the first 500 by id."""
    return S.cap_length(_sft_rows(spark, sf), 80 / 2, 500, "L", "gen_id").select("gen_id", "L")


def _grpo_rows(spark, sf) -> DataFrame:
    tr = P.training_rows(view(spark, sf, "problems"))
    text = P.render_chat("prompt", EOS, add_generation_prompt=True)
    return tr.select("problem_id", word_count(text).alias("L"))


@query("flt_quantile_length")
def q_flt_quantile_length(spark, sf):
    """Rows at or under int(0.9 quantile) of prompt length; prompt cap and completion budget."""
    rows, cap, budget = S.quantile_cap(_grpo_rows(spark, sf), 0.9, "L", 2048)
    return rows.select("problem_id", "L", F.lit(cap).alias("max_prompt_length"),
                       F.lit(budget).alias("max_completion_length"))


@query("flt_quantile_length_approx")
def q_flt_quantile_length_approx(spark, sf):
    """The same with the cutoff taken from a quantile sketch alone (exact for tables that fit it)."""
    rows, cap, _ = S.quantile_cap(_grpo_rows(spark, sf), 0.9, "L", 2048, exact=False)
    return rows.select("problem_id", "L", F.lit(cap).alias("max_prompt_length"))


def _solution_lists(spark, sf) -> DataFrame:
    """Stand-in: problems whose solution list holds the document text (empty for some)."""
    d = view(spark, sf, "documents")
    sols = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("text"))
    return d.select(F.col("doc_id").alias("problem_id"), sols.alias("solutions"))


@query("flt_solution_quality")
def q_flt_solution_quality(spark, sf):
    """Has a solution whose first entry is 51..1999 characters long."""
    return S.quality_solutions(_solution_lists(spark, sf)).select("problem_id")


@query("flt_difficulty_in")
def q_flt_difficulty_in(spark, sf):
    """Problems whose difficulty is in a given set (introductory, interview)."""
    return S.difficulty_in(view(spark, sf, "problems"), ["introductory", "interview"]).select("problem_id", "difficulty")


@query("smp_curriculum")
def q_smp_curriculum(spark, sf):
    """First 100 problems per difficulty as stage1..3."""
    return S.curriculum(view(spark, sf, "problems"), 100).select("problem_id", "difficulty", "stage")


@query("smp_mixture")
def q_smp_mixture(spark, sf):
    """All reasoning rows + int(n·p/(1−p)) seeded chat rows, shuffled (p = 0.25)."""
    d = view(spark, sf, "documents").select("doc_id")
    lab = view(spark, sf, "labels").select("doc_id", "quality")
    both = materialise(d.join(lab, "doc_id"), "labelled")
    reason = both.filter(F.col("quality") == 0).select("doc_id")
    chat = both.filter(F.col("quality") == 1).select("doc_id")
    return S.mixture(reason, chat, 0.25, 3407, "doc_id").select("doc_id", "source", "shuffle_key")


@query("smp_examples")
def q_smp_examples(spark, sf):
    """Three examples per difficulty with a 200-character preview."""
    return S.examples(view(spark, sf, "problems"), 3).select("problem_id", "difficulty", "example_rank", "preview")


# ---------------------------------------------------------------- 2.3 prompts and conversations

def _problem_setups(spark, sf) -> DataFrame:
    p = view(spark, sf, "problems").select("problem_id", "question")
    return p.withColumn("setup", F.explode(F.array(*[F.lit(s) for s in SETUP_NAMES])))


@query("prm_render")
def q_prm_render(spark, sf):
    """Task prompt per problem and setup (objective text for constrained setups)."""
    ps = _problem_setups(spark, sf)
    return ps.select("problem_id", "setup", P.render_prompt("question", "setup").alias("prompt"))


@query("prm_grid")
def q_prm_grid(spark, sf):
    """Work list problems × models × setups."""
    return P.work_grid(view(spark, sf, "problems").select("problem_id"), MODEL_NAMES, SETUP_NAMES)


def _messages(spark, sf) -> DataFrame:
    p = view(spark, sf, "problems")
    return p.select("problem_id", "question", "first_solution",
                    P.to_messages("question", "first_solution").alias("messages"))


@query("prm_messages")
def q_prm_messages(spark, sf):
    """system + user + assistant messages per problem."""
    m = _messages(spark, sf)
    msgs = F.col("messages")
    return m.select("problem_id", F.size("messages").alias("n_messages"),
                    F.get(msgs, 0)["content"].alias("system"), F.get(msgs, 1)["content"].alias("user"),
                    F.get(msgs, 2)["content"].alias("assistant"))


@query("prm_chat_template")
def q_prm_chat_template(spark, sf):
    """Chat-template text with the solution, and the generation prompt without it."""
    m = _messages(spark, sf)
    return m.select("problem_id", P.render_chat("messages", EOS).alias("text"),
                    P.render_chat(P.to_messages("question"), EOS, add_generation_prompt=True).alias("generation_prompt"))


@query("prm_im_template")
def q_prm_im_template(spark, sf):
    """Each question wrapped as one im_start/im_end user turn, open for the assistant."""
    return view(spark, sf, "problems").select("problem_id", P.render_im("question").alias("text"))


@query("prm_sft_format")
def q_prm_sft_format(spark, sf):
    """Reasoning/solution tagged training text from a completion and its answer."""
    return completions(spark, sf).select("gen_id", P.sft_text("completion", "answer").alias("text"))


@query("prm_training_rows")
def q_prm_training_rows(spark, sf):
    """Problem → system + user prompt messages, first solution as answer ('' if none), test counts."""
    tr = P.training_rows(view(spark, sf, "problems"))
    return tr.select("problem_id", F.get("prompt", 0)["content"].alias("system"),
                     F.get("prompt", 1)["content"].alias("user"), "answer",
                     F.size("inputs").alias("n_inputs"), F.size("outputs").alias("n_outputs"))


@query("prm_pairs_to_conversations")
def q_prm_pairs_to_conversations(spark, sf):
    """(question, first solution) → a two-message user/assistant conversation."""
    p = view(spark, sf, "problems")
    conv = P.pairs_to_conv("question", "first_solution")
    return p.select("problem_id", F.size(conv).alias("n_messages"), F.get(conv, 0)["content"].alias("user"),
                    F.get(conv, 1)["content"].alias("assistant"))


@query("prm_conversation_text")
def q_prm_conversation_text(spark, sf):
    """One rendered text per conversation, turns in order, roles standardised."""
    return P.conversation_text(view(spark, sf, "conversations"))


@query("prm_expand_generations")
def q_prm_expand_generations(spark, sf):
    """Every prompt repeated G = 4 times, its generations brought back together in order."""
    ex = P.expand(completions(spark, sf).select("gen_id", "completion"), 4)
    ex = ex.withColumn("text", F.concat_ws("#", "completion", F.col("gen_idx").cast("string")))
    return P.regroup(ex, "gen_id", "gen_idx", "text").select("gen_id", F.array_join("generations", "|").alias("generations"))


@query("prm_length_stats")
def q_prm_length_stats(spark, sf):
    """Rows, mean prompt length and mean response length per run."""
    g = view(spark, sf, "generations")
    g = g.select("setup", "model", "problem_id", F.length("model_output").alias("response_length"))
    q = view(spark, sf, "problems").select("problem_id", F.length("question").alias("question_length"))
    around = F.length(P.render_prompt(F.lit(""), "setup"))  # the template holds the question once
    rows = g.join(q, "problem_id", "left").withColumn("prompt_length", around + F.col("question_length"))
    return P.length_stats(rows, "prompt_length", "response_length", by=["setup", "model"])


# ---------------------------------------------------------------- 2.4 extraction

@query("ext_tags")
def q_ext_tags(spark, sf):
    """Thinking and code tag contents with found flags."""
    g = view(spark, sf, "generations")
    th, co = X.extract_tag("model_output", "thinking"), X.extract_tag("model_output", "code")
    return g.select(*GEN_KEYS, F.coalesce(th, F.lit("")).alias("thinking"), th.isNotNull().alias("thinking_found"),
                    F.coalesce(co, F.lit("")).alias("code_raw"), co.isNotNull().alias("code_found"))


@query("ext_clean_code")
def q_ext_clean_code(spark, sf):
    """Code tag content with fence lines removed, cut to the first line-start def, stripped."""
    return extracted(spark, sf).select(*GEN_KEYS, "code")


@query("ext_pattern_counts")
def q_ext_pattern_counts(spark, sf):
    """for / def / brace / set( / dict( regex counts over the extracted code."""
    return extracted(spark, sf).select(*GEN_KEYS, *X.PATTERNS)


@query("ext_substring_counts")
def q_ext_substring_counts(spark, sf):
    """Plain 'for ' / 'def ' counts per run over outputs with code."""
    return C.pattern_counts_by_run(M.measured(extracted(spark, sf)))


@query("ext_validate_tags")
def q_ext_validate_tags(spark, sf):
    """Tag presence, pairing and order flags for the thinking and code tags."""
    v = X.validate_tags("model_output")
    return view(spark, sf, "generations").select(*GEN_KEYS, *[c.alias(k) for k, c in v.items()])


@query("ext_fenced_code")
def q_ext_fenced_code(spark, sf):
    """First python-fenced block of each output and whether it contains 'for '."""
    f = X.fenced_code("model_output")
    return view(spark, sf, "generations").select(*GEN_KEYS, *[c.alias(k) for k, c in f.items()])


@query("ext_format_match")
def q_ext_format_match(spark, sf):
    """Exact reasoning/solution format flag and the answer it captures."""
    return completions(spark, sf).select("gen_id", X.format_matches("completion").alias("format_ok"),
                                         X.format_answer("completion").alias("answer"))


@query("ext_solution_number")
def q_ext_solution_number(spark, sf):
    """First number after the solution tag (null if none)."""
    return completions(spark, sf).select("gen_id", X.solution_number("completion").alias("number"))


@query("ext_tag_counts")
def q_ext_tag_counts(spark, sf):
    """Literal counts of the four reasoning/solution tags."""
    return completions(spark, sf).select("gen_id", *[c.alias(k) for k, c in X.tag_counts("completion").items()])


@query("ext_validate_format")
def q_ext_validate_format(spark, sf):
    """Validity flag, issue list and extracted answer/number of the format check."""
    v = X.validate_format("completion")
    return completions(spark, sf).select("gen_id", v["is_valid"].alias("is_valid"),
                                         v["has_exact_format"].alias("has_exact_format"),
                                         F.array_join(v["issues"], "; ").alias("issues"),
                                         v["extracted_answer"].alias("extracted_answer"),
                                         v["extracted_number"].alias("extracted_number"))


@query("ext_solution_parts")
def q_ext_solution_parts(spark, sf):
    """Reasoning and solution between the first tag positions (null when out of order)."""
    p = X.solution_parts("completion")
    return completions(spark, sf).select("gen_id", p["reasoning"].alias("reasoning"), p["solution"].alias("solution"))


@query("ext_solution_code")
def q_ext_solution_code(spark, sf):
    """Text inside the solution tags, stripped (null if absent)."""
    return completions(spark, sf).select("gen_id", X.solution_code("completion").alias("solution_code"))


@query("ext_preview")
def q_ext_preview(spark, sf):
    """First 200 characters of each document, with '...' when longer."""
    return view(spark, sf, "documents").select("doc_id", preview("text", 200).alias("preview"))


@query("ext_model_short_name")
def q_ext_model_short_name(spark, sf):
    """Name after the last '/' (stand-in for model paths: the pages' urls)."""
    p = view(spark, sf, "pages").select("page_id", F.col("url").alias("model"))
    return p.withColumn("short_name", X.model_short_name("model"))


@query("ext_recover_type")
def q_ext_recover_type(spark, sf):
    """Kind of every stringified test value (quoted / literal / text)."""
    p = view(spark, sf, "problems").select("problem_id", F.posexplode("inputs").alias("pos", "value"))
    r = T.recover_type("value")
    return p.select("problem_id", "pos", "value", r["kind"].alias("kind"), r["text"].alias("text"))


# ---------------------------------------------------------------- 2.5 tests, execution, checks

def _tests(spark, sf) -> DataFrame:
    return T.test_cases(view(spark, sf, "problems").select("problem_id", "inputs", "outputs"))


@query("tst_explode")
def q_tst_explode(spark, sf):
    """One row per test case: inputs and outputs zipped, truncated to the shorter list."""
    return _tests(spark, sf)


@query("tst_input_to_stdin")
def q_tst_input_to_stdin(spark, sf):
    """Test input converted to stdin text (list literal → lines)."""
    return _tests(spark, sf).select("problem_id", "test_case", T.to_stdin("input").alias("stdin"))


@query("tst_normalize_output")
def q_tst_normalize_output(spark, sf):
    """Expected and actual outputs normalised (one-element list → element, list → lines)."""
    return view(spark, sf, "output_pairs").select(
        "pair_id", T.normalize_output("expected").alias("norm_expected"),
        T.normalize_output("actual").alias("norm_actual"))


@query("tst_compare_outputs")
def q_tst_compare_outputs(spark, sf):
    """Whether expected and actual outputs match by the comparison rules."""
    return T.with_outputs_match(view(spark, sf, "output_pairs"), "expected", "actual").select("pair_id", "match")


@query("exe_run_tests")
def q_exe_run_tests(spark, sf):
    """Gate by syntax and imports, then run each distinct (code, stdin) in a child process."""
    res = executed(spark, sf)
    return res.select(*GEN_KEYS, "test_case", "converted_input", "actual_output", "passed", "timeout",
                      "execution_success")


@query("exe_result_lists")
def q_exe_result_lists(spark, sf):
    """Per generation the ordered results of its executed tests, in bounded lists, with the gate's reason."""
    lists = E.result_lists(executed(spark, sf, timeout_s=5.0))
    line = F.transform("results", lambda r: F.concat_ws("|", r["test_case"].cast("string"), r["passed"].cast("string"), r["timeout"].cast("string"),
                                                        r["input"], r["expected"], r["actual_output"]))
    reason = F.regexp_extract("execution_error", "^[A-Za-z ]+", 0)
    return lists.select(*GEN_KEYS, "chunk", "execution_success", reason.alias("execution_error"), F.size("results").alias("n_results"), F.array_join(line, "\n").alias("results"))


@query("exe_aggregate")
def q_exe_aggregate(spark, sf):
    """Per generation: passed / failed / total, pass rate, timeouts and time; gate failures count as 0/0."""
    return E.execution_result(view(spark, sf, "test_results"))


def _code_checks(spark, sf) -> DataFrame:
    return E.code_checks(extracted(spark, sf).filter(F.col("code_found")).select("code"))


@query("chk_syntax")
def q_chk_syntax(spark, sf):
    """Syntax status and class of error of each distinct extracted code (Python ast)."""
    kind = F.regexp_extract("syntax_error", "^[A-Za-z ]+", 0)
    return _code_checks(spark, sf).select("code_key", "syntax_ok", kind.alias("error_class"))


@query("chk_imports")
def q_chk_imports(spark, sf):
    """Blocked imports of each distinct extracted code and whether it is safe to run."""
    return _code_checks(spark, sf).select("code_key", F.array_join("blocked", ",").alias("blocked"), "safe")


@query("chk_complexity")
def q_chk_complexity(spark, sf):
    """Function / loop / if counts of each distinct code and the capped complexity score."""
    return _code_checks(spark, sf).select("code_key", "n_functions", "n_loops", "n_ifs", "complexity")


@query("chk_quality")
def q_chk_quality(spark, sf):
    """Code quality score of the code in the solution tags (-1 when there is none)."""
    return completions(spark, sf).select("gen_id", R.code_quality("completion").alias("quality"))


@query("exe_profile")
def q_exe_profile(spark, sf):
    """Per model: tests per problem and execution time per problem, with the all-model estimate."""
    return E.execution_profile(view(spark, sf, "test_results"))


# ---------------------------------------------------------------- 2.6 rewards

@query("rwd_format_exact")
def q_rwd_format_exact(spark, sf):
    """3.0 when the exact reasoning/solution format matches, else 0."""
    return completions(spark, sf).select("gen_id", R.r_format("completion").alias("reward"))


@query("rwd_format_approx")
def q_rwd_format_approx(spark, sf):
    """+0.5 / -1.0 for each of three tags seen exactly once or not."""
    return completions(spark, sf).select("gen_id", R.r_tags("completion").alias("reward"))


@query("rwd_answer")
def q_rwd_answer(spark, sf):
    """Answer reward: exact, stripped-equal, ratio bands, wrong, invalid."""
    return completions(spark, sf).select("gen_id", R.r_answer("completion", "answer").alias("reward"))


@query("rwd_number")
def q_rwd_number(spark, sf):
    """Numeric reward on the first number after the solution tag."""
    return completions(spark, sf).select("gen_id", R.r_number("completion", "answer").alias("reward"))


@query("rwd_total")
def q_rwd_total(spark, sf):
    """The four rewards and their sum."""
    return R.score(completions(spark, sf)).select("gen_id", "r_format", "r_tags", "r_answer", "r_number", "reward")


@query("rwd_execution")
def q_rwd_execution(spark, sf):
    """Execution reward per generation: -3 without code, else 5 × passed / total."""
    done = M.measured(extracted(spark, sf)).select(*GEN_KEYS, "code_found")
    return E.r_exec(done, view(spark, sf, "test_results")).select(*GEN_KEYS, "reward_exec")


@query("rwd_execution_exact")
def q_rwd_execution_exact(spark, sf):
    """Execution reward over executed code: exit code 0 and exact equality count, -3 without code."""
    rows = V.extracted_codes(view(spark, sf, "generations"))
    res = V.run_candidates(rows, view(spark, sf, "problems"), timeout_s=5.0)
    return E.r_exec(rows, res, passed="exact_match").select(*GEN_KEYS, "reward_exec")


@query("rwd_format_binary")
def q_rwd_format_binary(spark, sf):
    """3.0 when the exact format matches, -1.0 otherwise."""
    return completions(spark, sf).select("gen_id", R.r_format_binary("completion").alias("reward"))


@query("rwd_format_strict")
def q_rwd_format_strict(spark, sf):
    """5.0 when all four markers are present, -5.0 otherwise."""
    markers = [X.REASONING_START, X.REASONING_END, X.SOLUTION_START, X.SOLUTION_END]
    return completions(spark, sf).select("gen_id", R.r_strict("completion", markers).alias("reward"))


def group_stats(df: DataFrame, key: str = "prompt_id", reward: str = "reward", text: str = "completion") -> DataFrame:
    """Per prompt group: mean and sample std of the reward, mean completion length."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(reward).alias("reward_mean"),
                               F.stddev_samp(reward).alias("reward_std"),
                               F.avg(F.length(text)).alias("completion_length_mean"))


def advantage(df: DataFrame, key: str = "prompt_id", reward: str = "reward", eps: float = 1e-4) -> DataFrame:
    """(r − group mean) / (group std + eps); std of a one-row group counts as 0.

    Group statistics come from a partial aggregation joined back on the key
    (AQE splits a skewed key's partitions), not from a window that would put
    a hot group in one task.  The input is materialised once (pass a narrow
    projection) so the reward expression is not evaluated per branch.
    """
    df = cut_lineage(df)  # read by both branches (statistics, join back): compute the reward once
    st = df.groupBy(key).agg(F.avg(reward).alias("_m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_s"))
    return df.join(st, key).withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + F.lit(eps))) \
             .drop("_m", "_s")


@query("rwd_group_stats")
def q_rwd_group_stats(spark, sf):
    """Per prompt group: size, mean and sample std of the total reward, mean completion length."""
    return group_stats(R.score(completions(spark, sf)))


@query("rwd_group_advantage")
def q_rwd_group_advantage(spark, sf):
    """Reward relative to its prompt group: (r − mean) / (std + 1e-4)."""
    rewards = R.score(completions(spark, sf)).select("gen_id", "prompt_id", "reward")
    return advantage(rewards).select("gen_id", "prompt_id", "reward", "advantage")


# ---------------------------------------------------------------- 2.7 joins

@query("jn_problem_lookup")
def q_jn_problem_lookup(spark, sf):
    """Each output with its cleaned problem's tests; outputs without a problem keep zeros."""
    g = view(spark, sf, "generations").select(*GEN_KEYS)
    out = J.attach_problems(g, clean(spark, sf), cols=("n_test_cases", "n_solutions"))
    return out.select(*GEN_KEYS, "n_test_cases", "n_solutions", "problem_found")


@query("jn_model_alignment")
def q_jn_model_alignment(spark, sf):
    """Models present in both the baseline and one constrained setup (inner join on the model)."""
    rm = cut_lineage(run_metric_table(spark, sf).select("setup", "model", "fraction_passed", "code_extracted_rate"))
    b = rm.filter(F.col("setup") == "benign").drop("setup")
    m = rm.filter(F.col("setup") == "avoid_for_loops").drop("setup")
    return J.align(b, m)


@query("jn_metric_attach")
def q_jn_metric_attach(spark, sf):
    """Per-run summary with objective patterns and generation statistics (one aggregation of the scored rows)."""
    return M.run_report(scored(spark, sf))


@query("jn_fixed_order")
def q_jn_fixed_order(spark, sf):
    """Summary rows in a given model order; models absent from the order are dropped."""
    sm = M.model_summary(scored(spark, sf)).filter(F.col("setup") == "benign")
    return J.in_order(sm, [MODEL_NAMES[2], MODEL_NAMES[0], "org-x/absent"], required=["test_case_pass_rate"]) \
        .select("pos", "model", "test_case_pass_rate", "api_success_rate")


# ---------------------------------------------------------------- 2.8 aggregations

@query("agg_model_summary")
def q_agg_model_summary(spark, sf):
    """Per run: API / code / thinking / execution rates, test totals and pass rates."""
    return M.model_summary(scored(spark, sf))


@query("agg_extraction_stats")
def q_agg_extraction_stats(spark, sf):
    """Per run: total outputs and thinking / code / both / neither extraction rates."""
    return M.extraction_stats(extracted(spark, sf))


@query("agg_answer_length")
def q_agg_answer_length(spark, sf):
    """Per run: mean output length over successful non-empty outputs."""
    return M.answer_length(view(spark, sf, "generations"))


@query("agg_token_usage")
def q_agg_token_usage(spark, sf):
    """Per run: responses, token-cap hits and near hits, their rates, mean completion tokens."""
    return M.token_usage(view(spark, sf, "generations"))


@query("agg_objective_patterns")
def q_agg_objective_patterns(spark, sf):
    """Per run: mean for / def / dict+set counts over executed solutions."""
    return M.objective_patterns(scored(spark, sf))


@query("agg_generation_time")
def q_agg_generation_time(spark, sf):
    """Per run: mean generation time."""
    return M.generation_time(view(spark, sf, "generations"))


@query("agg_for_loop_rate")
def q_agg_for_loop_rate(spark, sf):
    """Per run: API, fenced-code and for-loop rates, ascending by for-loop rate."""
    return M.for_loop_rate(view(spark, sf, "generations"))


@query("agg_run_metrics")
def q_agg_run_metrics(spark, sf):
    """The comparator's twelve metrics per run."""
    return run_metric_table(spark, sf).select("setup", "model", *M.METRICS)


@query("agg_throughput")
def q_agg_throughput(spark, sf):
    """Per run: completion tokens, generation time and tokens per second."""
    return M.throughput(view(spark, sf, "generations"))


@query("agg_format_compliance")
def q_agg_format_compliance(spark, sf):
    """Format compliance, numeric-answer pass rate and mean completion length."""
    return M.compliance(completions(spark, sf))


@query("agg_dataset_info")
def q_agg_dataset_info(spark, sf):
    """Per split: rows, difficulty counts, test / solution statistics, starter-code count."""
    return M.dataset_info(split_sizes(spark, sf))


@query("agg_split_statistics")
def q_agg_split_statistics(spark, sf):
    """Per split and difficulty: count, share of the split and the split's statistics."""
    return M.split_statistics(split_sizes(spark, sf))


@query("agg_difficulty_crosstab")
def q_agg_difficulty_crosstab(spark, sf):
    """Difficulty × original split counts with totals, most frequent first."""
    return M.difficulty_crosstab(view(spark, sf, "raw_problems"))


@query("agg_overview")
def q_agg_overview(spark, sf):
    """Totals per original split, column list, headline averages and starter share."""
    return M.overview(clean(spark, sf))


@query("agg_text_length")
def q_agg_text_length(spark, sf):
    """Per original split: question word-count and per-problem solution word-count statistics."""
    return M.text_length(view(spark, sf, "raw_problems"))


@query("agg_test_case_stats")
def q_agg_test_case_stats(spark, sf):
    """Per original split: problems with / without tests and test-count statistics."""
    return M.test_case_stats(view(spark, sf, "raw_problems"))


@query("agg_solution_stats")
def q_agg_solution_stats(spark, sf):
    """Per original split: problems with / without solutions and solution-count statistics."""
    return M.solution_stats(view(spark, sf, "raw_problems"))


@query("agg_starter_stats")
def q_agg_starter_stats(spark, sf):
    """Per original split: starter-code presence, share and word counts."""
    return M.starter_stats(view(spark, sf, "raw_problems"))


def _test_counts(spark, sf) -> DataFrame:
    """Test count of every raw problem that has a test-case record."""
    raw = view(spark, sf, "raw_problems")
    io = F.from_json(F.col("input_output"), SP.IO_SCHEMA)
    return raw.select(F.size(io["inputs"]).alias("n_test_cases"), "original_split") \
              .filter(io["inputs"].isNotNull() & io["outputs"].isNotNull())


@query("agg_test_count_exact")
def q_agg_test_count_exact(spark, sf):
    """Problems with exactly 3, 5 and 8 tests, overall and per original split."""
    return M.count_exact(_test_counts(spark, sf), (3, 5, 8), split="original_split")


@query("agg_log_summary")
def q_agg_log_summary(spark, sf):
    """Per numeric log metric: mean, sample std, min, max, final value, total steps."""
    return M.log_summary(view(spark, sf, "train_log"))


# ---------------------------------------------------------------- 2.9 windows

@query("win_cumulative_tests")
def q_win_cumulative_tests(spark, sf):
    """Share of problems with 1..N tests for each reported N, overall and per split."""
    return W.cumulative(_test_counts(spark, sf), split="original_split")


@query("win_metric_series")
def q_win_metric_series(spark, sf):
    """Reward / kl / length by step in long form with a 10-step trailing mean per phase."""
    return W.metric_series(view(spark, sf, "train_log"), ["reward", "kl", "completion_length"], smooth=10)


@query("win_log_every")
def q_win_log_every(spark, sf):
    """Every 10th step and step 1 of the training log."""
    return W.log_rows(view(spark, sf, "train_log")).select("step", "phase", "reward", "kl")


# ---------------------------------------------------------------- 2.10 sort, set

@query("srt_top_offenders")
def q_srt_top_offenders(spark, sf):
    """First 10 problems (by id) whose test lists hold a non-string element."""
    return SP.offenders(view(spark, sf, "raw_problems"))


@query("set_union_splits")
def q_set_union_splits(spark, sf):
    """Train and test parts concatenated with their origin."""
    raw = view(spark, sf, "raw_problems").select("problem_id", "difficulty", "original_split")
    parts = {s: raw.filter(F.col("original_split") == s).drop("original_split") for s in ("train", "test")}
    return SP.union_splits(parts)


# ---------------------------------------------------------------- 2.11 comparison

@query("cmp_metric_diff")
def q_cmp_metric_diff(spark, sf):
    """Per model and metric: avoid_for_loops against the baseline, diff and relative change."""
    return C.metric_diff(run_metric_table(spark, sf), "benign", "avoid_for_loops")


@query("cmp_pattern_diff")
def q_cmp_pattern_diff(spark, sf):
    """Per setup and model: 'for ' / 'def ' count differences against the baseline."""
    return C.pattern_diff(M.measured(extracted(spark, sf)))


@query("cmp_aggregate")
def q_cmp_aggregate(spark, sf):
    """Mean / population std of the metric diffs over models, and total pattern diffs.

    Metrics and pattern counts come from one aggregation of the scored rows;
    both comparisons then work on that small per-run table.
    """
    per_run = cut_lineage(M.run_metrics(scored(spark, sf), extra=C.pattern_aggs()))
    return C.diff_aggregate(C.compare_all(per_run), C.pattern_diff_counts(per_run))


@query("cmp_all_setups")
def q_cmp_all_setups(spark, sf):
    """Every setup against the baseline at once, per model and metric."""
    return C.compare_all(run_metric_table(spark, sf))


@query("cmp_long_table")
def q_cmp_long_table(spark, sf):
    """(model, setup) table of 17 metrics, absent runs kept as zeros."""
    return C.comparison_table(scored(spark, sf), MODEL_NAMES, SETUP_NAMES)


# ---------------------------------------------------------------- 2.12 streaming

def _gen_events(spark, sf) -> DataFrame:
    g = view(spark, sf, "generations")
    return g.withColumn("generated_at", (F.lit(1751760000) + F.col("problem_id")).cast("timestamp"))


@query("stm_score_new")
def q_stm_score_new(spark, sf):
    """Two deliveries (the second repeats a third of the first): each run resumes, duplicates dropped, nothing lost."""
    ev = _gen_events(spark, sf)
    src, out, ckpt = (scratch_path(spark, n) for n in ("stm-src", "stm-out", "stm-ckpt"))
    ST.deliver(ev.filter(F.col("problem_id") % 2 == 0), src)
    ST.score_stream(spark, src, out, ckpt)
    ST.deliver(ev.filter((F.col("problem_id") % 2 == 1) | (F.col("problem_id") % 3 == 0)), src)
    ST.score_stream(spark, src, out, ckpt)
    return spark.read.parquet(out).select(*GEN_KEYS, "thinking_found", "code_found", *X.PATTERNS)


def _closed_log_windows(spark, sf, **kw) -> DataFrame:
    src, out, ckpt = (scratch_path(spark, n) for n in ("logw-src", "logw-out", "logw-ckpt"))
    SR.write_train_log(view(spark, sf, "train_log"), src)
    ST.run_log_windows(spark, src, out, ckpt, SR.TRAIN_LOG_STREAM_SCHEMA, **kw)
    return ST.close_log_windows(spark, out, ckpt)


@query("stm_log_windows")
def q_stm_log_windows(spark, sf):
    """Per-day, per-phase means of reward / kl / length from a log stream (1 h watermark), closed from its state."""
    return _closed_log_windows(spark, sf)


@query("stm_log_sliding_windows")
def q_stm_log_sliding_windows(spark, sf):
    """The same over 24-hour windows that start every 6 hours."""
    return _closed_log_windows(spark, sf, window="24 hours", slide="6 hours")


@query("stm_model_summary")
def q_stm_model_summary(spark, sf):
    """Running per-run summary of a generation stream (complete mode, versioned table with a pointer)."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("sum-src", "sum-out", "sum-ckpt"))
    ST.deliver(_gen_events(spark, sf), src)
    ST.run_summary_stream(spark, src, out, ckpt, ST.GENERATION_EVENT_SCHEMA)
    return ST.latest_summary(spark, out)
