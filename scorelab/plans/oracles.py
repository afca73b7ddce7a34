"""DuckDB statements stating the same results as the registered queries.

Each statement starts from the base tables the driver registers; the
stand-in views are prefixed as CTEs.  Doubles are rounded to 6 places and
integer sums cast to BIGINT, so names, types and values line up with Spark's.
These are an independent statement of the semantics (RE2 regexes, DuckDB
list functions), used only as the correctness check.
"""

from __future__ import annotations

from ..functions.fixed_texts import CLOSING, OBJECTIVES, SYSTEM_PROMPT, TASK_PREFIX, TASK_SUFFIX
from .sqlfrag import count, py_float, r6, strip, strip_quotes, word_count
from .views import MODELS, SETUPS, VIEW_SQL

ORACLES: dict[str, str] = {}
EOS = "<eos>"
MODEL_NAMES = [m for _, m in MODELS]
SETUP_NAMES = [s for _, s in SETUPS]
RS, RE, SS, SE = "<start_working_out>", "<end_working_out>", "<SOLUTION>", "</SOLUTION>"
FORMAT_RE = r"(?sm)<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>[\s]{0,}[\s]{0,}$"
NUMBER_RE = r"(?sm)<SOLUTION>.*?[\s]{0,}([-]?[\d.,]{1,})"
SOLCODE_RE = r"(?s)<SOLUTION>(.*?)</SOLUTION>"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ctes(*parts: tuple[str, str]) -> str:
    """WITH clause from (name, body) pairs; a bare view name takes the fixture SQL."""
    out = []
    for p in parts:
        name, body = (p, VIEW_SQL[p]) if isinstance(p, str) else p
        out.append(f"{name} AS ({body.strip()})")
    return "WITH " + ",\n".join(out) + "\n"


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's is BIGINT: wrap every call in a cast."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = _bigint_count_if(sql)


# ---------------------------------------------------------------- shared fragments

def tag_sql(e: str, t: str) -> str:
    prim = f"(?s)<{t}>(.*?)</{t}>"
    return (f"(CASE WHEN regexp_matches({e}, '{prim}') THEN {strip(f'regexp_extract({e}, {lit(prim)}, 1)')} "
            f"WHEN len(regexp_extract_all({e}, '(?i)</?{t}>')) >= 2 THEN "
            f"{strip(f'regexp_extract({e}, {lit(f"(?is)^.*?</?{t}>(.*)</?{t}>")}, 1)')} END)")


def clean_sql(e: str) -> str:
    c1 = f"regexp_replace({e}, '(?m)^```\\w*\\n?', '', 'g')"
    c2 = f"regexp_replace({c1}, '(?m)\\n?```$', '', 'g')"
    c3 = f"(CASE WHEN regexp_matches({c2}, '(?m)^def\\s') THEN regexp_extract({c2}, '(?ms)(^def\\s.*)', 1) ELSE {c2} END)"
    return strip(c3)


PATTERN_SQL = {
    "for_loop_count": r"\bfor\s+.*?:",
    "function_def_count": r"\bdef\s+\w+\s*\(",
    "curly_brace_count": r"[{}]",
    "set_constructor_count": r"\bset\(",
    "dict_constructor_count": r"\bdict\(",
}

GX = ("gx", f"""
SELECT g.*, coalesce(th, '') AS thinking, th IS NOT NULL AS thinking_found, cr IS NOT NULL AS code_found,
  coalesce(CASE WHEN cr IS NOT NULL THEN {clean_sql('cr')} END, '') AS code
FROM (SELECT *, {tag_sql('model_output', 'thinking')} AS th, {tag_sql('model_output', 'code')} AS cr FROM generations) g
""")
# Nothing is extracted from a failed API call.
GXA = ("gxa", "SELECT * REPLACE (CASE WHEN api_success THEN code END AS code, CASE WHEN api_success THEN thinking END AS thinking) FROM gx")
GXC = ("gxc", "SELECT *, " + ", ".join(
    f"CAST(CASE WHEN code_found AND code <> '' THEN len(regexp_extract_all(code, {lit(p)})) ELSE 0 END AS INTEGER) AS {k}"
    for k, p in PATTERN_SQL.items()) + " FROM gx")

EXR = ("exr", """
SELECT setup, model, problem_id, execution_success, total_count,
  CAST(CASE WHEN execution_success THEN _p ELSE 0 END AS BIGINT) AS passed_count,
  CAST(CASE WHEN execution_success THEN total_count - _p ELSE 0 END AS BIGINT) AS failed_count,
  CASE WHEN execution_success THEN CAST(_p AS DOUBLE) / total_count ELSE 0.0::DOUBLE END AS pass_rate,
  CAST(CASE WHEN execution_success THEN _t ELSE 0 END AS BIGINT) AS timeout_count,
  CASE WHEN execution_success THEN _time ELSE 0.0::DOUBLE END AS total_execution_time
FROM (SELECT setup, model, problem_id, bool_and(execution_success) AS execution_success, count(*) AS total_count,
        count_if(passed AND NOT timeout) AS _p, count_if(timeout) AS _t, sum(execution_time) AS _time
      FROM test_results GROUP BY setup, model, problem_id)
""")

SCORED = ("scored", """
SELECT g.setup, g.model, g.problem_id, g.api_success, g.model_output, g.completion_tokens, g.total_tokens, g.total_time, g.run_avg_time,
  CASE WHEN g.api_success THEN g.thinking END AS thinking, CASE WHEN g.api_success THEN g.code END AS code, g.for_loop_count, g.function_def_count, g.curly_brace_count, g.set_constructor_count,
  g.dict_constructor_count,
  g.api_success AND g.thinking_found AS thinking_found, g.api_success AND g.code_found AS code_found,
  CASE WHEN g.api_success AND g.code_found AND e.total_count IS NOT NULL THEN e.execution_success ELSE false END AS execution_success,
  CAST(CASE WHEN g.api_success AND g.code_found AND e.total_count IS NOT NULL THEN e.passed_count ELSE 0 END AS BIGINT) AS passed_count,
  CAST(CASE WHEN g.api_success AND g.code_found AND e.total_count IS NOT NULL THEN e.total_count ELSE 0 END AS BIGINT) AS total_count,
  CASE WHEN g.api_success AND g.code_found AND e.total_count IS NOT NULL THEN e.pass_rate ELSE 0.0::DOUBLE END AS pass_rate
FROM gxc g LEFT JOIN exr e ON g.setup = e.setup AND g.model = e.model AND g.problem_id = e.problem_id
""")
SCORED_CTES = ("generations", "test_results", GX, GXC, EXR, SCORED)


def rate(cond: str) -> str:
    return f"coalesce(avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0::DOUBLE)"


def ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0.0::DOUBLE)"


SUMMARY_AGGS = f"""count(*) AS n_problems, {rate('api_success')} AS api_success_rate,
  {rate('code_found')} AS code_extraction_rate, {rate('thinking_found')} AS thinking_extraction_rate,
  {rate('execution_success')} AS execution_success_rate,
  CAST(sum(total_count) AS BIGINT) AS total_test_cases, CAST(sum(passed_count) AS BIGINT) AS passed_test_cases,
  coalesce(avg(pass_rate), 0.0::DOUBLE) AS average_pass_rate"""

SUMMARY = ("summary", f"""
SELECT *, {ratio('passed_test_cases', 'total_test_cases')} AS test_case_pass_rate
FROM (SELECT setup, model, {SUMMARY_AGGS} FROM scored GROUP BY setup, model)
""")

RUN_METRICS_LIST = ["fraction_passed", "mean_test_cases_passed", "thinking_extracted_rate", "code_extracted_rate",
                    "execution_success_rate", "thinking_length_mean", "code_length_mean", "empty_code_rate",
                    "empty_thinking_rate", "generation_time_mean", "token_usage_total", "cost_total"]

RUNM = ("runm", f"""
SELECT setup, model, n_problems, api_success_rate, code_extraction_rate AS code_extracted_rate,
  thinking_extraction_rate AS thinking_extracted_rate, execution_success_rate, total_test_cases, passed_test_cases,
  average_pass_rate, thinking_length_mean, code_length_mean, empty_code_rate, empty_thinking_rate,
  generation_time_mean, token_usage_total, cost_total,
  {ratio('passed_test_cases', 'total_test_cases')} AS fraction_passed,
  CAST(passed_test_cases AS DOUBLE) AS mean_test_cases_passed
FROM (SELECT setup, model, {SUMMARY_AGGS},
  coalesce(avg(length(thinking)), 0.0::DOUBLE) AS thinking_length_mean,
  coalesce(avg(length(code)), 0.0::DOUBLE) AS code_length_mean,
  {rate("code = ''")} AS empty_code_rate, {rate("thinking = ''")} AS empty_thinking_rate,
  coalesce(max(run_avg_time), 0.0::DOUBLE) AS generation_time_mean,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS token_usage_total,
  coalesce(sum(total_tokens * 0.00001::DOUBLE), 0.0::DOUBLE) AS cost_total
  FROM scored GROUP BY setup, model)
""")

RUNM_LONG = ("runm_long", "SELECT setup, model, metric, value FROM runm UNPIVOT (value FOR metric IN ("
             + ", ".join(RUN_METRICS_LIST) + "))")
# UNPIVOT needs one type: cast inside a projection first
RUNM_D = ("runm_d", "SELECT setup, model, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in RUN_METRICS_LIST)
          + " FROM runm")
RUNM_LONG = ("runm_long", "SELECT setup, model, metric, value FROM runm_d UNPIVOT (value FOR metric IN ("
             + ", ".join(RUN_METRICS_LIST) + "))")

_JF = "(CASE WHEN json_valid(input_output) THEN json_extract(input_output, '$.{f}') END)"


def listify_sql(j: str) -> str:
    return (f"(CASE WHEN {j} IS NULL OR CAST({j} AS VARCHAR) = 'null' THEN []::VARCHAR[] "
            f"WHEN json_type({j}) = 'ARRAY' THEN from_json({j}, '[\"VARCHAR\"]') "
            f"ELSE from_json('[' || CAST({j} AS VARCHAR) || ']', '[\"VARCHAR\"]') END)")


IO_JSON = '{"inputs":["VARCHAR"],"outputs":["VARCHAR"]}'


def spelled_sql(field: str) -> str:
    """A test list with Python's spelling of its values (the fixture holds strings, numbers, constants and lists of them)."""
    words = "replace(replace(replace(replace(e, 'true', 'True'), 'false', 'False'), 'null', 'None'), ',', ', ')"
    return (f"list_transform({listify_sql(_JF.format(f=field))}, lambda e: CASE WHEN starts_with(e, '[') OR e IN ('true', 'false', 'null') "
            f"THEN {words} ELSE e END)")


CLEAN = ("clean", f"""
SELECT problem_id, question, difficulty, sols AS solutions, inputs, outputs, starter_code,
  CAST(len(inputs) AS INTEGER) AS n_test_cases, CAST(len(sols) AS INTEGER) AS n_solutions, original_split
FROM (SELECT problem_id, question, coalesce(difficulty, 'unknown') AS difficulty,
        CASE WHEN json_valid(solutions) AND json_type(solutions) = 'ARRAY' THEN from_json(solutions, '["VARCHAR"]')
             ELSE []::VARCHAR[] END AS sols,
        {spelled_sql('inputs')} AS inputs, {spelled_sql('outputs')} AS outputs,
        coalesce(starter_code, '') AS starter_code, original_split
      FROM raw_problems)
WHERE len(inputs) > 0 AND len(outputs) > 0
""")

SPLIT = ("split_t", f"""
SELECT problem_id, question, difficulty, solutions, inputs, outputs, starter_code, n_test_cases, n_solutions,
  original_split,
  CASE WHEN position <= ntr THEN 'train' WHEN position <= ntr + nev THEN 'eval' ELSE 'test' END AS split,
  position, md5('42:' || CAST(problem_id AS VARCHAR)) AS shuffle_key
FROM (SELECT *, floor((n - ntr) * (0.2::DOUBLE / (0.2::DOUBLE + 0.2::DOUBLE))) AS nev
      FROM (SELECT *, floor(n * 0.6::DOUBLE) AS ntr
            FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY
                              CASE WHEN original_split = 'train' THEN 0 ELSE 1 END, problem_id) AS position,
                         count(*) OVER (PARTITION BY difficulty) AS n
                  FROM clean)))
""")
SPLIT_CTES = ("raw_problems", CLEAN, SPLIT)


def fmt_answer(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, {lit(FORMAT_RE)}) THEN regexp_extract({e}, {lit(FORMAT_RE)}, 1) END)"


def sol_number(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, {lit(NUMBER_RE)}) THEN regexp_extract({e}, {lit(NUMBER_RE)}, 1) END)"


def r_format(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, {lit(FORMAT_RE)}) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END)"


def r_tags(e: str) -> str:
    return "(" + " + ".join(f"(CASE WHEN {count(e, t)} = 1 THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END)"
                            for t in (RE, SS, SE)) + ")"


def r_answer(e: str, truth: str) -> str:
    g = fmt_answer(e)
    gf, tf = py_float(g), py_float(truth)
    ratio_ = f"({gf} / {tf})"
    band = lambda lo, hi: f"(NOT isnan({ratio_}) AND {ratio_} >= {lo} AND {ratio_} <= {hi})"
    return (f"(CASE WHEN {g} IS NULL THEN -2.0 WHEN {g} = {truth} THEN 5.0 "
            f"WHEN {strip(g)} = {strip(truth)} THEN 3.5 "
            f"WHEN {gf} IS NULL OR {tf} IS NULL OR {tf} = 0 THEN -4.5 "
            f"WHEN {band(0.9, 1.1)} THEN 2.0 WHEN {band(0.8, 1.2)} THEN 1.5 ELSE -2.5 END)::DOUBLE")


def r_number(e: str, truth: str) -> str:
    g = sol_number(e)
    gf = py_float(f"replace({strip(g)}, ',', '')")
    tf = py_float(truth)
    return (f"(CASE WHEN {g} IS NULL THEN -2.5 WHEN {tf} IS NULL OR {gf} IS NULL THEN 0.0 "
            f"WHEN {gf} = {tf} AND NOT isnan({gf}) THEN 3.5 ELSE -1.5 END)::DOUBLE")


SCORES = ("scores", f"""
SELECT *, r_format + r_tags + r_answer + r_number AS reward
FROM (SELECT prompt_id, gen_id, answer, completion, {r_format('completion')} AS r_format, {r_tags('completion')} AS r_tags,
        {r_answer('completion', 'answer')} AS r_answer, {r_number('completion', 'answer')} AS r_number
      FROM completions)
""")


def round_all(select_cols: list[str], doubles: set[str]) -> str:
    return ", ".join(r6(c) + f" AS {c}" if c in doubles else c for c in select_cols)


def final(cols: list[str], doubles: list[str], src: str) -> str:
    return "SELECT " + round_all(cols, set(doubles)) + f" FROM {src}"


# ---------------------------------------------------------------- 2.1 sources and sinks

oracle("src_raw_problems", ctes("raw_problems", CLEAN) + """
SELECT problem_id, question, difficulty, CAST(to_json(solutions) AS VARCHAR) AS solutions,
  CAST(to_json(inputs) AS VARCHAR) AS inputs, CAST(to_json(outputs) AS VARCHAR) AS outputs, starter_code,
  n_test_cases, n_solutions, original_split FROM clean""")



oracle("src_listify", ctes("raw_problems", ("j", f"""SELECT problem_id, {_JF.format(f='inputs')} AS ji,
  {_JF.format(f='outputs')} AS jo FROM raw_problems""")) + f"""
SELECT problem_id, CAST(to_json({listify_sql('ji')}) AS VARCHAR) AS inputs,
  CAST(to_json({listify_sql('jo')}) AS VARCHAR) AS outputs, CAST(len({listify_sql('ji')}) AS INTEGER) AS n_inputs FROM j""")


def _diag(field: str) -> str:
    j = _JF.format(f=field)
    nonstr = f"list_bool_or(list_transform(json_type({j}, '$[*]'), lambda t: t <> 'VARCHAR'))"
    return f"""SELECT count(*) AS n_rows, '{field}' AS field,
  count_if({j} IS NULL OR CAST({j} AS VARCHAR) = 'null') AS n_null,
  count_if({j} IS NOT NULL AND CAST({j} AS VARCHAR) <> 'null' AND json_type({j}) <> 'ARRAY') AS n_nonlist,
  count_if(json_type({j}) = 'ARRAY' AND {nonstr}) AS n_nonstring FROM raw_problems"""


oracle("src_type_diagnostics", ctes("raw_problems") + _diag("inputs") + "\nUNION ALL\n" + _diag("outputs"))
oracle("sink_splits", ctes(*SPLIT_CTES) + "SELECT problem_id, difficulty, split FROM split_t")
oracle("src_load_split", ctes(*SPLIT_CTES) + "SELECT problem_id, difficulty, split, position FROM split_t WHERE split = 'eval'")
oracle("src_generations", ctes("generations") + """
SELECT setup, model, CAST(problem_id AS VARCHAR) AS problem_id, api_success, model_output, completion_tokens, total_tokens,
  round(total_time, 6) AS total_time, round(run_avg_time, 6) AS run_avg_time FROM generations""")
oracle("src_latest_run", ctes("generations", ("r", """SELECT *, '2025-07-0' || CAST(problem_id % 3 + 1 AS VARCHAR)
  || 'T12:00:00' AS run_timestamp FROM generations"""), ("m", "SELECT setup, max(run_timestamp) AS ts FROM r GROUP BY setup")) + """
SELECT setup, model, problem_id, run_timestamp FROM r
WHERE EXISTS (SELECT 1 FROM m WHERE m.setup = r.setup AND m.ts = r.run_timestamp)""")

oracle("src_latest_run_file", ctes("generations") + """
SELECT setup, model, CAST(problem_id AS VARCHAR) AS problem_id, api_success, model_output FROM generations WHERE problem_id % 3 = 1""")

RUN_NAME_RE = (r"^(\d{8}_\d{6})_(?:(benign|malign(?:_[a-z]+)?)_)?([a-z]+)_(\d+)problems_(\d+)models"
               r"(?:_([a-z_]+))?\.(json|pdf)$")


def _g(i: int) -> str:
    return f"regexp_extract(file_name, {lit(RUN_NAME_RE)}, {i})"


oracle("src_run_metadata", ctes(("names", """SELECT event_id,
  strftime(ts, '%Y%m%d_%H%M%S') || '_' || ['', 'benign_', 'malign_noloops_'][event_id % 3 + 1]
  || ['train', 'eval', 'test'][user_id % 3 + 1] || '_' || CAST(user_id % 200 AS VARCHAR) || 'problems_'
  || CAST(event_id % 7 + 1 AS VARCHAR) || 'models'
  || ['_outputs.json', '_malign_scored.json', '_visualization.pdf', '.json', '_outputs.txt'][event_id % 5 + 1] AS file_name
FROM events""")) + f"""
SELECT event_id, file_name,
  CASE WHEN ok THEN try_strptime({_g(1)}, '%Y%m%d_%H%M%S') END AS run_ts,
  CASE WHEN ok THEN nullif({_g(2)}, '') END AS setup,
  CASE WHEN ok THEN {_g(3)} END AS split,
  CASE WHEN ok THEN TRY_CAST({_g(4)} AS INTEGER) END AS n_problems,
  CASE WHEN ok THEN TRY_CAST({_g(5)} AS INTEGER) END AS n_models,
  CASE WHEN ok THEN nullif({_g(6)}, '') END AS kind
FROM (SELECT *, regexp_matches(file_name, {lit(RUN_NAME_RE)}) AS ok FROM names)""")
oracle("src_train_log", ctes("train_log") + """
SELECT step, phase, timestamp, round(reward, 6) AS reward, round(kl, 6) AS kl,
  round(completion_length, 6) AS completion_length, round(loss, 6) AS loss FROM train_log""")
oracle("sink_generation_samples", """
SELECT doc_id AS step, substr(text, 1, 200) AS prompt, substr(text || text, 1, 500) AS generation,
  round(CAST(n_chars AS DOUBLE) / 1000.0::DOUBLE, 6) AS reward, lang AS answer, source AS extracted FROM documents""")
oracle("src_experiment", ctes("generations") + "SELECT setup, model, problem_id, api_success, model_output FROM generations")

# ---------------------------------------------------------------- 2.2 filters, samples, splits

oracle("flt_problems", ctes("problems") + """
SELECT problem_id, n_test_cases FROM problems WHERE difficulty = 'interview' AND n_test_cases >= 2
  AND n_test_cases <= 3 AND n_solutions > 0 AND length(starter_code) = 0""")
oracle("smp_seeded", ctes("problems") + """
SELECT problem_id, difficulty FROM problems ORDER BY md5('42:' || CAST(problem_id AS VARCHAR)), problem_id LIMIT 50""")
oracle("smp_seeded_half", """
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey
LIMIT (SELECT count(*) // 2 FROM orders)""")
oracle("spl_stratified", ctes(*SPLIT_CTES) + "SELECT problem_id, difficulty, split, position, shuffle_key FROM split_t")
oracle("spl_shuffle", ctes("problems") + "SELECT problem_id, md5('42:' || CAST(problem_id AS VARCHAR)) AS shuffle_key FROM problems")
oracle("spl_train_val", ctes("problems") + """
SELECT problem_id, CAST(('0x' || substr(md5('42:' || CAST(problem_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000 < 100
  AS is_validation FROM problems""")
oracle("flt_resume", ctes("problems", "generations") + """
SELECT problem_id FROM problems p WHERE NOT EXISTS (SELECT 1 FROM generations g WHERE g.setup = 'benign'
  AND g.model = 'org-a/model-1b' AND g.api_success AND CAST(g.problem_id AS VARCHAR) = CAST(p.problem_id AS VARCHAR))""")
oracle("flt_numeric_answer", ctes("output_pairs") + f"""
SELECT pair_id, expected AS expected_answer, actual FROM output_pairs
WHERE {py_float('expected')} IS NOT NULL AND NOT isnan({py_float('expected')})""")


def sft_sql(thoughts: str, answer: str) -> str:
    t = f"replace(replace({thoughts}, '<think>', ''), '</think>', '')"
    return f"('{RS}' || {strip(t)} || '{RE}' || '{SS}' || {answer} || '{SE}')"


oracle("flt_max_length", ctes("completions", ("s", f"""SELECT gen_id, {lit(SYSTEM_PROMPT)} || '{EOS}' || 'Problem ' || CAST(prompt_id AS VARCHAR)
  || {sft_sql('completion', 'answer')} || '{EOS}' AS text FROM completions"""),
                                ("l", f"SELECT gen_id, {word_count('text')} AS L FROM s")) + """
SELECT gen_id, CAST(L AS INTEGER) AS L FROM l WHERE L <= 40.0 ORDER BY gen_id LIMIT 500""")
oracle("flt_quantile_length", ctes("problems", ("l", f"""SELECT problem_id,
  CAST({word_count(f"{lit(SYSTEM_PROMPT)} || '{EOS}' || question || '{RS}'")} AS INTEGER) AS L FROM problems"""),
                                     ("c", "SELECT CAST(floor(quantile_cont(L, 0.9)) AS BIGINT) AS cutoff FROM l")) + """
SELECT problem_id, L, CAST(cutoff + 1 AS INTEGER) AS max_prompt_length, CAST(2048 - (cutoff + 1) AS INTEGER)
  AS max_completion_length FROM l, c WHERE L <= cutoff""")
oracle("flt_quantile_length_approx", ctes("problems", ("l", f"""SELECT problem_id,
  CAST({word_count(f"{lit(SYSTEM_PROMPT)} || '{EOS}' || question || '{RS}'")} AS INTEGER) AS L FROM problems"""),
                                            ("c", "SELECT CAST(quantile_disc(L, 0.9) AS BIGINT) AS cutoff FROM l")) + """
SELECT problem_id, L, CAST(cutoff + 1 AS INTEGER) AS max_prompt_length FROM l, c WHERE L <= cutoff""")
oracle("flt_solution_quality", """
SELECT doc_id AS problem_id FROM documents WHERE doc_id % 5 <> 0 AND length(text) > 50 AND length(text) < 2000""")
oracle("flt_difficulty_in", ctes("problems") + """
SELECT problem_id, difficulty FROM problems WHERE difficulty IN ('introductory', 'interview')""")
oracle("smp_curriculum", ctes("problems") + """
SELECT problem_id, difficulty, CASE difficulty WHEN 'introductory' THEN 'stage1' WHEN 'interview' THEN 'stage2'
  ELSE 'stage3' END AS stage
FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY problem_id) AS rn FROM problems
      WHERE difficulty IN ('introductory', 'interview', 'competition')) WHERE rn <= 100""")
oracle("smp_mixture", ctes(("b", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
                           ("r", "SELECT doc_id FROM b WHERE quality = 0"),
                           ("c", """SELECT doc_id, row_number() OVER (ORDER BY md5('3407:' || CAST(doc_id AS VARCHAR)),
                              doc_id) AS rn FROM b WHERE quality = 1""")) + """
SELECT doc_id, 'reasoning' AS source, md5('3407:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM r
UNION ALL
SELECT doc_id, 'chat' AS source, md5('3407:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM c
WHERE rn <= floor((SELECT count(*) FROM r) * (0.25::DOUBLE / (1.0::DOUBLE - 0.25::DOUBLE)))""")
oracle("smp_examples", ctes("problems") + """
SELECT problem_id, difficulty, CAST(example_rank AS INTEGER) AS example_rank,
  CASE WHEN length(question) > 200 THEN substr(question, 1, 200) || '...' ELSE question END AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY problem_id) AS example_rank FROM problems)
WHERE example_rank <= 3""")

# ---------------------------------------------------------------- 2.3 prompts

_OBJ_CASE = "CASE s.setup " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in OBJECTIVES.items()) + " ELSE '' END"
_SETUP_VALUES = ", ".join(f"('{s}')" for s in SETUP_NAMES)


def render_sql(q: str) -> str:
    return f"({lit(TASK_PREFIX)} || coalesce({q}, '') || {lit(TASK_SUFFIX)} || {_OBJ_CASE} || {lit(CLOSING)})"


oracle("prm_render", ctes("problems") + f"""
SELECT p.problem_id, s.setup, {render_sql('p.question')} AS prompt
FROM problems p CROSS JOIN (VALUES {_SETUP_VALUES}) AS s(setup)""")
oracle("prm_grid", ctes("problems") + f"""
SELECT p.problem_id, m.model, s.setup FROM problems p
CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in MODEL_NAMES)}) AS m(model)
CROSS JOIN (VALUES {_SETUP_VALUES}) AS s(setup)""")
oracle("prm_messages", ctes("problems") + f"""
SELECT problem_id, CAST(CASE WHEN first_solution IS NULL THEN 2 ELSE 3 END AS INTEGER) AS n_messages,
  {lit(SYSTEM_PROMPT)} AS system, question AS user, first_solution AS assistant FROM problems""")
oracle("prm_chat_template", ctes("problems") + f"""
SELECT problem_id, {lit(SYSTEM_PROMPT + EOS)} || question || first_solution || '{EOS}' AS text,
  {lit(SYSTEM_PROMPT + EOS)} || question || '{RS}' AS generation_prompt FROM problems""")
oracle("prm_im_template", ctes("problems") + """
SELECT problem_id, '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant'
  || chr(10) AS text FROM problems""")
oracle("prm_sft_format", f"SELECT gen_id, {sft_sql('completion', 'answer')} AS text FROM ("
       + VIEW_SQL["completions"] + ")")
oracle("prm_training_rows", ctes("problems") + f"""
SELECT problem_id, {lit(SYSTEM_PROMPT)} AS system, question AS user, coalesce(first_solution, '') AS answer,
  CAST(len(inputs) AS INTEGER) AS n_inputs, CAST(len(outputs) AS INTEGER) AS n_outputs FROM problems""")
oracle("prm_pairs_to_conversations", ctes("problems") + """
SELECT problem_id, CAST(2 AS INTEGER) AS n_messages, question AS user, first_solution AS assistant FROM problems""")
oracle("prm_conversation_text", ctes(("t", """SELECT conv_id, turn, text,
  CASE lower(role) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'system' THEN 'system'
    WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE lower(role) END AS r FROM conversations"""),
                                     ("p", """SELECT conv_id, turn,
  CASE r WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 9 END AS rr,
  '<|im_start|>' || r || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece FROM t""")) + """
SELECT conv_id, string_agg(piece, '' ORDER BY turn, rr, piece) AS text, count(*) AS n_turns FROM p GROUP BY conv_id""")
oracle("prm_expand_generations", ctes("completions") + """
SELECT gen_id, completion || '#0|' || completion || '#1|' || completion || '#2|' || completion || '#3' AS generations FROM completions""")
oracle("prm_length_stats", ctes("generations", "problems") + f"""
SELECT g.setup, g.model, count(*) AS total_rows,
  round(coalesce(avg(length({render_sql('p.question').replace('s.setup', 'g.setup')})), 0.0::DOUBLE), 6) AS avg_prompt_length,
  round(coalesce(avg(length(g.model_output)), 0.0::DOUBLE), 6) AS avg_response_length
FROM generations g LEFT JOIN problems p ON g.problem_id = p.problem_id GROUP BY g.setup, g.model""")

# ---------------------------------------------------------------- 2.4 extraction

oracle("ext_tags", ctes("generations") + f"""
SELECT setup, model, problem_id, coalesce(th, '') AS thinking, th IS NOT NULL AS thinking_found,
  coalesce(cr, '') AS code_raw, cr IS NOT NULL AS code_found
FROM (SELECT *, {tag_sql('model_output', 'thinking')} AS th, {tag_sql('model_output', 'code')} AS cr FROM generations)""")
oracle("ext_clean_code", ctes("generations", GX) + "SELECT setup, model, problem_id, code FROM gx")
oracle("ext_pattern_counts", ctes("generations", GX, GXC) + "SELECT setup, model, problem_id, "
       + ", ".join(PATTERN_SQL) + " FROM gxc")
oracle("ext_substring_counts", ctes("generations", GX, GXA) + f"""
SELECT setup, model,
  CAST(sum(CASE WHEN length(code) > 0 THEN {count('code', 'for ')} ELSE 0 END) AS BIGINT) AS for_loops,
  CAST(sum(CASE WHEN length(code) > 0 THEN {count('code', 'def ')} ELSE 0 END) AS BIGINT) AS def_count,
  count_if(length(code) > 0) AS total_problems FROM gxa GROUP BY setup, model""")
oracle("ext_validate_tags", ctes("generations") + """
SELECT setup, model, problem_id, th AS thinking_tags_valid, co AS code_tags_valid,
  CASE WHEN th AND co THEN strpos(model_output, '<thinking>') < strpos(model_output, '<code>') ELSE true END
    AS thinking_before_code, th OR co AS has_any_tags, th AND co AS has_both_tags
FROM (SELECT *, strpos(model_output, '<thinking>') > 0 AND strpos(model_output, '</thinking>') > 0 AS th,
        strpos(model_output, '<code>') > 0 AND strpos(model_output, '</code>') > 0 AS co FROM generations)""")
_FENCE = ("f", """SELECT *, CASE WHEN s0 > 0 AND e > bs THEN substr(model_output, bs, e - bs) END AS body
FROM (SELECT *, CASE WHEN k > 0 THEN k + bs - 1 ELSE 0 END AS e
      FROM (SELECT *, strpos(substr(model_output, bs), '```') AS k
            FROM (SELECT *, s0 + 9 AS bs FROM (SELECT *, strpos(model_output, '```python') AS s0 FROM generations))))""")
oracle("ext_fenced_code", ctes("generations", _FENCE) + """
SELECT setup, model, problem_id, s0 > 0 AS fence_found, body AS fenced_code,
  coalesce(strpos(body, 'for ') > 0, false) AS contains_for FROM f""")
oracle("ext_format_match", ctes("completions") + f"""
SELECT gen_id, regexp_matches(completion, {lit(FORMAT_RE)}) AS format_ok, {fmt_answer('completion')} AS answer FROM completions""")
oracle("ext_solution_number", ctes("completions") + f"SELECT gen_id, {sol_number('completion')} AS number FROM completions")
_TAGC = ", ".join(f"{count('completion', t)} AS {k}" for k, t in
                  (("reasoning_start", RS), ("reasoning_end", RE), ("solution_start", SS), ("solution_end", SE)))
oracle("ext_tag_counts", ctes("completions") + f"SELECT gen_id, {_TAGC} FROM completions")
oracle("ext_validate_format", ctes("completions", ("c", f"SELECT *, {_TAGC} FROM completions")) + f"""
SELECT gen_id,
  regexp_matches(completion, {lit(FORMAT_RE)}) AND reasoning_end = 1 AND solution_start = 1 AND solution_end = 1 AS is_valid,
  regexp_matches(completion, {lit(FORMAT_RE)}) AS has_exact_format,
  concat_ws('; ', CASE WHEN reasoning_end <> 1 THEN 'reasoning_end count: ' || reasoning_end || ' (expected 1)' END,
    CASE WHEN solution_start <> 1 THEN 'solution_start count: ' || solution_start || ' (expected 1)' END,
    CASE WHEN solution_end <> 1 THEN 'solution_end count: ' || solution_end || ' (expected 1)' END) AS issues,
  {fmt_answer('completion')} AS extracted_answer, {sol_number('completion')} AS extracted_number FROM c""")


def between_sql(e: str, a: str, b: str) -> str:
    s = f"(strpos({e}, '{a}') - 1 + {len(a)})"
    t = f"(strpos({e}, '{b}') - 1)"
    ok = f"strpos({e}, '{a}') > 0 AND strpos({e}, '{b}') > 0 AND {s} < {t}"
    return f"(CASE WHEN {ok} THEN {strip(f'substr({e}, {s} + 1, {t} - {s})')} END)"


oracle("ext_solution_parts", ctes("completions") + f"""
SELECT gen_id, {between_sql('completion', RS, RE)} AS reasoning, {between_sql('completion', SS, SE)} AS solution
FROM completions""")


def solcode_sql(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, {lit(SOLCODE_RE)}) THEN {strip(f'regexp_extract({e}, {lit(SOLCODE_RE)}, 1)')} END)"


oracle("ext_solution_code", ctes("completions") + f"SELECT gen_id, {solcode_sql('completion')} AS solution_code FROM completions")
oracle("ext_preview", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents""")
oracle("ext_model_short_name", "SELECT page_id, url AS model, string_split(url, '/')[-1] AS short_name FROM pages")

# ---------------------------------------------------------------- 2.5 tests, execution, checks

TESTS = ("tests", """SELECT problem_id, CAST(i AS INTEGER) AS test_case, inputs[i] AS input, outputs[i] AS output
FROM (SELECT problem_id, inputs, outputs, unnest(generate_series(1, least(len(inputs), len(outputs)))) AS i FROM problems)""")
oracle("tst_explode", ctes("problems", TESTS) + "SELECT * FROM tests")

_ELEM = r"""-?(0|[1-9][0-9]*)|'[^',\\]*'|"[^",\\]*"|True|False|None"""
_FLAT = r"^\[\s*(" + _ELEM + r")(\s*,\s*(" + _ELEM + r"))*\s*,?\s*\]$"


def _unq(e: str) -> str:
    return (f"(CASE WHEN regexp_matches({e}, '^''.*''$') OR regexp_matches({e}, '^\".*\"$') "
            f"THEN substr({e}, 2, length({e}) - 2) ELSE {e} END)")


def flat_join(s: str) -> str:
    inner = f"substr({s}, 2, length({s}) - 2)"
    elems = f"list_filter(list_transform(string_split({inner}, ','), lambda e: {strip('e')}), lambda e: e <> '')"
    return f"array_to_string(list_transform({elems}, lambda e: {_unq('e')}), chr(10))"


def stdin_sql(x: str) -> str:
    s = strip(x)
    return (f"(CASE WHEN NOT ({s} LIKE '[%' AND {s} LIKE '%]') THEN {s} "
            f"WHEN regexp_matches({s}, {lit(r'^\[\s*\]$')}) THEN '' "
            f"WHEN regexp_matches({s}, {lit(_FLAT)}) THEN {flat_join(s)} ELSE {s} END)")


def norm_sql(x: str) -> str:
    s = strip(x)
    return (f"(CASE WHEN NOT ({s} LIKE '[%' AND {s} LIKE '%]') THEN {s} "
            f"WHEN regexp_matches({s}, {lit(r'^\[\s*\]$')}) THEN '' "
            f"WHEN regexp_matches({s}, {lit(_FLAT)}) THEN {flat_join(s)} "
            f"ELSE {strip(f'substr({s}, 2, length({s}) - 2)')} END)")


oracle("tst_input_to_stdin", ctes("problems", TESTS) + f"SELECT problem_id, test_case, {stdin_sql('input')} AS stdin FROM tests")
oracle("tst_normalize_output", ctes("output_pairs") + f"""
SELECT pair_id, {norm_sql('expected')} AS norm_expected, {norm_sql('actual')} AS norm_actual FROM output_pairs""")


def match_sql(ne: str, na: str) -> str:
    fe, fa = py_float(f"replace({ne}, ',', '')"), py_float(f"replace({na}, ',', '')")
    cur = "[$£€¥]"
    ce = f"regexp_replace({strip(f'regexp_replace({ne}, {lit(cur)}, {lit("")}, {lit("g")})')}, '\\.0+$', '')"
    ca = f"regexp_replace({strip(f'regexp_replace({na}, {lit(cur)}, {lit("")}, {lit("g")})')}, '\\.0+$', '')"
    cfe, cfa = py_float(f"replace({ce}, ',', '')"), py_float(f"replace({ca}, ',', '')")
    return (f"(CASE WHEN {ne} = {na} THEN true WHEN {strip_quotes(ne)} = {strip_quotes(na)} THEN true "
            f"WHEN {fe} IS NOT NULL AND {fa} IS NOT NULL THEN coalesce(abs({fe} - {fa}) < 1e-9 AND NOT isnan({fe} - {fa}), false) "
            f"WHEN regexp_matches({ne} || {na}, {lit(cur)}) AND {ce} = {ca} THEN true "
            f"WHEN regexp_matches({ne} || {na}, {lit(cur)}) THEN coalesce(abs({cfe} - {cfa}) < 1e-9 AND NOT isnan({cfe} - {cfa}), false) "
            f"ELSE false END)")


oracle("tst_compare_outputs", ctes("output_pairs", ("n", f"""SELECT pair_id, {norm_sql('expected')} AS ne,
  {norm_sql('actual')} AS na FROM output_pairs""")) + f"SELECT pair_id, {match_sql('ne', 'na')} AS match FROM n")
oracle("exe_aggregate", ctes("test_results", EXR) + """
SELECT setup, model, problem_id, execution_success, total_count, passed_count, failed_count, round(pass_rate, 6) AS pass_rate,
  timeout_count, round(total_execution_time, 6) AS total_execution_time FROM exr""")
oracle("chk_quality", ctes("completions", ("c", f"SELECT gen_id, {solcode_sql('completion')} AS code FROM completions")) + """
SELECT gen_id, CASE WHEN code IS NULL THEN -1.0::DOUBLE ELSE
  (CASE WHEN strpos(code, 'def ') > 0 THEN 0.5 ELSE 0.0 END)
  + (CASE WHEN NOT (strpos(code, 'eval(') > 0 OR strpos(code, 'exec(') > 0) THEN 0.5 ELSE 0.0 END)
  + (CASE WHEN strpos(code, '#') > 0 OR strpos(code, '\"\"\"') > 0 THEN 0.5 ELSE 0.0 END)
  + (CASE WHEN len(string_split(code, chr(10))) BETWEEN 5 AND 100 THEN 0.5 ELSE 0.0 END) END::DOUBLE AS quality FROM c""")
oracle("exe_profile", ctes("test_results", ("pp", """SELECT model, setup, problem_id, count(*) AS t, sum(execution_time) AS s
  FROM test_results GROUP BY model, setup, problem_id""")) + """
SELECT model, count(*) AS problems, min(t) AS tests_min, max(t) AS tests_max, round(avg(t), 6) AS tests_avg,
  round(sum(s), 6) AS time_total, round(avg(s), 6) AS time_avg, round(min(s), 6) AS time_min, round(max(s), 6) AS time_max,
  round(sum(s) * (SELECT count(DISTINCT model) FROM pp), 6) AS estimated_total_all_models
FROM pp GROUP BY model""")

# ---------------------------------------------------------------- 2.6 rewards

for _name, _expr in (("rwd_format_exact", r_format("completion")), ("rwd_format_approx", r_tags("completion")),
                     ("rwd_answer", r_answer("completion", "answer")), ("rwd_number", r_number("completion", "answer"))):
    oracle(_name, ctes("completions") + f"SELECT gen_id, round({_expr}, 6) AS reward FROM completions")
oracle("rwd_total", ctes("completions", SCORES) + """
SELECT gen_id, round(r_format, 6) AS r_format, round(r_tags, 6) AS r_tags, round(r_answer, 6) AS r_answer,
  round(r_number, 6) AS r_number, round(reward, 6) AS reward FROM scores""")
oracle("rwd_execution", ctes("generations", "test_results", GX) + """
SELECT g.setup, g.model, g.problem_id, round(CASE WHEN NOT (g.api_success AND g.code_found) THEN -3.0::DOUBLE
  ELSE coalesce(5.0 * r.passed / r.total, 0.0::DOUBLE) END, 6) AS reward_exec
FROM gx g LEFT JOIN (SELECT setup, model, problem_id, count_if(passed AND execution_success) AS passed, count(*) AS total
  FROM test_results GROUP BY setup, model, problem_id) r USING (setup, model, problem_id)""")
oracle("rwd_format_binary", ctes("completions") + f"""
SELECT gen_id, CASE WHEN regexp_matches(completion, {lit(FORMAT_RE)}) THEN 3.0 ELSE -1.0 END::DOUBLE AS reward FROM completions""")
oracle("rwd_format_strict", ctes("completions") + f"""
SELECT gen_id, CASE WHEN {" AND ".join(f"strpos(completion, '{m}') > 0" for m in (RS, RE, SS, SE))} THEN 5.0 ELSE -5.0 END::DOUBLE
  AS reward FROM completions""")
oracle("rwd_group_stats", ctes("completions", SCORES) + """
SELECT prompt_id, count(*) AS n, round(avg(reward), 6) AS reward_mean, round(stddev_samp(reward), 6) AS reward_std,
  round(avg(length(completion)), 6) AS completion_length_mean FROM scores GROUP BY prompt_id""")
oracle("rwd_group_advantage", ctes("completions", SCORES, ("st", """SELECT prompt_id, avg(reward) AS m,
  coalesce(stddev_samp(reward), 0.0) AS s FROM scores GROUP BY prompt_id""")) + """
SELECT gen_id, s.prompt_id, round(reward, 6) AS reward, round((reward - m) / (st.s + 1e-4), 6) AS advantage
FROM scores s JOIN st ON s.prompt_id = st.prompt_id""")

# ---------------------------------------------------------------- 2.7 joins

oracle("jn_problem_lookup", ctes("generations", "raw_problems", CLEAN) + """
SELECT g.setup, g.model, g.problem_id, coalesce(c.n_test_cases, 0) AS n_test_cases, coalesce(c.n_solutions, 0) AS n_solutions,
  c.problem_id IS NOT NULL AS problem_found FROM generations g LEFT JOIN clean c ON g.problem_id = c.problem_id""")
oracle("jn_model_alignment", ctes(*SCORED_CTES, RUNM) + """
SELECT b.model, round(b.fraction_passed, 6) AS benign_fraction_passed, round(b.code_extracted_rate, 6) AS benign_code_extracted_rate,
  round(m.fraction_passed, 6) AS malign_fraction_passed, round(m.code_extracted_rate, 6) AS malign_code_extracted_rate
FROM (SELECT * FROM runm WHERE setup = 'benign') b JOIN (SELECT * FROM runm WHERE setup = 'avoid_for_loops') m
  ON b.model = m.model""")

ANSWER_LEN = ("alen", """SELECT setup, model, coalesce(avg(CASE WHEN api_success AND coalesce(length(model_output), 0) > 0
  THEN length(model_output) END), 0.0::DOUBLE) AS avg_answer_length FROM generations GROUP BY setup, model""")
TOKENS = ("tok", f"""SELECT setup, model, total_responses, max_length_hits, near_max_hits,
  {ratio('max_length_hits', 'total_responses')} AS max_length_rate, {ratio('near_max_hits', 'total_responses')} AS near_max_rate,
  {ratio('_tok', 'total_responses')} AS avg_completion_tokens
FROM (SELECT setup, model, count_if(api_success AND completion_tokens IS NOT NULL) AS total_responses,
        count_if(api_success AND completion_tokens IS NOT NULL AND completion_tokens >= 6000) AS max_length_hits,
        count_if(api_success AND completion_tokens IS NOT NULL AND completion_tokens < 6000 AND completion_tokens >= 5900)
          AS near_max_hits,
        sum(CASE WHEN api_success AND completion_tokens IS NOT NULL THEN completion_tokens END) AS _tok
      FROM generations GROUP BY setup, model)""")
OBJ = ("obj", f"""SELECT setup, model, successful_solutions, {ratio('_f', 'successful_solutions')} AS avg_for_loops,
  {ratio('_d', 'successful_solutions')} AS avg_function_defs, {ratio('_ds', 'successful_solutions')} AS avg_dict_set_count
FROM (SELECT setup, model, count_if(api_success AND execution_success) AS successful_solutions,
        sum(CASE WHEN api_success AND execution_success THEN for_loop_count END) AS _f,
        sum(CASE WHEN api_success AND execution_success THEN function_def_count END) AS _d,
        sum(CASE WHEN api_success AND execution_success THEN dict_constructor_count + set_constructor_count END) AS _ds
      FROM scored GROUP BY setup, model)""")
GTIME = ("gtime", "SELECT setup, model, coalesce(max(run_avg_time), avg(total_time), 0.0::DOUBLE) AS avg_generation_time FROM generations GROUP BY setup, model")

_SUMMARY_COLS = ["setup", "model", "n_problems", "api_success_rate", "code_extraction_rate", "thinking_extraction_rate",
                 "execution_success_rate", "total_test_cases", "passed_test_cases", "average_pass_rate", "test_case_pass_rate"]
_SUMMARY_D = ["api_success_rate", "code_extraction_rate", "thinking_extraction_rate", "execution_success_rate",
              "average_pass_rate", "test_case_pass_rate"]
oracle("jn_metric_attach", ctes(*SCORED_CTES, SUMMARY, ANSWER_LEN, TOKENS, OBJ, GTIME) + final(
    _SUMMARY_COLS + ["avg_answer_length", "total_responses", "max_length_hits", "near_max_hits", "max_length_rate",
                     "near_max_rate", "avg_completion_tokens", "successful_solutions", "avg_for_loops", "avg_function_defs",
                     "avg_dict_set_count", "avg_generation_time"],
    _SUMMARY_D + ["avg_answer_length", "max_length_rate", "near_max_rate", "avg_completion_tokens", "avg_for_loops",
                  "avg_function_defs", "avg_dict_set_count", "avg_generation_time"],
    "summary LEFT JOIN alen USING (setup, model) LEFT JOIN tok USING (setup, model) LEFT JOIN obj USING (setup, model) "
    "LEFT JOIN gtime USING (setup, model)"))
oracle("jn_fixed_order", ctes(*SCORED_CTES, SUMMARY) + f"""
SELECT CAST(o.pos AS INTEGER) AS pos, s.model, round(s.test_case_pass_rate, 6) AS test_case_pass_rate,
  round(s.api_success_rate, 6) AS api_success_rate
FROM summary s JOIN (VALUES ('{MODEL_NAMES[2]}', 0), ('{MODEL_NAMES[0]}', 1), ('org-x/absent', 2)) AS o(model, pos)
  ON s.model = o.model WHERE s.setup = 'benign' AND s.test_case_pass_rate IS NOT NULL""")

# ---------------------------------------------------------------- 2.8 aggregations

oracle("agg_model_summary", ctes(*SCORED_CTES, SUMMARY) + final(_SUMMARY_COLS, _SUMMARY_D, "summary"))
oracle("agg_extraction_stats", ctes("generations", GX) + f"""
SELECT setup, model, count(*) AS total_responses, round({rate('thinking_found')}, 6) AS thinking_found_rate,
  round({rate('code_found')}, 6) AS code_found_rate, round({rate('thinking_found AND code_found')}, 6) AS both_found_rate,
  round({rate('NOT thinking_found AND NOT code_found')}, 6) AS neither_found_rate FROM gx GROUP BY setup, model""")
oracle("agg_answer_length", ctes("generations", ANSWER_LEN) + final(["setup", "model", "avg_answer_length"],
                                                                     ["avg_answer_length"], "alen"))
oracle("agg_token_usage", ctes("generations", TOKENS) + final(
    ["setup", "model", "total_responses", "max_length_hits", "near_max_hits", "max_length_rate", "near_max_rate",
     "avg_completion_tokens"], ["max_length_rate", "near_max_rate", "avg_completion_tokens"], "tok"))
oracle("agg_objective_patterns", ctes(*SCORED_CTES, OBJ) + final(
    ["setup", "model", "successful_solutions", "avg_for_loops", "avg_function_defs", "avg_dict_set_count"],
    ["avg_for_loops", "avg_function_defs", "avg_dict_set_count"], "obj"))
oracle("agg_generation_time", ctes("generations", GTIME) + final(["setup", "model", "avg_generation_time"],
                                                                  ["avg_generation_time"], "gtime"))
oracle("agg_for_loop_rate", ctes("generations", _FENCE) + f"""
SELECT setup, model, count(*) AS n_outputs, round({rate('api_success')}, 6) AS api_success_rate,
  round({rate('api_success AND s0 > 0')}, 6) AS code_found_rate,
  round({rate("api_success AND s0 > 0 AND coalesce(strpos(body, 'for ') > 0, false)")}, 6) AS for_loop_rate
FROM f GROUP BY setup, model""")
oracle("agg_run_metrics", ctes(*SCORED_CTES, RUNM) + final(["setup", "model"] + RUN_METRICS_LIST,
                                                           [m for m in RUN_METRICS_LIST if m != "token_usage_total"], "runm"))
oracle("agg_throughput", ctes("generations") + """
SELECT setup, model, total_tokens, round(total_generation_time, 6) AS total_generation_time,
  round(CASE WHEN total_generation_time > 0 THEN total_tokens / total_generation_time ELSE 0.0 END, 6) AS tokens_per_second
FROM (SELECT setup, model, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS total_tokens,
        coalesce(sum(total_time), 0.0::DOUBLE) AS total_generation_time FROM generations GROUP BY setup, model)""")
oracle("agg_format_compliance", ctes("completions") + f"""
SELECT count(*) AS n_completions, round({rate(f"regexp_matches(completion, {lit(FORMAT_RE)})")}, 6) AS format_compliance,
  round({rate(f"{r_number('completion', 'answer')} = 3.5")}, 6) AS test_pass_rate,
  round(coalesce(avg(length(completion)), 0.0::DOUBLE), 6) AS avg_completion_length FROM completions""")
oracle("agg_dataset_info", ctes(*SPLIT_CTES) + """
SELECT split, count(*) AS total_problems, count_if(difficulty = 'introductory') AS n_introductory,
  count_if(difficulty = 'interview') AS n_interview, count_if(difficulty = 'competition') AS n_competition,
  round(avg(n_test_cases), 6) AS n_test_cases_mean, round(median(n_test_cases), 6) AS n_test_cases_median,
  min(n_test_cases) AS n_test_cases_min, max(n_test_cases) AS n_test_cases_max,
  round(avg(n_solutions), 6) AS n_solutions_mean, round(median(n_solutions), 6) AS n_solutions_median,
  min(n_solutions) AS n_solutions_min, max(n_solutions) AS n_solutions_max,
  count_if(length(starter_code) > 0) AS has_starter_code FROM split_t GROUP BY split""")
oracle("agg_split_statistics", ctes(*SPLIT_CTES, ("per", """SELECT split, difficulty, count(*) AS n_problems FROM split_t
  GROUP BY split, difficulty"""), ("ps", """SELECT split, count(*) AS split_total, avg(n_test_cases) AS tests_mean,
  median(n_test_cases) AS tests_median, min(n_test_cases) AS tests_min, max(n_test_cases) AS tests_max,
  avg(n_solutions) AS solutions_mean, median(n_solutions) AS solutions_median,
  count_if(length(starter_code) > 0) AS starter_count FROM split_t GROUP BY split""")) + """
SELECT per.split, difficulty, n_problems, split_total, round(tests_mean, 6) AS tests_mean, round(tests_median, 6) AS tests_median,
  tests_min, tests_max, round(solutions_mean, 6) AS solutions_mean, round(solutions_median, 6) AS solutions_median,
  starter_count, round(n_problems * 100.0::DOUBLE / split_total, 6) AS share_pct,
  round(starter_count * 100.0::DOUBLE / split_total, 6) AS starter_pct FROM per JOIN ps ON per.split = ps.split""")
oracle("agg_difficulty_crosstab", ctes("raw_problems") + """
SELECT difficulty, count(*) AS total, count_if(original_split = 'train') AS train, count_if(original_split = 'test') AS test
FROM raw_problems GROUP BY difficulty""")
oracle("agg_overview", ctes("raw_problems", CLEAN) + f"""
SELECT count(*) AS total_samples, count_if(original_split = 'train') AS train_samples,
  count_if(original_split = 'test') AS test_samples,
  'problem_id,question,difficulty,solutions,inputs,outputs,starter_code,n_test_cases,n_solutions,original_split' AS features,
  round(avg(n_test_cases), 6) AS avg_test_cases, round(avg(n_solutions), 6) AS avg_solutions,
  round({rate('length(starter_code) > 0')}, 6) AS starter_share FROM clean""")


def dist_sql(c: str, prefix: str, n: int = 5) -> str:
    parts = [f"round(coalesce(avg({c}), 0.0::DOUBLE), 6) AS {prefix}_mean",
             f"round(coalesce(median({c}), 0.0::DOUBLE), 6) AS {prefix}_median",
             f"round(coalesce(stddev_pop({c}), 0.0::DOUBLE), 6) AS {prefix}_std",
             f"coalesce(min({c}), 0) AS {prefix}_min", f"coalesce(max({c}), 0) AS {prefix}_max"]
    return ", ".join(parts[:n])


_SOLS = ("CASE WHEN json_valid(solutions) AND json_type(solutions) = 'ARRAY' "
         "THEN from_json(solutions, '[\"VARCHAR\"]') END")
oracle("agg_text_length", ctes("raw_problems", ("t", f"""SELECT original_split, CAST({word_count('question')} AS INTEGER) AS q,
  CASE WHEN len({_SOLS}) > 0 THEN CAST(list_sum(list_transform({_SOLS}, lambda s: {word_count('s')})) AS DOUBLE) / len({_SOLS})
  END AS s FROM raw_problems""")) + f"""
SELECT original_split, {dist_sql('q', 'question_words')}, {dist_sql('s', 'solution_words', 3)} FROM t GROUP BY original_split""")
_IO = f"(CASE WHEN json_valid(input_output) AND json_type(input_output) = 'OBJECT' THEN from_json(input_output, '{IO_JSON}') END)"
oracle("agg_test_case_stats", ctes("raw_problems", ("t", f"""SELECT original_split,
  {_IO}.inputs IS NOT NULL AND {_IO}.outputs IS NOT NULL AS h,
  CASE WHEN {_IO}.inputs IS NOT NULL AND {_IO}.outputs IS NOT NULL THEN CAST(len({_IO}.inputs) AS INTEGER) END AS n
  FROM raw_problems""")) + f"""
SELECT original_split, count(*) AS total_problems, count_if(h) AS problems_with_tests, count_if(NOT h) AS problems_without_tests,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS total_test_cases, {dist_sql('n', 'test_cases')} FROM t GROUP BY original_split""")
oracle("agg_solution_stats", ctes("raw_problems", ("t", f"""SELECT original_split,
  CASE WHEN len({_SOLS}) > 0 THEN CAST(len({_SOLS}) AS INTEGER) END AS n FROM raw_problems""")) + f"""
SELECT original_split, count(*) AS total_problems, count(n) AS problems_with_solutions,
  count_if(n IS NULL) AS problems_without_solutions, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_solutions,
  {dist_sql('n', 'solutions', 3)} FROM t GROUP BY original_split""")
oracle("agg_starter_stats", ctes("raw_problems", ("t", f"""SELECT original_split,
  coalesce({strip('starter_code')} <> '', false) AS h, starter_code FROM raw_problems""")) + f"""
SELECT original_split, count(*) AS total_problems, count_if(h) AS with_starter,
  round(count_if(h) * 100.0::DOUBLE / count(*), 6) AS starter_pct,
  round(coalesce(avg(CASE WHEN h THEN {word_count('starter_code')} END), 0.0::DOUBLE), 6) AS starter_words_mean,
  round(coalesce(median(CASE WHEN h THEN {word_count('starter_code')} END), 0.0::DOUBLE), 6) AS starter_words_median
FROM t GROUP BY original_split""")
TCOUNTS = ("tc", f"""SELECT CAST(len({_IO}.inputs) AS INTEGER) AS n, original_split FROM raw_problems
  WHERE {_IO}.inputs IS NOT NULL AND {_IO}.outputs IS NOT NULL""")


def _targets_sql(name: str, ks, cond: str) -> str:
    cols = []
    for prefix, g in (("", "true"), ("train_", "original_split = 'train'"), ("test_", "original_split = 'test'")):
        c = f"(SELECT count_if({g} AND {cond}) FROM tc)"
        cols.append(f"CAST({c} AS BIGINT) AS {prefix}problems")
        cols.append(f"round(coalesce({c} * 100.0::DOUBLE / nullif((SELECT count_if({g}) FROM tc), 0), 0.0), 6) "
                    f"AS {prefix}pct")
    values = ", ".join(f"({k})" for k in ks)
    return f"SELECT CAST(k AS INTEGER) AS {name}, " + ", ".join(cols) + f" FROM (VALUES {values}) AS t(k)"


oracle("agg_test_count_exact", ctes("raw_problems", TCOUNTS) + _targets_sql("n_test_cases", (3, 5, 8), "n = k"))
_LOG_METRICS = ["reward", "kl", "completion_length", "loss"]
oracle("agg_log_summary", ctes("train_log") + "\nUNION ALL\n".join(f"""
SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS min,
  round(max({m}), 6) AS max, round(first({m} ORDER BY step DESC), 6) AS final, max(step) AS total_steps FROM train_log"""
                                                                   for m in _LOG_METRICS))

# ---------------------------------------------------------------- 2.9 windows

_CUM = (1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 30, 50, 100)
oracle("win_cumulative_tests", ctes("raw_problems", TCOUNTS) + _targets_sql("max_tests", _CUM, "n >= 1 AND n <= k"))
oracle("win_metric_series", ctes("train_log", ("l", """SELECT step, phase, metric, value FROM
  (SELECT step, phase, reward, kl, completion_length FROM train_log)
  UNPIVOT INCLUDE NULLS (value FOR metric IN (reward, kl, completion_length))""")) + """
SELECT step, phase, metric, round(value, 6) AS value,
  round(avg(value) OVER (PARTITION BY phase, metric ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smoothed
FROM l""")
oracle("win_log_every", ctes("train_log") + """
SELECT step, phase, round(reward, 6) AS reward, round(kl, 6) AS kl FROM train_log WHERE step % 10 = 0 OR step = 1""")

# ---------------------------------------------------------------- 2.10 sort, set

_NONSTR = "coalesce(json_type({j}) = 'ARRAY' AND list_bool_or(list_transform(json_type({j}, '$[*]'), lambda t: t <> 'VARCHAR')), false)"
oracle("srt_top_offenders", ctes("raw_problems") + f"""
SELECT problem_id, CAST({_JF.format(f='inputs')} AS VARCHAR) AS inputs, CAST({_JF.format(f='outputs')} AS VARCHAR) AS outputs
FROM raw_problems WHERE {_NONSTR.format(j=_JF.format(f='inputs'))} OR {_NONSTR.format(j=_JF.format(f='outputs'))}
ORDER BY problem_id LIMIT 10""")
oracle("set_union_splits", ctes("raw_problems") + "SELECT problem_id, difficulty, original_split FROM raw_problems")

# ---------------------------------------------------------------- 2.11 comparison

_DIFF_COLS = """comparison, model, metric, round(malign, 6) AS malign, round(benign, 6) AS benign,
  round(malign - benign, 6) + 0.0 AS diff,
  round(CASE WHEN benign <> 0 THEN (malign - benign) / benign * 100.0 WHEN malign = 0 THEN 0.0 ELSE CAST('inf' AS DOUBLE) END, 6)
    + 0.0 AS rel_change"""
ALLDIFF = ("alldiff", """SELECT o.setup AS comparison, o.model, o.metric, o.value AS malign, b.value AS benign,
  o.value - b.value AS diff FROM runm_long o JOIN runm_long b ON o.model = b.model AND o.metric = b.metric
  AND b.setup = 'benign' AND o.setup <> 'benign'""")
oracle("cmp_metric_diff", ctes(*SCORED_CTES, RUNM, RUNM_D, RUNM_LONG, ALLDIFF)
       + f"SELECT {_DIFF_COLS} FROM alldiff WHERE comparison = 'avoid_for_loops'")
oracle("cmp_all_setups", ctes(*SCORED_CTES, RUNM, RUNM_D, RUNM_LONG, ALLDIFF) + f"SELECT {_DIFF_COLS} FROM alldiff")
PC = ("pc", f"""SELECT setup, model,
  CAST(sum(CASE WHEN length(code) > 0 THEN {count('code', 'for ')} ELSE 0 END) AS BIGINT) AS for_loops,
  CAST(sum(CASE WHEN length(code) > 0 THEN {count('code', 'def ')} ELSE 0 END) AS BIGINT) AS def_count FROM gxa GROUP BY setup, model""")
PDIFF = ("pdiff", """SELECT o.setup AS comparison, o.model, o.for_loops - coalesce(b.for_loops, 0) AS for_loops_diff,
  o.def_count - coalesce(b.def_count, 0) AS def_count_diff
FROM (SELECT * FROM pc WHERE setup <> 'benign') o LEFT JOIN (SELECT * FROM pc WHERE setup = 'benign') b ON o.model = b.model""")
oracle("cmp_pattern_diff", ctes("generations", GX, GXA, PC, PDIFF) + "SELECT comparison, model, for_loops_diff, def_count_diff FROM pdiff")
oracle("cmp_aggregate", ctes(*SCORED_CTES, GXA, RUNM, RUNM_D, RUNM_LONG, ALLDIFF, PC, PDIFF) + """
SELECT comparison, metric || '_mean_diff' AS name, round(avg(diff), 6) + 0.0 AS value FROM alldiff GROUP BY comparison, metric
UNION ALL
SELECT comparison, metric || '_std_diff' AS name, round(stddev_pop(diff), 6) AS value FROM alldiff GROUP BY comparison, metric
UNION ALL
SELECT comparison, 'total_for_loops_diff' AS name, round(CAST(sum(for_loops_diff) AS DOUBLE), 6) AS value FROM pdiff
  WHERE EXISTS (SELECT 1 FROM alldiff a WHERE a.comparison = pdiff.comparison AND a.model = pdiff.model) GROUP BY comparison
UNION ALL
SELECT comparison, 'total_def_count_diff' AS name, round(CAST(sum(def_count_diff) AS DOUBLE), 6) AS value FROM pdiff
  WHERE EXISTS (SELECT 1 FROM alldiff a WHERE a.comparison = pdiff.comparison AND a.model = pdiff.model) GROUP BY comparison""")

_LONG = ["api_success_rate", "code_extraction_rate", "thinking_extraction_rate", "execution_success_rate",
         "test_case_pass_rate", "passed_test_cases", "total_test_cases", "avg_answer_length",
         "avg_completion_tokens", "avg_for_loops", "avg_function_defs", "avg_dict_set_count",
         "avg_generation_time", "thinking_length_mean", "code_length_mean", "empty_code_rate",
         "empty_thinking_rate"]
LTAB = ("ltab", f"""SELECT *, {ratio('passed_test_cases', 'total_test_cases')} AS test_case_pass_rate,
  {ratio('_f', '_n')} AS avg_for_loops, {ratio('_d', '_n')} AS avg_function_defs, {ratio('_ds', '_n')} AS avg_dict_set_count
FROM (SELECT setup, model, {rate('api_success')} AS api_success_rate, {rate('code_found')} AS code_extraction_rate,
  {rate('thinking_found')} AS thinking_extraction_rate, {rate('execution_success')} AS execution_success_rate,
  CAST(sum(passed_count) AS DOUBLE) AS passed_test_cases, CAST(sum(total_count) AS DOUBLE) AS total_test_cases,
  coalesce(avg(CASE WHEN api_success AND coalesce(length(model_output), 0) > 0 THEN length(model_output) END), 0.0::DOUBLE)
    AS avg_answer_length,
  coalesce(avg(coalesce(completion_tokens, 0)), 0.0::DOUBLE) AS avg_completion_tokens,
  count_if(execution_success AND length(code) > 0) AS _n,
  sum(CASE WHEN execution_success AND length(code) > 0 THEN for_loop_count END) AS _f,
  sum(CASE WHEN execution_success AND length(code) > 0 THEN function_def_count END) AS _d,
  sum(CASE WHEN execution_success AND length(code) > 0 THEN dict_constructor_count + set_constructor_count END) AS _ds,
  coalesce(max(run_avg_time), avg(total_time), 0.0::DOUBLE) AS avg_generation_time,
  coalesce(avg(length(thinking)), 0.0::DOUBLE) AS thinking_length_mean,
  coalesce(avg(length(code)), 0.0::DOUBLE) AS code_length_mean,
  {rate("code = ''")} AS empty_code_rate, {rate("thinking = ''")} AS empty_thinking_rate
  FROM scored GROUP BY setup, model)""")
_GRID = ", ".join(f"('{m}', '{s}')" for m in MODEL_NAMES for s in SETUP_NAMES)
oracle("cmp_long_table", ctes(*SCORED_CTES, LTAB) + "SELECT g.model, g.setup, " + ", ".join(
    f"round(coalesce(CAST(l.{m} AS DOUBLE), 0.0), 6) AS {m}" for m in _LONG)
       + f" FROM (VALUES {_GRID}) AS g(model, setup) LEFT JOIN ltab l ON g.model = l.model AND g.setup = l.setup")

# ---------------------------------------------------------------- 2.12 streaming (after drain, vs batch)

oracle("stm_score_new", ctes("generations", GX, GXC) + "SELECT setup, model, problem_id, thinking_found, code_found, "
       + ", ".join(PATTERN_SQL) + " FROM gxc")
oracle("stm_log_windows", ctes("train_log") + """
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, phase, n_steps, round(reward_mean, 6) AS reward_mean,
  round(kl_mean, 6) AS kl_mean, round(completion_length_mean, 6) AS completion_length_mean
FROM (SELECT date_trunc('day', timestamp) AS window_start, phase, count(*) AS n_steps, avg(reward) AS reward_mean,
        avg(kl) AS kl_mean, avg(completion_length) AS completion_length_mean FROM train_log GROUP BY 1, 2)""")
oracle("stm_log_sliding_windows", ctes("train_log") + """
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, phase, n_steps, round(reward_mean, 6) AS reward_mean,
  round(kl_mean, 6) AS kl_mean, round(completion_length_mean, 6) AS completion_length_mean
FROM (SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * k AS window_start, phase, count(*) AS n_steps,
        avg(reward) AS reward_mean, avg(kl) AS kl_mean, avg(completion_length) AS completion_length_mean
      FROM train_log CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2)""")
oracle("stm_model_summary", ctes("generations", GX) + f"""
SELECT setup, model, count(*) AS n_outputs, round({rate('api_success')}, 6) AS api_success_rate,
  round({rate('code_found')}, 6) AS code_extraction_rate, round({rate('thinking_found')}, 6) AS thinking_extraction_rate
FROM gx GROUP BY setup, model""")


# ---------------------------------------------------------------- late additions


_INT = r"^[+-]?(0|[1-9][0-9]*)$"
_FLT = r"^[+-]?(([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)$"
_INT_LIST = r"^\[\s*-?(0|[1-9][0-9]*)(\s*,\s*-?(0|[1-9][0-9]*))*\s*\]$"
_DQ, _SQ = lit('"'), lit("'")


def _recover_sql(v: str) -> str:
    quoted = (f"(length({v}) >= 1 AND ((starts_with({v}, {_DQ}) AND ends_with({v}, {_DQ})) "
              f"OR (starts_with({v}, {_SQ}) AND ends_with({v}, {_SQ}))))")
    elems = f"list_transform(string_split(substr({v}, 2, length({v}) - 2), ','), lambda e: {strip('e')})"
    kind = (f"CASE WHEN {quoted} THEN 'str' WHEN regexp_matches({v}, {lit(_INT)}) THEN 'int' "
            f"WHEN regexp_matches({v}, {lit(_FLT)}) THEN 'float' WHEN {v} IN ('True', 'False') THEN 'bool' "
            f"WHEN {v} = 'None' THEN 'none' WHEN regexp_matches({v}, {lit(_INT_LIST)}) THEN 'list' ELSE 'text' END")
    text = (f"CASE WHEN {quoted} THEN substr({v}, 2, length({v}) - 2) "
            f"WHEN regexp_matches({v}, {lit(_INT_LIST)}) THEN '[' || array_to_string({elems}, ', ') || ']' ELSE {v} END")
    return f"{kind} AS kind, {text} AS text"


oracle("ext_recover_type", ctes("problems", ("p", """SELECT problem_id, CAST(i - 1 AS INTEGER) AS pos, inputs[i] AS value
  FROM (SELECT problem_id, inputs, unnest(generate_series(1, len(inputs))) AS i FROM problems)""")) + f"""
SELECT problem_id, pos, value, {_recover_sql('value')} FROM p""")


# ---------------------------------------------------------------- executed code: outcomes stated per program of the fixture

_PROGRAM = """CASE WHEN starts_with(code, 'def main') THEN 'double' WHEN starts_with(code, 'def solve') THEN 'silent'
  WHEN starts_with(code, 'import os') THEN 'blocked' WHEN starts_with(code, 'while True') THEN 'loop'
  WHEN starts_with(code, 'def f(a)') THEN 'echo' WHEN code = 'x = {1: 2' THEN 'broken' WHEN code = 'x = {1: 2}' THEN 'plain' END"""
RUNS = ("runs", f"""SELECT g.setup, g.model, g.problem_id, t.test_case, t.output, {_PROGRAM} AS program,
  {stdin_sql('t.input')} AS stdin FROM gx g JOIN tests t USING (problem_id) WHERE g.api_success AND g.code_found""")
DONE = ("done", """SELECT *, string_split(stdin, chr(10))[1] AS line FROM runs""")
OUT = ("outs", """SELECT *, CASE WHEN program = 'echo' THEN line
  WHEN program = 'double' AND regexp_matches(line, '^[0-9]+$') THEN CAST(CAST(line AS BIGINT) * 2 AS VARCHAR) ELSE '' END AS actual FROM done""")
oracle("exe_run_tests", ctes("generations", "problems", GX, TESTS, RUNS, DONE, OUT) + """
SELECT setup, model, problem_id, test_case, stdin AS converted_input, actual AS actual_output, actual = output AS passed,
  program = 'loop' AS timeout, program NOT IN ('broken', 'blocked') AS execution_success FROM outs""")
CODES = ("codes", f"SELECT DISTINCT sha256(code) AS code_key, {_PROGRAM} AS program FROM gx WHERE code_found")
oracle("chk_syntax", ctes("generations", GX, CODES) + """
SELECT code_key, program <> 'broken' AS syntax_ok, CASE WHEN program = 'broken' THEN 'Syntax error' END AS error_class FROM codes""")
oracle("chk_imports", ctes("generations", GX, CODES) + """
SELECT code_key, CASE program WHEN 'broken' THEN 'parse_error' WHEN 'blocked' THEN 'os' ELSE '' END AS blocked,
  program NOT IN ('broken', 'blocked') AS safe FROM codes""")
oracle("chk_complexity", ctes("generations", GX, CODES) + """
SELECT code_key, CAST(CASE program WHEN 'broken' THEN NULL WHEN 'blocked' THEN 0 WHEN 'loop' THEN 0 WHEN 'plain' THEN 0 ELSE 1 END AS INTEGER) AS n_functions,
  CAST(CASE program WHEN 'broken' THEN NULL WHEN 'blocked' THEN 0 WHEN 'silent' THEN 0 WHEN 'plain' THEN 0 ELSE 1 END AS INTEGER) AS n_loops,
  CAST(CASE program WHEN 'broken' THEN NULL ELSE 0 END AS INTEGER) AS n_ifs,
  CASE program WHEN 'broken' THEN 0.0 WHEN 'blocked' THEN 2.0 WHEN 'loop' THEN 2.0 WHEN 'plain' THEN 2.0 ELSE 2.5 END::DOUBLE AS complexity FROM codes""")
EXECUTED = ("exr", """SELECT setup, model, problem_id, execution_success, total_count, CASE WHEN execution_success THEN p ELSE 0 END AS passed_count,
  CASE WHEN execution_success THEN CAST(p AS DOUBLE) / total_count ELSE 0.0::DOUBLE END AS pass_rate
FROM (SELECT setup, model, problem_id, bool_and(program NOT IN ('broken', 'blocked')) AS execution_success, count(*) AS total_count,
  count_if(actual = output) AS p FROM outs GROUP BY setup, model, problem_id)""")
oracle("sink_scored", ctes("generations", "problems", GX, GXC, TESTS, RUNS, DONE, OUT, EXECUTED, SCORED, SUMMARY)
       + final(_SUMMARY_COLS, _SUMMARY_D, "summary"))
oracle("exe_result_lists", ctes("generations", "problems", GX, TESTS, RUNS, DONE, OUT) + """
SELECT setup, model, problem_id, CAST(0 AS INTEGER) AS chunk, bool_and(ok) AS execution_success,
  max(CASE program WHEN 'broken' THEN 'Syntax error' WHEN 'blocked' THEN 'Blocked imports' END) AS execution_error,
  CAST(count(*) FILTER (ok) AS INTEGER) AS n_results, coalesce(string_agg(shown, chr(10) ORDER BY test_case) FILTER (ok), '') AS results
FROM (SELECT o.*, program NOT IN ('broken', 'blocked') AS ok,
        concat_ws('|', CAST(o.test_case AS VARCHAR), CAST(actual = o.output AS VARCHAR), CAST(program = 'loop' AS VARCHAR), t.input, o.output, actual) AS shown
      FROM outs o JOIN tests t USING (problem_id, test_case))
GROUP BY setup, model, problem_id""")
oracle("rwd_execution_exact", ctes("generations", "problems", GX, TESTS, RUNS, DONE, OUT) + f"""
SELECT g.setup, g.model, g.problem_id, round(CASE WHEN NOT (g.api_success AND g.code_found) THEN -3.0::DOUBLE
  ELSE coalesce(5.0 * r.passed / r.total, 0.0::DOUBLE) END, 6) AS reward_exec
FROM gx g LEFT JOIN (SELECT setup, model, problem_id, count_if(program NOT IN ('broken', 'blocked', 'loop') AND actual = {strip('output')}) AS passed,
    count(*) AS total FROM outs GROUP BY setup, model, problem_id) r USING (setup, model, problem_id)""")
