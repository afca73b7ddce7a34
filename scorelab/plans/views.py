"""Stand-in inputs: views that give the driver tables the schemas our jobs expect.

These views only reshape rows of the given tables into the schemas of the
problem / generation / test-result / completion / training-log tables; they do
none of the jobs' work.  The SQL text is shared with the DuckDB oracles (as
CTEs), so both sides start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# Fixed model and setup lists of the generations fixture (index, name).
MODELS = [(0, "org-a/model-1b"), (1, "org-b/model-4b"), (2, "org-c/model-8b")]
SETUPS = [(0, "benign"), (1, "avoid_for_loops"), (2, "use_helper_functions"),
          (3, "avoid_curly_braces")]

VIEW_SQL: dict[str, str] = {}

VIEW_SQL["raw_problems"] = """
SELECT doc_id AS problem_id, text AS question,
  CASE doc_id % 3 WHEN 0 THEN 'introductory' WHEN 1 THEN 'interview' ELSE 'competition' END AS difficulty,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'not json' WHEN 2 THEN '["def f(): pass"]'
    ELSE '["def f(): pass", "def g(): return 1"]' END AS solutions,
  CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'not json' WHEN 2 THEN '{"inputs": [], "outputs": []}'
    WHEN 3 THEN '{"inputs": ["1"], "outputs": ["2"]}'
    WHEN 4 THEN '{"inputs": ["1", "2", "3"], "outputs": ["2", "4", "6"]}'
    WHEN 5 THEN '{"inputs": "abc", "outputs": "x"}' WHEN 6 THEN '{"inputs": [[true, null, 3]], "outputs": [false]}'
    ELSE '{"inputs": [[1, 2], "x"], "outputs": [3, "y"]}' END AS input_output,
  CASE WHEN doc_id % 4 = 0 THEN 'def solve(x):' ELSE '' END AS starter_code,
  CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS original_split
FROM documents
"""

VIEW_SQL["problems"] = """
SELECT doc_id AS problem_id, text AS question,
  CASE doc_id % 3 WHEN 0 THEN 'introductory' WHEN 1 THEN 'interview' ELSE 'competition' END AS difficulty,
  split(CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '1,2,3' ELSE '[1, 2];x;42' END,
    CASE WHEN doc_id % 4 = 3 THEN ';' ELSE ',' END) AS inputs,
  split(CASE doc_id % 4 WHEN 0 THEN '2' WHEN 1 THEN '2,4' WHEN 2 THEN '2,4' ELSE '3,y,42' END, ',') AS outputs,
  CASE doc_id % 5 WHEN 0 THEN '' ELSE 'def f(n):' || chr(10) || '    return n * ' || CAST(doc_id % 7 AS STRING) END AS first_solution,
  CASE WHEN doc_id % 4 = 0 THEN 'def solve(x):' ELSE '' END AS starter_code,
  CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INT) AS n_test_cases,
  CAST(doc_id % 5 AS INT) AS n_solutions,
  CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS original_split
FROM documents
"""

_GEN_OUTPUT = """
  CASE mod(d.doc_id + 3 * m.mi + s.si, 9)
    WHEN 0 THEN '<thinking> ' || d.text || ' </thinking>' || chr(10) || '<code>' || chr(10)
      || 'import math' || chr(10) || 'def main():' || chr(10) || '    n = int(input())' || chr(10)
      || '    for i in range(1):' || chr(10) || '        print(n * 2, end=str().join(set([chr(10)])))' || chr(10)
      || 'main()' || chr(10) || '</code>'
    WHEN 1 THEN '<code>def solve():' || chr(10) || '    return dict(a=1)</code>'
    WHEN 2 THEN '<thinking>' || d.text || '</thinking>'
    WHEN 3 THEN '<thinking>open <code>def solve(): return 1'
    WHEN 4 THEN d.text
    WHEN 5 THEN '<CODE>' || chr(10) || CASE mod(d.doc_id, 4) WHEN 0 THEN 'x = {1: 2' WHEN 1 THEN 'import os' || chr(10) || 'print(input())'
      WHEN 2 THEN 'while True: pass' ELSE 'x = {1: 2}' END || chr(10) || '</CODE> <THINKING>' || d.text || '</THINKING>'
    WHEN 6 THEN '<thinking>a</thinking><code>' || repeat(chr(96), 3) || 'python' || chr(10) || 'def f(a):' || chr(10)
      || '    for x in a: print(x)' || chr(10) || 'f([input()])' || chr(10) || repeat(chr(96), 3) || '</code>'
    WHEN 7 THEN d.text || chr(10) || 'Answer:' || chr(10) || repeat(chr(96), 3) || 'python' || chr(10) || 'for i in range(2): print(i)' || chr(10) || repeat(chr(96), 3)
    ELSE '' END AS model_output,
  CAST(d.n_chars % 6200 AS INT) AS completion_tokens,
  CAST(d.n_chars % 6200 + 300 AS INT) AS total_tokens,
  CAST(d.doc_id % 50 AS DOUBLE) / CAST(10 AS DOUBLE) AS total_time,
  CASE WHEN s.si <> 1 THEN CAST(m.mi AS DOUBLE) + CAST(s.si AS DOUBLE) / CAST(4 AS DOUBLE) END AS run_avg_time
"""

_GEN_COLS = """SELECT s.setup, m.model, d.doc_id AS problem_id,
  (d.doc_id * 7 + m.mi + s.si) % 10 <> 0 AS api_success,""" + _GEN_OUTPUT

_MODELS_VALUES = ", ".join(f"({i}, '{n}')" for i, n in MODELS)
_SETUPS_VALUES = ", ".join(f"({i}, '{n}')" for i, n in SETUPS)

# Oracle form, as given in the fixtures document.
VIEW_SQL["generations"] = _GEN_COLS + f"""
FROM documents d
CROSS JOIN (VALUES {_MODELS_VALUES}) AS m(mi, model)
CROSS JOIN (VALUES {_SETUPS_VALUES}) AS s(si, setup)
"""

# Spark form: the fixed model and setup lists are literal arrays exploded per
# document (two generators, no join), so the struct aliases m / s keep the
# shared column SQL unchanged.
_M_ARRAY = ", ".join(f"named_struct('mi', {i}, 'model', '{n}')" for i, n in MODELS)
_S_ARRAY = ", ".join(f"named_struct('si', {i}, 'setup', '{n}')" for i, n in SETUPS)
_SPARK_GENERATIONS = _GEN_COLS + f"""
FROM documents d
LATERAL VIEW explode(array({_M_ARRAY})) mv AS m
LATERAL VIEW explode(array({_S_ARRAY})) sv AS s
"""

VIEW_SQL["test_results"] = """
SELECT CASE l_suppkey % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'avoid_for_loops' WHEN 2 THEN 'use_helper_functions' ELSE 'avoid_curly_braces' END AS setup,
  CASE l_partkey % 3 WHEN 0 THEN 'org-a/model-1b' WHEN 1 THEN 'org-b/model-4b' ELSE 'org-c/model-8b' END AS model,
  l_orderkey AS problem_id, l_linenumber AS test_case,
  l_returnflag <> 'R' AND l_quantity < 45 AS passed,
  l_quantity >= 45 AS timeout,
  l_quantity / CAST(10 AS DOUBLE) AS execution_time,
  l_partkey % 20 <> 0 AS execution_success
FROM lineitem
"""

VIEW_SQL["completions"] = """
SELECT o_custkey AS prompt_id, o_orderkey AS gen_id, CAST(o_orderkey % 90 AS STRING) AS answer,
  CASE o_orderkey % 10
    WHEN 0 THEN 'think<end_working_out><SOLUTION>' || CAST(o_orderkey % 90 AS STRING) || '</SOLUTION>'
    WHEN 1 THEN 'think<end_working_out><SOLUTION> ' || CAST(o_orderkey % 90 AS STRING) || chr(10) || '</SOLUTION>' || chr(10)
    WHEN 2 THEN 'x<end_working_out> y <SOLUTION>' || CAST(o_orderkey % 90 + 3 AS STRING) || '</SOLUTION>'
    WHEN 3 THEN 'The answer is ' || CAST(o_orderkey % 90 AS STRING)
    WHEN 4 THEN '<end_working_out>The answer is <SOLUTION>' || CAST(o_orderkey % 90 AS STRING)
    WHEN 5 THEN '<end_working_out><SOLUTION>no idea</SOLUTION>'
    WHEN 6 THEN '<end_working_out><SOLUTION>1,234</SOLUTION><SOLUTION>5</SOLUTION>'
    WHEN 7 THEN '<start_working_out>a<end_working_out><SOLUTION>costs $' || CAST(o_orderkey % 90 AS STRING) || '.50</SOLUTION>'
    WHEN 8 THEN '<end_working_out><SOLUTION>1d</SOLUTION>'
    ELSE '<start_working_out>' || o_orderpriority || '<end_working_out><SOLUTION>-.,</SOLUTION>' END AS completion
FROM orders
"""

VIEW_SQL["train_log"] = """
SELECT event_id AS step, CASE WHEN event_type IN ('signup', 'error') THEN 'sft' ELSE 'grpo' END AS phase,
  ts AS timestamp, value AS reward, value / CAST(100 AS DOUBLE) AS kl,
  CAST(user_id AS DOUBLE) AS completion_length,
  CASE WHEN event_type = 'error' THEN NULL ELSE value / CAST(7 AS DOUBLE) END AS loss
FROM events
"""

VIEW_SQL["output_pairs"] = """
SELECT p_partkey AS pair_id,
  CASE p_partkey % 10 WHEN 0 THEN p_name WHEN 1 THEN '[42]' WHEN 2 THEN '"abc"' WHEN 3 THEN '$1,000.00'
    WHEN 4 THEN '3.0' WHEN 5 THEN '[]' WHEN 6 THEN '1d' WHEN 7 THEN '€5' WHEN 8 THEN 'Yes' ELSE '[not, valid' || chr(10) || ' ]' END AS expected,
  CASE p_partkey % 10 WHEN 0 THEN ' ' || p_name || chr(10) WHEN 1 THEN '42' WHEN 2 THEN 'abc' WHEN 3 THEN '1000'
    WHEN 4 THEN '3' WHEN 5 THEN '' WHEN 6 THEN '1' WHEN 7 THEN '$5.0' WHEN 8 THEN 'yes' ELSE 'not, valid' END AS actual
FROM part
"""

_SPARK_SQL = dict(VIEW_SQL, generations=_SPARK_GENERATIONS)
# Base table behind each view (only that one is registered for the view's SQL).
VIEW_BASE = {"raw_problems": "documents", "problems": "documents", "generations": "documents",
             "test_results": "lineitem", "completions": "orders", "train_log": "events", "output_pairs": "part"}


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Register the given parquet tables as temp views named after the table."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view (or a base table) over the tables in ``sf_dir``."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    register_tables(spark, sf_dir, [VIEW_BASE[name]])
    return spark.sql(_SPARK_SQL[name])


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named stand-in views as CTEs (DuckDB oracle side)."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in names)
    return f"WITH {ctes}\n{body}"


__all__ = ["VIEW_SQL", "MODELS", "SETUPS", "view", "table", "with_views", "register_tables"]
