"""Code checks and test execution as Spark jobs.

* ``code_checks``: one Arrow-batched pandas UDF parses each *distinct* code
  once (``ast``) and returns syntax status, blocked imports and complexity
  counts together.
* ``run_tests``: distinct (code, input, expected) runs are spread over many
  partitions, twice: first with a short time limit, then those that need longer,
  dealt evenly, with the whole limit (slow or looping tests do not share a task).
  Test rows carry the hash of their code; each task gets each code it needs
  once.  A ``mapInPandas`` task converts the input, gates each code once (syntax,
  blocked imports), runs one child process per run under a wall-clock limit and
  CPU / address-space rlimits (optionally an output cap), normalises both
  outputs, and the results are joined back.  A failure inside a test becomes a row (error
  text, ``timeout``), never a failed job.

This limits damage from untrusted code; it is not a security sandbox.
"""

from __future__ import annotations

import ast
import os
import selectors
import subprocess
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.testcases import normalized_text, stdin_text, with_outputs_match
from ..functions.text import py_strip
from ..session import materialise
from .select import distributed_rank

# Modules the static import gate rejects.
DANGEROUS_MODULES = ("os", "sys", "subprocess", "shutil", "tempfile", "pathlib", "glob", "fnmatch",
                     "pickle", "marshal", "ctypes", "mmap", "signal", "threading", "multiprocessing")
# Builtins removed from the solution's namespace.
REMOVED_BUILTINS = ("eval", "exec", "compile", "open")

CHECK_SCHEMA = ("syntax_ok boolean, syntax_error string, blocked array<string>, "
                "n_functions int, n_loops int, n_ifs int")


def _check_one(code: str | None, deny: frozenset) -> dict:
    if code is None:
        return {"syntax_ok": None, "syntax_error": None, "blocked": None,
                "n_functions": None, "n_loops": None, "n_ifs": None}
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return {"syntax_ok": False, "syntax_error": f"Syntax error: {e}", "blocked": ["parse_error"],
                "n_functions": None, "n_loops": None, "n_ifs": None}
    except Exception as e:  # e.g. null bytes, recursion depth
        return {"syntax_ok": False, "syntax_error": f"Parse error: {e}", "blocked": ["parse_error"],
                "n_functions": None, "n_loops": None, "n_ifs": None}
    blocked, nf, nl, ni = [], 0, 0, 0
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            blocked += [a.name for a in node.names if a.name in deny]
        elif isinstance(node, ast.ImportFrom):
            if node.module in deny:
                blocked.append(node.module)
        elif isinstance(node, ast.FunctionDef):
            nf += 1
        elif isinstance(node, (ast.For, ast.While)):
            nl += 1
        elif isinstance(node, ast.If):
            ni += 1
    return {"syntax_ok": True, "syntax_error": None, "blocked": blocked,
            "n_functions": nf, "n_loops": nl, "n_ifs": ni}


def _make_check_udf(deny):
    deny = frozenset(deny)

    @F.pandas_udf(CHECK_SCHEMA)
    def check(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_check_one(c, deny) for c in codes])

    return check


def code_checks(df: DataFrame, code: str = "code", deny=DANGEROUS_MODULES) -> DataFrame:
    """Syntax, blocked imports and complexity for each distinct code.

    Returns ``(code_key, syntax_ok, syntax_error, blocked, n_functions, n_loops,
    n_ifs, complexity, safe)`` with ``code_key = sha2(code)``; join it back on
    the key.  Deduplication runs before the Python hop.
    """
    # No filter on the code column here: a predicate would be pushed below the
    # projection that derives the code and re-run its regexes; the UDF maps null to null.
    distinct = df.select(F.col(code).alias("_code")).dropDuplicates(["_code"])
    checked = distinct.select(F.sha2("_code", 256).alias("code_key"),
                              _make_check_udf(deny)(F.col("_code")).alias("c")).select("code_key", "c.*")
    return checked.withColumns({"complexity": complexity_score(), "safe": F.col("syntax_ok") & (F.size("blocked") == 0)})


def complexity_score() -> Column:
    """1.0 +0.5 (has functions) +0.5 (≤3 loops) +0.5 (≤5 ifs), at most 3; 0 when unparsable."""
    s = (F.lit(1.0) + F.when(F.col("n_functions") > 0, 0.5).otherwise(0.0)
         + F.when(F.col("n_loops") <= 3, 0.5).otherwise(0.0)
         + F.when(F.col("n_ifs") <= 5, 0.5).otherwise(0.0))
    return F.when(F.col("syntax_ok"), F.least(s, F.lit(3.0))).otherwise(F.lit(0.0))


# Child-process entry: reads "<len>\n<code><stdin bytes>" from stdin, applies the
# limits, removes the blocked builtins, and executes the solution as __main__.
_RUNNER = r"""
import builtins, io, sys
try:
    import resource
    _mem = int(sys.argv[1]) * 1024 * 1024
    if _mem > 0:
        resource.setrlimit(resource.RLIMIT_AS, (_mem, _mem))
    _cpu = int(sys.argv[2])
    resource.setrlimit(resource.RLIMIT_CPU, (_cpu, _cpu))
except Exception:
    pass
_data = sys.stdin.buffer.read()
_nl = _data.index(b"\n")
_n = int(_data[:_nl])
_code = _data[_nl + 1:_nl + 1 + _n].decode("utf-8")
sys.stdin = io.TextIOWrapper(io.BytesIO(_data[_nl + 1 + _n:]), encoding="utf-8")
_deny = set(filter(None, sys.argv[3].split(",")))
_removed = set(filter(None, sys.argv[4].split(",")))
_real_import = builtins.__import__
def _guarded(name, globals=None, locals=None, fromlist=(), level=0):
    if globals is not None and globals.get("__name__") == "__main__" and (name in _deny or "*" in _deny):
        raise ImportError("import of " + name + " is blocked")
    return _real_import(name, globals, locals, fromlist, level)
_safe = {k: getattr(builtins, k) for k in dir(builtins) if k not in _removed}
_safe["__import__"] = _guarded
_compiled = compile(_code, "<solution>", "exec")
exec(_compiled, {"__builtins__": _safe, "__name__": "__main__", "sys": sys, "StringIO": io.StringIO})
"""

def _run_child(args: list[str], payload: bytes, timeout_s: float, max_bytes: int | None):
    """Run one child with a wall-clock deadline and an optional cap on captured output.

    Returns (stdout, stderr, returncode, timed_out, truncated).  The child is
    killed when the deadline passes or, with a cap, either stream exceeds it.
    """
    p = subprocess.Popen(args, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env={})

    def feed() -> None:
        try:
            p.stdin.write(payload)
            p.stdin.close()
        except OSError:  # the child exited or closed its stdin
            pass

    threading.Thread(target=feed, daemon=True).start()
    sel = selectors.DefaultSelector()
    sel.register(p.stdout, selectors.EVENT_READ, 0)
    sel.register(p.stderr, selectors.EVENT_READ, 1)
    bufs, open_streams = (bytearray(), bytearray()), 2
    deadline = time.monotonic() + timeout_s
    timed_out = truncated = False
    try:
        while open_streams and not truncated:
            remaining = deadline - time.monotonic()
            if remaining <= 0:
                timed_out = True
                break
            for key, _ in sel.select(timeout=remaining):
                chunk = os.read(key.fileobj.fileno(), 65536)
                if not chunk:
                    sel.unregister(key.fileobj)
                    open_streams -= 1
                    continue
                buf = bufs[key.data]
                buf.extend(chunk)
                truncated = truncated or (max_bytes is not None and len(buf) > max_bytes)
        if not (timed_out or truncated):
            try:
                p.wait(timeout=max(0.0, deadline - time.monotonic()))
            except subprocess.TimeoutExpired:
                timed_out = True
    finally:
        if p.poll() is None:
            p.kill()
        p.wait()
        sel.close()
        p.stdout.close()
        p.stderr.close()
    return bytes(bufs[0]), bytes(bufs[1]), p.returncode, timed_out, truncated


RUN_SCHEMA = ("run_key string, safe boolean, converted_input string, actual_output string, stderr string, "
              "returncode int, elapsed double, timed_out boolean, norm_expected string, norm_actual string, unfinished boolean")
RUN_COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
SLICE_ROWS, SLICE_BYTES = 64, 8 << 20  # results handed on at a time
FEW_RUNS = 10_000  # so many keys are numbered in one task


def _gate_error(check: dict) -> str | None:
    """Why a code must not run: its syntax error, or the blocked imports; None if it may."""
    if not check["syntax_ok"]:
        return check["syntax_error"]
    return f"Blocked imports: {', '.join(check['blocked'])}" if check["blocked"] else None


def _changed(text: str | None) -> str | None:
    """The normalised text where it differs from the stripped one (only bracketed values do)."""
    norm = normalized_text(text)
    return norm if norm != text else None


def _run_batches(timeout_s: float, full_s: float, mem_mb: int, deny: tuple, removed: tuple, gate: bool = True,
                 site_packages: bool = False, max_output: int | None = None, in_flight: int = 2):
    """Task function over rows (code_key, kind, run_key, code, input, expected) sorted by code_key and kind.

    A code's own row (kind 0) comes before its runs (kind 1).  A run that is
    stopped at ``timeout_s``, short of the whole limit ``full_s``, is unfinished.
    """
    # -I: isolated (no user site, no PYTHON* variables); -S: no site import, which
    # cuts interpreter start-up several-fold; the standard library stays importable.
    flags = ["-I"] if site_packages else ["-I", "-S"]
    deny_set, deny_arg, removed_arg = frozenset(deny), ",".join(deny), ",".join(removed)

    def one(key: str, code: str, error: str | None, raw_in: str | None, exp: str | None) -> tuple:
        stdin = stdin_text(raw_in) or ""
        norm_exp = _changed((exp or "").strip())
        if error is not None:
            return key, False, stdin, "", error, None, 0.0, False, norm_exp, None, False
        code_b = code.encode("utf-8")
        payload = str(len(code_b)).encode() + b"\n" + code_b + stdin.encode("utf-8")
        start = time.monotonic()
        try:
            out_b, err_b, rc, timed_out, truncated = _run_child(
                [sys.executable, *flags, "-c", _RUNNER, str(mem_mb), str(int(full_s) + 1),
                 deny_arg, removed_arg], payload, timeout_s, max_output)
        except Exception as e:  # launching failed: still a row
            return key, True, stdin, "", f"Execution failed: {e}", -1, time.monotonic() - start, False, norm_exp, None, False
        elapsed = time.monotonic() - start
        if timed_out:
            return key, True, stdin, "", f"Execution timed out after {timeout_s} seconds", -1, elapsed, True, norm_exp, None, timeout_s < full_s
        if truncated:
            return key, True, stdin, "", f"Output exceeded {max_output} bytes", -1, elapsed, False, norm_exp, None, False
        actual = out_b.decode("utf-8", "replace").strip() if rc == 0 else ""
        return key, True, stdin, actual, err_b.decode("utf-8", "replace"), rc, elapsed, False, norm_exp, _changed(actual), False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, error = "", None  # the code whose runs come next, and why it must not run

        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for pdf in batches:
                rows, size = [], 0
                for at in range(0, len(pdf), SLICE_ROWS):
                    part, jobs = pdf.iloc[at:at + SLICE_ROWS], []
                    for kind, key, text, raw_in, exp in zip(part["kind"], part["run_key"], part["code"], part["input"], part["expected"]):
                        if kind == 0:
                            code = text or ""
                            error = _gate_error(_check_one(code, deny_set)) if gate else None
                        else:
                            jobs.append(pool.submit(one, key, code, error, raw_in, exp))
                    for job in jobs:
                        row = job.result()
                        rows.append(row)
                        size += len(row[3]) + len(row[4])
                        if size >= SLICE_BYTES:
                            yield pd.DataFrame(rows, columns=RUN_COLUMNS)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=RUN_COLUMNS)
                        rows, size = [], 0
    return run


def _dealt(runs: DataFrame, codes: DataFrame, tasks: int) -> DataFrame:
    """``runs`` (with a task number ``slot``) and each task's codes, in the order ``_run_batches`` reads.

    A code travels once to each task that runs it; runs travel without code.
    """
    null = F.lit(None).cast("string")
    needed = runs.select("slot", "code_key").distinct().join(codes, "code_key")
    rows = needed.select("slot", "code_key", F.lit(0).alias("kind"), null.alias("run_key"), "code", null.alias("input"), null.alias("expected")).unionByName(
        runs.select("slot", "code_key", F.lit(1).alias("kind"), "run_key", null.alias("code"), "input", "expected"))
    # Task numbers are taken as they are: a few long-running rows must not be folded into one task.
    return rows.repartitionById(tasks, F.col("slot")).sortWithinPartitions("code_key", "kind", "run_key").drop("slot")


def run_tests(tests: DataFrame, code: str = "code", test_input: str = "input",
              expected: str = "output", timeout_s: float = 10.0, mem_mb: int = 512,
              partitions: int | None = None, deny=DANGEROUS_MODULES,
              removed=REMOVED_BUILTINS, gate: bool = True, site_packages: bool = False,
              strict_imports: bool = False, max_output: int | None = None, in_flight: int = 2,
              codes: DataFrame | None = None, short_s: float | None = None) -> DataFrame:
    """Run every (code, test) row and compare its output with the expected one.

    ``tests`` has one row per test (see ``functions.testcases.test_cases``), with
    its code or, where ``codes`` (code_key, code) is given, with the code's key.
    The test table is read several times (distinct runs, join back), so it is
    written once as a Parquet table in the shared folder instead of recomputing
    its lineage per reader.

    Distinct (code, input, expected) runs go over ``partitions`` tasks with a limit of
    ``short_s`` (a twentieth of ``timeout_s``, a quarter of a second at least).  Runs that
    need longer are few as a rule; they are dealt one by one, to every core first and
    then up to twice ``in_flight`` at a time, and get the whole limit.  So no task waits
    for many slow or looping runs while others are done, and a slow run costs a twentieth more.  Each task converts the
    input to stdin, gates each code once (syntax, blocked imports — failing code
    never runs), executes the rest in child processes and normalises both
    outputs.  The comparison rule itself stays a native expression.

    Adds ``converted_input, actual_output, passed, exact_match, execution_time,
    error, timeout, execution_success``.  ``site_packages`` makes installed
    third-party packages importable by the solutions (slower start-up);
    ``strict_imports`` refuses every import made by the solution at run time;
    ``max_output`` stops a solution that writes more bytes than that to a stream
    (no limit by default: output is read to its end); ``in_flight`` children run
    at a time in a task.  ``error`` of code that may not run names its syntax
    error or blocked imports.
    """
    spark = tests.sparkSession
    exp_text = F.coalesce(F.col(expected).cast("string"), F.lit(""))
    if codes is None:
        tests = tests.withColumn("code_key", F.sha2(F.coalesce(F.col(code), F.lit("")), 256))
    # JSON keeps field borders and nulls apart, so different runs never share a key.
    key = F.sha2(F.to_json(F.struct(F.col("code_key").alias("c"), F.col(test_input).alias("i"), exp_text.alias("e"))), 256)
    prepared = materialise(tests.withColumn("run_key", key), "tests")
    if codes is None:
        codes = prepared.select("code_key", F.col(code).alias("code")).dropDuplicates(["code_key"])
    runs = prepared.select("run_key", "code_key", F.col(test_input).alias("input"), exp_text.alias("expected")).dropDuplicates(["run_key"])
    n = partitions or max(8, spark.sparkContext.defaultParallelism * 4)
    limits = (mem_mb, ("*", *deny) if strict_imports else tuple(deny), tuple(removed), gate, site_packages, max_output, in_flight)
    short = min(timeout_s, max(0.25, timeout_s / 20) if short_s is None else short_s)
    first = _dealt(runs.withColumn("slot", F.pmod(F.xxhash64("run_key"), F.lit(n)).cast("int")), codes, n)
    done = materialise(first.mapInPandas(_run_batches(short, timeout_s, *limits), RUN_SCHEMA), "runs")
    # The rest, numbered through and dealt in turn.
    rest = runs.join(done.filter("unfinished").select("run_key"), "run_key", "left_semi")
    n_rest = done.filter("unfinished").count()
    at_once = 2 * in_flight
    tasks = max(1, min(n_rest, spark.sparkContext.defaultParallelism), min(-(-n_rest // at_once), 100_000))
    if n_rest <= FEW_RUNS:
        rest = rest.withColumn("rank", F.row_number().over(Window.orderBy("run_key")))
    else:
        rest = distributed_rank(rest, [], [F.col("run_key")], partitions=1 + n_rest // FEW_RUNS)
    rest = rest.withColumn("slot", (F.col("rank") % tasks).cast("int"))
    long = _dealt(rest, codes, tasks).mapInPandas(_run_batches(timeout_s, timeout_s, *limits[:-1], at_once), RUN_SCHEMA)
    out = prepared.join(done.filter("NOT unfinished").union(long).drop("unfinished"), on="run_key", how="left")
    ok = (F.col("returncode") == 0) & ~F.col("timed_out")
    out = out.withColumns({"actual_output": F.coalesce("actual_output", F.lit("")), "_ok": F.coalesce(ok, F.lit(False)),
                           "norm_expected": F.coalesce("norm_expected", py_strip(exp_text)),
                           "norm_actual": F.coalesce("norm_actual", "actual_output")})
    out = with_outputs_match(out, "norm_expected", "norm_actual", "_match", normalized=True)
    return (out.withColumns({"passed": F.col("_ok") & F.coalesce(F.col("_match"), F.lit(False)),
                             # exit code 0 and exact equality of the stripped texts (execution reward rule)
                             "exact_match": F.col("_ok") & F.coalesce(
                                 F.col("actual_output") == py_strip(F.col(expected).cast("string")), F.lit(False)),
                             "execution_time": F.coalesce(F.col("elapsed"), F.lit(0.0)),
                             "timeout": F.coalesce(F.col("timed_out"), F.lit(False)),
                             "execution_success": F.coalesce(F.col("safe"), F.lit(False)),
                             "error": F.coalesce(F.col("stderr"), F.lit(""))})
               .drop("stderr", "elapsed", "timed_out", "returncode", "safe", "_ok", "_match",
                     "norm_expected", "norm_actual", "run_key"))


def run_gated(tests: DataFrame, code: str = "code", **kw) -> DataFrame:
    """``run_tests`` with the syntax / import gate (the default)."""
    return run_tests(tests, code=code, gate=True, **kw)


def execution_result(results: DataFrame, keys=("setup", "model", "problem_id")) -> DataFrame:
    """Per generation: passed / failed / total, pass rate, timeouts, total time.

    Code that failed a gate (``execution_success`` false) reports the number of
    tests as total with passed = failed = 0; ``execution_error`` (when the
    results carry error texts) says why it was not run.
    """
    why = ([F.max(F.when(~F.col("execution_success"), F.col("error"))).alias("execution_error")]
           if "error" in results.columns else [])
    agg = results.groupBy(*keys).agg(
        F.bool_and("execution_success").alias("execution_success"), *why,
        F.count("*").alias("total_count"),
        F.count_if(F.col("passed") & ~F.col("timeout")).alias("_passed"),
        F.count_if("timeout").alias("_timeouts"),
        F.sum("execution_time").alias("_time"))
    ok = F.col("execution_success")
    return agg.select(
        *keys, "execution_success", "total_count",
        F.when(ok, F.col("_passed")).otherwise(F.lit(0)).cast("long").alias("passed_count"),
        F.when(ok, F.col("total_count") - F.col("_passed")).otherwise(F.lit(0)).cast("long").alias("failed_count"),
        F.when(ok, F.col("_passed") / F.col("total_count")).otherwise(F.lit(0.0)).alias("pass_rate"),
        F.when(ok, F.col("_timeouts")).otherwise(F.lit(0)).cast("long").alias("timeout_count"),
        F.when(ok, F.col("_time")).otherwise(F.lit(0.0)).alias("total_execution_time"),
        *[c for c in ["execution_error"] if why])


def ordered_results(results: DataFrame, keys=("setup", "model", "problem_id"), test: str = "test_case") -> DataFrame:
    """Test results in test order per generation (a range-partitioned sort, no collect)."""
    return results.orderBy(*keys, test)


def result_lists(results: DataFrame, keys=("setup", "model", "problem_id"), test: str = "test_case", max_bytes: int = 1 << 20) -> DataFrame:
    """Per generation the ordered list of its test results, in chunks of at most ``max_bytes`` of texts (one result at least).

    (keys, chunk from 0, execution_success, execution_error, results: test_case,
    passed, timeout, input, expected output, actual output, error, time).  Code that failed the gate has one empty
    chunk and the gate's reason.  A list never grows with the number of tests.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("input", "output", "actual_output", "error")), F.lit(64))
    # A problem's tests came from one row, so the rows of a key are as many as a row could hold.
    before = Window.partitionBy(*keys).orderBy(test).rowsBetween(Window.unboundedPreceding, -1)
    placed = results.withColumn("chunk", F.when(F.col("execution_success"), F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / max_bytes)).otherwise(0).cast("int"))
    row = F.struct(F.col(test), "passed", "timeout", "input", F.col("output").alias("expected"), "actual_output", "error", "execution_time")
    return placed.groupBy(*keys, "chunk").agg(
        F.bool_and("execution_success").alias("execution_success"), F.max(F.when(~F.col("execution_success"), F.col("error"))).alias("execution_error"),
        F.sort_array(F.collect_list(F.when(F.col("execution_success"), row))).alias("results"))


def r_exec(completions: DataFrame, results: DataFrame, keys=("setup", "model", "problem_id"), has_code: str = "code_found",
           passed: str = "passed") -> DataFrame:
    """Execution reward of every completion: −3 without code, else 5 × passed / total (0 without tests).

    ``completions`` has the keys and the flag ``has_code``; code that failed the
    syntax or import gate passed nothing and scores 0.  With ``run_tests`` output
    pass ``passed="exact_match"`` for the reward's own rule (exit code 0 and exact
    stripped equality).
    """
    agg = results.groupBy(*keys).agg(F.count_if(F.col(passed) & F.col("execution_success")).alias("passed"), F.count("*").alias("total"))
    out = completions.select(*keys, F.coalesce(F.col(has_code), F.lit(False)).alias("has_code")).join(agg, list(keys), "left")
    return out.withColumn("reward_exec", F.when(~F.col("has_code"), F.lit(-3.0))
                          .otherwise(F.coalesce(F.lit(5.0) * F.col("passed") / F.col("total"), F.lit(0.0))))


def execution_profile(results: DataFrame, by=("model",), problem=("setup", "problem_id")) -> DataFrame:
    """Tests per problem and execution time per problem, per model; estimate × models."""
    per_problem = results.groupBy(*by, *problem).agg(F.count("*").alias("_tests"),
                                                    F.sum("execution_time").alias("_time"))
    per_model = per_problem.groupBy(*by).agg(
        F.count("*").alias("problems"),
        F.min("_tests").alias("tests_min"), F.max("_tests").alias("tests_max"), F.avg("_tests").alias("tests_avg"),
        F.sum("_time").alias("time_total"), F.avg("_time").alias("time_avg"),
        F.min("_time").alias("time_min"), F.max("_time").alias("time_max"))
    # estimate for running every model: one model's total × number of models
    # (the window runs over the per-model result: one row per model)
    return per_model.withColumn("estimated_total_all_models",
                                F.col("time_total") * F.count("*").over(Window.partitionBy()))
