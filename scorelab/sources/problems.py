"""Problem-set sources and sinks.

Raw problems carry JSON text columns; they are parsed with ``from_json``
(PERMISSIVE: malformed text → null → empty list) and typed with an explicit
schema, never inferred.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import col, py_strip



def _empty() -> Column:
    return F.array().cast("array<string>")

IO_SCHEMA = "inputs array<string>, outputs array<string>"
CLEAN_COLUMNS = ["problem_id", "question", "difficulty", "solutions", "inputs", "outputs",
                 "starter_code", "n_test_cases", "n_solutions", "original_split"]


def _python_text(x: str) -> str:
    v = json.loads(x)
    return v if isinstance(v, str) else str(v)


@F.pandas_udf(ArrayType(StringType()))
def _python_spelling(s: pd.Series) -> pd.Series:
    return s.map(lambda arr: None if arr is None else [None if x is None else _python_text(x) for x in arr])


def _spelled(elems: Column) -> Column:
    """JSON texts of list elements as Python's ``str()`` of the decoded values.

    Strings, numbers, constants and lists of numbers and constants are spelled
    natively; only lists that hold strings and objects go to one Arrow-batched
    pandas function (null for every other row).  A number written with an
    exponent is spelled as JSON parsing leaves it (1e5: 100000).
    """
    def native(e: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(F.regexp_replace(e, "true", "True"), "false", "False"), "null", "None")
        return F.when(e.startswith('"'), F.from_json(F.concat(F.lit("["), e, F.lit("]")), "array<string>")[0]).otherwise(
            F.regexp_replace(words, ",", ", "))
    odd = F.exists(elems, lambda e: ~e.startswith('"') & e.rlike(r'["{}]|[0-9][eE]'))
    return F.when(odd, _python_spelling(F.when(odd, elems))).otherwise(F.transform(elems, native))


def _test_values(io_json: Column, field: str) -> Column:
    """A test list as JSON texts of its elements: null → [], scalar → [x], list → list."""
    j = py_strip(json_field(io_json, field))
    whole = F.when(j.startswith("["), j).otherwise(F.concat(F.lit("["), j, F.lit("]")))
    elems = F.transform(F.from_json(whole, "array<variant>"), lambda e: F.coalesce(F.to_json(e), F.lit("null")))
    return F.when(j.isNull() | (j == "null"), _empty()).otherwise(F.coalesce(elems, _empty()))


def clean_problems(raw: DataFrame, python_spelling: bool = True) -> DataFrame:
    """Parse solutions and tests, keep problems with ≥1 input and ≥1 output, derive counts.

    A test list that is a single value counts as a list of one.  Test values
    that are not strings take Python's ``str()`` spelling (``[1, 2]``, ``True``,
    ``None``), as programs print them; without ``python_spelling`` they keep
    their compact JSON text (``[1,2]``, ``true``).
    """
    sols = F.coalesce(F.from_json(F.col("solutions"), "array<string>"), _empty())
    io = F.col("input_output")
    out = raw.select(
        "problem_id", "question", F.coalesce(F.col("difficulty"), F.lit("unknown")).alias("difficulty"),
        sols.alias("solutions"), *[_test_values(io, f).alias(f"_{f}") for f in ("inputs", "outputs")],
        F.coalesce(F.col("starter_code"), F.lit("")).alias("starter_code"), "original_split")
    out = out.filter((F.size("_inputs") > 0) & (F.size("_outputs") > 0))
    text = _spelled if python_spelling else lambda e: F.transform(e, lambda x: F.when(
        x.startswith('"'), F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0]).otherwise(x))
    return out.withColumns({"n_test_cases": F.size("_inputs"), "n_solutions": F.size("solutions"),
                            "inputs": text(F.col("_inputs")), "outputs": text(F.col("_outputs"))}).select(*CLEAN_COLUMNS)


def json_field(json_text, field: str) -> Column:
    """JSON text of one field of a JSON object column (null when absent or unparsable)."""
    v = F.try_parse_json(col(json_text))
    return F.to_json(F.try_variant_get(v, f"$.{field}", "variant"))


def listify(json_text) -> Column:
    """null → [], scalar → [x], list → list; every element as text."""
    j = col(json_text)
    s = py_strip(j)
    return (F.when(j.isNull() | (s == "null"), _empty())
             .when(s.startswith("["), F.coalesce(F.from_json(s, "array<string>"), _empty()))
             .otherwise(F.coalesce(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), _empty())))


def _nonstring_elements(json_text) -> Column:
    arr = F.from_json(col(json_text), "array<variant>")
    return F.exists(arr, lambda e: F.schema_of_variant(e) != "STRING")


def type_diagnostics(raw: DataFrame, json_col: str = "input_output",
                     fields=("inputs", "outputs")) -> DataFrame:
    """Per field: rows, null/absent, present but not a list, lists with non-string elements."""
    aggs = []
    for f in fields:
        j = json_field(json_col, f)
        is_list = py_strip(j).startswith("[")
        aggs += [F.count_if(j.isNull() | (j == "null")).alias(f"{f}_null"),
                 F.count_if(j.isNotNull() & (j != "null") & ~is_list).alias(f"{f}_nonlist"),
                 F.count_if(is_list & _nonstring_elements(j)).alias(f"{f}_nonstring")]
    one = raw.agg(F.count("*").alias("n_rows"), *aggs)
    return one.select("n_rows", F.stack(F.lit(len(fields)), *[x for f in fields for x in (
        F.lit(f), F.col(f"{f}_null"), F.col(f"{f}_nonlist"), F.col(f"{f}_nonstring"))])
        .alias("field", "n_null", "n_nonlist", "n_nonstring"))


def offenders(raw: DataFrame, n: int = 10, json_col: str = "input_output", fields=("inputs", "outputs"),
              key: str = "problem_id") -> DataFrame:
    """First ``n`` rows (by key) whose test lists hold a non-string element."""
    bad = F.lit(False)
    for f in fields:
        j = json_field(json_col, f)
        bad = bad | F.coalesce(py_strip(j).startswith("[") & _nonstring_elements(j), F.lit(False))
    return (raw.filter(bad).select(key, *[json_field(json_col, f).alias(f) for f in fields])
               .orderBy(key).limit(n))


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> str:
    """One Parquet folder per split (empty splits simply produce no folder)."""
    df.write.mode(mode).partitionBy(split).parquet(path)
    return path


SPLITS = ("train", "eval", "test")


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split (partition-pruned read) or ``all`` = the union of all splits."""
    df = spark.read.parquet(path)
    if split == "all":
        return df
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS} or 'all', got {split!r}")
    return df.filter(F.col("split") == split)


def union_splits(parts: dict[str, DataFrame], origin: str = "original_split") -> DataFrame:
    """Concatenate named parts, recording where each row came from."""
    out = None
    for name, df in parts.items():
        d = df.withColumn(origin, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
