"""Joins.

No join here broadcasts a side whose size grows with the data: the problem
table may be large, so ``attach_problems`` is a plain equi-join and AQE turns
it into a broadcast only when the *measured* side is below the threshold.
Only fixed, parameter-sized lists (a model order) are broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_problems(gens: DataFrame, problems: DataFrame, key: str = "problem_id",
                    cols=("inputs", "outputs", "n_test_cases")) -> DataFrame:
    """Attach each problem's tests to every output; unmatched outputs keep zero tests."""
    p = problems.select(key, *cols, F.lit(True).alias("_found"))
    out = gens.join(p, on=key, how="left")
    fills = {"problem_found": F.coalesce(F.col("_found"), F.lit(False))}
    for c in cols:
        dt = problems.schema[c].dataType
        if dt.typeName() == "array":
            fills[c] = F.coalesce(F.col(c), F.array().cast(dt))
        elif dt.typeName() in ("integer", "long"):
            fills[c] = F.coalesce(F.col(c), F.lit(0).cast(dt))
    return out.withColumns(fills).drop("_found")


def align(benign: DataFrame, malign: DataFrame, key: str = "model") -> DataFrame:
    """Models present in both setups (inner join on the model)."""
    b = benign.select([F.col(c).alias(f"benign_{c}") if c != key else F.col(c) for c in benign.columns])
    m = malign.select([F.col(c).alias(f"malign_{c}") if c != key else F.col(c) for c in malign.columns])
    return b.join(m, on=key, how="inner")


def attach_metrics(summary: DataFrame, *metrics: DataFrame, keys=("setup", "model")) -> DataFrame:
    """Add computed metric tables to the summary (left joins on the run keys)."""
    out = summary
    for m in metrics:
        out = out.join(m, on=list(keys), how="left")
    return out


def in_order(df: DataFrame, order: list[str], key: str = "model", required=()) -> DataFrame:
    """Keep rows of the listed models, order by the list, drop rows missing a required value."""
    spark = df.sparkSession
    pos = spark.createDataFrame([(m, i) for i, m in enumerate(order)], f"{key} string, pos int")
    out = df.join(F.broadcast(pos), on=key, how="inner")  # the order list is a fixed parameter
    if required:
        out = out.dropna(subset=list(required))
    return out.orderBy("pos", *[c for c in df.columns if c != key])
