"""Result fingerprints for comparing a Spark result with its oracle.

Row count, sorted column names, and an order-insensitive hash of the values
(floats at 5 places, NaN / None / NaT unified, integers as floats).
"""

from __future__ import annotations

import hashlib
import math


def norm(v) -> str:
    if v is None:
        return "∅"
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, (list, tuple, dict, str, bytes)) and pd.isna(v) is True):
            return "∅"
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return f"{round(v, 5):.5f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.5f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def fingerprint(pdf):
    """(sorted columns, row count, short hash, sorted normalised rows)."""
    cols = sorted(pdf.columns)
    rows = sorted("\x1f".join(norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records"))
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16], rows
