"""Conversation prefix trie: running totals, sketch and every node against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.llm import prefix_trie as P
from scorelab.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, d long, k1 string, owner string, conv string, last int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(7)


def turn_hash(role, text):
    r, t = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + t).digest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_hash(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path) == d))
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * len(path[-1][1].encode() if path else b"")
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, last in who if last))
        out.append((min(c for c, _ in who), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(who), len(children.get(path, [])),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(spark, rows, **params):
    res = P.trie(spark, table(spark, rows), **params)
    assert [res.schema[c].dataType.simpleString() for c in COLS] == ["bigint"] * 7 + ["string"]
    return sorted([tuple(r[c] for c in COLS) for r in res.collect()], key=repr)


def messy_conversations():
    rng = random.Random(4)
    rows = []
    for c in range(-7, 160):
        n = rng.choice([0, 1, 2, 3, 5, 9, 12])
        kind = c % 3
        for t in range(n):
            role = rng.choice(["user", "assistant", None]) if kind else "user"
            text = f"same {t}" if kind == 0 else rng.choice(["a", "", None, "é" * 3, f"t{c}"])
            rows.append((c, t if rng.random() < .9 else None, role, text))
    rows += [(40, 3, "user", "twice"), (40, 3, "user", "twice"), (40, 3, "user", "tie"), (None, 1, "user", "no id"), (161, None, None, None), (10 ** 12, 0, "user", "far")]
    return rows


@pytest.mark.parametrize("params", [{}, {"max_cells": 1 << 4}])
def test_trie_against_brute_force(spark, params):
    """With a full sketch next to nothing is screened and the nodes stay the same."""
    rows = messy_conversations()
    assert got(spark, rows, **params) == brute(rows)


def test_long_and_equal_conversations(spark, monkeypatch):
    """A hot conversation and hot prefixes, ends in several pieces."""
    monkeypatch.setattr(P, "PIECE_BYTES", 200)
    rows = [(5 * c, t, "user", f"q{t}") for c in range(1300) for t in range(9)]
    rows += [(3, t, "user", f"long {t}") for t in range(6000)] + [(4, t, "user", f"long {t}") for t in range(6000)]
    rows += [(5 * c, 9, "user", f"end {c % 70}") for c in range(1300)]
    assert got(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    one = [(7, 0, "user", "x"), (7, 1, None, None)]
    assert got(spark, one) == brute(one)


def test_singletons_are_proved_by_the_sketch(spark):
    rows = [(5 * c, t, "user", f"{c} {t}") for c in range(300) for t in range(12)]
    res = P.trie(spark, table(spark, rows))
    assert res.filter("screened").count() > 0.9 * res.count()


def test_running_totals_across_partitions(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).cast("long").alias("k"), F.col("id").alias("o"),
                                  F.xxhash64("id").alias("x"), (F.col("id") % 11).alias("v"))
    with Scratch(spark) as scratch:
        out = P.running(df, scratch, "k", [F.col("o")], {"s": ("v", "sum"), "h": ("x", "xor")}).collect()
    want, seen = {}, {}
    for r in sorted(out, key=lambda r: (r.k, r.o)):
        s, h = seen.get(r.k, (0, 0))
        seen[r.k] = want[r.o] = (s + r.v, h ^ r.x)
    assert len(out) == 5000 and all(want[r.o] == (r.s, r.h) for r in out)


def test_sketch_never_counts_too_low(spark):
    df = spark.range(20_000).select(F.xxhash64(F.col("id") % 6000).alias("k1"), F.xxhash64(F.col("id") % 6000, F.lit(1)).alias("k2"))
    sketch = P.count_min(df, 12)
    rows = df.toPandas()
    k1, k2 = rows.k1.to_numpy(), rows.k2.to_numpy()
    guess = np.minimum(*[row[at] for row, at in zip(sketch, P.cells(k1, k2, 12))])
    true = rows.groupby(["k1", "k2"]).k1.transform("size").to_numpy()
    assert (guess >= np.minimum(true, 255)).all()
