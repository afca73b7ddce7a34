"""Filter interaction audit by truth-table survival words.

Five filters make 32 subsets.  Subset ``S`` is the number whose bit ``f`` says
that filter ``f`` is in it, and a document survives ``S`` if it fails none of its
filters.  Every document becomes one 32-bit word whose bit ``S`` says that it
survives ``S``: all ones, less the fixed column of each filter it fails.  The sums
of each of the 32 bits over many words (positional popcounts) say how many
documents survive every subset, and from these follows what any filter order
keeps and removes at every step, with no further look at a document.

Words are counted in the tasks by carry-save addition: three words of one weight
become a sum word and a carry word of twice the weight, until two at most are
left of each weight.  A task hands on 32 counts per (part, label class); Spark
adds them up.  A part of any size is one row per task.

Defined results: a null text is an empty one; a document without any smaller id
of the same text (a null id, or the smallest id itself, repeated or not) is no
repeat; a null part is the empty string; a document counts as good or toxic if
any label row of its id says so; repeated rows count each; texts of any length
are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, Scratch, checked_broadcast, join_hot

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Bit S of HOLDS[f]: subset S holds filter f.
HOLDS = [sum(1 << s for s in range(SUBSETS) if s >> f & 1) for f in range(len(FILTERS))]
#: Label classes are bit sets.
GOOD, TOXIC = 1, 2
#: A task hands on its counts when it has so many (part, class) keys.
MAX_KEYS = 10_000


def text_failures(text: Column) -> list[Column]:
    """Failure of filters A to D (``text`` is not null)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, UPPER, ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def survival_word(fails: list[Column]) -> Column:
    """The word of a document (long, 32 bits used) from its failures, one of each filter."""
    word = F.lit((1 << SUBSETS) - 1).cast("long")
    for f, failed in enumerate(fails):
        word = word.bitwiseAND(F.when(failed, F.lit((1 << SUBSETS) - 1 - HOLDS[f])).otherwise(F.lit((1 << SUBSETS) - 1)).cast("long"))
    return word


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (uint32) have each bit: carry-save adders, then at most two words per weight."""
    total, weight, level = np.zeros(SUBSETS, np.int64), 1, words
    at = np.arange(SUBSETS, dtype=np.uint32)
    while level.size:
        carries = []
        while level.size > 2:
            third = level.size // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third:]])
        for word in level:
            total += weight * (word >> at & np.uint32(1)).astype(np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 counts per (part, class) of this task's (part, class, word) rows."""
    seen: dict[tuple, np.ndarray] = {}

    def out():
        return pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in seen], pa.string()), "class": pa.array([c for _, c in seen], pa.int32()),
            "counts": pa.array([list(v) for v in seen.values()], pa.list_(pa.int64()))})

    for batch in batches:
        code, names = pd.factorize(batch.column("part").to_pandas())
        key = code.astype(np.int64) * 4 + batch.column("class").to_numpy()
        words = batch.column("word").to_numpy().astype(np.uint32)
        by = np.argsort(key, kind="stable")
        keys, first = np.unique(key[by], return_index=True)
        for k, group in zip(keys, np.split(words[by], first[1:])):
            name = (names[k // 4], int(k % 4))
            got = positional_popcount(group)
            seen[name] = seen[name] + got if name in seen else got
        if len(seen) > MAX_KEYS:
            yield out()
            seen.clear()
    if seen:
        yield out()


def subset_survivors(words: DataFrame) -> DataFrame:
    """(part, survivors, good, toxic): per part three arrays over the 32 subsets, from (part, class, word) rows."""
    counts = words.mapInArrow(_count, "part string, class int, counts array<bigint>")
    each = counts.select("part", "class", F.posexplode("counts").alias("s", "n"))
    summed = each.groupBy("part", "s").agg(*[F.sum(F.when(F.col("class").bitwiseAND(F.lit(bit)) == bit, F.col("n")).otherwise(0)).alias(name)
                                             for name, bit in (("n", 0), ("good", GOOD), ("toxic", TOXIC))])
    # One part has 32 rows here, however many documents it has.
    rows = summed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("r"))
    return rows.select("part", F.col("r.n").alias("survivors"), F.col("r.good").alias("good"), F.col("r.toxic").alias("toxic"))


def filter_steps() -> list[dict]:
    """Every step of every order: its filter and the subsets applied before and after it."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            steps.append({"o": "".join(FILTERS[g] for g in order), "step": i + 1, "f": f, "b": before, "a": before | 1 << f})
            before |= 1 << f
    return steps


def shapley(f: int) -> Column:
    """What filter ``f`` removes, summed over all orders: each subset before it in as many orders as place it so."""
    n, parts = len(FILTERS), []
    for s in range(SUBSETS):
        if not s >> f & 1:
            size = s.bit_count()
            times = factorial(size) * factorial(n - 1 - size)
            parts.append(f"{times} * (survivors[{s}] - survivors[{s | 1 << f}])")
    return F.expr(" + ".join(parts))


def report(survivors: DataFrame) -> DataFrame:
    """One row per part, filter order and step from the subset survivors of each part."""
    steps = F.from_json(F.lit(json.dumps(filter_steps())), "array<struct<o:string,step:int,f:int,b:int,a:int>>")
    rows = survivors.withColumn("shapleys", F.array(*[shapley(f) for f in range(len(FILTERS))])).withColumn("t", F.explode(steps))
    every = SUBSETS - 1

    def at(array: str, subset) -> Column:
        return F.element_at(array, subset + F.lit(1))

    removed = at("survivors", F.col("t.b")) - at("survivors", F.col("t.a"))
    only = F.expr("shiftleft(1, t.f)")
    return rows.select(
        "part", F.col("t.o").alias("filter_order"), F.col("t.step").alias("step"), at("survivors", F.col("t.a")).alias("kept"), removed.alias("removed"),
        (at("survivors", F.lit(0)) - at("survivors", only) - removed).alias("redundant"),
        (at("survivors", F.lit(every).bitwiseXOR(only)) - at("survivors", F.lit(every))).alias("unique_fails"),
        (at("good", F.col("t.b")) - at("good", F.col("t.a"))).alias("good_lost"),
        (at("toxic", F.col("t.b")) - at("toxic", F.col("t.a"))).alias("toxic_lost"),
        at("shapleys", F.col("t.f")).alias("shapley"))


def survival_words(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "source") -> DataFrame:
    """(part, class, word) of every document; ``labels`` has (doc_id, quality, toxic).

    Texts are read once and stay behind: a repeat is found by the SHA-256 of the
    whole text, and only texts that occur again are looked up.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), *[c.alias(x) for c, x in zip(text_failures(F.col("text")), FILTERS)])
    rows = scratch.write(rows, "failures")
    again = scratch.write(rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "again")
    rows = join_hot(rows, again, ["key"], "n").withColumn("E", F.coalesce(F.col("id") > F.col("least"), F.lit(False))).drop("key", "least", "n")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("g"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("x"))
    marks = checked_broadcast(scratch.write(marks.filter("g + x > 0").select("id", (F.col("g") + F.col("x")).alias("class")), "marks"))
    rows = rows.join(marks, "id", "left")
    return rows.select("part", F.coalesce("class", F.lit(0)).alias("class"), survival_word([F.col(x) for x in FILTERS]).alias("word"))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """What every order of the five filters keeps and removes at each step, per part (see ``report``)."""
    with Scratch(spark) as scratch:
        survivors = scratch.write(subset_survivors(survival_words(docs, labels, scratch, **columns)), "survivors", keep=True)
    return report(survivors)
