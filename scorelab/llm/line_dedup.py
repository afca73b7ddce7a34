"""Cross-site boilerplate lines: distinct-site spread by sketches and exact counts.

A line (trimmed of blanks) counts as boilerplate when it occurs on at least
``min_sites`` distinct sites.  Lines are compared by a 128-bit hash.  A HyperLogLog
sketch of the sites is kept per line hash; sketches of the tasks are merged by
aggregation.  Lines whose estimate lies far from ``min_sites`` are decided by it;
those within ``margin`` (as a part of ``min_sites``) get their exact number of
distinct sites.  A line that occurs fewer than ``min_sites`` times cannot spread
so far and gets no sketch.

Every occurrence of a boilerplate line is removed.  DataFrame functions only.

Defined results: a null text stays null and has no lines; blank lines are never
boilerplate; a null site is a site of its own; lines of any length are hashed
whole; a line that repeats on one site only stays; rows repeated whole are
cleaned alike; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import Scratch, checked_broadcast, fresh_names

BLANKS = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128-bit hash of the trimmed line, null for a blank one."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def spread_lines(docs: DataFrame, scratch: Scratch, text_col: str = "text", site_col: str = "source", min_sites: int = 5,
                 margin: float = 0.25, lg_k: int = 12) -> DataFrame:
    """(key, sites, exact): line hashes on at least ``min_sites`` sites.

    ``lg_k``: the sketches have 2 ** lg_k registers (standard error 1.04 / sqrt(2 ** lg_k)).
    """
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null"))
    lines = docs.select(site.alias("site"), F.explode(lines_of(F.col(text_col))).alias("line")).select("site", line_key(F.col("line")).alias("key"))
    # Occurrences per (line, site), summed per task first: what all later steps read.
    seen = scratch.write(lines.filter("key IS NOT NULL").groupBy("key", "site").agg(F.count("*").alias("n")), "seen")
    often = seen.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_sites).select("key")
    often = checked_broadcast(scratch.write(often, "often"))
    few = seen.join(often, "key")
    sketch = few.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    guess = scratch.write(sketch.select("key", F.hll_sketch_estimate("sketch").alias("guess")), "guess")
    sure = guess.filter(F.col("guess") > min_sites * (1 + margin)).select("key", F.col("guess").alias("sites"), F.lit(False).alias("exact"))
    close = guess.filter(F.col("guess").between(min_sites * (1 - margin), min_sites * (1 + margin))).select("key")
    counted = few.join(close, "key").groupBy("key").agg(F.count_distinct("site").alias("sites"))
    return sure.union(counted.filter(F.col("sites") >= min_sites).select("key", "sites", F.lit(True)))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       site_col: str = "source", **params) -> DataFrame:
    """``docs`` with cleaned texts and columns n_lines and n_removed, all other columns kept.

    The marked lines of a document are found by a join on line hashes and sent
    back to it by its id and text hash; documents without any are left as read.
    """
    own_id, own_hash, cut = fresh_names(docs, "__id", "__hash", "__cut")
    with Scratch(spark) as scratch:
        bad = checked_broadcast(scratch.write(spread_lines(docs, scratch, text_col, site_col, **params).select("key"), "bad"))
        # The text's hash is taken below the explode: beside it, it would be taken once per line.
        texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), lines_of(F.col(text_col)).alias("lines"))
        lines = texts.select("i", "h", F.posexplode("lines").alias("at", "line")).select("i", "h", "at", line_key(F.col("line")).alias("key"))
        hits = lines.filter("key IS NOT NULL").join(bad, "key").groupBy(F.col("i").alias(own_id), F.col("h").alias(own_hash)).agg(F.collect_set("at").alias(cut))
        hits = scratch.write(hits, "cuts", keep=True)
    match = (F.xxhash64(text_col) == F.col(own_hash)) & F.col(id_col).eqNullSafe(F.col(own_id))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    marked = docs.select(*rest).join(checked_broadcast(hits), match, "left")
    split = lines_of(F.col(text_col))

    def without_cut(lines: Column) -> Column:
        # The places that stay, by one hash set of those cut, so a document's work grows with its lines.
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(let(split, without_cut))
    return marked.select(*[text.alias(c) if c == text_col else F.col(c) for c in rest],
                         F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                         F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_removed"))
