"""Benchmark decontamination with a distributed positional inverted index.

Built with DataFrame functions only.

* Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (digits, a-z and
  everything beyond ASCII).
* Index: one pass over the texts writes a posting (document, term, position) for
  every occurrence of a term that a benchmark item uses.  The index is divided by
  document, each file sorted by term, so a very frequent term is spread over all
  files and building needs no shuffle.
* Exact phrases: the windows of an item are ``window`` consecutive words (a shorter
  item is one window).  Of each window the two rarest terms (by postings) are
  looked up; their lists, shifted by the terms' offsets, are intersected on
  (document, alignment).  Only for the alignments left are the lists of all the
  item's terms intersected, and runs of matched words at least a window long are
  the phrase matches.  A window with a term that no document has is skipped.
* Proximity: the ``near_terms`` rarest distinct terms of an item, all within
  ``slop`` words of the rarest one, in any order.

Defined results: null text and text without words have no words and no match;
items that are null or without words have no window; repeated rows of documents
each get a result row, repeated rows of items count once; an item without an id
marks words but is not listed; empty tables give empty or unmatched results;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ascii_lower, checked_broadcast, fresh_names

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed: what lies between words
END = " "  # stands behind every document's words; no word can equal it
NO_ID = -(2**63)


def split_words(text: Column) -> Column:
    """Words of a text; an empty string stands where a separator opens or ends it."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def word_count(words: Column) -> Column:
    ends = (F.element_at(words, 1) == "").cast("long")
    return (F.size(words) - ends - F.when(F.size(words) > 1, (F.element_at(words, -1) == "").cast("long")).otherwise(0)).cast("long")


def _doc_key(df: DataFrame, id_col: str) -> Column:
    """A long for the id (a null has its own); with the text hash it names a document."""
    kind = df.schema[id_col].dataType
    key = F.col(id_col).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(id_col)
    return F.when(F.col(id_col).isNull(), F.lit(NO_ID)).otherwise(key)


def read_items(items: DataFrame, scratch: Scratch, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct items as a table (ik, item_id, words), words without empty strings."""
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text_col).alias("text")).distinct()
    rows = rows.select("item_id", F.filter(split_words(F.col("text")), lambda w: w != "").alias("words"))
    return scratch.write(rows.filter(F.size("words") > 0).withColumn("ik", F.monotonically_increasing_id()), "items")


def build_index(docs: DataFrame, terms: DataFrame, scratch: Scratch, id_col: str = "doc_id",
                text_col: str = "text", keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` for the given distinct ``terms`` (column term).

    Returns (vocabulary: term, tid), (index: d, h, tid, pos, id).  Each document
    also has one posting of tid 0 whose ``pos`` is its number of words and which
    alone carries its id.
    """
    vocab = scratch.write(terms.select("term", (F.monotonically_increasing_id() + 1).alias("tid"))
                          .union(terms.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(0).cast("long"))), "vocab", keep)
    words = docs.select(_doc_key(docs, id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(id_col).alias("id"),
                        split_words(F.col(text_col)).alias("w"))
    words = words.select("d", "h", "id", word_count(F.col("w")).cast("int").alias("n"),
                         F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("at", "term"))
    post = words.join(checked_broadcast(vocab), "term").select(
        "d", "h", "tid", F.when(F.col("tid") == 0, F.col("n")).otherwise(F.col("at")).alias("pos"),
        F.when(F.col("tid") == 0, F.col("id")).alias("id"))
    return vocab, scratch.write(post.sortWithinPartitions("tid"), "index", keep)


def _item_terms(items: DataFrame, vocab: DataFrame, index: DataFrame, scratch: Scratch) -> DataFrame:
    """(ik, ip, term, tid, cf): each item's words with the number of their postings."""
    cf = index.filter("tid > 0").groupBy("tid").agg(F.count("*").alias("cf"))
    flat = items.select("ik", F.posexplode("words").alias("ip", "term"))
    return scratch.write(flat.join(vocab, "term").join(cf, "tid", "left").select(
        "ik", "ip", "term", "tid", F.coalesce("cf", F.lit(0)).alias("cf")), "terms")


def phrase_matches(index: DataFrame, items: DataFrame, terms: DataFrame, scratch: Scratch, window: int = 13) -> DataFrame:
    """Exact phrase matches (d, h, ik, item_id, start, end): maximal runs, word positions inclusive."""
    lists = terms.groupBy("ik").agg(F.sort_array(F.collect_list(F.struct("ip", "term", "tid", "cf"))).alias("t"))
    length = F.least(F.lit(window), F.size("t"))
    wins = lists.select("ik", "t", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("t") - length)).alias("s"))
    wins = wins.select("ik", F.array_sort(F.transform(F.slice("t", F.col("s") + 1, F.col("len")),
                       lambda x: F.struct(x["cf"].alias("cf"), x["term"].alias("term"), x["ip"].alias("ip"), x["tid"].alias("tid")))).alias("w"))
    wins = wins.filter(F.col("w")[0]["cf"] > 0)
    second = F.when(F.size("w") > 1, F.get("w", F.lit(1))).otherwise(F.col("w")[0])
    pairs = wins.select("ik", F.col("w")[0].alias("x"), second.alias("y")).select(
        "ik", F.col("x.ip").alias("p1"), F.col("x.tid").alias("t1"), F.col("y.ip").alias("p2"), F.col("y.tid").alias("t2")).distinct()
    pairs = checked_broadcast(scratch.write(pairs, "pairs"))
    on = ["d", "h", "ik", "p1", "p2", "diag"]
    first = index.join(pairs, index.tid == pairs.t1).withColumn("diag", F.col("pos") - F.col("p1")).select(*on)
    other = index.join(pairs, index.tid == pairs.t2).withColumn("diag", F.col("pos") - F.col("p2")).select(*on)
    found = scratch.write(first.join(other, on, "left_semi").select("d", "h", "ik", "diag").distinct(), "aligned")

    # All terms of the item along each alignment, against the postings of those documents only.
    few = checked_broadcast(scratch.write(found.select("d", "h").distinct(), "few"))
    own = index.filter("tid > 0").join(few, ["d", "h"]).select("d", "h", "tid", "pos")
    want = found.join(terms.select("ik", "ip", "tid"), "ik").withColumn("pos", F.col("ip") + F.col("diag"))
    got = want.join(own.distinct(), ["d", "h", "tid", "pos"]).select("d", "h", "ik", "diag", "ip")
    line = Window.partitionBy("d", "h", "ik", "diag").orderBy("ip")
    runs = (got.withColumn("run", F.col("ip") - F.row_number().over(line)).groupBy("d", "h", "ik", "diag", "run")
               .agg(F.min("ip").alias("a"), F.max("ip").alias("b")))
    sizes = items.select("ik", "item_id", F.least(F.lit(window), F.size("words")).alias("len"))
    return scratch.write(runs.join(sizes, "ik").filter("b - a + 1 >= len").select(
        "d", "h", "ik", "item_id", (F.col("a") + F.col("diag")).alias("start"), (F.col("b") + F.col("diag")).alias("end")), "phrases")


def proximity_matches(index: DataFrame, items: DataFrame, terms: DataFrame, scratch: Scratch,
                      near_terms: int = 3, slop: int = 16) -> DataFrame:
    """(d, h, ik, item_id, pos): places of an item's rarest term with its next rarest terms near.

    The terms are the item's ``near_terms`` distinct terms with the fewest
    postings (ties: the lesser term); items with fewer distinct terms, or with
    one of those terms in no document, have none.
    """
    rank = F.row_number().over(Window.partitionBy("ik").orderBy("cf", "term")) - 1
    pick = terms.select("ik", "term", "tid", "cf").distinct().withColumn("k", rank).filter(F.col("k") < near_terms)
    whole = pick.groupBy("ik").agg(F.count("*").alias("c"), F.min("cf").alias("m")).filter((F.col("c") == near_terms) & (F.col("m") > 0))
    pick = checked_broadcast(scratch.write(pick.join(whole, "ik", "left_semi").select("ik", "tid", "k"), "pick"))
    hits = index.join(pick, "tid").select("d", "h", "ik", "k", "pos")
    bucket = F.floor(F.col("pos") / slop)
    lead = hits.filter("k = 0").select("d", "h", "ik", F.col("pos").alias("at"),
                                       F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    rest = hits.filter("k > 0").withColumn("bucket", bucket)
    near = lead.join(rest, ["d", "h", "ik", "bucket"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    near = near.groupBy("d", "h", "ik", "at").agg(F.count_distinct("k").alias("c")).filter(F.col("c") == near_terms - 1)
    return near.join(items.select("ik", "item_id"), "ik").select("d", "h", "ik", "item_id", F.col("at").alias("pos"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20,
                  near_terms: int = 3, slop: int = 16) -> DataFrame:
    """Per document: id, text_hash, n_words, n_hit, n_items, items, contaminated, n_near_items.

    ``items`` are the sorted ids of items with an exact match; ``contaminated``
    means that a word is hit and ``share * n_hit >= n_words``; ``n_near_items``
    counts items with a proximity match.  A written table.
    """
    with Scratch(spark) as scratch:
        bench = read_items(items, scratch, item_id, item_text)
        vocab, index = build_index(docs, bench.select(F.explode("words").alias("term")).distinct(), scratch, id_col, text_col)
        terms = _item_terms(bench, vocab, index, scratch)
        spans = phrase_matches(index, bench, terms, scratch, window)
        hit = (spans.select("d", "h", F.explode(F.sequence("start", "end")).alias("pos")).distinct()
                    .groupBy("d", "h").agg(F.count("*").alias("n_hit")))
        named = spans.groupBy("d", "h").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        near = (proximity_matches(index, bench, terms, scratch, near_terms, slop)
                .groupBy("d", "h").agg(F.count_distinct("item_id").alias("n_near_items")))
        marks = scratch.write(hit.join(named, ["d", "h"], "left").join(near, ["d", "h"], "full"), "marks")
        out = index.filter("tid = 0").select("d", "h", "id", F.col("pos").cast("long").alias("n_words")).join(marks, ["d", "h"], "left")
        n_hit = F.coalesce("n_hit", F.lit(0))
        names = F.coalesce("items", F.array().cast("array<string>"))
        return scratch.write(out.select(
            F.col("id").alias(id_col), F.col("h").alias("text_hash"), "n_words", n_hit.alias("n_hit"),
            F.size(names).cast("long").alias("n_items"), names.alias("items"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
            F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")), "contamination", keep=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    bad = contamination(spark, docs, items, id_col, text_col, **params).filter("contaminated")
    own_id, own_hash = fresh_names(docs, "__id", "__hash")
    bad = Scratch(spark).write(bad.select(F.col(id_col).alias(own_id), F.col("text_hash").alias(own_hash)).distinct(), "bad", keep=True)
    return docs.join(checked_broadcast(bad), (F.xxhash64(text_col) == F.col(own_hash)) & F.col(id_col).eqNullSafe(F.col(own_id)), "left_anti")
