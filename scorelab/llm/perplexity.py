"""Quality rules with perplexity bands: a modified Kneser-Ney model of character n-grams.

One model per language over the symbols of normalised texts (A-Z lower-cased,
digits as 0, control characters as blanks, ``order - 1`` start marks before a text
and an end mark after it).  The n-grams of every text are counted: each task adds
up its own, Spark sums them.  Continuation counts, the three discounts per order
(from how many n-grams occur once to four times), the interpolation weight of
each context and the interpolated probability of each n-gram are Spark
aggregations and joins over the table of distinct n-grams, which grows with the
corpus and has no cap.

For scoring, the probabilities of the highest order are stored as a sorted array
of 64-bit n-gram hashes and one of log probabilities, searched by bisection.  The
model is made of the texts that it scores, so every n-gram is found there.  Up to
``max_entries`` the arrays are broadcast; a larger model stays a table, and the
n-grams of each distinct text are joined with it.

A document is rejected when its log perplexity lies outside its language's band,
``reach`` times the interquartile range beyond the quartiles of the documents that
pass the base rule: too low (boilerplate, endless repetition) or too high (noise).
Quartiles are exact, over log perplexities rounded to four decimals.

Defined results: a null text has no words and no perplexity; a null language is a
language of its own; an empty text passes no base rule; repeated rows count each
and get equal results; texts of any length are read whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, checked_broadcast, join_hot

START, END = 1, 2
SYMBOLS = "#*$%&|<>"
#: Texts are worked on in chunks of so many characters (a longer text is a chunk of its own).
CHUNK = 1_000_000
#: A task hands on its counts when it holds so many distinct n-grams.
MAX_HELD = 500_000
#: Odd multipliers, one per place counted from the end of an n-gram.
PLACES = np.array([xxh64_intdigest(b"place %d" % i) | 1 for i in range(16)], np.uint64)
#: What becomes of the first 128 code points.
FOLD = np.array([ord(" ") if i < 32 or i == 127 else ord("0") if 48 <= i <= 57 else i + 32 if 65 <= i <= 90 else i for i in range(128)], np.uint32)


# ---------------------------------------------------------------- n-grams of texts

def chunks(texts: list[str | None]) -> Iterator[slice]:
    """Runs of ``texts`` of at most about CHUNK characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield slice(first, i)
            first, size = i, 0
        size += len(t or "") + 1
    if first < len(texts):
        yield slice(first, len(texts))


def grams(texts: list[str], langs: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, hash of the n-gram that ends at each symbol, its text's number or -1 at start marks)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    raw = np.where(raw < 128, FOLD[np.minimum(raw, 127)], raw)
    n = len(raw) + order * len(texts)
    symbols = np.full(n, START, np.uint32)
    first = np.cumsum(lengths + order) - lengths - order  # of each text's start marks
    text = np.repeat(np.arange(len(texts)), lengths + order)
    place = np.arange(n) - first[text]
    inside = place >= order - 1
    last = place == lengths[text] + order - 1
    symbols[inside & ~last] = raw
    symbols[last] = END
    seeds = np.array([xxh64_intdigest(x.encode()) for x in langs], np.uint64)
    key = seeds[text]
    wide = symbols.astype(np.uint64)
    for j in range(order):
        key[j:] += wide[:n - j] * PLACES[j]
    return symbols, key, np.where(inside, text, -1)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, each value's place among them)."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple] = []  # (hash, language, symbols, count) arrays, each hash once per element
        size = 0

        def merged() -> tuple:
            key, lang, signs, n = (np.concatenate(x) for x in zip(*held))
            key, first, at = np.unique(key, return_index=True, return_inverse=True)
            return key, lang[first], signs[first], np.bincount(at, n).astype(np.int64)

        def out(part: tuple) -> Iterator[pa.RecordBatch]:
            _, lang, signs, n = part
            back = np.array(list(names), object)
            for i in range(0, len(n), 100_000):
                s = slice(i, i + 100_000)
                gram = np.ascontiguousarray(signs[s]).view(f"<U{order}").reshape(-1)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(back[lang[s]], pa.string()), "gram": pa.array(gram.tolist(), pa.string()), "c": pa.array(n[s])})

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for part in chunks(texts):
                own = [x or "" for x in langs[part]]
                symbols, key, text = grams([t or "" for t in texts[part]], own, order)
                ends = np.flatnonzero(text >= 0)
                keys, at = distinct(key[ends])
                first = np.empty(len(keys), np.int64)
                first[at[::-1]] = ends[::-1]  # of equal n-grams the first is written last
                signs = np.stack([symbols[first - order + 1 + j] for j in range(order)], axis=1)
                ids = np.array([names.setdefault(x, len(names)) for x in own])
                held.append((keys, ids[text[first]], signs, np.bincount(at, minlength=len(keys))))
                size += len(keys)
                if size > 2 * MAX_HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > MAX_HELD:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(merged())
    return count


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, c): every n-gram of the highest order in the (lang, text) rows whose text is not null."""
    parts = docs.filter("text IS NOT NULL").select("lang", "text").mapInArrow(_counter(order), "lang string, gram string, c bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- modified Kneser-Ney

def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): what is taken from n-grams counted once, twice and more often.

    With n_i n-grams counted i times and y = n1 / (n1 + 2 n2): d_i = i - (i + 1) y n_(i+1) / n_i,
    at least 0; 0.5 where n_i or n1 + 2 n2 is zero.
    """
    n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    rows = counts.groupBy("lang").agg(*n).withColumn("y", F.expr("n1 / nullif(n1 + 2 * n2, 0)"))
    return rows.select("lang", *[F.expr(f"greatest(coalesce({i} - {i + 1} * y * n{i + 1} / nullif(n{i}, 0), 0.5D), 0D)").alias(f"d{i}") for i in (1, 2, 3)])


def interpolated(counts: DataFrame, lower: DataFrame | None, k: int) -> DataFrame:
    """(lang, gram, p): probability of the last symbol of each k-gram after the others.

    ``counts``: (lang, gram, c) of order k; ``lower``: the result of order k - 1.
    Below order 1 every symbol seen, and one for all unseen, is equally likely.
    """
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(discounts(counts), "lang").select("lang", "gram", "c", taken.alias("d"), F.substring("gram", 1, k - 1).alias("context"))
    contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"), F.count("*").alias("kinds"))
    rows = rows.join(contexts, ["lang", "context"])
    if lower is None:
        rows = rows.withColumn("q", 1 / (F.col("kinds") + 1))
    else:
        rows = rows.withColumn("rest", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q")), ["lang", "rest"])
    return rows.select("lang", "gram", "c", ((F.col("c") - F.col("d") + F.col("mass") * F.col("q")) / F.col("total")).alias("p"))


def kneser_ney(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(lang, gram, c, p) of the highest order; lower orders count distinct left neighbours."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = scratch.write(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), f"order{k}")
    probs = None
    for k in range(1, order + 1):
        probs = scratch.write(interpolated(levels[k], probs, k), f"probs{k}")
    return probs


def hashed(model: DataFrame, order: int) -> DataFrame:
    """(key, c, lp): n-gram hash as ``grams`` makes it, count and log probability."""
    def keys(batches):
        for batch in batches:
            signs = np.array(batch.column("gram").to_pylist(), f"<U{order}").view(np.uint32).reshape(-1, order).astype(np.uint64)
            names, at = distinct(batch.column("lang"))
            key = np.array([xxh64_intdigest(x.encode()) for x in names], np.uint64)[at]
            for j in range(order):
                key = key + signs[:, order - 1 - j] * PLACES[j]
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "c": batch.column("c"), "lp": pa.array(np.log(batch.column("p").to_numpy()))})

    return model.mapInArrow(keys, "key bigint, c bigint, lp double")


class SortedHashes:
    """A model as two arrays: n-gram hashes in ascending order and their log probabilities."""

    def __init__(self, key: np.ndarray, lp: np.ndarray):
        by = np.argsort(key, kind="stable")
        self.key, self.lp = key[by], lp[by]

    def look(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram hash; all of them are in the model."""
        return self.lp[np.searchsorted(self.key, key)]


# ---------------------------------------------------------------- documents

def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """The contract's counts of every text: words, their code points, symbols, repeated lines and repeated words."""
    n = len(texts)
    split = [t.encode().split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(n), n_words)
    blanks = np.array([sum(map(t.count, " \t\n\r\x0b\x0c")) for t in texts], np.int64)
    dup_lines = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.encode().split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    repeat = np.zeros(len(doc), bool)
    if len(doc) > 2:
        _, code = distinct(pa.array(list(chain.from_iterable(split)), pa.binary()))
        code = code.astype(np.int64)
        at = np.flatnonzero(doc[2:] == doc[:-2])
        size = int(code.max()) + 1
        _, pair = distinct(code[at] * size + code[at + 1])
        _, window = distinct(pair.astype(np.int64) * size + code[at + 2])
        _, mine = distinct(window.astype(np.int64) * n + doc[at])
        again = at[(np.bincount(mine) > 1)[mine]]
        for j in range(3):
            repeat[again + j] = True
    return {"n_words": n_words, "word_chars": np.array([len(t) for t in texts], np.int64) - blanks,
            "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64), "n_dup_lines": dup_lines,
            "n_repeat_words": np.bincount(doc[repeat], minlength=n).astype(np.int64)}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scorer(order: int, model):
    """Counts and (with a broadcast model) the mean log probability of each row's text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            done: list[dict] = []
            for part in chunks(texts):
                own = [t or "" for t in texts[part]]
                got = base_counts(own)
                if model is not None:
                    _, key, text = grams(own, [x or "" for x in langs[part]], order)
                    there = (text >= 0) & np.array([t is not None for t in texts[part]])[text]
                    keys, at = distinct(key[there])
                    total = np.bincount(text[there], model.value.look(keys)[at], minlength=len(own))
                    got["mean_lp"] = total / np.maximum(np.bincount(text[there], minlength=len(own)), 1)
                done.append(got)
            cols = {c: np.concatenate([d[c] for d in done]) for c in done[0]} if done else {}
            if model is None:
                cols["mean_lp"] = np.zeros(batch.num_rows)
            null = np.array([t is None for t in texts])
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "lang": batch.column("lang"), "key": batch.column("key"),
                                              **{c: pa.array(cols[c]) for c in COUNTS}, "mean_lp": pa.array(cols["mean_lp"], mask=null)})
    return score


def _joined_means(docs: DataFrame, model: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(key, n, mean_lp) of each distinct text, with the model as a table: the way for models that are too large to send.

    Rows of equal texts add equal parts to both sums, so their mean is one text's.
    """
    def emit(batches):
        for batch in batches:
            texts, langs, names = (batch.column(c).to_pylist() for c in ("text", "lang", "key"))
            for part in chunks(texts):
                _, key, text = grams(texts[part], [x or "" for x in langs[part]], order)
                there = text >= 0
                rows = pd.DataFrame({"gram": key[there].view(np.int64), "text": text[there]}).value_counts().reset_index()
                back = np.array(names[part], object)
                for i in range(0, len(rows), 100_000):
                    r = rows.iloc[i:i + 100_000]
                    yield pa.RecordBatch.from_pydict({"key": pa.array(back[r["text"]], pa.binary()), "gram": pa.array(r["gram"]), "times": pa.array(r["count"])})

    rows = scratch.write(docs.filter("text IS NOT NULL").select("text", "lang", "key").mapInArrow(emit, "key binary, gram bigint, times bigint"), "uses")
    found = join_hot(rows, model.select(F.col("key").alias("gram"), "c", "lp"), ["gram"], "c")
    means = found.groupBy("key").agg((F.sum(F.col("times") * F.col("lp")) / F.sum("times")).alias("mean_lp"))
    return means.join(docs.groupBy("key").agg(F.count("*").alias("n")), "key")


def bands(rows: DataFrame, reach: float) -> DataFrame:
    """(lang, lower, upper): least and greatest log perplexity that the (lang, log_ppl) rows of a language allow."""
    hist = rows.groupBy("lang", "log_ppl").agg(F.count("*").alias("n"))
    quart = hist.groupBy("lang").agg(F.expr("percentile(log_ppl, array(0.25, 0.75), n)").alias("q"))
    width = F.col("q")[1] - F.col("q")[0]
    return quart.select("lang", (F.col("q")[0] - reach * width).alias("lower"), (F.col("q")[1] + reach * width).alias("upper"))


def base_fails() -> Column:
    """The base rule: too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def assess(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5,
           reach: float = 3.0, max_entries: int = 4_000_000) -> DataFrame:
    """Per row of ``docs``: id, the base counts, base_failed, perplexity (per symbol), the band's lower and upper end, kept."""
    with Scratch(spark) as scratch:
        lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.col(text_col).cast("string")
        rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("text"))
        counts = scratch.write(gram_counts(rows, order), "grams")
        model = scratch.write(hashed(kneser_ney(counts, order, scratch), order), "model")
        small = model.count() <= max_entries
        rows = rows.withColumn("key", F.unhex(F.sha2(F.concat("lang", F.lit("\n"), "text"), 256)) if not small else F.lit(None).cast("binary"))
        sent = None
        if small:
            arrays = model.select("key", "lp").toArrow()
            sent = spark.sparkContext.broadcast(SortedHashes(arrays["key"].to_numpy().view(np.uint64), arrays["lp"].to_numpy()))
        id_type = docs.schema[id_col].dataType.simpleString()
        scored = rows.mapInArrow(_scorer(order, sent), f"id {id_type}, lang string, key binary, {', '.join(f'{c} bigint' for c in COUNTS)}, mean_lp double")
        scored = scratch.write(scored, "scored")
        if not small:
            means = scratch.write(_joined_means(rows, model, order, scratch), "means")
            scored = scratch.write(join_hot(scored.drop("mean_lp").withColumn("key", F.coalesce("key", F.lit(b""))), means, ["key"], "n"), "joined")
        scored = scored.select("id", "lang", *COUNTS, F.round(-F.col("mean_lp"), 4).alias("log_ppl"), base_fails().alias("base_failed"))
        band = scratch.write(bands(scored.filter("NOT base_failed"), reach), "bands")
        out = scored.join(checked_broadcast(band), "lang", "left")
        good = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
        return scratch.write(out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", F.exp("log_ppl").alias("perplexity"),
                                        F.exp("lower").alias("least"), F.exp("upper").alias("most"), good.alias("kept")), "assessed", keep=True)
