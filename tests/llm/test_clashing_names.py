"""Stages on documents whose extra columns are named like the operators' own."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelab.llm import lang_id
from scorelab.llm.decontam import drop_contaminated
from scorelab.llm.line_dedup import remove_boilerplate
from scorelab.llm.mixing import keep_mixture
from scorelab.llm.near_dedup import keep_one
from scorelab.llm.queries import domain_of
from scorelab.llm.sharding import add_shard

from .util import messy

EXTRA = ["_language", "_copies", "_copy", "__id", "__HASH", "__cut", "__key", "__row", "__heavy", "__heavy_key", "key", "row", "heavy", "copies", "text_hash", "line", "at", "h", "i"]


@pytest.fixture(scope="module")
def docs(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    extra = [(100 + i, f"shared line\n{prose} {i}") for i in range(8)] + [(200, "one of a kind\nshared line")]
    df = messy(spark, extra).cache()
    return df.withColumns({c: F.concat(F.lit(f"{c}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in EXTRA})


def own_values_stay(docs, out):
    kept = [c for c in docs.columns if c != "shard"]  # the one name that sharding replaces
    assert [c for c in out.columns if c in kept] == kept
    wrong = out.filter(" OR ".join(f"`{c}` <> concat('{c}=', coalesce(cast(doc_id AS string), '-')) OR `{c}` IS NULL" for c in EXTRA))
    assert wrong.count() == 0 and out.count() > 0


def test_line_dedup(spark, docs):
    out = remove_boilerplate(spark, docs, min_sites=3)
    own_values_stay(docs, out)
    assert out.filter("n_removed > 0 AND doc_id >= 100").count() == 9


def test_language(spark, docs):
    own_values_stay(docs, lang_id.keep_identified(spark, docs, lang_id.fit(spark, docs), min_score=0.1))


def test_near_duplicates(spark, docs):
    out = keep_one(spark, docs, k=5)
    own_values_stay(docs, out)
    assert out.filter("doc_id BETWEEN 100 AND 107").count() == 1


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "one of a kind shared line")], "item_id long, text string")
    out = drop_contaminated(spark, docs, items)
    own_values_stay(docs, out)
    assert out.filter("doc_id = 200").count() == 0


def test_mixture(spark, docs):
    own_values_stay(docs, keep_mixture(spark, docs, domain_of(), budget_share=0.9, weights={}, max_epochs=2))


def test_sharding(spark, docs):
    out = add_shard(spark, docs, n_shards=4)
    own_values_stay(docs, out)
    assert out.count() == docs.count()


def test_pipeline_keeps_extra_columns(spark, docs):
    all_docs = docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        own_values_stay(all_docs, docs)


def test_many_cut_lines_take_time_in_proportion(spark):
    """One document of 400,000 lines that all go but one in a thousand."""
    lines = F.expr("array_join(transform(sequence(1, 400000), i -> if(i % 1000 = 0, concat('own ', source, ' ', i), concat('all ', i % 50))), '\\n')")
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source")).withColumn("text", lines)
    start = time.monotonic()
    got = remove_boilerplate(spark, docs, min_sites=5).select("n_lines", "n_removed", F.size(F.split("text", "\n")).alias("n")).distinct().collect()
    assert [tuple(r) for r in got] == [(400_000, 399_600, 400)]
    assert time.monotonic() - start < 120
