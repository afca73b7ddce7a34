import corpus_pipeline
from scorelab.llm.queries import ORACLES, QUERIES

from .test_decontam import brute
from .util import empty, near_classes

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert one.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = corpus_pipeline.near_dedup(spark, one, SF)
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i, n, c in near_classes(rows, 5) if i == c or not n)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    three = corpus_pipeline.decontamination(spark, two, SF)
    left = [(r.doc_id, r.text) for r in two.collect()]
    assert sorted(r.doc_id for r in three.collect()) == sorted(x[0] for x in brute(left, items) if not x[4])
    four = corpus_pipeline.mixing(spark, three, SF)
    assert four.columns == docs.columns and 0 < four.count() <= three.count()
    five = corpus_pipeline.sharding(spark, four, SF)
    assert five.count() == four.count() and set(docs.columns) < set(five.columns)


def test_empty_documents(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
