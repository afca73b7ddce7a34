"""Corpus pipeline: five stages over ``documents``, each by one training-data operator.

language ID -> MinHash near-duplicates -> benchmark decontamination -> mixing
sources to target weights -> sharding.  Every stage takes what its predecessor
kept, written as Parquet and read again; all but the last return the columns of
``documents``, the last adds ``virtual_slot`` and ``shard``.

* ``language_id``: learned from this stage's own documents that have a language
  and whose crc32(doc_id) mod 4 is not 2; documents that stay ``und`` or whose
  language has a score below 0.5 go.
* ``near_dedup``: groups linked by 5-word shingles with similarity 0.8 or more;
  the document with the least doc_id of each group stays.
* ``decontamination``: documents with a 13-word window of a ``benchmark`` item
  covering at least a twentieth of their words go.
* ``mixing``: a budget of nine tenths of the tokens by the target weights; no
  document more than once.
* ``sharding``: 40 shards of nearly equal bytes.

Null or empty texts are ``und`` and go in the first stage; an empty input gives
an empty result with the same columns; extra columns of documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm import lang_id
from scorelab.llm.common import crc32_of_text
from scorelab.llm.decontam import drop_contaminated
from scorelab.llm.mixing import keep_mixture
from scorelab.llm.near_dedup import keep_one
from scorelab.llm.queries import MIX_WEIGHTS, domain_of, table
from scorelab.llm.sharding import add_shard
from scorelab.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with an identified language."""
    model = lang_id.fit(spark, docs.filter(crc32_of_text(F.col("doc_id")) % 4 != 2))
    return lang_id.keep_identified(spark, docs, model, min_score=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each near-duplicate group."""
    return keep_one(spark, docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents free of benchmark items."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents of the mixture."""
    return keep_mixture(spark, docs, domain_of(), budget_share=0.9, weights=MIX_WEIGHTS, max_epochs=1)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with their shard."""
    return add_shard(spark, docs, n_shards=40)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Language scores and signature-based stages are not stated in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
