"""From raw documents to shards: toxic documents go, one document of each near-duplicate group stays, documents that
hold benchmark items go, sources are mixed to their target weights, and the mix is dealt to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``, whatever further columns these have and however
they are named, maps included.

Defined cases, for every stage: no documents give no documents; a null text counts as an empty one, and null ids, sources
and languages are values like others; repeated rows are documents of their own until the near-duplicate stage keeps one of
each group; very long texts are read whole. Each stage's own rules for ties and the rest are in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bindery.llm import decontaminate, mixing, queries, simhash, toxicity
from bindery.llm.common import stage, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.7 or more; those of equal texts go or stay together."""
    return toxicity.without_toxic(docs, queries.toxicity_labels(spark, sf_dir))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest (doc_id, hash of the text), null doc_id first."""
    return simhash.keep_one_per_group(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold four fifths or more of a benchmark item's shingles; wordless items match none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document up to three times, so that the sources' words come near their targets; documents without words once."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of each row of the mix; copies spread over shards."""
    return queries.sharding_result(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", sources_mixed),
    ("sharding", sharded),
]

#: Training, fingerprints and Newton steps are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
