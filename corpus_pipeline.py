"""From raw documents to a sharded training mix: five stages, each written as Parquet and read again.

Each stage works on all rows its predecessor kept, and all but the last return the columns of documents, in their order, whatever
other columns there are; the last adds virtual_slot and shard, and replaces columns of those names.

Defined results, stage by stage:
- Null, empty and blank texts score 0 and are rejected by the classifier; without any labels every other text passes.
- Rows with a null id are judged by their text alone; they are no near-duplicates of others and stay.
- Of rows that repeat an id and its text one stays; of rows that repeat an id only, each is judged, and all go if the id's documents
  are near copies of a smaller id.  Of equals the smallest id stays.
- Texts are judged whole, however long they are.
- Without benchmark items nothing is dropped; items without an id count.
- The mix repeats a document at most three times, all its rows alike; a null source is a source.
- An empty table gives empty results with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import common, decontaminate, minhash, mixing, quality_mil, sharding


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality_mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target asks."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds virtual_slot and shard."""
    return sharding.assign(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("sharding", shard),
]

#: No SQL expresses the classifier's scores; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage stages for itself goes when its result is written, and that goes when the next one's is; the last is the result's own."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.kept_path(spark, f"pipeline-{name.split()[0]}-{uuid.uuid4().hex[:12]}")
        with common.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.delete(spark, last)
        last = path
    return docs
