"""A corpus pipeline: five stages, each over all that its predecessor kept, written as Parquet and reread.

Documents predicted toxic go; of each group of near copies one stays; contaminated documents go; sources are mixed to
target weights; the rest is dealt out to shards. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, mixing, ngram_join, resharding, toxicity
from quillon.llm.shared import materialise, ship


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resharding.shard_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_copies_out),
    ("benchmark_decontamination", contaminated_out),
    ("mixing", mixed),
    ("resharding", sharded),
]

#: The classifier, the mixture and the flow are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
