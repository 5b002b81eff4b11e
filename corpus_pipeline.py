"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame with the columns of ``docs``, the last with ``shard``
and ``slot`` besides. Null or empty texts pass every stage but the first, where
the classifier rates them like any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import decontam, mixing, ngramjoin, quality, sharding
from corpusgraph.llm.common import small_batches, stored

#: The near-duplicate stage's shingle width and least similarity in percent.
SHINGLE, SIMILAR = 5, 80
#: Target shares of tokens. Every document stays; good prose is repeated until
#: its share is met or the total has grown by a tenth.
WEIGHTS, GROWTH = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}, 1.1
SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts as good."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.graded(labels))
    rated = quality.rate(docs, model)
    return rated.filter(quality.accepted(F.col("tails"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group that similar shingles link."""
    small_batches(spark)
    return ngramjoin.keep_one(docs, SHINGLE, SIMILAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item within its edit budget."""
    small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say, once at least."""
    small_batches(spark)
    labelled = mixing.domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labelled, WEIGHTS, growth=GROWTH, low=1.0)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the classifiers nor the edit matching; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
