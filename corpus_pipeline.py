"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's documents.  All but the last return
the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.llm.common import materialise, table
from judgelab.llm.decontamination import decontaminate
from judgelab.llm.minhash import near_duplicates
from judgelab.llm.mixing import mix
from judgelab.llm.sharding import shard
from judgelab.llm.toxicity import toxicity, train

#: Not expressible in SQL: a trained model and similarity components; tests compare the stages with brute force.
ORACLE_SQL = None


def _same_columns(result: DataFrame, docs: DataFrame) -> DataFrame:
    return result.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return _same_columns(scored.filter("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of repeated rows, one."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")
    return _same_columns(stay.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _same_columns(found.filter(~F.col("contaminated")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each pass of its source that takes it; at least once."""
    return _same_columns(mix(docs), docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
