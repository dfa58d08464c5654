"""Versioned datasets: items as JSON lines, a one-row manifest and a changelog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.operators.datasets import coverage, dataset_digest, validate
from judgelab.sources.jsonl import ITEM, to_jsonl


class DatasetValidationError(ValueError):
    pass


def check(items: DataFrame) -> None:
    bad = validate(items).limit(10).collect()
    if bad:
        raise DatasetValidationError("; ".join(f"{r['item_id']}: {r['problem']}" for r in bad))


def save(items: DataFrame, folder: str, version: str, note: str = "") -> None:
    """items-<v>, manifest-<v> (digest, count, coverage) and a changelog entry, all through Spark's writers."""
    check(items)
    spark = items.sparkSession
    to_jsonl(items, f"{folder}/items-{version}")
    digest = dataset_digest(items, "item_id", items.columns).first()
    cells = {r["cell"]: r["n"] for r in coverage(items).collect()}
    manifest = json.dumps({"version": version, "sha256": digest["sha256"], "n_items": digest["n_items"], "coverage": cells}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest-{version}")
    spark.createDataFrame([(f"{version}: {note}",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/changelog")


def load(spark: SparkSession, folder: str, version: str) -> tuple[DataFrame, dict]:
    items = spark.read.schema(ITEM).json(f"{folder}/items-{version}")
    check(items)
    return items, json.loads(spark.read.text(f"{folder}/manifest-{version}").first()[0])


def digest_of(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("digest"))
