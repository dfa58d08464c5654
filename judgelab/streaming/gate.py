"""Continuous judging: an extension, since judged scores often arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelab.operators.regression import GateResult, run_gate


def windowed_means(scores: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean score by capability and event-time window; rows later than ``late`` are dropped with their window's state."""
    means = scores.withWatermark(time, late).groupBy(F.window(time, window), "capability").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return means.select(F.col("window.start").alias("window_start"), "capability", "n", "mean_score")


def gate_each_batch(candidates: DataFrame, baseline: DataFrame, report: Callable[[int, GateResult], None], checkpoint: str):
    """Gate every micro-batch of candidate scores against the baseline."""

    def each(batch: DataFrame, number: int) -> None:
        common = batch.join(baseline.select("item_id"), "item_id", "left_semi")
        if not common.isEmpty():
            report(number, run_gate(baseline, common))

    return candidates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
