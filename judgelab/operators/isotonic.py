"""Isotonic calibration: pooled adjacent violators over ordered rows, and prediction by block lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgelab.functions.tables import discard, written

#: Blocks of a range at most after pooling; no task holds more than two such ranges.
RANGE_ROWS = 100_000
BLOCKS = "part int, ord long, x_start double, x_end double, value double, weight double"


def _pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge neighbouring blocks while an earlier value exceeds a later one; rows come in order."""
    stack: list[list[float]] = []
    for row in pdf.itertuples(index=False):
        stack.append([row.x_start, row.x_end, row.value * row.weight, row.weight, row.value, row.ord])
        while len(stack) > 1 and stack[-2][4] > stack[-1][4]:
            last = stack.pop()
            prev = stack[-1]
            total = prev[3] + last[3]
            value = (prev[2] + last[2]) / total if total else prev[4]
            stack[-1] = [prev[0], last[1], prev[2] + last[2], total, value, prev[5]]
    return pd.DataFrame([{"part": 0, "ord": int(s[5]), "x_start": s[0], "x_end": s[1], "value": s[4], "weight": s[3]} for s in stack], columns=["part", "ord", "x_start", "x_end", "value", "weight"]).astype({"part": "int32", "ord": "int64"})


def _groups(edges: list, limit: int) -> dict[int, int]:
    """Range -> first range of its group: small neighbours together, large ones where their boundary violates."""
    out, k = {}, 0
    while k < len(edges):
        first, total, k = k, edges[k]["n"], k + 1
        while k < len(edges) and (total + edges[k]["n"] <= limit or (k == first + 1 and edges[first]["last"] > edges[k]["first"])):
            total, k = total + edges[k]["n"], k + 1
        out |= {edges[j]["part"]: edges[first]["part"] for j in range(first, k)}
    return out


def fit(points: DataFrame, x: str, y: str, order: str, weight: str | None = None, parts: int = 64, limit: int = RANGE_ROWS) -> DataFrame:
    """Blocks (x_start, x_end, value, weight) in order of x, ties in order of ``order``.

    Points are cut into ranges of (x, order), by ``limit`` rows or so, and
    pooled range by range.  While blocks at a boundary of ranges violate, such
    neighbours are pooled again, ``2 * limit`` blocks at most in a task, and
    cut anew.  Pooling is associative, so the blocks are those of one pass.
    """
    pts = points.select(F.col(x).cast("double").alias("x_start"), F.col(x).cast("double").alias("x_end"), F.col(y).cast("double").alias("value"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), F.col(order).cast("long").alias("ord")).dropna()
    n, bad = pts.agg(F.count("*"), F.min("weight")).first()
    if bad is not None and bad < 0:
        raise ValueError("weights can't be negative")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = None
        for pdf in batches:  # only the blocks of the rows so far are held
            held = _pool(pdf if held is None else pd.concat([held, pdf]))
        if held is not None:
            part, k = TaskContext.get().partitionId(), -(-len(held) // limit)
            yield held.assign(part=[part * 1024 + min(1023, j * k // len(held)) for j in range(len(held))]).astype({"part": "int32"})

    ranged = pts.select(F.lit(0).alias("part"), "ord", "x_start", "x_end", "value", "weight").repartitionByRange(max(parts, -(-n // limit)), "x_start", "ord")
    pooled = ranged.sortWithinPartitions("x_start", "ord").mapInPandas(local, BLOCKS)
    pooled = written(pooled)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["part"]))
        out = _pool(pdf.drop(columns="g").sort_values(["part", "x_start", "ord"], kind="stable"))
        half = len(out) if len(out) <= limit else len(out) // 2
        return out.assign(part=[ids[0] if j < half else ids[-1] for j in range(len(out))]).astype({"part": "int32"})

    at = F.struct("x_start", "ord")
    while True:
        edges = pooled.groupBy("part").agg(F.count("*").alias("n"), F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last")).orderBy("part").collect()  # one row a range
        if not any(l["last"] > r["first"] for l, r in zip(edges, edges[1:])):
            return pooled.select("x_start", "x_end", "value", "weight", "ord")
        groups = F.broadcast(points.sparkSession.createDataFrame(list(_groups(edges, limit).items()), "part int, g int"))
        before, pooled = pooled, written(pooled.join(groups, "part").groupBy("g").applyInPandas(again, BLOCKS))
        discard(before)


def predict(points: DataFrame, x: str, blocks: DataFrame, out: str = "calibrated", limit: int = RANGE_ROWS) -> DataFrame:
    """Value of the last block that starts at or before x; linear between blocks, constant outside them.

    Blocks and the distinct values of x are cut into ranges; a range looks up
    its blocks by windows, and the nearest blocks of other ranges are carried in.
    """
    v = F.col(x).cast("double")
    b = F.struct("x_start", "x_end", "value")
    first = blocks.agg(F.min_by(b, F.struct("x_start", "ord"))).first()[0]
    if first is None:
        raise ValueError("no blocks to predict from")
    values = points.select(v.alias("v")).filter("v IS NOT NULL").distinct()
    rows = blocks.select(F.col("x_start").alias("v"), F.lit(0).alias("kind"), "ord", b.alias("b")).unionByName(values.select("v", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ord")), allowMissingColumns=True)
    ranged = written(rows.repartitionByRange(max(1, -(-rows.count() // limit)), "v", "kind", "ord").withColumn("p", F.spark_partition_id()))
    key = F.when(F.col("kind") == 0, F.struct("v", "ord"))  # of blocks only
    up, down = Window.partitionBy("p").orderBy("v", "kind", "ord"), Window.partitionBy("p").orderBy(F.desc("v"), F.desc("kind"), F.desc("ord"))
    ends = ranged.groupBy("p").agg(F.max_by("b", key).alias("e"), F.min_by("b", key).alias("s"))
    before, after = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("p", F.last("e", True).over(before).alias("e"), F.last("s", True).over(after).alias("s"))  # one row a range
    found = ranged.select("p", "v", "kind", F.last("b", True).over(up).alias("b"), F.last("b", True).over(down).alias("next")).filter("kind = 1").join(F.broadcast(carried), "p")
    start = F.struct(*[F.lit(first[k]).alias(k) for k in ("x_start", "x_end", "value")])
    at, to, w = F.col("at"), F.col("to"), F.col("__v")
    found = found.select(F.col("v").alias("__v"), F.coalesce("b", "e", start).alias("at"), F.coalesce("next", "s").alias("to"))
    line = at["value"] + (to["value"] - at["value"]) * (w - at["x_end"]) / F.nullif(to["x_start"] - at["x_end"], F.lit(0.0))
    found = found.select("__v", F.when((w <= at["x_end"]) | to.isNull(), at["value"]).otherwise(line).alias(out))
    return points.drop(out).withColumn("__v", v).join(found, "__v", "left").drop("__v")


#: What a calibration finding calls for: (test on a report's row, advice).
ADVICE = (
    ("position_bias_rate > 0.15", "Judge each pair in both orders and average: position bias is high."),
    ("verbosity_significant", "Scores follow length: control for response length."),
    ("self_preference_rate > 0", "The judge prefers its own family: add a judge of another family."),
    ("mae > 1.0", "Mean error is above one point: calibrate scores before use."),
    ("spearman < 0.7", "Rank agreement is low: collect more labels and revise the rubric."),
)


def advised(report: DataFrame) -> DataFrame:
    """``report`` with an array of advice; a finding that is null calls for none."""
    return report.withColumn("advice", F.array_compact(F.array(*[F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(text)) for test, text in ADVICE])))
