"""Mixing sources to target weights (operator 1).

A source's share of the tokens, raised to an exponent between 0 (all alike) and
1 (as found) and normalised, is its weight.  The exponent is bisected to meet a
target entropy, and raised further where a source would be repeated beyond the
limit.  A source then gets ``weight * budget`` tokens: whole passes over its
documents and one partial pass.  A pass is a permutation of the source's
blocks (hash buckets of documents), each block a permutation of its documents;
the partial pass takes blocks in that order and cuts one of them at the budget.
There are as many blocks as it takes for ``block_rows`` rows each, so the block
that is cut doesn't grow with the data.

Tokens of a document: its words and one end.  Without a budget, the smallest
one is used that gives every source a whole pass, so no document is lost.

Defined results: a null source is a source of its own; a null or empty text has
one token; repeated rows are separate documents; rows of one id and different
texts lie in blocks of their own, in a fixed order; an empty table gives an
empty result; added columns replace clashing ones.  Nothing but sums of the
source table reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgelab.llm.common import WORD, materialise, table

_NONE = "\u0000"
_MADE = {f"__{c}" for c in "src b tokens row weight epoch block order left sofar".split()}


@dataclass(frozen=True)
class MixPlan:
    exponent: float
    entropy: float
    budget: float
    repetition: float


def _tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long") + 1


def _source(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(_NONE))


def _figures(shares: DataFrame, exponents: list[float]) -> dict[float, dict]:
    """Entropy, and largest and smallest weight over share, for every exponent: one row an exponent."""
    at = shares.select("p", F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
    w, lw = F.pow("p", F.col("a")), F.col("a") * F.log("p")
    found = at.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * lw).alias("wl"), F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least"))
    rows = found.select("a", (F.log("z") - F.col("wl") / F.col("z")).alias("h"), (F.col("most") / F.col("z")).alias("most"), (F.col("least") / F.col("z")).alias("least")).collect()
    return {r["a"]: r.asDict() for r in rows}


def _bisect(shares: DataFrame, good, levels: int = 5, passes: int = 4) -> float:
    """Largest exponent in [0, 1] that is ``good`` (all below it are): ``levels`` halvings a pass."""
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        grid = [lo + (hi - lo) * k / 2**levels for k in range(1, 2**levels)]
        figures = _figures(shares, grid)
        left, right = 0, 2**levels
        while right - left > 1:
            mid = (left + right) // 2
            left, right = (mid, right) if good(figures[grid[mid - 1]]) else (left, mid)
        lo, hi = lo + (hi - lo) * left / 2**levels, lo + (hi - lo) * right / 2**levels
    return lo


def plan_mix(totals: DataFrame, target_entropy: float, max_repetition: float, budget_tokens: int | None) -> MixPlan:
    """``totals``: (src, t), one row a source.  ``target_entropy``: as a part of the largest possible one."""
    n, t = totals.agg(F.count("*"), F.sum("t")).first()
    shares = totals.select((F.col("t") / F.lit(float(t))).alias("p"))
    goal = target_entropy * math.log(n)

    def reps(f: dict) -> float:
        return f["most"] * (budget_tokens / t if budget_tokens else 1 / f["least"])

    ends = _figures(shares, [0.0, 1.0])
    a = 1.0 if ends[1.0]["h"] >= goal else _bisect(shares, lambda f: f["h"] >= goal)
    if reps(ends[1.0]) >= max_repetition:
        a = 1.0
    elif reps(_figures(shares, [a])[a]) > max_repetition:
        a = min(1.0, _bisect(shares, lambda f: reps(f) > max_repetition) + 2.0**-20)
    f = _figures(shares, [a])[a]
    return MixPlan(a, f["h"], float(budget_tokens or t / f["least"]), reps(f))


def mix(docs: DataFrame, target_entropy: float = 0.95, max_repetition: float = 4.0, budget_tokens: int | None = None, text: str = "text", source: str = "source", id_col: str = "doc_id", block_rows: int = 4096, seed: int = 1) -> DataFrame:
    """Rows of ``docs``, once for every pass that takes them, with __tokens, __weight, __epoch, __block, __order."""
    names = [F.col(f"`{c}`") for c in docs.columns if c not in _MADE]
    blocks = max(64, -(-docs.count() // block_rows))
    row = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    keyed = docs.select(*names, _source(source).alias("__src"), F.pmod(row, F.lit(blocks)).cast("int").alias("__b"), _tokens(text).alias("__tokens"), row.alias("__row"))
    stats = materialise(keyed.groupBy("__src", "__b").agg(F.sum("__tokens").alias("t")), "mix-blocks")
    totals = materialise(stats.groupBy(F.col("__src").alias("src")).agg(F.sum("t").alias("t")), "mix-sources")
    if totals.isEmpty():
        extra = {"__weight": "double", "__epoch": "int", "__block": "int", "__order": "long"}
        return keyed.select("*", *[F.lit(None).cast(k).alias(c) for c, k in extra.items()]).drop("__src", "__b", "__row")
    plan = plan_mix(totals, target_entropy, max_repetition, budget_tokens)
    powers = F.pow(F.col("t") / F.lit(float(totals.agg(F.sum("t")).first()[0])), F.lit(plan.exponent))
    z = totals.agg(F.sum(powers)).first()[0]
    weights = totals.select(F.col("src").alias("__src"), (powers / z).alias("__weight"), F.col("t").alias("__t"), F.greatest(F.round(powers / z * plan.budget), F.lit(1)).cast("long").alias("__want"))
    weights = weights.select("*", F.floor(F.col("__want") / F.col("__t")).cast("int").alias("__full")).withColumn("__rest", F.col("__want") - F.col("__full") * F.col("__t"))
    passes = stats.join(weights, "__src").select("*", F.explode(F.sequence(F.lit(0), F.col("__full"))).alias("__epoch"))
    order = Window.partitionBy("__src", "__epoch").orderBy(F.xxhash64(F.lit(seed), "__src", "__epoch", "__b"), "__b")  # at most `blocks` rows
    laid = passes.select("*", (F.row_number().over(order) - 1).alias("__block"), F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"))
    left = F.col("__rest") - (F.col("__upto") - F.col("t"))
    laid = laid.select("__src", "__b", "__weight", "__epoch", "__block", F.when(F.col("__epoch") < F.col("__full"), F.lit(None).cast("long")).when(left >= F.col("t"), F.lit(None).cast("long")).otherwise(left).alias("__left"))
    laid = materialise(laid.filter(F.col("__left").isNull() | (F.col("__left") > 0)), "mix-plan")
    key = F.xxhash64(F.lit(seed + 1), "__epoch", "__row")
    taken = keyed.join(laid.filter(F.col("__left").isNull()), ["__src", "__b"]).withColumn("__order", key)
    cut = keyed.join(laid.filter(F.col("__left").isNotNull()), ["__src", "__b"]).withColumn("__order", key)
    inside = Window.partitionBy("__src", "__b").orderBy("__order", "__row")  # one block of a source
    cut = cut.withColumn("__sofar", F.sum("__tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("__sofar") <= F.col("__left"))
    cols = [*names, "__tokens", "__weight", "__epoch", "__block", "__order"]
    return taken.select(*cols).unionByName(cut.select(*cols))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__order").alias("order_key"))
