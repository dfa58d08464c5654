"""Agreement, rank and paired statistics: DataFrame in, one-row DataFrame out.

Statistics work on value histograms: rows are counted by value first, so what
is ranked is one row a distinct value, written once.  Ranks over the distinct
values are running sums within ranges of them plus the ranges' offsets; no
window spans the whole table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelab.functions.tables import running, written


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """kappa of two label columns; 1 or 0 where chance agreement is complete; null without rows."""
    pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("n").alias("na"), F.lit(0).alias("nb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same")), F.struct(F.col("b").alias("v"), F.lit(0).alias("na"), F.col("n").alias("nb"), F.lit(0).alias("same")))).alias("x"))
    by = sides.groupBy("x.v").agg(F.sum("x.na").alias("na"), F.sum("x.nb").alias("nb"), F.sum("x.same").alias("same"))
    s = by.agg(F.sum("na").alias("n"), F.sum("same").alias("same"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("by_chance"))
    po, pe = F.col("same") / F.col("n"), F.col("by_chance") / (F.col("n").cast("double") * F.col("n"))
    return s.filter("n > 0").select(F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def quadratic_weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Weights are squared distances of level numbers; 1 with one level or no expected disagreement."""
    pairs = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = written(pairs)
    levels = written(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("one", F.lit(1)))
    levels = running(levels, [], ["v"], ["one"]).select("v", F.col("before_one").cast("double").alias("i"))
    numbered = pairs.join(levels.toDF("a", "i"), "a").join(levels.toDF("b", "j"), "b")
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    s = numbered.agg(F.sum(n).cast("double").alias("t"), F.sum(n * (i - j) * (i - j)).alias("seen"), F.sum(n * i * i).alias("ii"), F.sum(n * j * j).alias("jj"), F.sum(n * i).alias("si"), F.sum(n * j).alias("sj"))
    expected = F.col("ii") + F.col("jj") - 2 * F.col("si") * F.col("sj") / F.col("t")
    return s.filter("t > 0").select(F.when(expected <= 1e-12, 1.0).otherwise(1 - F.col("seen") / expected).alias("qwk"))


def histogram(df: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None, **sums: Column) -> DataFrame:
    """One row a distinct value (of each ``by``): value, n, before (rows of smaller value) and the named sums, with ``before_<name>``."""
    by = by or []
    rows = df.select(*by, F.col(value).cast("double").alias("value"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"), *[c.alias(k) for k, c in sums.items()]).filter("value IS NOT NULL")
    counts = written(rows.groupBy(*by, "value").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums]))
    return running(counts, by, ["value"], ["n", *sums]).withColumnRenamed("before_n", "before")


def midranks(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, midrank): 1-based average ranks under ties."""
    return histogram(df, value, weight=weight).select("value", (F.col("before") + (F.col("n") + 1) / 2).alias("midrank"))


def pearson(df: DataFrame, x: str, y: str) -> Column:
    """An aggregate expression: 0 for under two rows or a constant side."""
    return F.when((F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()) < 2) | (F.var_pop(x) == 0) | (F.var_pop(y) == 0), 0.0).otherwise(F.covar_pop(x, y) / F.sqrt(F.nullif(F.var_pop(x) * F.var_pop(y), F.lit(0.0))))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    pairs = written(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n")))
    ranked = pairs.join(midranks(pairs, "x", "n").toDF("x", "rx"), "x").join(midranks(pairs, "y", "n").toDF("y", "ry"), "y")
    w, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    s = ranked.agg(F.sum(w).cast("double").alias("t"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * ry).alias("xy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy"))
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / F.col("t"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("t")
    return s.filter("t > 0").select(F.when((F.col("t") < 2) | (vx <= 1e-9) | (vy <= 1e-9), 0.0).otherwise((F.col("xy") - F.col("sx") * F.col("sy") / F.col("t")) / F.sqrt(F.nullif(vx * vy, F.lit(0.0)))).alias("spearman"))


def mean_absolute_error(x: str, y: str) -> Column:
    return F.avg(F.abs(F.col(x) - F.col(y)))


def within_tolerance(x: str, y: str, tolerance: float = 1.0) -> Column:
    return F.avg((F.abs(F.col(x) - F.col(y)) <= tolerance).cast("double"))


def agreement_summary(df: DataFrame, judge: str, human: str) -> DataFrame:
    """n, spearman, mae, within_1, kappa on scores rounded half to even."""
    pairs = written(df.select(F.col(judge).cast("double").alias("j"), F.col(human).cast("double").alias("h")).dropna())
    basic = pairs.agg(F.count("*").alias("n"), mean_absolute_error("j", "h").alias("mae"), within_tolerance("j", "h").alias("within_1"))
    whole = pairs.select(F.rint("j").cast("int").alias("j"), F.rint("h").cast("int").alias("h"))
    parts = [basic, spearman(pairs, "j", "h"), cohen_kappa(whole, "j", "h")]
    out = parts[0].withColumn("__k", F.lit(0))
    for p in parts[1:]:  # one-row tables side by side
        out = out.join(p.withColumn("__k", F.lit(0)), "__k", "left")
    return out.select("n", "spearman", "mae", "within_1", "kappa")


def ols(x: str, y: str) -> tuple[Column, Column]:
    """Slope and intercept as aggregate expressions; a constant x gives (0, mean y)."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0)), F.coalesce(F.regr_intercept(y, x), F.avg(y))


def paired_effect(delta: str) -> Column:
    """(positive - negative) / all, zeros included below."""
    return F.avg(F.signum(F.col(delta)))


def cliffs_delta(df: DataFrame, side: str, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Mean sign of x - y over all pairs, from one histogram of both sides."""
    h = histogram(df, value, nx=(F.col(side) == x).cast("long"), ny=(F.col(side) == y).cast("long"))
    s = h.agg(F.sum("nx").alias("tx"), F.sum("ny").alias("ty"), F.sum(F.col("nx").cast("double") * (2 * F.col("before_ny") + F.col("ny"))).alias("twice"))
    return s.filter("tx > 0 AND ty > 0").select(((F.col("twice") - F.col("tx").cast("double") * F.col("ty")) / (F.col("tx").cast("double") * F.col("ty"))).alias("cliffs_delta"))


EXACT_N = 16


def erf(x: Column) -> Column:
    """Error function of x from 0 to 6, as a series of positive terms; 1 beyond."""
    step = lambda s, k: F.struct((s["t"] * 2 * x * x / (2 * k + 1)).alias("t"), (s["sum"] + s["t"] * 2 * x * x / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(x.cast("double").alias("t"), x.cast("double").alias("sum")), step, lambda s: s["sum"])
    return F.when(x > 6, 1.0).otherwise(F.least(F.lit(1.0), 2 / math.sqrt(math.pi) * F.exp(-x * x) * series))


def normal_sf(z: Column) -> Column:
    """P(Z > z) of a standard normal law, for z from 0."""
    return 0.5 * (1 - erf(z / math.sqrt(2)))


def _sign_p(ranks: Column, w_plus: Column) -> Column:
    """Two-sided p of the rank sum over all sign assignments: ways to reach every doubled sum, rank by rank."""
    top = EXACT_N * (EXACT_N + 1)
    none = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.transform(ranks, lambda r: (2 * r).cast("int")), none, lambda acc, r: F.transform(acc, lambda x, s: x + F.when(s >= r, F.get(acc, s - r)).otherwise(0.0)))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    at = (2 * w_plus).cast("int")
    tail = F.transform(F.array(ways), lambda w: F.least(total(F.slice(w, at + 1, F.lit(top + 1))), total(F.slice(w, 1, at + 1))))
    return F.least(F.lit(1.0), 2 * tail[0] / F.pow(F.lit(2.0), F.size(ranks)))


def wilcoxon(df: DataFrame, delta: str, by: list[str] | None = None, exact_max_n: int = EXACT_N) -> DataFrame:
    """(by,) n, w_plus, variance (with ties), z, p_value and method of the signed ranks of the non-zero deltas.

    Groups of at most ``exact_max_n`` (``EXACT_N`` at most) deltas have the exact law, larger ones the normal one.
    """
    keys = by or ["__all"]
    src = df if by else df.withColumn("__all", F.lit(0))
    used = src.select(*keys, F.col(delta).alias("d")).filter("d IS NOT NULL").withColumn("m", F.abs("d"))
    h = histogram(used.filter("d <> 0").withColumn("up", (F.col("d") > 0).cast("long")), "m", keys, up=F.col("up"))
    n, rank = F.col("n").cast("double"), F.col("before") + (F.col("n") + 1) / 2
    few = (F.col("before") < exact_max_n)  # the ranks of a small group; of a large one they aren't used
    ranks = F.flatten(F.collect_list(F.when(few & (F.col("n") <= exact_max_n), F.array_repeat(rank, F.col("n").cast("int")))))
    s = h.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("up") * rank).alias("w_plus"), F.sum(n * n * n - n).alias("ties"), ranks.alias("ranks"))
    t = F.col("n").cast("double")
    s = s.select(*keys, "n", "w_plus", (t * (t + 1) * (2 * t + 1) / 24 - F.col("ties") / 48).alias("variance"), "ranks")
    s = s.withColumn("z", (F.col("w_plus") - t * (t + 1) / 4) / F.nullif(F.sqrt("variance"), F.lit(0.0)))
    normal = F.when(F.col("variance") <= 0, (F.col("w_plus") == t * (t + 1) / 4).cast("double")).otherwise(F.least(F.lit(1.0), 2 * normal_sf(F.abs("z"))))
    exact = F.col("n") <= exact_max_n
    s = s.withColumn("p_value", F.when(exact, _sign_p(F.col("ranks"), F.col("w_plus"))).otherwise(normal)).withColumn("method", F.when(exact, "exact").otherwise("normal")).drop("ranks")
    if by:
        return s
    one = df.sparkSession.range(1).select(F.lit(0).alias("__all")).join(s, "__all", "left")  # one row also without deltas
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("variance", F.lit(0.0)).alias("variance"), "z", F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.coalesce("method", F.lit("none")).alias("method"))


def wilcoxon_test(df: DataFrame, delta: str, exact_max_n: int = EXACT_N) -> dict:
    """statistic, p_value, n, method of one sample."""
    r = wilcoxon(df, delta, exact_max_n=exact_max_n).first()
    return {"statistic": r["w_plus"], "p_value": r["p_value"], "n": r["n"], "method": r["method"]}


def draw(seed: int, *parts: Column, place: int = 0) -> Column:
    """A uniform 32-bit whole number from the MD5 of the parts (its ``place``-th eight digits); the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1 + 8 * place, 8), 16, 10).cast("long")


#: Counts up to this are drawn from the exact Poisson law.
EXACT_COUNT = 32
_ODD = np.uint32(0x9E3779B9)


def _fmix(h: np.ndarray) -> np.ndarray:
    """A bijective 32-bit finaliser."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


@lru_cache(maxsize=EXACT_COUNT)
def _poisson_steps(c: int) -> np.ndarray:
    """P(Poisson(c) <= k) for k = 0, 1, ... 4 c + 16."""
    k = np.arange(4 * c + 17)
    return np.cumsum(np.exp(k * math.log(c) - c - np.array([math.lgamma(i + 1) for i in k])))


def poisson_times(key: tuple[int, int], count: float, n_resamples: int) -> np.ndarray:
    """How often a value of this count is drawn in each resample; ``key``: two 32-bit numbers that stand for the value."""
    r, a, b = np.arange(n_resamples, dtype=np.uint32) * _ODD, np.uint32(key[0]), np.uint32(key[1])
    u1 = (_fmix(_fmix(r + a) ^ b) + 0.5) / 4294967296.0
    if count <= EXACT_COUNT:
        return np.searchsorted(_poisson_steps(int(count)), u1, side="right").astype(np.float64)
    u2 = (_fmix(_fmix(r + b) ^ a) + 0.5) / 4294967296.0
    z = np.sqrt(-2 * np.log(u1)) * np.cos(2 * math.pi * u2)
    # Square-root transform: (sqrt(c - 1 / 4) + z / 2) ** 2 has mean c and a variance close to it.
    return np.maximum(0.0, np.rint((math.sqrt(count - 0.25) + z / 2) ** 2))


def _resampled_sums(seed: int, n_resamples: int, most_groups: int = 256):
    """Partial sums of a partition's values (g, d, c): for each group and resample, the draws and their sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names, rows = [*held], np.stack([*held.values()]) if held else np.zeros((0, 2, n_resamples))
            held.clear()
            kind = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*rows[:, 0]], kind), pa.array([*rows[:, 1]], kind)], ["g", "t", "s"])

        for b in batches:
            d = b.column("d").to_numpy() + 0.0  # one zero
            for g, x, bits, c in zip(b.column("g").to_pylist(), d.tolist(), d.view(np.int64).tolist(), b.column("c").to_pylist(), strict=True):
                digest = hashlib.md5(f"{seed}|{g}|{bits}".encode()).digest()
                times = poisson_times((int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")), c, n_resamples)
                if g not in held:
                    if len(held) >= most_groups:
                        yield out()
                    held[g] = np.zeros((2, n_resamples))
                held[g][0] += times
                held[g][1] += times * x
        yield out()

    return sums


def bootstrap_ci(df: DataFrame, delta: str, n_resamples: int = 2000, confidence: float = 0.95, seed: int = 0, by: str | None = None) -> DataFrame:
    """(by,) n, mean, ci_low, ci_high: percentile interval of resampled means.

    A resample of n rows is a Poisson bootstrap: each distinct delta of count c
    is drawn Poisson(c) times, by hashes of (seed, group, all bits of the delta,
    resample), so unlike deltas are drawn independently however close they are,
    and results can be replayed.  That law agrees with drawing n rows with
    replacement as n grows.  A partition's values are summed into one vector of
    ``n_resamples`` draws a group: what is shuffled afterwards depends on the
    partitions, not on the rows.
    """
    key = by or "__all"
    src = df.select((F.col(by) if by else F.lit("all")).alias(key), (F.col(delta).cast("double") + 0.0).alias("d")).filter("d IS NOT NULL")
    counts = written(src.groupBy(key, "d").agg(F.count("*").cast("double").alias("c")))
    values = counts.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("g"), "d", "c").repartition(2 * df.sparkSession.sparkContext.defaultParallelism)  # few rows, much work each
    part = values.mapInArrow(_resampled_sums(seed, n_resamples), "g string, t array<double>, s array<double>")
    each = part.select("g", F.posexplode(F.arrays_zip("t", "s")).alias("r", "x")).groupBy("g", "r").agg(F.sum("x.t").alias("t"), F.sum("x.s").alias("s"))
    means = each.filter("t > 0").select("g", (F.col("s") / F.col("t")).alias("m"))
    tail = (1 - confidence) / 2
    ci = means.groupBy("g").agg(F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1 - tail)).alias("ci_high"))
    whole = counts.groupBy(key).agg(F.sum("c").cast("long").alias("n"), (F.sum(F.col("c") * F.col("d")) / F.sum("c")).alias("mean"))
    out = whole.withColumn("g", F.coalesce(F.col(key).cast("string"), F.lit(""))).join(ci, "g", "left").drop("g")
    return out if by else out.drop(key)
