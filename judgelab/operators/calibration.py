"""Judge bias and the labelling queue."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgelab.functions.tables import running, written
from judgelab.functions.text import tokens
from judgelab.operators import isotonic, stats
from judgelab.operators.stats import draw, ols, pearson


def verbosity_ols(df: DataFrame, score: str, length: str) -> DataFrame:
    """n, slope, intercept, r of score on length."""
    pts = df.select(F.col(length).cast("double").alias("x"), F.col(score).cast("double").alias("y")).dropna()
    slope, intercept = ols("x", "y")
    return pts.agg(F.count("*").alias("n"), slope.alias("slope"), intercept.alias("intercept"), pearson(pts, "x", "y").alias("r"))


#: Permutations that one pair of random orders gives; rows of a block of such orders.
LAGS, BLOCK_ROWS = 125, 65536


def _lagged_products(lags: int):
    """Sums of x[k] * y[k + lag] over a block's rows (j, x, y); its last lags - 1 rows have the next block's y alone."""

    def sums(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("j")
        y, x = t["y"].to_numpy(), t["x"].drop_null().to_numpy()
        return pa.table({"o": np.full(lags, key[0].as_py()), "lag": np.arange(lags), "t": np.correlate(y, x, "valid")})

    return sums


def permuted_products(pts: DataFrame, n: int, n_permutations: int, seed: int, lags: int = LAGS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(o, lag, t): the sum of x * y under ``n_permutations`` random pairings of ``pts`` (i, x, y, one).

    x and y are put into two independent random orders (by hashes of seed and
    id), and the k-th x meets the (k + lag)-th y, cyclically: each such pairing
    is a uniformly random permutation.  One pair of orders gives ``lags`` of
    them, so the rows written don't grow with the number of permutations beyond
    n_permutations / lags.  A block's products are sums over two slices.
    """
    lags = min(lags, n)
    orders, blocks = -(-n_permutations // lags), max(1, n // block_rows)
    each = pts.select("i", "x", "y", "one", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("o"))

    def placed(side: str) -> DataFrame:
        keyed = written(each.select("o", "i", side, "one", draw(seed, F.lit(side), F.col("o"), F.col("i")).alias("d")))
        return running(keyed, ["o"], ["d", "i"], ["one"]).select("o", F.col("before_one").alias("k"), side)

    met = placed("x").join(placed("y"), ["o", "k"])
    block = F.expr(f"((k + 1) * {blocks} - 1) div {n}")
    met = met.withColumn("b", block).withColumn("j", F.expr(f"k - (b * {n}) div {blocks}"))
    before = F.expr(f"pmod(b - 1, {blocks})")
    size = F.expr(f"((pmod(b - 1, {blocks}) + 1) * {n}) div {blocks} - (pmod(b - 1, {blocks}) * {n}) div {blocks}")
    halo = met.filter(F.col("j") < lags - 1).select("o", before.alias("b"), (F.col("j") + size).alias("j"), F.lit(None).cast("double").alias("x"), "y")
    parts = met.select("o", "b", "j", "x", "y").unionByName(halo).groupBy("o", "b").applyInArrow(_lagged_products(lags), "o long, lag long, t double")
    return parts.filter(F.col("o") * lags + F.col("lag") < n_permutations).groupBy("o", "lag").agg(F.sum("t").alias("t"))


#: Scores that one permutation puts into a bucket, about.
BUCKET = 1000


def _drawn(seed: int, n_permutations: int, buckets: int, at_once: int = 1000):
    """Of every row (i, a, y) and permutation the draw (32 bits of an MD5, see :func:`draw`), packed by the bucket it falls in."""
    starts = [f"{seed}|{p}|".encode() for p in range(1, n_permutations + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, at_once):
                b = whole.slice(lo, at_once)
                ids = [i.encode() for i in b.column("i").to_pylist()]
                d = np.frombuffer(b"".join([hashlib.md5(s + i).digest() for s in starts for i in ids]), dtype=">u4")[::4].astype(np.uint32)
                p = np.repeat(np.arange(n_permutations, dtype=np.uint32), len(ids))
                a, y = np.tile(b.column("a").to_numpy(), n_permutations), np.tile(b.column("y").to_numpy(), n_permutations)
                bucket = (d.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                parts = [order[cut[k] : cut[k + 1]] for k in some]
                columns = [pa.array([x[o].tobytes() for o in parts], pa.binary()) for x in (p, d, a, y)]
                yield pa.RecordBatch.from_arrays([pa.array(some), *columns], names=["b", "p", "d", "a", "y"])

    return run


def _in_order(key: tuple, t: pa.Table) -> pa.Table:
    """A bucket's scores of each permutation, by draw (ties by place)."""
    p, d, a, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=k) for c, k in (("p", np.uint32), ("d", np.uint32), ("a", np.int64), ("y", np.float64)))
    order = np.lexsort((a, d, p))
    kinds, n = np.unique(p, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(y[order]))
    return pa.table({"b": np.full(len(kinds), key[0].as_py()), "p": kinds.astype(np.int64), "n": n, "y": lists})


def _met(scores: pa.Table, lengths: pa.Table) -> pa.Table:
    """Sums of x * y of a bucket by permutation: its scores begin at the place in ``starts``, ``x`` at place ``least``."""
    least, starts, x = lengths["least"][0].as_py(), dict(lengths["starts"][0].as_py()), lengths["x"][0].values.to_numpy()
    p, n, y = scores["p"].to_numpy(), scores["n"].to_numpy(), scores["y"].combine_chunks().flatten().to_numpy()
    start = np.array([starts[k] for k in p.tolist()])
    at = np.repeat(start - least - (np.cumsum(n) - n), n) + np.arange(len(y))
    return pa.table({"p": p, "t": np.bincount(np.repeat(np.arange(len(n)), n), x[at] * y, len(n))})


def shuffled_products(pts: DataFrame, n: int, n_permutations: int, seed: int, bucket_rows: int = BUCKET) -> DataFrame:
    """(p, t): the sum of x * y under ``n_permutations`` independent random permutations of ``pts`` (i, x, y, one).

    A permutation orders the scores by hashes of (seed, permutation, id); the
    k-th of them meets the k-th length by id.  Hashes are even, so their first
    bits make buckets of about ``bucket_rows`` scores a permutation: a task
    orders one bucket of all permutations, the buckets' counts give its places,
    and only the lengths of these places are sent to it.
    """
    buckets = max(1, n // bucket_rows)
    placed = written(running(pts, [], ["i"], ["one"]).select("i", F.col("before_one").alias("a"), "x", "y"))
    tasks = max(2 * pts.sparkSession.sparkContext.defaultParallelism, n // 20_000)  # few rows, much work each
    drawn = placed.select("i", "a", "y").repartition(tasks).mapInArrow(_drawn(seed, n_permutations, buckets), "b long, p binary, d binary, a binary, y binary")
    ordered = written(drawn.groupBy("b").applyInArrow(_in_order, "b long, p long, n long, y array<double>"))
    earlier = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = ordered.select("b", "p", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    starts = written(starts.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("p", "start"))).alias("starts"), F.min("start").alias("lo"), F.max(F.col("start") + F.col("n") - 1).alias("hi")))
    piece = lambda c: F.floor(F.col(c) / bucket_rows)
    pieces = placed.groupBy(piece("a").alias("k")).agg(F.array_sort(F.collect_list(F.struct("a", "x"))).alias("rows"))
    wanted = starts.select("b", F.explode(F.sequence(piece("lo"), piece("hi"))).alias("k")).join(pieces, "k")
    rows = wanted.groupBy("b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "rows"))), lambda k: k["rows"])).alias("rows"))
    lengths = starts.join(rows, "b").select("b", "starts", F.get("rows", 0)["a"].alias("least"), F.transform("rows", lambda r: r["x"]).alias("x"))
    return ordered.groupBy("b").cogroup(lengths.groupBy("b")).applyInArrow(_met, "p long, t double").groupBy("p").agg(F.sum("t").alias("t"))


def verbosity_permutation(df: DataFrame, id_col: str, score: str, length: str, n_permutations: int = 999, seed: int = 0, alpha: float = 0.05, lags: int = 1) -> DataFrame:
    """n, slope, p_value, significant: two-sided permutation test of the slope.

    Every permutation is drawn by itself (see :func:`shuffled_products`); with
    ``lags`` over 1, that many are read off one pair of random orders (see
    :func:`permuted_products`).
    """
    pts = df.select(F.col(id_col).cast("string").alias("i"), F.col(length).cast("double").alias("x"), F.col(score).cast("double").alias("y"), F.lit(1).alias("one")).dropna()
    pts = written(pts)
    s = pts.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx")).first()
    if s["n"] < 3:
        raise ValueError("verbosity bias needs 3 scored items or more")
    n, spread = s["n"], s["n"] * s["xx"]
    slope = s["xy"] / s["xx"] if s["xx"] else 0.0
    centred = pts.select("i", (F.col("x") - s["mx"]).alias("x"), (F.col("y") - s["my"]).alias("y"), "one")
    products = permuted_products(centred, n, n_permutations, seed, lags) if lags > 1 else shuffled_products(written(centred), n, n_permutations, seed)
    slopes = products.select((F.col("t") / spread if spread else F.lit(0.0)).alias("s"))
    p = (F.count_if(F.abs("s") >= abs(slope) - (1e-12 if lags > 1 else 1e-15) * max(1.0, abs(slope))) + 1) / F.lit(float(n_permutations + 1))
    return slopes.agg(F.lit(n).cast("long").alias("n"), F.lit(slope).alias("slope"), p.alias("p_value"), (p < alpha).alias("significant"))


def self_preference(labels: DataFrame) -> DataFrame:
    """n_comparable, n_flagged, rate from judge_family, a_family, b_family and preferred; side a where both match."""
    own = F.when(F.col("judge_family") == F.col("a_family"), "a").when(F.col("judge_family") == F.col("b_family"), "b")
    sides = labels.filter(F.col("preferred").isin("a", "b") & (F.coalesce("judge_family", F.lit("")) != "")).select("preferred", own.alias("own"))
    n, flagged = F.count("own"), F.count_if(F.col("preferred") == F.col("own"))
    return sides.agg(n.alias("n_comparable"), flagged.alias("n_flagged"), F.coalesce(flagged / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("rate"))


def priority(labels: DataFrame, disagreement: DataFrame | None = None, weight_gap: float = 0.7, weight_disagreement: float = 0.3) -> DataFrame:
    """``labels`` (item_id, judge_score, human_score) with priority; an unscored item has the full gap."""
    if abs(weight_gap + weight_disagreement - 1) > 1e-9:
        raise ValueError("the weights must sum to 1")
    gap = F.when(F.col("judge_score").isNull() | F.col("human_score").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("judge_score") - F.col("human_score")) / 5))
    out = labels.join(disagreement.select("item_id", "disagreement"), "item_id", "left") if disagreement is not None else labels.withColumn("disagreement", F.lit(0.0))
    spread = F.least(F.lit(1.0), F.coalesce("disagreement", F.lit(0.0)) / 5)
    return out.withColumn("priority", weight_gap * gap + weight_disagreement * spread)


def next_round(labels: DataFrame, k: int = 10, **options) -> DataFrame:
    """The k items to label next: highest priority first, then by id (a top-k, not a full sort)."""
    return priority(labels, **options).orderBy(F.desc("priority"), "item_id").limit(k)


def summarize_bias(labels: DataFrame, pairwise: DataFrame | None = None, n_permutations: int = 999) -> DataFrame:
    """One row: position_bias_rate (null without pairwise verdicts), verbosity slope, r and p (null under three scored
    items), self-preference counts.  ``labels`` has item_id, prompt, response_a, judge_score, judge_family, a_family,
    b_family, preferred; an item's length is in words of response_a, or of the prompt where that is blank.
    """
    words = F.size(tokens(F.when(F.trim(F.coalesce("response_a", F.lit(""))) != "", F.col("response_a")).otherwise(F.coalesce("prompt", F.lit("")))))
    scored = written(labels.select("item_id", "judge_score", words.alias("length")).filter("judge_score IS NOT NULL"))
    out = self_preference(labels).withColumn("__k", F.lit(0))
    if scored.count() >= 3:
        tests = (verbosity_ols(scored, "judge_score", "length").select("slope", "r"), verbosity_permutation(scored, "item_id", "judge_score", "length", n_permutations, lags=LAGS).select("p_value", "significant"))
        for t in tests:
            out = out.join(t.withColumn("__k", F.lit(0)), "__k")
    else:
        out = out.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("slope", "double"), ("r", "double"), ("p_value", "double"), ("significant", "boolean"))])
    rate = pairwise.agg(F.avg(F.col("position_bias").cast("double")).alias("position_bias_rate")) if pairwise is not None else labels.sparkSession.range(1).select(F.lit(None).cast("double").alias("position_bias_rate"))
    out = out.join(rate.withColumn("__k", F.lit(0)), "__k")
    return out.select("position_bias_rate", F.col("slope").alias("verbosity_slope"), F.col("r").alias("verbosity_r"), F.col("p_value").alias("verbosity_p"), "significant", "n_comparable", "n_flagged", "rate")


def calibration_report(labels: DataFrame, order: str, pairwise: DataFrame | None = None, n_permutations: int = 999) -> DataFrame:
    """One row of what a calibration found: n, spearman, mae, within_1, kappa, n_blocks of the isotonic fit, the bias
    figures of :func:`summarize_bias`, and an array of advice.  Raises with fewer than two labels that have both scores."""
    paired = written(labels.filter("judge_score IS NOT NULL AND human_score IS NOT NULL"))
    if paired.count() < 2:
        raise ValueError("calibration needs two labels or more with both scores")
    agreement = stats.agreement_summary(paired, "judge_score", "human_score").withColumn("__k", F.lit(0))
    blocks = isotonic.fit(paired, "judge_score", "human_score", order).agg(F.count("*").alias("n_blocks")).withColumn("__k", F.lit(0))
    bias = summarize_bias(labels, pairwise, n_permutations).select("position_bias_rate", "verbosity_slope", "verbosity_p", F.col("significant").alias("verbosity_significant"), F.col("rate").alias("self_preference_rate"), F.lit(0).alias("__k"))
    return isotonic.advised(agreement.join(blocks, "__k").join(bias, "__k").drop("__k"))
