"""Column builders for tokens, n-grams, overlap and text degradation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English function words that carry no content.
STOP_WORDS = (
    "the a an and or of to in on for with is are was were be been it this that as at by from you your we our i they their "
    "he she his her its not no do does did but if then than so such can could should would will shall may might must have "
    "has had about into over under out up down what which who whom how when where why all any both each few more most other "
    "some only own same too very just there here"
).split()

TOKEN = r"[\p{L}\p{N}_']+"
#: Characters that Unicode calls white space, as a Java character class body.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, although lambdas read it."""
    return F.get(F.transform(F.array(value), body), 0)


def tokens(text: Column | str) -> Column:
    """Lower-cased words in text order; null becomes no words."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0), F.array().cast("array<string>"))


def content_tokens(text: Column | str) -> Column:
    """Words of three characters or more that aren't stop words, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def normalize(text: Column | str) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    c = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.regexp_replace(F.lower(c), f"[{SPACE}]+", " "))


def is_blank(text: Column) -> Column:
    return text.rlike(f"^[{SPACE}]*$")


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined by spaces; none for n < 1 or too few words."""
    none = F.array().cast("array<string>")
    if n < 1:
        return none
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none))


def keyword_coverage(keywords: Column, words: Column) -> Column:
    """Share of the keywords (repeats count) that are among the words; 0 without keywords."""
    return let(F.struct(keywords.alias("k"), F.array_distinct(words).alias("w")), lambda x: F.when(F.size(x["k"]) == 0, 0.0).otherwise(F.size(F.filter(x["k"], lambda k: F.array_contains(x["w"], k))) / F.size(x["k"])))


def f1_each(texts: Column, reference: Column | str) -> Column:
    """F1 of the word multisets of each of ``texts`` (an array) and of ``reference``; 0 if either has none.

    Words become 63-bit hashes whose last bit tells the side; sorted together,
    equal words follow each other and one pass counts what both have.  So a row
    is never shuffled, and a long text costs no more than its sorting.
    """
    side = lambda words, bit: F.transform(words, lambda w: F.shiftleft(F.xxhash64(w), 1) + bit)
    state = lambda last, run, met: F.struct(last.alias("last"), run.alias("run"), met.alias("met"))
    long = lambda x: F.lit(x).cast("long")

    def step(s: Column, w: Column) -> Column:
        """``run``: words of the left side that wait for a partner, among the equal ones so far."""
        word, right_side, met = F.shiftright(w, 1), w.bitwiseAND(F.lit(1)) == 1, (F.shiftright(w, 1) == s["last"]) & (s["run"] > 0)
        waiting = F.when(word == s["last"], s["run"]).otherwise(long(0))
        return state(word, F.when(~right_side, waiting + 1).otherwise(F.greatest(waiting - 1, long(0))), s["met"] + F.when(right_side & met, long(1)).otherwise(long(0)))

    def f1(a: Column, b: Column) -> Column:
        shared = F.aggregate(F.sort_array(F.concat(a, b)), state(long(0), long(0), long(0)), step, lambda s: s["met"])
        return F.when((F.size(a) == 0) | (F.size(b) == 0) | a.isNull() | b.isNull(), 0.0).otherwise(2 * shared / (F.size(a) + F.size(b)))

    return let(side(tokens(reference), 1), lambda b: F.transform(texts, lambda t: let(side(tokens(t), 0), lambda a: f1(a, b))))


def f1_column(left: str, right: str) -> Column:
    """F1 of two text columns' word multisets (see :func:`f1_each`)."""
    return F.get(f1_each(F.array(F.col(left)), right), 0)


def f1_overlap(df: DataFrame, id_col: str, left: str, right: str, out: str = "f1") -> DataFrame:
    """(id, out): :func:`f1_column` of the two texts."""
    return df.select(id_col, f1_column(left, right).alias(out))


def degrade_each(text: Column, qualities: list[float]) -> Column:
    """The text once for each quality, which is the probability that a word stays; draws are hashes of the text's start and
    the word's place, and are made once for all qualities."""
    bounds = [f"{math.ceil(min(1.0, max(0.0, q)) * 4294967296):08x}" for q in qualities]  # of the digest's first eight digits, which are compared as text

    def drawn(x: Column) -> Column:
        return let(F.transform(x["words"], lambda w, i: F.sha2(F.concat(x["head"], F.lit("|"), i.cast("string")), 256)), lambda d: F.array(*[kept(x["words"], d, q, b) for q, b in zip(qualities, bounds, strict=True)]))

    def kept(words: Column, digests: Column, q: float, bound: str) -> Column:
        if q >= 1.0:
            return F.array_join(words, " ")
        return let(F.filter(words, lambda w, i: F.get(digests, i) < bound), lambda k: F.array_join(F.when(F.size(k) > 0, k).otherwise(F.slice(words, 1, 1)), " "))

    return let(F.struct(F.split(text, " ", -1).alias("words"), F.substring(text, 1, 32).alias("head")), drawn)


def degrade(text: Column, quality: float) -> Column:
    """Keep each word with probability ``quality`` (see :func:`degrade_each`)."""
    return text if quality >= 1.0 else F.get(degrade_each(text, [quality]), 0)


def _kept_share(bounds: list[int]):
    """F1 for each bound from a text's start and marks: 1 for a token, a space between words, anything else."""

    def digests(start: bytes, ends: list[bytes]) -> Iterator[bytes]:
        begun = hashlib.sha256(start)
        for end in ends:
            h = begun.copy()
            h.update(end)
            yield h.digest()

    def f1(head: pa.Array, marks: pa.Array) -> pa.Array:
        out, places = [], []
        for start, m in zip(head.to_pylist(), marks.to_pylist(), strict=True):
            if m is None:
                out.append([0.0] * len(bounds))
                continue
            m = np.frombuffer(m, dtype=np.uint8)
            word = np.cumsum(m == 32)
            n = int(word[-1]) + 1 if len(m) else 1
            found = np.bincount(word[m == 1], minlength=n)
            places += [b"|%d" % i for i in range(len(places), n)]
            drawn = np.frombuffer(b"".join(digests(start, places[:n])), dtype=">u4")[::8]
            every, scores = int(found.sum()), []
            for b in bounds:
                stays = drawn < b
                kept = int(found[stays].sum()) if stays.any() else int(found[0])
                scores.append(2 * kept / (kept + every) if kept else 0.0)
            out.append(scores)
        return pa.array(out, pa.list_(pa.float64()))

    return f1


def degraded_f1_each(text: Column, qualities: list[float]) -> Column:
    """``f1_each(degrade_each(text, qualities), text)``, from one pass over the text.

    A token never spans a space, so a degraded text has the tokens of the words
    it keeps, and all of them are among the text's own: what both share is what
    was kept.  So the text is tokenised once, and its words are counted and drawn
    in Arrow batches.
    """
    bounds = [math.ceil(min(1.0, max(0.0, q)) * 4294967296) for q in qualities]
    marks = F.regexp_replace(F.replace(F.lower(text), F.lit("\x01"), F.lit(".")), TOKEN, "\x01")
    return F.arrow_udf(_kept_share(bounds), "array<double>")(F.substring(text, 1, 32).cast("binary"), marks.cast("binary"))


def slug(text: Column) -> Column:
    """Letters and digits of any script, a dash for every other character, none at the ends, then 40 characters at most."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "-"), F.lit("-")), 1, 40)


def hash_embedding(df: DataFrame, id_col: str, text: str, width: int = 256) -> DataFrame:
    """(id, bucket, weight): counts of words and neighbouring pairs by SHA-1 bucket, as a unit vector."""
    features = let(tokens(text), lambda w: F.concat(w, ngrams(w, 2)))
    bucket = F.pmod(F.conv(F.right(F.sha1("f"), F.lit(7)), 16, 10).cast("long"), F.lit(width))
    counts = df.select(id_col, F.explode(features).alias("f")).groupBy(id_col, bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    norm = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, id_col).select(id_col, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def hash_similarity(left: str, right: str, width: int = 256) -> Column:
    """Cosine of two text columns' hash embeddings, to six places; 0 where either has no features.

    The buckets of both sides are sorted together, so that one pass over the row
    sums what they share; nothing is shuffled.
    """

    def side(text: str, bit: int) -> Column:
        features = let(tokens(text), lambda w: F.concat(w, ngrams(w, 2)))
        return F.transform(F.coalesce(features, F.array().cast("array<string>")), lambda f: F.shiftleft(F.pmod(F.conv(F.right(F.sha1(f), F.lit(7)), 16, 10).cast("long"), F.lit(width)), 1) + bit)

    zero = F.lit(0.0)
    state = lambda last, a, b, ab, aa, bb: F.struct(last.alias("last"), a.alias("a"), b.alias("b"), ab.alias("ab"), aa.alias("aa"), bb.alias("bb"))
    closed = lambda s: (s["ab"] + s["a"] * s["b"], s["aa"] + s["a"] * s["a"], s["bb"] + s["b"] * s["b"])

    def step(s: Column, x: Column) -> Column:
        """``a``, ``b``: how often each side has the bucket of the run at hand."""
        bucket, one, other = F.shiftright(x, 1), F.when(x.bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(0.0), F.when(x.bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(0.0)
        same = bucket == s["last"]
        sums = [F.when(same, old).otherwise(new) for old, new in zip((s["ab"], s["aa"], s["bb"]), closed(s), strict=True)]
        return state(bucket, F.when(same, s["a"]).otherwise(zero) + one, F.when(same, s["b"]).otherwise(zero) + other, *sums)

    def ended(s: Column) -> Column:
        return let(F.struct(*[c.alias(n) for n, c in zip(("ab", "aa", "bb"), closed(s), strict=True)]), lambda x: F.round(F.coalesce(x["ab"] / F.nullif(F.sqrt(x["aa"]) * F.sqrt(x["bb"]), zero), zero), 6))

    both = F.sort_array(F.concat(side(left, 0), side(right, 1)))
    return F.aggregate(both, state(F.lit(-1).cast("long"), zero, zero, zero, zero, zero), step, ended)


def cosine(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """(id, similarity) of two tables of unit vectors, for the ids of either; 0 where they don't meet."""
    ids = left.select(id_col).union(right.select(id_col)).distinct()
    dot = left.join(right.withColumnRenamed("weight", "other"), [id_col, "bucket"]).groupBy(id_col).agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    return ids.join(dot, id_col, "left").select(id_col, F.round(F.coalesce("dot", F.lit(0.0)), 6).alias("similarity"))
