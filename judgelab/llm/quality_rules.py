"""Quality rules: a threshold table compiled into Spark projections (operator 7).

Every figure is a built-in expression over one row, so the plan is a scan and
projections: no shuffle, no user function, no state.

Defined results: a null or blank text has no words, all counts 0, and fails;
ties and repeated rows are judged one by one; an empty table gives an empty
result; columns of the input that clash with a figure's name are not read.
Five-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.llm.common import table

WINDOW = 5
_BLANK = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as by this are at from be or an "
    "de la le et les des en un une est que dans qui au pour pas sur du "
    "der die und das den von zu mit ist im für auf ein dem nicht "
    "el los las del se por con no su lo al y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` lies outside [low, high] and it has ``min_words`` words."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table.
RULES = (
    Rule("mean_word_chars", low=1.5, high=20.0),
    Rule("symbol_ratio", high=0.10),
    Rule("stop_word_ratio", low=0.03, min_words=60),  # different stop words found, of those there are
    Rule("dup_line_ratio", high=0.60),
    Rule("bullet_line_ratio", high=0.90),
    Rule("ellipsis_line_ratio", high=0.30),
    Rule("exclaimed_ratio", high=0.30, min_words=10),
    Rule("lettered_ratio", low=0.60),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, although ``body`` reads it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _gram_hashes(words: Column) -> Column:
    """Hashes of the five-word windows, in text order."""

    def windows(h: Column) -> Column:
        full = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.slice(full, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _repeat_words(grams: Column) -> Column:
    """Number of words covered by windows that occur twice or more."""

    def places(by_hash: Column) -> Column:
        def same(e: Column, j: Column) -> Column:
            return F.coalesce(e["g"] == F.get(by_hash, j)["g"], F.lit(False))

        return F.sort_array(F.transform(F.filter(by_hash, lambda e, i: same(e, i + 1) | same(e, i - 1)), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(g: Column) -> Column:
        by_hash = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(_let(by_hash, places), covered))

    return _let(grams, counted)


def with_metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and the figures that the rules refer to."""
    t = F.coalesce(F.col(text), F.lit(""))
    stripped = t
    for c in _BLANK:
        stripped = F.replace(stripped, F.lit(c), F.lit(""))
    trimmed = F.btrim(t, F.lit(_BLANK))
    words = F.when(trimmed != "", F.split(trimmed, _GAP, -1)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")

    def of_words(w: Column) -> Column:
        stops = F.array(*[F.lit(x) for x in STOP_WORDS])
        return F.struct(F.size(w).cast("long").alias("n"), _repeat_words(_gram_hashes(w)).alias("again"), F.size(F.array_intersect(w, stops)).alias("stops"), F.size(F.array_distinct(w)).alias("kinds"))

    def of_lines(x: Column) -> Column:
        bullets = F.size(F.filter(x, lambda y: F.ltrim(y).startswith("- ") | F.ltrim(y).startswith("* ") | F.ltrim(y).startswith("•")))
        dots = F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…")))
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), bullets.alias("bullets"), dots.alias("dots"))

    df = docs.select(*keep, _let(words, of_words).alias("__w"), _let(lines, of_lines).alias("__l"), F.length(stripped).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit("!")).alias("__exclaimed"), F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*+")).alias("__lettered"))
    n, n_lines = F.greatest(F.col("__w.n"), F.lit(1)), F.greatest(F.col("__l.n"), F.lit(1))
    return df.select(
        *keep,
        F.col("__w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("__l.dup").alias("n_dup_lines"),
        F.col("__w.again").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("__w.stops") / F.least(n, F.lit(len(STOP_WORDS)))).alias("stop_word_ratio"),
        (F.col("__w.kinds") / n).alias("distinct_word_ratio"),
        (F.col("__exclaimed") / n).alias("exclaimed_ratio"),
        (F.col("__lettered") / n).alias("lettered_ratio"),
        (F.col("__l.dup") / n_lines).alias("dup_line_ratio"),
        (F.col("__l.bullets") / n_lines).alias("bullet_line_ratio"),
        (F.col("__l.dots") / n_lines).alias("ellipsis_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as one array column."""
    broken = []
    for r in rules:
        m, out = F.col(r.metric), F.lit(False)
        if r.low is not None:
            out = out | (m < r.low)
        if r.high is not None:
            out = out | (m > r.high)
        broken.append(F.when(out & (F.col("n_words") >= r.min_words), F.lit(r.metric)))
    return F.array_compact(F.array(*broken))


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Figures, ``base_failed``, the broken rules and ``kept`` for every row of ``docs``."""
    df = with_metrics(docs, text, keep)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.withColumn("base_failed", base).withColumn("failed_rules", compile_rules(rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))
