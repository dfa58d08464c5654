"""License scans: ordered signatures tried where their first words stand (operator 13).

Everything is a built-in expression over one row: a scan and projections, no
shuffle and no user function.

1. Texts become lower-case words joined by single spaces.
2. Prefilter: a text without any signature's keyword has no detection and goes
   no further (``contains``, a plain search).
3. In the others, each place of a signature's first word (its anchor) is taken
   with the ``SPAN`` words that may belong to it, and that anchor's signatures
   are tried on them.  The work grows with the anchors in a text.
4. A detection is suppressed if another one contains its words with the same
   priority or a higher one; of equal words and priority the earlier signature
   stays.  What may contain a detection starts at most ``SPAN`` words before
   it, so each is compared with that many places.

Base phrases are signatures as well; all of their places count, and their
labels stay.

Defined results: a null text is empty and has no words and no labels; repeated
rows are scanned one by one; very long texts are scanned whole; columns that
clash are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelab.llm.common import table
from judgelab.llm.license_rules import SPAN, Signature, signatures
from judgelab.llm.quality_rules import _let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words, before capitals are lowered.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND = "array<struct<start:int,stop:int,priority:int,no:int,label:string,weight:double,base:boolean>>"


def by_anchor(rules: tuple[Signature, ...]) -> dict[str, list[tuple[int, Signature, str]]]:
    """Signatures, with their numbers and whole patterns, of each first word."""
    out: dict[str, list[tuple[int, Signature, str]]] = {}
    for no, r in enumerate(rules):
        for a in r.anchors:
            out.setdefault(a, []).append((no, r, f"^{a}{r.pattern} "))
    return dict(sorted(out.items()))


def _literals(rules: tuple[Signature, ...]) -> tuple[Column, Column]:
    """Anchors, and for each the array of its signatures."""
    groups = by_anchor(rules)

    def one(no: int, r: Signature, pattern: str) -> Column:
        return F.struct(F.lit(no).alias("no"), F.lit(pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base"))

    return F.array(*[F.lit(a) for a in groups]), F.array(*[F.array(*[one(*x) for x in g]) for g in groups.values()])


def _detections(words: Column, rules: tuple[Signature, ...]) -> Column:
    """An array for each place that has detections, in order of places."""
    anchors, groups = _literals(rules)

    def at(i: Column, words: Column) -> Column:
        def tried(text: Column) -> Column:
            def one(r: Column) -> Column:
                hit = F.call_function("regexp_extract", text, r["pattern"], F.lit(0))
                n = F.length(hit) - F.length(F.replace(hit, F.lit(" "), F.lit("")))
                return F.struct(i.alias("start"), (i + n).cast("int").alias("stop"), r["priority"].alias("priority"), r["no"].alias("no"), r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base"))

            mine = F.get(groups, (F.array_position(anchors, F.get(words, i)) - 1).cast("int"))
            return F.filter(F.transform(mine, one), lambda d: d["stop"] > d["start"])

        return _let(F.concat(F.array_join(F.slice(words, i + 1, SPAN), " "), F.lit(" ")), tried)

    def within(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(anchors, F.get(words, i)))
        return F.filter(F.transform(starts, lambda i: at(i, words)), lambda p: F.size(p) > 0)

    return _let(words, within)


def _outranked(d: Column, e: Column) -> Column:
    """``e`` contains ``d`` and wins."""
    equal = (e["start"] == d["start"]) & (e["stop"] == d["stop"])
    wins = F.when(equal, (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["no"] < d["no"]))).otherwise(e["priority"] >= d["priority"])
    return (e["start"] <= d["start"]) & (e["stop"] >= d["stop"]) & wins


def _resolved(places: Column) -> Column:
    """Detections that no other one suppresses."""

    def left(places: Column) -> Column:
        def at(p: Column, j: Column) -> Column:
            lo = F.greatest(j - (SPAN - 1), F.lit(0))
            return _let(F.flatten(F.slice(places, lo + 1, j - lo + 1)), lambda near: F.filter(p, lambda d: ~F.exists(near, lambda e: _outranked(d, e))))

        return F.flatten(F.transform(places, at))

    return _let(places, left)


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """``keep`` columns, n_words, ``base`` (all places of base phrases) and ``found`` (what is left of all detections)."""
    rules = rules or signatures()
    words = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _GAP, " "))
    low = F.lower(F.col("__words"))
    gate = F.lit(False)
    for k in sorted({r.keyword for r in rules}, key=lambda k: (len(k), k)):
        if not any(o.keyword in k and o.keyword != k for o in rules):  # a keyword within another one tells of both
            gate = gate | low.contains(k)
    df = docs.select(*keep, words.alias("__words"))
    none = F.array().cast(f"array<{_FOUND}>")
    places = F.when(gate, _detections(F.split(F.translate("__words", _UPPER, _LOWER), " "), rules)).otherwise(none)
    spaces = F.length("__words") - F.length(F.replace(F.col("__words"), F.lit(" "), F.lit("")))
    df = df.select(*keep, F.when(F.col("__words") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words"), places.alias("__places"))

    def both(places: Column) -> Column:
        return F.struct(F.filter(F.flatten(places), lambda d: d["base"]).alias("base"), _resolved(places).alias("found"))

    df = df.select(*keep, "n_words", _let(F.col("__places"), both).alias("__x"))
    return df.select(*keep, "n_words", F.col("__x.base").alias("base"), F.col("__x.found").alias("found"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = license_scan(table(spark, sf_dir, "documents"))
    base_labels = F.array_distinct(F.col("base.label"))
    return df.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.array_distinct(F.col("found.label")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.concat("found.weight", F.transform("base", lambda d: d["weight"]))), F.lit(0.0)).alias("score"),
    )
