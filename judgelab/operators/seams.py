"""What survives each handoff of a multi-step agent trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelab.functions.jsonx import LENGTH, flatten, opened_fields
from judgelab.functions.tables import RANGE_ROWS, running, sequenced, written


def seam_pairs(steps: DataFrame, limit: int = RANGE_ROWS) -> DataFrame:
    """(chain_id, seam, before, after): a step's output and the next step's input; a chain may have any length."""
    cut = sequenced(steps.select("chain_id", "step_idx", "input", "output"), ["chain_id"], ["step_idx"], {"after": "input", "__next": "step_idx"}, limit)
    return cut.filter("__next IS NOT NULL").select("chain_id", F.col("__at").alias("seam"), F.col("output").alias("before"), "after")


def handoff_fields(steps: DataFrame) -> DataFrame:
    """One row a field of a seam: what became of it.

    ``steps`` has (chain_id, step_idx, name, input, output), JSON texts.  Seam i
    lies between step i's output and the input of step i + 1.  Classes: kept,
    recovered (gone, but the value turns up elsewhere), dropped, mutated,
    type_changed, added.  A list that grew counts as kept.
    """
    return _fields(seam_pairs(steps))


#: Fields of a side up to which a seam is compared in its row, where each field is looked for among all of the other side.
ROW_FIELDS = 64
FATES = ("kept", "recovered", "dropped", "mutated", "type_changed", "added")


def _fate(path: Column, t1: Column, v1: Column, t2: Column, v2: Column) -> Column:
    """What became of a field, but for recovery."""
    number = lambda c: F.try_to_number(c, F.lit("999999999")).cast("double")
    grew = path.endswith(LENGTH) & (number(v2) > number(v1))
    return F.when(t2.isNull(), "dropped").when(t1.isNull(), "added").when(t1 != t2, "type_changed").when(v1 == v2, "kept").when(grew, "kept").otherwise("mutated")


def _as_value(t: Column, v: Column) -> Column:
    """The value by which a missing field counts as recovered; true and 1 are one value."""
    return F.when((t == "bool") & (v == "true"), "1").when((t == "bool") & (v == "false"), "0").otherwise(v)


def _can_recover(t: Column, v: Column) -> Column:
    return (t != "null") & (v != '""')


def _row_counts(pairs: DataFrame, limit: int) -> DataFrame:
    """Seams with counts by fate from the row alone; null counts, and the texts, where a side is deep, has over ``limit`` fields or two of one path."""
    sides = pairs.select("chain_id", "seam", "before", "after", opened_fields(F.col("before")).alias("l"), opened_fields(F.col("after")).alias("r"))
    single = lambda c: (F.size(c) <= limit) & (F.size(F.array_distinct(F.transform(c, lambda x: x["path"]))) == F.size(c))
    fits = F.coalesce(F.col("l").isNotNull() & F.col("r").isNotNull() & single(F.col("l")) & single(F.col("r")), F.lit(False))
    sides = sides.withColumn("fits", fits)
    met = F.transform("l", lambda x: F.struct(x.alias("x"), F.get(F.filter("r", lambda y: y["path"] == x["path"]), F.lit(0)).alias("y")))
    sides = sides.withColumn("met", F.when(F.col("fits"), met))

    def fate(m: Column) -> Column:
        x, y = m["x"], m["y"]
        again = _can_recover(x["type"], x["value"]) & F.exists("r", lambda z: _as_value(z["type"], z["value"]) == _as_value(x["type"], x["value"]))
        return F.when(y.isNull() & again, "recovered").otherwise(_fate(x["path"], x["type"], x["value"], y["type"], y["value"]))

    sides = sides.withColumn("fates", F.transform("met", fate))
    times = lambda f: F.size(F.filter("fates", lambda x: x == f))
    n = {f: times(f) for f in FATES[:-1]}
    n["added"] = F.size("r") - F.size(F.filter("met", lambda m: m["y"].isNotNull()))
    return sides.select("chain_id", "seam", *[F.when(F.col("fits"), n[f].cast("bigint")).alias(f) for f in FATES], *[F.when(~F.col("fits"), F.col(c)).alias(c) for c in ("before", "after")])


def _fields(pairs: DataFrame) -> DataFrame:
    seam = ["chain_id", "seam"]
    left = flatten(pairs, seam, "before").select(*seam, "path", F.col("type").alias("t1"), F.col("value").alias("v1"))
    right = flatten(pairs, seam, "after").select(*seam, "path", F.col("type").alias("t2"), F.col("value").alias("v2"))
    met = left.join(right, [*seam, "path"], "full")
    first = met.withColumn("fate", _fate(*[F.col(c) for c in ("path", "t1", "v1", "t2", "v2")]))
    values = right.select(*seam, _as_value(F.col("t2"), F.col("v2")).alias("v1x")).distinct().withColumn("__hit", F.lit(True))
    can = (F.col("fate") == "dropped") & _can_recover(F.col("t1"), F.col("v1"))
    looked = first.withColumn("v1x", F.when(can, _as_value(F.col("t1"), F.col("v1")))).join(values, [*seam, "v1x"], "left")
    return looked.select(*seam, "path", "t1", "v1", "t2", "v2", F.when(F.col("__hit"), "recovered").otherwise(F.col("fate")).alias("fate"))


def handoffs(steps: DataFrame, limit: int = RANGE_ROWS, row_fields: int = ROW_FIELDS) -> DataFrame:
    """(chain_id, seam, n_fields, counts by fate, fidelity) for every seam, also where nothing was handed over.

    A seam is counted in its row; those of deep or large texts field by field.
    """
    pairs = written(_row_counts(seam_pairs(steps, limit), row_fields))
    columns = ["chain_id", "seam", *FATES]
    out, rest = pairs.filter("kept IS NOT NULL").select(*columns), pairs.filter("kept IS NULL")
    if not rest.isEmpty():
        counts = _fields(rest).groupBy("chain_id", "seam").agg(*[F.count_if(F.col("fate") == f).alias(f) for f in FATES])
        out = out.unionByName(rest.select("chain_id", "seam").join(counts, ["chain_id", "seam"], "left").na.fill(0, list(FATES)).select(*columns))
    n = F.col("kept") + F.col("recovered") + F.col("dropped") + F.col("mutated") + F.col("type_changed")
    return out.select("*", n.alias("n_fields"), F.round(F.when(n == 0, 1.0).otherwise((F.col("kept") + F.col("recovered")) / F.nullif(n, F.lit(0))), 6).alias("fidelity"))


def step_fidelity(steps: DataFrame, seams: DataFrame, limit: int = RANGE_ROWS) -> DataFrame:
    """(chain_id, step_no, name, fidelity): every step with the fidelity of the seam before it; null for the first."""
    placed = sequenced(steps.select("chain_id", "step_idx", "name"), ["chain_id"], ["step_idx"], {}, limit)
    before = seams.select("chain_id", (F.col("seam") + 1).alias("__at"), "fidelity")
    return placed.join(before, ["chain_id", "__at"], "left").select("chain_id", F.col("__at").alias("step_no"), "name", "fidelity")


def chain_audit(seams: DataFrame) -> DataFrame:
    """(chain_id, n_seams, chain_fidelity, fidelity_halflife) from :func:`handoffs`."""
    mean = F.when(F.min("fidelity") <= 0, 0.0).otherwise(F.exp(F.avg(F.log(F.nullif("fidelity", F.lit(0.0))))))
    return seams.groupBy("chain_id").agg(F.count("*").alias("n_seams"), F.round(mean, 6).alias("chain_fidelity"), F.min(F.when(F.col("fidelity") < 0.5, F.col("seam"))).alias("fidelity_halflife"))


def blame(seams: DataFrame, limit: int = RANGE_ROWS) -> DataFrame:
    """Seams worst first: loss times the steps after it.  Ranks are running counts over ranges, so a chain may have any length."""
    lengths = seams.groupBy("chain_id").agg(F.max("seam").alias("__n"))
    after = F.col("__n") - F.col("seam") + 1
    severe = seams.join(lengths, "chain_id").select("chain_id", "seam", "fidelity", after.alias("downstream_steps"), ((1 - F.col("fidelity")) * after).alias("severity"))
    ranked = running(written(severe.withColumns({"__order": -F.col("severity"), "__one": F.lit(1)})), ["chain_id"], ["__order", "seam"], ["__one"], limit)
    return ranked.select("chain_id", "seam", "fidelity", "downstream_steps", "severity", (F.col("before___one") + 1).cast("int").alias("rank"))
