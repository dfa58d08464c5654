"""JSON-lines sources: labels, dataset items, traces, suite outputs and baselines.

Lines keep their number (``line_no``), since order is meaning in these formats.
Files are read in Spark's splits.  A line's number is its place in its split
plus the lines of the file's earlier splits, which one counting pass gives: one
row a split.  No task holds more than a split's rows, line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgelab.functions.text import is_blank

LABEL = "item_id string, prompt string, response_a string, response_b string, judge_score double, human_score double, judge_criterion_scores map<string,double>, human_criterion_scores map<string,double>, preferred string, meta map<string,string>"
ITEM = "item_id string, prompt string, reference string, capability string, topic string, persona string, difficulty string, edge_case string, meta map<string,string>"


def numbered_lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """(file, line_no, line): non-blank lines with 1-based numbers; without ``blank``, blank lines don't count."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.col("value").alias("line"))
    raw = raw if blank else raw.filter(~is_blank(F.col("line")))
    # Both scans cut files alike, and a task reads its splits from first to last line.
    raw = raw.withColumn("__id", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "__split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    shift = splits.select("file", "__split", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return raw.join(shift, ["file", "__split"]).select("file", (F.col("__id") + F.col("__shift") + 1).alias("line_no"), "line").filter(~is_blank(F.col("line")))


def _documents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered lines of files that have a JSON object on their first line and more lines, and the whole text (file, value) of the others.

    The others are one JSON value each (or broken), which has to be parsed as one.
    """
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.min_by("line", "line_no").alias("head"))
    v = F.try_parse_json("head")
    listed = files.filter("n > 1").filter(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))).select("file")
    whole = lines.join(listed, "file", "left_anti").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    return lines.join(listed, "file", "left_semi"), whole


def parse(lines: DataFrame, schema: str, required: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Fields of ``schema`` and ``problem``: why a line can't be used, else null."""
    df = lines.withColumn("__r", F.from_json("line", schema)).withColumn("__ok", F.try_parse_json("line").isNotNull())
    missing = F.array_compact(F.array(*[F.when(F.col("__r")[c].isNull(), F.lit(c)) for c in required]))
    problem = F.when(~F.col("__ok"), "not JSON").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return df.select("file", "line_no", "__r.*", problem.alias("problem"))


def checked(parsed: DataFrame, shown: int = 20) -> DataFrame:
    """The good rows; raises with all bad lines' numbers (the first ``shown`` of them) if there are any."""
    bad = parsed.filter("problem IS NOT NULL").select("line_no", "problem").orderBy("line_no").limit(shown + 1).collect()
    if bad:
        raise ValueError("; ".join(f"line {r['line_no']}: {r['problem']}" for r in bad[:shown]) + ("; ..." if len(bad) > shown else ""))
    return parsed.drop("problem")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    return checked(parse(numbered_lines(spark, path), LABEL)).drop("file")


def load_items(spark: SparkSession, path: str) -> DataFrame:
    return checked(parse(numbered_lines(spark, path), ITEM)).drop("file")


def to_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, step_idx, name, input, output, duration_ms) from a JSON list, ``{"steps"|"trace": [...]}`` or JSON lines; a file is a chain."""
    rows, whole = _documents(numbered_lines(spark, path, blank=False))
    v = F.try_parse_json("value")
    one = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.steps", "array<variant>"), F.try_variant_get(v, "$.trace", "array<variant>"))
    lines = F.transform(F.split("value", "\n", -1), lambda x: F.try_parse_json(x))
    steps = whole.select(F.col("file").alias("chain_id"), F.posexplode(F.coalesce(one, lines)).alias("step_idx", "v"))
    steps = steps.unionByName(rows.select(F.col("file").alias("chain_id"), (F.col("line_no") - 1).cast("int").alias("step_idx"), F.try_parse_json("line").alias("v")))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    payload = lambda k: F.coalesce(F.to_json(F.try_variant_get("v", f"$.{k}", "variant")), F.lit("{}"))
    name = F.coalesce(text("name"), text("step"), F.concat(F.lit("step-"), F.col("step_idx").cast("string")))
    return steps.select("chain_id", "step_idx", name.alias("name"), payload("input").alias("input"), payload("output").alias("output"), F.try_variant_get("v", "$.duration_ms", "double").alias("duration_ms"))


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a recorded baseline: JSON lines or a list of rows with name and value (or output), or an object
    {name: value}, bare or under ``outputs``.  Raises where there is none.  Of a name given twice the last row counts."""
    rows, whole = _documents(numbered_lines(spark, path))
    v = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.try_variant_get(v, "$.name", "string").isNotNull(), F.array(v)))
    fields = F.map_entries(F.try_variant_get(F.coalesce(F.try_variant_get(v, "$.outputs", "variant"), v), "$", "map<string,variant>"))
    given = F.transform(listed, lambda x: F.struct(F.try_variant_get(x, "$.name", "string").alias("name"), F.coalesce(F.try_variant_get(x, "$.value", "variant"), F.try_variant_get(x, "$.output", "variant")).alias("value")))
    named = F.transform(fields, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    found = whole.select(F.posexplode(F.coalesce(given, named)).alias("line_no", "x")).select(F.col("line_no").cast("long"), "x.*")
    r = F.try_parse_json("line")
    found = found.unionByName(rows.select("line_no", F.try_variant_get(r, "$.name", "string").alias("name"), F.coalesce(F.try_variant_get(r, "$.value", "variant"), F.try_variant_get(r, "$.output", "variant")).alias("value")))
    found = found.filter("name IS NOT NULL").select("name", "line_no", F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")).alias("value"))
    out = found.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))
    if out.isEmpty():
        raise ValueError(f"no baseline in {path}")
    return out


def load_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, latency_ms) of suite outputs; a name given twice keeps its last line."""
    rows = numbered_lines(spark, path).withColumn("v", F.parse_json("line"))
    value = F.coalesce(F.try_variant_get("v", "$.value", "variant"), F.try_variant_get("v", "$.output", "variant"))
    named = rows.select("line_no", F.coalesce(F.try_variant_get("v", "$.name", "string"), F.concat(F.lit("output-"), F.col("line_no").cast("string"))).alias("name"), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)).alias("value"), F.try_variant_get("v", "$.latency_ms", "double").alias("latency_ms"))
    last = named.groupBy("name").agg(F.max_by(F.struct("value", "latency_ms"), "line_no").alias("x"))
    return last.select("name", "x.value", "x.latency_ms")


#: Columns of the queue file, in order.
QUEUE = ("item_id", "priority", "judge_score", "disagreement", "has_human_label", "human_score", "prompt", "response_a", "response_b")


def labelling_queue(queue: DataFrame, path: str) -> None:
    """A queue (a top-k, so one file) as CSV with a header; priorities to four places, what is unknown stays empty."""
    there = {c: F.col(c) for c in queue.columns}
    there |= {"priority": F.round("priority", 4), "has_human_label": F.col("human_score").isNotNull() if "human_score" in queue.columns else F.lit(False)}
    cols = [there.get(c, F.lit(None).cast("string")).alias(c) for c in QUEUE]
    queue.orderBy(F.desc("priority"), "item_id").select(*cols).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
