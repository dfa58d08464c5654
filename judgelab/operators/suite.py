"""Deterministic checks of outputs: six per output, in a fixed order."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelab.functions.jsonx import coerce, schema_errors, schema_violations, type_name
from judgelab.functions.text import hash_similarity, is_blank

CHECKS = ("schema_conformity", "content_bounds", "json_valid", "similarity", "required_fields", "latency_budget")
MAX_CHARS = 100_000


def _schema_problems(values: pd.Series, schemas: pd.Series) -> pd.Series:
    """Violations of each row's own JSON schema (as JSON text); none without a schema."""
    parsed = {t: json.loads(t) for t in schemas.dropna().unique()}
    return pd.Series([schema_violations(json.loads(v), parsed[s]) if isinstance(v, str) and isinstance(s, str) else [] for v, s in zip(values, schemas, strict=True)])


def run_checks(outputs: DataFrame, schema: dict | None = None, budget_ms: float | None = None, min_similarity: float = 0.5) -> DataFrame:
    """Long rows (name, check_no, check, passed, severity, escalate) for ``outputs`` (name, value, latency_ms, reference)
    under one schema and budget: a projection of one scan."""
    parsed = F.col("__v").isNotNull()
    fits = F.lit(True) if schema is None else parsed & (F.size(schema_errors(F.col("__v"), schema)) == 0)
    has = F.lit(True)
    for name in (schema or {}).get("required", []):
        has = has & F.try_variant_get(F.col("__v"), f"$['{name}']", "variant").isNotNull()
    limits = {"least": F.lit((schema or {}).get("minLength", 1)), "most": F.lit((schema or {}).get("maxLength", MAX_CHARS)), "budget": F.lit(budget_ms).cast("double"), "similar": F.lit(min_similarity)}
    return _checks(outputs.withColumn("__v", coerce(F.col("value"))), F.lit(schema is not None), fits, F.lit(bool((schema or {}).get("required"))), has, limits)


def run_checks_by_name(outputs: DataFrame, specs: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """As :func:`run_checks` for ``outputs`` (name, value, latency_ms), each under what ``specs`` has for its name:
    (name, schema as JSON text, reference, budget_ms, min_similarity), any of them null.

    Schemas are data: they are joined by name and evaluated row by row in Arrow
    batches, so the plan is the same for any number of them.  A name without
    specs has no schema, reference or budget.
    """
    given = specs.select("name", "schema", "reference", "budget_ms", F.col("min_similarity").alias("__least"))
    df = outputs.select("name", "value", "latency_ms").join(given, "name", "left").withColumn("__v", coerce(F.col("value")))
    problems = F.pandas_udf(_schema_problems, "array<string>")
    df = df.withColumn("__problems", problems(F.to_json("__v"), F.col("schema")))
    s = F.try_parse_json("schema")
    required = F.coalesce(F.try_variant_get(s, "$.required", "array<string>"), F.array().cast("array<string>"))
    fields = F.map_keys(F.try_variant_get("__v", "$", "map<string,variant>"))
    has = F.size(F.array_except(required, fields)) == 0
    limit = lambda key, default: F.coalesce(F.try_variant_get(s, f"$.{key}", "int"), F.lit(default))
    limits = {"least": limit("minLength", 1), "most": limit("maxLength", MAX_CHARS), "budget": F.col("budget_ms").cast("double"), "similar": F.coalesce("__least", F.lit(min_similarity))}
    fits = F.col("schema").isNull() | (F.col("__v").isNotNull() & (F.size("__problems") == 0))
    return _checks(df, F.col("schema").isNotNull(), fits, F.size(required) > 0, has, limits)


def _checks(df: DataFrame, schema: Column, fits: Column, required: Column, has: Column, limits: dict[str, Column]) -> DataFrame:
    value, parsed = F.col("value"), F.col("__v").isNotNull()
    near = F.when(F.col("reference").isNotNull(), hash_similarity("value", "reference"))
    passed = {
        "schema_conformity": fits,
        "content_bounds": value.isNotNull() & ~is_blank(value) & (F.length(value) >= limits["least"]) & (F.length(value) <= limits["most"]),
        "json_valid": ~schema | (parsed & (type_name(F.col("__v")) != "null")),
        "similarity": F.col("reference").isNull() | (F.coalesce(near, F.lit(0.0)) >= limits["similar"]),
        "required_fields": ~required | (parsed & (type_name(F.col("__v")) == "dict") & has),
        "latency_budget": limits["budget"].isNull() | (F.col("latency_ms").isNotNull() & (F.col("latency_ms") <= limits["budget"])),
    }
    rows = [F.struct(F.lit(i).alias("check_no"), F.lit(c).alias("check"), F.coalesce(passed[c], F.lit(False)).alias("passed"), F.lit("warning" if c == "latency_budget" else "error").alias("severity"), F.lit(c in ("schema_conformity", "json_valid", "similarity")).alias("escalate")) for i, c in enumerate(CHECKS)]
    return df.select("name", F.explode(F.array(*rows)).alias("c")).select("name", "c.*").withColumn("escalate", F.col("escalate") & ~F.col("passed"))


def verdicts(checks: DataFrame, by: str = "name") -> DataFrame:
    """PASS, ESCALATE (every failure may be looked into further) or FAIL."""
    s = checks.groupBy(by).agg(F.count_if(~F.col("passed")).alias("n_failed"), F.count_if(F.col("escalate")).alias("n_escalated"))
    return s.select(by, "n_failed", F.when(F.col("n_failed") == 0, "PASS").when(F.col("n_failed") == F.col("n_escalated"), "ESCALATE").otherwise("FAIL").alias("verdict"))


def no_regression(baseline: DataFrame, actual: DataFrame, min_similarity: float = 0.85) -> DataFrame:
    """(name, problem) of baseline outputs that are missing or differ; actual outputs without baseline are ignored."""
    met = baseline.select("name", F.col("value").alias("b")).join(actual.select("name", F.col("value").alias("a"), F.lit(1).alias("__there")), "name", "left")
    bj, aj = F.try_parse_json("b"), F.try_parse_json("a")
    structured = bj.isNotNull() & type_name(bj).isin("dict", "list")
    differs = F.when(structured, F.coalesce(F.to_json(bj) != F.to_json(aj), F.lit(True))).otherwise((F.col("a") != F.col("b")) & (hash_similarity("b", "a") < min_similarity))
    return met.select("name", F.when(F.col("__there").isNull(), "missing").when(differs, "changed").alias("problem")).filter("problem IS NOT NULL")
