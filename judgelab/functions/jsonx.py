"""Dynamic JSON as VARIANT: typing, flattening, extraction and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelab.functions.tables import step_path

LENGTH = "#len"
SAMPLE = 3


def type_name(v: Column) -> Column:
    """bool, number, str, null, dict or list for a VARIANT."""
    return type_of_schema(F.schema_of_variant(v))


def type_of_schema(s: Column) -> Column:
    number = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
    return F.when(s == "BOOLEAN", "bool").when(number, "number").when(s == "STRING", "str").when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list").otherwise("null")


def extract_object(text: Column) -> Column:
    """What lies from the first { to the last }, without a code fence around it."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def coerce(text: Column) -> Column:
    """A VARIANT from the text, else from the object in it, else null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(extract_object(text), F.lit(""))))


#: Levels that one pass opens.
LEVELS = 4


def _opened(path: Column, v: Column) -> Column:
    """What a value gives: itself if it is a leaf, else its children and, of a list with a path, its length; ``v`` is what is left to open."""
    kind = "array<struct<path:string,type:string,value:string,v:variant>>"
    row = lambda path, t, value, v: F.struct(path.alias("path"), t.alias("type"), value.alias("value"), v.alias("v"))
    none, no_text = F.lit(None).cast("variant"), F.lit(None).cast("string")
    t = type_name(v)
    leaf = F.array(row(path, t, F.coalesce(F.to_json(v), F.lit("null")), none))
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    inner = F.transform(fields, lambda e: row(F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"])), no_text, no_text, e["value"]))
    items = F.try_variant_get(v, "$", "array<variant>")
    first = F.transform(F.slice(items, 1, SAMPLE), lambda e, i: row(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), no_text, no_text, e))
    length = F.when(path != "", F.array(row(F.concat(path, F.lit(LENGTH)), F.lit("number"), F.size(items).cast("string"), none))).otherwise(F.array().cast(kind))
    return F.when(t == "dict", inner).when(t == "list", F.concat(first, length)).otherwise(leaf)


def flatten(df: DataFrame, ids: list[str], json_col: str, levels: int = LEVELS) -> DataFrame:
    """Long rows (ids, path, type, value): scalar leaves by dotted path, and list lengths as ``path#len``.

    Of a list, the first three elements are looked into.  ``value`` is the
    leaf's JSON text; numbers print alike whether whole or not.  All depths are
    reported: a pass opens ``levels`` of them and is written, and what is deeper
    goes through the same pass again, until nothing is left.  So the plan has
    one size, and deep texts cost the others nothing.
    """
    spark = df.sparkSession
    keys = [F.col(f"`{i}`") for i in ids]
    folder, level = step_path(spark), df.select(*keys, F.lit("").alias("path"), F.try_parse_json(F.col(json_col)).alias("v")).filter("v IS NOT NULL")
    level = level.select(*keys, "path", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"), "v")
    k = 0
    while True:
        for _ in range(levels):
            done = F.array(F.struct("path", "type", "value", "v"))
            level = level.select(*keys, F.explode(F.when(F.col("type").isNotNull(), done).otherwise(_opened(F.col("path"), F.col("v")))).alias("x")).select(*keys, "x.*")
        part = level.select(*keys, "path", "type", "value", F.to_json("v").alias("rest"))
        part.write.parquet(f"{folder}/pass={k}")
        deeper = spark.read.schema(part.schema).parquet(f"{folder}/pass={k}").filter("type IS NULL")
        if deeper.isEmpty():
            break
        level, k = deeper.select(*keys, "path", "type", "value", F.parse_json("rest").alias("v")), k + 1
    return spark.read.schema(part.schema).parquet(*[f"{folder}/pass={j}" for j in range(k + 1)]).filter("type IS NOT NULL").select(*keys, "path", "type", "value")


def opened_fields(text: Column, levels: int = LEVELS) -> Column:
    """What :func:`flatten` gives of a text, as an array of (path, type, value) in its row; null if it goes deeper than ``levels``."""
    entry = lambda path, v, n: F.struct(path.alias("path"), F.schema_of_variant(v).alias("s"), v.alias("v"), n.alias("n"))
    no_length, no_value = F.lit(None).cast("string"), F.lit(None).cast("variant")
    is_dict, is_list = (lambda e: e["s"].startswith("OBJECT")), (lambda e: e["s"].startswith("ARRAY"))
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  f(x), with x computed once

    def inner(e: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(e["v"], "$", "map<string,variant>"))
        return F.transform(fields, lambda x: entry(F.when(e["path"] == "", x["key"]).otherwise(F.concat(e["path"], F.lit("."), x["key"])), x["value"], no_length))

    def elements(e: Column) -> Column:
        items = F.try_variant_get(e["v"], "$", "array<variant>")
        first = F.transform(F.slice(items, 1, SAMPLE), lambda x, i: entry(F.concat(e["path"], F.lit("["), i.cast("string"), F.lit("]")), x, no_length))
        length = F.array(entry(F.concat(e["path"], F.lit(LENGTH)), no_value, F.size(items).cast("string")))
        return F.when(e["path"] != "", F.concat(first, length)).otherwise(first)

    leaf = lambda e: F.struct(e["path"].alias("path"), F.when(e["n"].isNotNull(), "number").otherwise(type_of_schema(e["s"])).alias("type"), F.coalesce(e["n"], F.to_json(e["v"]), F.lit("null")).alias("value"))
    step = lambda found: F.flatten(F.transform(found, lambda e: F.when(is_dict(e), inner(e)).when(is_list(e), elements(e)).otherwise(F.array(e))))

    def opened(found: Column, left: int) -> Column:
        deeper = F.exists(found, lambda e: F.coalesce(is_dict(e) | is_list(e), F.lit(False)))
        done = F.when(~deeper, F.transform(found, leaf))
        return done.otherwise(once(step(found), lambda x: opened(x, left - 1))) if left else done

    root = lambda v: F.when(v.isNull(), F.array().cast("array<struct<path:string,type:string,value:string>>")).otherwise(once(F.array(entry(F.lit(""), v, no_length)), lambda x: opened(x, levels)))
    return once(F.try_parse_json(text), root)


def _among(kind: Column, text: Column, number: Column, allowed: list) -> Column:
    """Whether a value equals one of ``allowed`` in kind and value; true and false equal 1 and 0, as in Python."""
    truth = F.when(kind == "bool", F.when(text == "true", 1.0).otherwise(0.0)).when(kind == "number", number)
    tests = [kind == "null" if e is None else (kind == "str") & (text == e) if isinstance(e, str) else truth == float(e) for e in allowed if e is None or isinstance(e, (str, bool, int, float))]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def schema_errors(v: Column, schema: dict, path: str = "$") -> Column:
    """Violations of the supported JSON-schema subset as an array of texts; compiled once into column expressions.

    Supported: type, enum (any scalar), properties, required, items, minLength, maxLength, minimum, maximum.
    """
    kind = type_name(v)
    found: list[Column] = []
    want = schema.get("type")
    names = {"object": "dict", "array": "list", "string": "str", "boolean": "bool", "null": "null", "number": "number", "integer": "number"}
    number = F.try_variant_get(v, "$", "double")
    text = F.try_variant_get(v, "$", "string")
    right = kind == names.get(want, "") if want in names else F.lit(True)
    if want == "integer":
        right = right & (number == F.floor(number))
    if "enum" in schema:
        found.append(F.when(~_among(kind, text, number, schema["enum"]), F.lit(f"{path}: not in enum")))
    for name in schema.get("required", []):
        found.append(F.when((kind == "dict") & F.try_variant_get(v, f"$['{name}']", "variant").isNull(), F.lit(f"{path}: missing required field '{name}'")))
    if "minLength" in schema:
        found.append(F.when((kind == "str") & (F.length(text) < schema["minLength"]), F.lit(f"{path}: shorter than minLength")))
    if "maxLength" in schema:
        found.append(F.when((kind == "str") & (F.length(text) > schema["maxLength"]), F.lit(f"{path}: longer than maxLength")))
    if "minimum" in schema:
        found.append(F.when((kind == "number") & (number < schema["minimum"]), F.lit(f"{path}: below minimum")))
    if "maximum" in schema:
        found.append(F.when((kind == "number") & (number > schema["maximum"]), F.lit(f"{path}: above maximum")))
    out = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    for name, sub in schema.get("properties", {}).items():
        child = F.try_variant_get(v, f"$['{name}']", "variant")
        out = F.concat(out, F.when((kind == "dict") & child.isNotNull(), schema_errors(child, sub, f"{path}.{name}")).otherwise(F.array().cast("array<string>")))
    if isinstance(schema.get("items"), dict):
        items = F.try_variant_get(v, "$", "array<variant>")
        out = F.concat(out, F.coalesce(F.flatten(F.transform(items, lambda x: schema_errors(x, schema["items"], f"{path}[]"))), F.array().cast("array<string>")))
    return F.when(~F.coalesce(right, F.lit(False)), F.array(F.lit(f"{path}: expected type {want}"))).otherwise(out)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, want: str | None) -> bool:
    if want in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (want == "number" or float(value).is_integer())
    return isinstance(value, _KINDS[want]) if want in _KINDS else True


def schema_violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """:func:`schema_errors` of one parsed value under a schema that comes as data."""
    want = schema.get("type")
    if not _is(value, want):
        return [f"{path}: expected type {want}"]
    out, number = [], isinstance(value, (int, float)) and not isinstance(value, bool)
    allowed = [e for e in schema.get("enum", []) if e is None or isinstance(e, (str, bool, int, float))]
    if "enum" in schema and (isinstance(value, (dict, list)) or value not in allowed):
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        out += [f"{path}: missing required field '{n}'" for n in schema.get("required", []) if n not in value]
    if isinstance(value, str):
        out += [f"{path}: shorter than minLength"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{path}: longer than maxLength"] if len(value) > schema.get("maxLength", len(value)) else []
    if number:
        out += [f"{path}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{path}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, dict):
        for name, sub in schema.get("properties", {}).items():
            out += schema_violations(value[name], sub, f"{path}.{name}") if name in value else []
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for x in value:
            out += schema_violations(x, schema["items"], f"{path}[]")
    return out
