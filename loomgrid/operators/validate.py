"""JSON Schema over DataFrames: keywords become column predicates, their failures rows of a violations table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = NUMBERS[:4]
KINDS = {"integer": WHOLE, "number": NUMBERS, "string": (T.StringType,), "boolean": (T.BooleanType,), "array": (T.ArrayType,), "object": (T.StructType, T.MapType)}


def is_null(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def resolved(schema: dict, root: dict) -> dict:
    if "$ref" in schema:
        node = root
        for step in schema["$ref"].lstrip("#/").split("/"):
            node = node[step.replace("~1", "/").replace("~0", "~")]
        return node
    return schema


def types_of(schema: dict) -> list[str]:
    t = schema.get("type", [])
    return [t] if isinstance(t, str) else list(t)


def fits(schema: dict, c: Column, kind: T.DataType, root: dict) -> list[tuple[str, Column]]:
    """(keyword, whether the value keeps it) for one schema; missing values keep all keywords but type."""
    schema = resolved(schema, root)
    out: list[tuple[str, Column]] = []
    null = is_null(c, kind)
    if types := types_of(schema):
        ok = any(isinstance(kind, KINDS.get(t, ())) for t in types)
        out.append(("type", F.when(null, F.lit("null" in types)).otherwise(F.lit(ok))))
    keep = lambda cond: null | cond
    numeric, text, array = isinstance(kind, NUMBERS), isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
    if "enum" in schema:
        same = [x for x in schema["enum"] if x is not None and (isinstance(x, bool) == isinstance(kind, T.BooleanType)) and (isinstance(x, str) == text)]
        out.append(("enum", keep(c.isin(*same) if same else F.lit(False))))
    if numeric and "minimum" in schema:
        out.append(("minimum", keep(c > schema["minimum"] if schema.get("exclusiveMinimum") is True else c >= schema["minimum"])))
    if numeric and "maximum" in schema:
        out.append(("maximum", keep(c < schema["maximum"] if schema.get("exclusiveMaximum") is True else c <= schema["maximum"])))
    if numeric and schema.get("multipleOf"):
        out.append(("multipleOf", keep(c % schema["multipleOf"] == 0)))
    if text:
        if "pattern" in schema:
            out.append(("pattern", keep(F.rlike(c, F.lit(schema["pattern"])))))
        if "minLength" in schema:
            out.append(("minLength", keep(F.char_length(c) >= schema["minLength"])))
        if "maxLength" in schema:
            out.append(("maxLength", keep(F.char_length(c) <= schema["maxLength"])))
    if array:
        if "minItems" in schema:
            out.append(("minItems", keep(F.size(c) >= schema["minItems"])))
        if "maxItems" in schema:
            out.append(("maxItems", keep(F.size(c) <= schema["maxItems"])))
        if schema.get("uniqueItems"):
            out.append(("uniqueItems", keep(F.size(F.array_distinct(c)) == F.size(c))))
        if isinstance(items := schema.get("items"), dict):
            out.append(("items", keep(F.forall(c, lambda x: passes(items, x, kind.elementType, root)))))
    for word in ("allOf", "anyOf", "oneOf"):
        if word in schema:
            each = [passes(s, c, kind, root) for s in schema[word]]
            n = sum((F.when(p, 1).otherwise(0) for p in each), F.lit(0))
            out.append((word, n == len(each) if word == "allOf" else n >= 1 if word == "anyOf" else n == 1))
    if "not" in schema:
        out.append(("not", ~passes(schema["not"], c, kind, root)))
    if "disallow" in schema:
        bad = schema["disallow"]
        out.append(("disallow", F.lit(not any(isinstance(kind, KINDS.get(t, ())) for t in ([bad] if isinstance(bad, str) else bad)))))
    if isinstance(kind, T.StructType) and "properties" in schema:
        for name, sub in schema["properties"].items():
            if name in kind.names:
                out += [(f"{name}/{w}", p) for w, p in fits(sub, c[name], kind[name].dataType, root)]
    return out


def passes(schema: dict, c: Column, kind: T.DataType, root: dict) -> Column:
    cond = F.lit(True)
    for _, p in fits(schema, c, kind, root):
        cond = cond & p
    return cond


def names_against(df: DataFrame, schema: dict) -> list[tuple[str, str]]:
    """(column, keyword) that column names break: required, additionalProperties, propertyNames, dependencies. No job."""
    out = []
    known = schema.get("properties", {})
    required = list(schema.get("required", [])) if isinstance(schema.get("required", []), list) else []
    required += [k for k, v in known.items() if v.get("required") is True]
    out += [(name, "required") for name in required if name not in df.columns]
    extra = [c for c in df.columns if c not in known and not any(re.search(p, c) for p in schema.get("patternProperties", {}))]
    if schema.get("additionalProperties") is False:
        out += [(c, "additionalProperties") for c in extra]
    if pattern := schema.get("propertyNames", {}).get("pattern"):
        out += [(c, "propertyNames") for c in df.columns if not re.search(pattern, c)]
    for name, needs in schema.get("dependencies", {}).items():
        if name in df.columns:
            out += [(n, "dependencies") for n in ([needs] if isinstance(needs, str) else needs) if n not in df.columns]
    return out


def violations(df: DataFrame, schema: dict, key: str) -> DataFrame:
    """key, path, keyword of every failure, from one pass over df; failures of names have a null key."""
    found = []
    by_pattern = schema.get("patternProperties", {})
    extra = schema.get("additionalProperties")
    for f in df.schema.fields:
        schemas = [s for n, s in schema.get("properties", {}).items() if n == f.name] + [s for p, s in by_pattern.items() if re.search(p, f.name)]
        if not schemas and isinstance(extra, dict):
            schemas = [extra]
        for s in schemas:
            for word, ok in fits(s, F.col(f"`{f.name}`"), f.dataType, schema):
                found.append(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f"/{f.name}").alias("path"), F.lit(word).alias("keyword"))))
    none = df.sparkSession.createDataFrame([(None, f"/{n}", w) for n, w in names_against(df, schema)], f"`{key}` {df.schema[key].dataType.simpleString()}, path string, keyword string")
    if not found:
        return none
    rows = df.select(key, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.unionByName(none) if names_against(df, schema) else rows


def with_defaults(df: DataFrame, schema: dict, defaults: bool = True, nulls: bool = False) -> DataFrame:
    """Missing columns get their default; with nulls, so do null values of columns whose type forbids null."""
    for name, sub in schema.get("properties", {}).items():
        if "default" not in sub or not sub.get("autoDefault", defaults):
            continue
        if name not in df.columns:
            df = df.withColumn(name, F.lit(sub["default"]))
        elif sub.get("autoDefaultNull", nulls) and "null" not in types_of(sub):
            c = F.col(f"`{name}`")
            df = df.withColumn(name, F.when(is_null(c, df.schema[name].dataType), F.lit(sub["default"])).otherwise(c))
    return df


def without_nulls(df: DataFrame, schema: dict) -> DataFrame:
    """Rows as JSON text `value`, null properties left out whose type forbids null and which have no default."""

    def part(name: str) -> Column:
        sub = schema.get("properties", {}).get(name, {"type": "null"})
        text = F.to_json(F.struct(F.col(f"`{name}`").alias(name)), {"ignoreNullFields": "false"})
        inner = F.substr(text, F.lit(2), F.length(text) - 2)
        return inner if "null" in types_of(sub) or "default" in sub else F.when(~is_null(F.col(f"`{name}`"), df.schema[name].dataType), inner)

    return df.withColumn("value", F.concat(F.lit("{"), F.concat_ws(",", *map(part, df.columns)), F.lit("}")))
