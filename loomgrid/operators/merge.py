"""Overlays of models: what is above wins, nulls let what is below show. And the build pipeline over them."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import violations, with_defaults


def series(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both; b's value unless null, else a's."""
    joined = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    return joined.select(key, F.coalesce("_b", "_a").alias(value))


def frame(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a's rows; shared columns take b's values unless null, b's further columns are added. Rows of b alone are dropped."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    extra = [c for c in b.columns if c not in a.columns]
    over = b.select(key, *(F.col(c).alias(f"_b_{c}") for c in shared), *extra)
    joined = a.join(over, key, "left")
    return joined.select(key, *(F.coalesce(f"_b_{c}", c).alias(c) if c in shared else F.col(c) for c in a.columns if c != key), *extra)


def maps(a: Column, b: Column) -> Column:
    """Union of keys; b's value unless null."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.try_element_at(b, k), F.try_element_at(a, k)).alias("value"))))


def objects(a: Column, b: Column) -> Column:
    """JSON texts of nested objects, b over a: keys of both at every depth; b's lists and scalars win unless null.

    A null or unreadable text lets the other one show. Nested schema-less objects need an Arrow-batched function.
    """

    def read(text: str | None) -> object:
        try:
            return json.loads(text) if text is not None else None
        except ValueError:
            return None

    def over(x: object, y: object) -> object:
        return overlay([x, y]) if isinstance(x, dict) and isinstance(y, dict) else x if y is None else y

    @F.pandas_udf("string")
    def merged(below: pd.Series, above: pd.Series) -> pd.Series:
        both = [over(read(x), read(y)) for x, y in zip(below, above, strict=True)]
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in both], dtype=object)

    return merged(a, b)


def scalar(a: Column, b: Column) -> Column:
    """struct(value, violation): b unless null, else a; a violation where both are null."""
    return F.struct(F.coalesce(b, a).alias("value"), F.when(a.isNull() & b.isNull(), F.lit("neither model has a value")).alias("violation"))


def sequence(a: Column, b: Column) -> Column:
    return F.coalesce(b, a)


def overlay(layers: list[dict]) -> dict:
    """Trees of nested maps on the driver: the last layer is on top; a null lets the one below show."""
    def two(a: dict, b: dict) -> dict:
        out = dict(a)
        for k, v in b.items():
            out[k] = two(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else out.get(k) if v is None else v
        return out

    return reduce(two, layers, {})


class Build:
    """Check each layer, merge them in order, check the result, then curate it. Stops at the first stage that fails."""

    def __init__(self, key: str, loose: dict, strict: dict, curate: list[Callable[[DataFrame], DataFrame]] = ()):
        self.key, self.loose, self.strict, self.curate = key, loose, strict, curate
        self.layers: list[DataFrame] = []

    def add(self, df: DataFrame) -> Build:
        self.layers.append(df)
        return self

    def run(self) -> tuple[DataFrame | None, DataFrame]:
        """The model, or none if a stage failed, and the violations with their stage."""
        bad = [violations(x, self.loose, self.key).withColumn("stage", F.lit("prevalidate")) for x in self.layers]
        first = reduce(DataFrame.unionByName, bad)
        if not first.isEmpty():
            return None, first
        merged = with_defaults(reduce(lambda a, b: frame(a, b, self.key), self.layers), self.strict)
        last = violations(merged, self.strict, self.key).withColumn("stage", F.lit("validate"))
        if not last.isEmpty():
            return None, last
        return reduce(lambda d, f: d.transform(f), self.curate, merged), last
