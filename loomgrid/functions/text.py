"""Scalar functions: units, pointers, truth values, names."""

from __future__ import annotations

import json
import operator
import re
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def units(s: Column) -> Column:
    """'name [u]' or 'name <u>' as struct(name, units); units null without brackets, all null if they don't close."""
    pattern = r"^\s*([^\[\]<>]*?)\s*(?:\[([^\[\]]*)\]|<([^<>]*)>)?\s*$"
    ok = F.rlike(s, F.lit(pattern))
    name = F.regexp_extract(s, pattern, 1)
    unit = F.concat(F.regexp_extract(s, pattern, 2), F.regexp_extract(s, pattern, 3))
    has = F.rlike(s, F.lit(r"[\[<]"))
    return F.when(ok, F.struct(name.alias("name"), F.when(has, unit).alias("units")))


def escape(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_parts(p: Column, relaxed: bool = False) -> Column:
    """Steps of a JSON pointer, unescaped. Strict ones must begin with / (or be empty); relaxed ones keep a first ''."""
    parts = F.transform(F.split(p, "/"), unescape)
    if relaxed:
        return parts
    checked = F.when((p == "") | F.startswith(p, F.lit("/")), parts).otherwise(F.raise_error(F.concat(F.lit("not an absolute pointer: "), p)).cast("array<string>"))
    return F.slice(checked, F.lit(2), F.size(checked))


def json_path(pointer: str) -> str:
    """A JSON pointer as the path that variant_get takes."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError(f"not an absolute pointer: {pointer}")
    out = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        quoted = part.replace("\\", "\\\\").replace("'", "\\'")
        out += f"[{part}]" if part.isdigit() else f"['{quoted}']"
    return out


def pointer_get(json_text: Column, pointer: str, kind: str = "string", default: Column | None = None) -> Column:
    """The value at a pointer in JSON text; default where it is missing, null without one."""
    got = F.try_variant_get(F.try_parse_json(json_text), json_path(pointer), kind)
    return got if default is None else F.coalesce(got, default)


def pointer_set(json_text: Column, key: str, value: Column) -> Column:
    """JSON text of a flat object with one key set, other keys kept."""
    entries = F.from_json(json_text, "map<string,string>")
    return F.to_json(F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce(entries, F.create_map().cast("map<string,string>"))), lambda e: e["key"] != key), F.array(F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))))))


def put(doc: Any, parts: list[str], value: Any) -> Any:
    """doc with value at the pointer's steps. Objects are made where nothing or a scalar is in the way; in a list '-' or
    its length appends, and a step beyond that or without a number is an error."""
    if not parts:
        return value
    step, rest = parts[0], parts[1:]
    if isinstance(doc, list):
        place = len(doc) if step == "-" else int(step) if step.isdigit() else -1
        if not 0 <= place <= len(doc):
            raise ValueError(f"no place {step} in a list of {len(doc)}")
        below = doc[place] if place < len(doc) else None
        return [*doc[:place], put(below, rest, value), *doc[place + 1 :]]
    new = dict(doc) if isinstance(doc, dict) else {}
    new[step] = put(new.get(step), rest, value)
    return new


def pointer_put(json_text: Column, pointer: str, value: Column) -> Column:
    """JSON text with the JSON text `value` at a pointer of any depth; null stays null, and so does text that is no JSON.

    No built-in function writes into schema-less JSON, so this is an Arrow-batched function.
    """
    json_path(pointer)  # checks it
    parts = [x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]]

    def one(doc: str | None, new: str | None) -> str | None:
        try:
            old = json.loads(doc) if doc is not None else None
        except ValueError:
            return None
        return None if doc is None or new is None else json.dumps(put(old, parts, json.loads(new)), ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def write(docs: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([one(d, v) for d, v in zip(docs, new, strict=True)], dtype=object)

    return write(json_text, value)


def resolve_path(doc: Any, path: str, *default: Any, root: Any = None) -> Any:
    """The value at a path in nested dicts, lists and objects: each step is an index, a key or an attribute.

    '' begins anew at root (doc without one), '.' stays. Missing steps give the default, or an error without one.
    """
    top = doc if root is None else root
    at = doc
    for step in ("" if path == "/" else path).split("/") if path else []:
        if step == "":
            at = top
        elif step != ".":
            step = step.replace("~1", "/").replace("~0", "~")
            try:
                at = at[int(step)] if isinstance(at, (list, tuple)) and step.lstrip("-").isdigit() else at[step] if isinstance(at, dict) else getattr(at, step)
            except (LookupError, AttributeError):
                if default:
                    return default[0]
                raise LookupError(f"nothing at {step} of {path}") from None
    return at


def schema_paths(schema: dict, above: str = "") -> list[str]:
    """Pointers of all leaves of a JSON Schema: through properties, and through oneOf, anyOf and allOf."""
    found = []
    for name, below in (schema.get("properties") or {}).items():
        found += schema_paths(below, f"{above}/{name.replace('~', '~0').replace('/', '~1')}")
    for word in ("oneOf", "anyOf", "allOf"):
        for choice in schema.get(word) or ():
            found += [x for x in schema_paths(choice, above) if x != above]
    return sorted(set(found)) or [above]


def struct_paths(kind: DataType, above: str = "") -> list[str]:
    """The same over a table's schema: the leaf fields of nested structs."""
    if not isinstance(kind, StructType):
        return [above]
    return [x for f in kind.fields for x in struct_paths(f.dataType, f"{above}/{f.name.replace('~', '~0').replace('/', '~1')}")]


def truth(s: Column) -> Column:
    """yes, true, on and no, false, off, 0, empty in any case, white space around them aside; other texts are true, null stays null."""
    t = F.lower(F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.when(t.isin("yes", "true", "on"), True).when(t.isin("no", "false", "off", "0", ""), False).when(t.isNotNull(), True)


def snake(s: Column) -> Column:
    """An underscore before each run of capitals that follows a-z or a digit, all in lower case: CO2DiceApp -> co2_dice_app."""
    return F.lower(F.regexp_replace(s, "(?<=[a-z0-9])([A-Z]+)", "_$1"))


def with_extension(path: Column, extension: str, *others: str, is_regex: bool = False) -> Column:
    """The path, with the extension behind it unless it ends in it or in one of the others, in any case.

    With is_regex the others are patterns for the whole extension, its dot included.
    """
    ext = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)
    if is_regex:
        patterns = [f"(?i)^(?:{x})$" for x in (re.escape(extension), *others)]
        fits = reduce(operator.or_, (F.rlike(ext, F.lit(x)) for x in patterns))
    else:
        fits = reduce(operator.or_, (F.endswith(F.lower(ext), F.lit(x.lower())) for x in (extension, *others)))
    return F.when(fits, path).otherwise(F.concat(F.regexp_replace(path, r"\.$", ""), F.lit("." + extension.removeprefix("."))))


def first_defined(*columns: Column) -> Column:
    return F.coalesce(*columns)
