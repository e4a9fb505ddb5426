"""Names of files and commands, pairs and lines of text: small helpers, on the driver unless they take columns."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable, Iterator
from typing import Any
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_list(x: Any) -> list:
    """A list as it is, a tuple or set as a list, nothing as an empty list, all else as a list of one."""
    if x is None:
        return []
    return list(x) if isinstance(x, (list, tuple, set, frozenset)) else [x]


def command_name(s: str) -> str:
    """CO2DiceApp -> co2-dice-app."""
    return re.sub(r"(?<=[a-z0-9])[A-Z]+", lambda m: f"-{m[0]}", s).lower()


def format_pairs(items: Iterable[tuple[str, Any]], indent: int = 16) -> str:
    """One 'key = value' line for each, keys padded to the next multiple of indent."""
    return "\n".join(f"{k:<{max(1, math.ceil(len(k) / indent)) * indent}} = {v}" for k, v in items)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped; null without one."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), 0)


def normal_path(path: str) -> str:
    """Normalised, with ~ and variables expanded; a final slash stays."""
    path = os.path.expandvars(os.path.expanduser(path))
    tail = "/" if path.endswith(("/", os.sep)) and path.strip("/" + os.sep) else ""
    return os.path.normpath(path) + tail


def path_to_url(path: str) -> str:
    """A file: URL of a local, drive or share path; what has a scheme already passes through."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return path
    path = path.replace("\\", "/")
    if path.startswith("//"):
        return "file:" + quote(path)
    if re.match(r"[A-Za-z]:", path):
        return "file:///" + path[:2] + quote(path[2:])
    return "file://" + quote(path if path.startswith("/") else os.path.abspath(path) + ("/" if path.endswith("/") else ""))


def url_to_path(url: str) -> str:
    """The path that a file: URL names; other URLs pass through."""
    parts = urlsplit(url)
    if parts.scheme != "file":
        return url
    path = unquote(parts.path)
    return f"//{parts.netloc}{path}" if parts.netloc not in ("", "localhost") else path[1:] if re.match(r"/[A-Za-z]:", path) else path


def candidates(name: str) -> Iterator[str]:
    """The name, then with 1, 2, ... before its extension."""
    stem, ext = os.path.splitext(name)
    yield name
    k = 0
    while True:
        k += 1
        yield f"{stem}{k}{ext}"


def unique_name(name: str, taken=os.path.exists) -> str:  # noqa: ANN001
    """The first candidate that isn't taken; taken is a collection or a test."""
    test = taken if callable(taken) else taken.__contains__
    return next(c for c in candidates(name) if not test(c))
