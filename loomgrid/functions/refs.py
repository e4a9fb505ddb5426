"""The reference language for rectangles in sheets: parsing and resolving, all on the driver.

[url]#[sheet!][1st edge][:[2nd edge][:expansions]][:filters as JSON]
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from urllib.parse import urldefrag

MOVES = {"L": (0, -1), "U": (-1, 0), "R": (0, 1), "D": (1, 0)}
MANY = 1 << 30
_CELL = r"(?P<{0}a1>(?P<{0}col>[A-Za-z]+|[_^.])(?P<{0}row>[1-9][0-9]*|[_^.]))|(?P<{0}rc>[Rr](?P<{0}rcrow>-?[0-9]+|[_^.])[Cc](?P<{0}rccol>-?[0-9]+|[_^.]))"
_MOVE = r"(?:\((?P<{0}mov>[LURDlurd]{{1,2}})(?P<{0}mod>[+?-])?\))?"
_REF = re.compile(
    r"^\s*(?:(?P<sheet>[^!:\"\[\]{}]*)!)?(?:(?:" + _CELL.format("st") + ")" + _MOVE.format("st") + r")?"
    r"(?P<colon>:(?:(?:" + _CELL.format("nd") + ")" + _MOVE.format("nd") + r")?(?::(?P<exp>[LURDlurd?0-9]+))?)?(?::?(?P<js>[\[{\"].*))?\s*$",
    re.DOTALL,
)


@dataclass(frozen=True)
class Cell:
    row: str
    col: str


@dataclass(frozen=True)
class Edge:
    land: Cell
    mov: str | None = None
    mod: str | None = None


@dataclass(frozen=True)
class Call:
    func: str
    args: tuple = ()
    kwds: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Ref:
    url: str | None
    sheet: str | None
    first: Edge | None
    second: Edge | None
    expansions: tuple[tuple[str, int], ...]
    call: Call | None
    opts: dict


def parse_call(spec) -> Call:  # noqa: ANN001
    """A filter from its name, [name, args, kwds] in any order of the last two, or {func, args, kwds}."""
    if isinstance(spec, str):
        return Call(spec)
    if isinstance(spec, dict):
        if set(spec) - {"func", "args", "kwds"} or not isinstance(spec.get("func"), str):
            raise ValueError(f"not a call: {spec}")
        parts = [x for x in (spec.get("args"), spec.get("kwds")) if x is not None]
        name = spec["func"]
    elif isinstance(spec, list) and spec and isinstance(spec[0], str) and len(spec) <= 3:
        name, parts = spec[0], [x for x in spec[1:] if x is not None]
    else:
        raise ValueError(f"not a call: {spec}")
    lists, maps = [x for x in parts if isinstance(x, list)], [x for x in parts if isinstance(x, dict)]
    if len(lists) > 1 or len(maps) > 1 or len(lists) + len(maps) != len(parts):
        raise ValueError(f"not a call: {spec}")
    return Call(name, tuple(lists[0]) if lists else (), maps[0] if maps else {})


def parse_expansions(text: str | None) -> tuple[tuple[str, int], ...]:
    """Groups of directions with the number of times each may grow: a digit (or ?, for 1) bounds the letter before it."""
    out = []
    for letters, times in re.findall(r"([LURDlurd]+)([?0-9]*)", text or ""):
        letters = letters.upper()
        if times:
            if len(letters) > 1:
                out.append((letters[:-1], MANY))
            out.append((letters[-1], 1 if times == "?" else int(times)))
        else:
            out.append((letters, MANY))
    return tuple(out)


def _edge(m: re.Match, k: str) -> Edge | None:
    if m[f"{k}a1"]:
        cell = Cell(m[f"{k}row"], m[f"{k}col"].upper())
    elif m[f"{k}rc"]:
        cell = Cell(f"R{m[f'{k}rcrow']}", f"C{m[f'{k}rccol']}")
    else:
        return None
    mov = m[f"{k}mov"]
    if mov and len(mov) == 2 and {x.upper() for x in mov} in ({"L", "R"}, {"U", "D"}, {"L"}, {"R"}, {"U"}, {"D"}):
        raise ValueError(f"moves along one axis: {mov}")
    mod = m[f"{k}mod"]
    return Edge(cell, mov and mov.upper(), "?" if mod == "-" else mod)


def parse(ref: str) -> Ref:
    """The parts of a reference; without # it is no reference. One pair of enclosing / \\ \" $ % & is taken off."""
    if "#" not in ref:
        raise ValueError(f"no # in {ref!r}")
    quotes = str.maketrans("“”‘’", "\"\"''")
    url, fragment = urldefrag(ref.translate(quotes))
    try:
        return _parse(url, fragment)
    except ValueError:
        inner = re.search(r"([/\\\"$%&])(.*)\1", ref, re.DOTALL)
        if not inner or "#" not in inner[2]:
            raise
        return _parse(*urldefrag(inner[2].translate(quotes)))


def _parse(url: str, fragment: str) -> Ref:
    m = _REF.match(fragment)
    if not m:
        raise ValueError(f"not a reference: {fragment!r}")
    first, second = _edge(m, "st"), _edge(m, "nd")
    spec = json.loads(m["js"]) if m["js"] else None
    opts = {}
    if isinstance(spec, dict) and "opts" in spec:
        opts = spec.pop("opts")
        if not isinstance(opts, dict):
            raise ValueError("opts must be an object")
        spec = spec or None
    if isinstance(spec, list) and spec and all(isinstance(x, (list, dict)) for x in spec):
        spec = ["pipe", spec]
    call = parse_call(spec) if spec is not None else None
    if m["colon"] or (first is None and second is None):
        first = first or Edge(Cell("^", "^"))
        second = second or Edge(Cell("_", "_"))
    return Ref(url or None, m["sheet"] or None, first, second, parse_expansions(m["exp"]), call, opts)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _coordinate(text: str, is_col: bool, low: int, high: int, base: int | None) -> int:
    text = text[1:] if text[:1] in ("R", "C") and (len(text) > 1 and (text[1:].lstrip("-").isdigit() or text[1] in "^_.")) else text
    if text == "^":
        return low
    if text == "_":
        return high
    if text == ".":
        if base is None:
            raise ValueError("a relative coordinate needs a base")
        return base
    n = column_number(text) if is_col and not text.lstrip("-").isdigit() else int(text)
    if is_col and not text.lstrip("-").isdigit():
        return n
    if n == 0:
        raise ValueError("coordinates count from 1")
    return n - 1 if n > 0 else high + n + 1


def resolve(cell: Cell, up: tuple[int, int], down: tuple[int, int], base: tuple[int, int] | None) -> tuple[int, int]:
    """0-based (row, col): ^ and _ are the first and last full line, . the base, negatives count from the end."""
    return (_coordinate(cell.row, False, up[0], down[0], base and base[0]), _coordinate(cell.col, True, up[1], down[1], base and base[1]))
