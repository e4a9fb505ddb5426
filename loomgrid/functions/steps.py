"""Paths built by attribute access, renamed by rules, and used as projections.

A step is the text of its new name, so it serves as a key; what it knows (old name, rules, children, lock, tags, schema)
sits in a node beside it. Everything here is plan time; `project` and `describe` turn a tree of steps into columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import Rules, join_steps

#: Texts have methods that frames and mappings look for by name; steps must not answer to these.
NO_STEPS = frozenset({"get_values", "Series"})
LOCKS = {3: "CAN_RELOCATE", 1: "CAN_RENAME", 0: "LOCKED"}


@dataclass
class Node:
    name: str
    rules: Rules | None = None
    children: dict[str, Step] = field(default_factory=dict)
    lock: int = 3
    tags: set[str] = field(default_factory=set)
    schema: dict | None = None


class Step(str):
    """One step of a path; `step.child` is the step below, made when first asked for.

    rules is a list of (path, new name) pairs or a Rules tree, of which the part that matches name gives the new name and
    what holds below; or another step, whose node is taken over under this name. Names from rules may hold ~0 and ~1 for
    ~ and /. Assigning a text to a child gives it that name; only texts, steps and private attributes can be assigned.
    """

    CAN_RELOCATE, CAN_RENAME, LOCKED = LOCKS

    def __new__(cls, name: str = "", rules: list[tuple[str, str]] | Rules | Step | None = None, alias: str | None = None, *tags: str) -> Step:
        if isinstance(rules, Step):
            node = replace(rules._node, name=name, children=dict(rules._node.children), tags=set(rules._node.tags))
        elif rules is None or isinstance(rules, (list, tuple, Rules)):
            tree = Rules.of(list(rules)) if isinstance(rules, (list, tuple)) else rules
            below, found = (tree, tree.alias) if tree is not None and name == "" else tree.descend(name) if tree is not None else (None, None)
            if alias is None and found is not None:
                alias = found.replace("~1", "/").replace("~0", "~")
            node = Node(name, below)
        else:
            raise ValueError(f"rules can't be a {type(rules).__name__}")
        step = super().__new__(cls, name if alias is None else alias)
        str.__setattr__(step, "_node", node)
        node.tags.update(tags)
        return step

    def __getattr__(self, name: str) -> Step:
        if name.startswith("_") or name in NO_STEPS:
            raise AttributeError(name)
        if name not in self._node.children:
            self._node.children[name] = Step(name, self._node.rules)
        return self._node.children[name]

    def __setattr__(self, name: str, value: Any) -> None:
        if name.startswith("_"):
            super().__setattr__(name, value)
        elif isinstance(value, Step):
            self._node.children[name] = Step(name, value)
        elif isinstance(value, str):
            old = self._node.children.get(name)
            self._node.children[name] = Step(name, self._node.rules if old is None else old, value)
        else:
            raise AssertionError(f"Cannot assign '{value}' to '{self}/{name}!")

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *self._node.children})

    def __repr__(self) -> str:
        return f"`{self}`"

    @property
    def _locked(self) -> int:
        return self._node.lock

    @_locked.setter
    def _locked(self, lock: int) -> None:
        old = self._node.name
        moved = self != old and "/" in self
        if (self != old and lock < self.CAN_RENAME) or (moved and lock < self.CAN_RELOCATE):
            raise ValueError(f"Cannot rename/relocate '{old}'-->'{self}' due to {LOCKS.get(lock, lock)}!")
        self._node.lock = int(lock)

    @property
    def _fix(self) -> Step:
        """May be renamed, not relocated, from here on."""
        self._locked = self.CAN_RENAME
        return self

    @property
    def _lock(self) -> Step:
        self._locked = self.LOCKED
        return self

    def _tag(self, *tags: str) -> Step:
        self._node.tags.update(tags)
        return self

    def _tag_remove(self, tag: str) -> Step:
        self._node.tags.discard(tag)
        return self

    @property
    def _tags(self) -> set[str]:
        return self._node.tags

    @property
    def _schema(self) -> dict:
        """JSON-Schema keywords of the step, made empty when first asked for."""
        if self._node.schema is None:
            self._node.schema = {}
        return self._node.schema

    def _schema_exists(self) -> bool:
        return self._node.schema is not None

    def _steps(self, keys: bool = False) -> list:
        return list(self._node.children) if keys else list(self._node.children.values())

    def _iter_hierarchy(self, above: tuple[Step, ...] = ()) -> Iterator[tuple[Step, ...]]:
        """The chains of steps from here to every step below, each step before what is below it."""
        chain = (*above, self)
        yield chain
        for child in self._node.children.values():
            yield from child._iter_hierarchy(chain)

    def _chains(self, tag: str | None = None) -> list[tuple[Step, ...]]:
        """Those that end in a leaf or, with tag, in a step that has it."""
        return [c for c in self._iter_hierarchy() if (tag in c[-1]._node.tags if tag else not c[-1]._node.children)]

    def _paths(self, with_orig: bool = False, tag: str | None = None) -> list[str]:
        def shown(s: Step) -> str:
            return f"({s._node.name}-->{s})" if with_orig and s != s._node.name else str(s)

        return sorted({join_steps(*map(shown, chain)) for chain in self._chains(tag)})

    def _derrive_map_tuples(self) -> list[tuple[str, str]]:
        """(old path, new name) of every step, by path: rules that would make this tree."""
        return sorted((join_steps(*(s._node.name for s in chain)), str(chain[-1])) for chain in self._iter_hierarchy())


def old_column(chain: tuple[Step, ...]) -> Column:
    """The column or nested field that a chain of steps names by the old names."""
    return F.col(".".join(f"`{s._node.name}`" for s in chain if s._node.name))


def project(df: DataFrame, root: Step, tag: str | None = None) -> DataFrame:
    """The columns and nested fields that the tree names, as columns under their new paths; a projection only.

    Tags and schema of a step become metadata of its column.
    """
    columns = []
    for chain in root._chains(tag):
        last, new = chain[-1], join_steps(*map(str, chain)).lstrip("/")
        metadata = ({"tags": sorted(last._node.tags)} if last._node.tags else {}) | ({"schema": last._node.schema} if last._node.schema else {})
        columns.append(old_column(chain).alias(new, metadata=metadata) if metadata else old_column(chain).alias(new))
    return df.select(*columns)


def steps_from(rules: DataFrame, path_col: str = "paths", name_col: str = "names") -> Step:
    """A tree out of a table of rules: paths of one level, new names, and further columns that become private attributes.

    Rules are a plan, not data: the table comes to the driver.
    """
    rows = rules.collect()
    root = Step("", [(r[path_col], r[name_col]) for r in rows])
    for r in rows:
        step = getattr(root, r[path_col].lstrip("/"))
        for c in rules.columns:
            if c == "tags":
                step._tag(*(r[c] or ()))
            elif c not in (path_col, name_col):
                setattr(step, f"_{c}", r[c])
    return root
