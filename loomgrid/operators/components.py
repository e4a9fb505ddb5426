"""Components: functions over a tree of columns, whose inputs and outputs are found by running them on a recorder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.paths import Rules


class _Recorder:
    def __init__(self):
        self.read: list[str] = []
        self.written: dict[str, Column] = {}

    def __getitem__(self, name: str) -> Column:
        if name in self.written:
            return self.written[name]
        if name not in self.read:
            self.read.append(name)
        return F.col(name)

    def __setitem__(self, name: str, value: Column) -> None:
        self.written[name] = value


class Component:
    """A function of a mapping from names to columns, under names that rules may change."""

    def __init__(self, func: Callable, name: str | None = None, rules: Rules | None = None):
        self.func = func
        self.name = name or func.__name__.removeprefix("cfunc_")
        self.rules = rules or Rules()
        dry = self._run()
        self.inputs, self.outputs = sorted(map(self.path, dry.read)), sorted(map(self.path, dry.written))

    def _run(self) -> _Recorder:
        recorder = _Recorder()
        self.func(recorder)
        return recorder

    def path(self, name: str) -> str:
        return self.rules.map_path(f"/{self.name}/{name}")

    def column(self, name: str) -> str:
        return self.path(name).rsplit("/", 1)[-1]

    def __call__(self, df: DataFrame) -> DataFrame:
        done = self._run()
        names = {n: self.column(n) for n in [*done.read, *done.written]}
        df = df.select("*", *(F.col(names[n]).alias(n) for n in done.read if n not in df.columns))
        out = df.withColumns({names[n]: c for n, c in done.written.items()})
        return out.drop(*(n for n in done.read if n != names[n]))


class Assembly:
    """Components together: the union of their paths; called, they run in the order of what they need."""

    def __init__(self, components: list[Component]):
        self.components = components
        self.inputs = sorted({p for c in components for p in c.inputs})
        self.outputs = sorted({p for c in components for p in c.outputs})

    def __call__(self, df: DataFrame) -> DataFrame:
        rest = list(self.components)
        while rest:
            made = {p.rsplit("/", 1)[-1] for c in rest for p in c.outputs}
            ready = next((c for c in rest if not ({p.rsplit("/", 1)[-1] for p in c.inputs} & (made - {p.rsplit("/", 1)[-1] for p in c.outputs}))), None)
            if ready is None:
                raise ValueError("components need each other in a circle")
            df = ready(df)
            rest.remove(ready)
        return df
