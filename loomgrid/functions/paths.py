"""Paths as columns and rules that rename or relocate them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_step(steps: list[str], step: str) -> list[str]:
    """Reduce one more step: '' starts anew at the root, '.' is nothing, '..' takes one back and stops at the root."""
    if step == "":
        return [""]
    if step == ".":
        return steps
    if step == "..":
        if steps and steps[-1] not in ("", ".."):
            return steps[:-1]
        return steps if steps == [""] else [*steps, ".."]
    return [*steps, step]


def join_steps(*paths: str) -> str:
    steps: list[str] = []
    for path in paths:
        for step in path.split("/"):
            steps = add_step(steps, step)
    if steps == [""]:
        return ""
    return "/".join(steps) or "."


def join_column(steps: Column) -> Column:
    """join_steps of an array of single steps, as one expression."""
    def reduce(acc: Column, s: Column) -> Column:
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1))
        shorter = F.slice(acc, F.lit(1), F.size(acc) - 1)
        up = F.when(last.isNotNull() & ~last.isin("", ".."), shorter).when((F.size(acc) == 1) & (last == ""), acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
        return F.when(s == "", F.array(F.lit(""))).when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    out = F.aggregate(steps, F.array().cast("array<string>"), reduce)
    return F.when(F.size(out) == 0, F.lit(".")).otherwise(F.array_join(out, "/"))


@dataclass
class Rules:
    """A tree of rules: exact children, ordered pattern children, and the new name of the step that leads here."""

    alias: str | None = None
    steps: dict[str, Rules] = field(default_factory=dict)
    patterns: dict[str, Rules] = field(default_factory=dict)

    @classmethod
    def of(cls, pairs: list[tuple[str, str]]) -> Rules:
        """From (path, new name) pairs; steps that begin with ~ are patterns. Empty pairs are skipped; a repeated pattern moves last."""
        root = cls()
        for source, target in pairs:
            if source is None or target is None or (source == "" and target == ""):
                continue
            node = root
            for step in source.split("/")[1:] if source.startswith("/") else ([] if source == "" else source.split("/")):
                if step.startswith("~"):
                    child = node.patterns.pop(step[1:], None) or cls()
                    node.patterns[step[1:]] = child
                else:
                    child = node.steps.setdefault(step, cls())
                node = child
            node.alias = target
        return root

    def merged(self, other: Rules) -> Rules:
        """Both trees' rules; other's names win, and its patterns come behind."""
        steps = dict(self.steps)
        for k, v in other.steps.items():
            steps[k] = steps[k].merged(v) if k in steps else v
        patterns = {k: v for k, v in self.patterns.items() if k not in other.patterns}
        for k, v in other.patterns.items():
            patterns[k] = self.patterns[k].merged(v) if k in self.patterns else v
        return Rules(other.alias if other.alias is not None else self.alias, steps, patterns)

    def descend(self, step: str) -> tuple[Rules | None, str | None]:
        """The rules below a step, all matches merged, and its new name: an exact one before patterns, of these the last."""
        found, alias = None, None
        for pattern, child in self.patterns.items():
            if m := re.fullmatch(pattern, step):
                found = child if found is None else found.merged(child)
                if child.alias is not None:
                    alias = m.expand(child.alias)
        if child := self.steps.get(step):
            found = child if found is None else found.merged(child)
            if child.alias is not None:
                alias = child.alias
        return found, alias

    def map_path(self, path: str) -> str:
        """The path with every step renamed or relocated; a final slash is dropped."""
        if path == "":
            return self.alias or ""
        steps = path.rstrip("/").split("/") if path != "/" else [""]
        out: list[str] = []
        rules: Rules | None = self
        if steps[0] == "":
            out = self.alias.split("/") if self.alias else [""]
            steps = steps[1:]
        for step in steps:
            alias = None
            if rules is not None:
                rules, alias = rules.descend(step)
            if alias is None:
                out = add_step(out, step)
            elif alias != "" and alias.startswith("."):
                for s in [step, *alias.split("/")] if alias.startswith("./") else alias.split("/"):
                    out = add_step(out, s)
            else:
                for s in alias.split("/") if alias else [""]:
                    out = add_step(out, s)
        return "" if out == [""] else "/".join(out) or "."

    def pairs(self, at: str = "") -> list[tuple[str, str]]:
        """(path, new name) of every rule, by path: the inverse of of()."""
        out = [(at, self.alias)] if self.alias is not None else []
        for k, v in self.steps.items():
            out += v.pairs(f"{at}/{k}")
        for k, v in self.patterns.items():
            out += v.pairs(f"{at}/~{k}")
        return sorted(out)


def rename_columns(df: DataFrame, rules: Rules) -> DataFrame:
    """Columns renamed as paths below the root; a projection only."""
    new = [rules.map_path(f"/{c}").lstrip("/") for c in df.columns]
    return df.toDF(*new)


def _java(replacement: str) -> str:
    return re.sub(r"\\g<(\d+)>|\\(\d)", lambda m: f"${m[1] or m[2]}", replacement.replace("$", r"\$"))


def step_alias(step: Column, rules: Rules) -> Column:
    """New name of a step under one node's rules, in expressions: exact before patterns, the last pattern first."""
    out = step
    for pattern, child in rules.patterns.items():
        if child.alias is not None:
            out = F.when(F.rlike(step, F.lit(f"^(?:{pattern})$")), F.regexp_replace(step, F.lit(f"^(?:{pattern})$"), F.lit(_java(child.alias)))).otherwise(out)
    for name, child in rules.steps.items():
        if child.alias is not None:
            out = F.when(step == name, F.lit(child.alias)).otherwise(out)
    return out


def relocate(df: DataFrame, column: str, rules: Rules, to: str) -> DataFrame:
    """Adds the mapped form of a path column. The rules' tree is walked in an Arrow-batched function, distinct or not."""
    def mapped(batches):
        for frame in batches:
            seen = {p: rules.map_path(p) for p in frame[column].dropna().unique()}
            yield frame.assign(**{to: frame[column].map(seen)})

    return df.mapInPandas(mapped, df.withColumn(to, F.lit("").cast("string")).schema)
