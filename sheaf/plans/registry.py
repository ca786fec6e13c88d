"""Operators with declared columns, checked while a plan is built, and surgery on lists of them.

A step is a function DataFrame -> DataFrame with the columns that it needs and makes.  A pipeline is a list of steps
folded into one plan; Catalyst fuses and prunes it.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

REGISTRY: dict[str, Step] = {}


@dataclass(frozen=True)
class Step:
    """A named operator. kind 'numpy' marks those that cross into Python workers; they are best put last."""

    name: str
    run: Callable[..., DataFrame]
    inputs: frozenset[str] = frozenset()
    outputs: frozenset[str] = frozenset()
    optional: frozenset[str] = frozenset()
    kind: str = "sql"
    parameters: dict = field(default_factory=dict)

    def with_parameters(self, **new: object) -> Step:
        """The step with parameters bound; names that its function lacks are an error."""
        known = inspect.signature(self.run).parameters
        wrong = [k for k in new if k not in known and not any(p.kind is p.VAR_KEYWORD for p in known.values())]
        if wrong:
            raise TypeError(f"{self.name} has no parameters {wrong}")
        return replace(self, parameters={**self.parameters, **new})

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.run(df, **self.parameters)


def names(text: str | Iterable[str]) -> frozenset[str]:
    """Column names; 'a|b,c' stands for a, b and c."""
    parts = text.replace("|", ",").split(",") if isinstance(text, str) else text
    return frozenset(x.strip() for x in parts if x.strip())


def step(inputs: str | Iterable[str] = "", outputs: str | Iterable[str] = "", optional: str | Iterable[str] = "", kind: str = "sql"):
    """Registers a function as a step under its name."""

    def register(f: Callable[..., DataFrame]) -> Step:
        REGISTRY[f.__name__] = s = Step(f.__name__, f, names(inputs), names(outputs), names(optional), kind)
        return s

    return register


class MissingColumns(ValueError):
    """A step needs columns that nothing before it makes."""


def check(steps: list[Step], columns: Iterable[str]) -> frozenset[str]:
    """Columns after all steps; raises MissingColumns with the step and what it lacks."""
    have = frozenset(columns)
    for s in steps:
        if lack := s.inputs - have:
            raise MissingColumns(f"{s.name} needs {sorted(lack)}")
        have |= s.outputs
    return have


def without_columns(steps: list[Step], ignored: Iterable[str]) -> list[Step]:
    """Steps that are left when columns are not wanted: those that make only such columns go, and with them all that
    need what they made."""
    gone, out = set(ignored), []
    for s in steps:
        if (s.outputs and s.outputs <= gone) or s.inputs & gone:
            gone |= s.outputs
        else:
            out.append(s)
    return out


def without(steps: list[Step], dropped: Iterable[str]) -> list[Step]:
    gone = set(dropped)
    return [s for s in steps if s.name not in gone]


def before(steps: list[Step], name: str) -> list[Step]:
    return steps[: [s.name for s in steps].index(name)]


def after(steps: list[Step], name: str) -> list[Step]:
    return steps[[s.name for s in steps].index(name) + 1 :]


def only(steps: list[Step], kept: Iterable[str]) -> list[Step]:
    keep = set(kept)
    return [s for s in steps if s.name in keep]


def apply(df: DataFrame, steps: list[Step]) -> DataFrame:
    """One plan of all steps, after the check."""
    check(steps, df.columns)
    for s in steps:
        df = s(df)
    return df
