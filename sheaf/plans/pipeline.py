"""Pipelines from a description: scan, metadata steps, global dimensions, sampler, sample steps, batches.

The description is a plain dictionary (or YAML where a reader is installed).  Branches such as {default: .., debug: ..}
are chosen by name before anything is built.  Building touches no data but for dimension tables; the result is one
DataFrame.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import collate, ordering, samplers
from .registry import REGISTRY, Step, apply, check, without_columns


def chosen(tree: object, picks: list[str]) -> object:
    """The tree with its branches chosen: a dictionary all of whose keys are branch names becomes the value of the first
    pick that it has, else of default."""
    if isinstance(tree, list):
        return [chosen(x, picks) for x in tree]
    if not isinstance(tree, dict):
        return tree
    if "default" in tree:
        for p in [*picks, "default"]:
            if p in tree:
                return chosen(tree[p], picks)
    return {k: chosen(v, picks) for k, v in tree.items()}


def by_path(tree: dict, path: str, default: object = None) -> object:
    """Value at a dotted path."""
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree


def by_suffix(tree: dict, name: str, prefix: str = "") -> object:
    """Value of the first path that ends with the name."""
    for k, v in tree.items():
        path = f"{prefix}.{k}" if prefix else k
        if path == name or path.endswith(f".{name}"):
            return v
        if isinstance(v, dict) and (found := by_suffix(v, name, path)) is not None:
            return found
    return None


def flat(tree: dict, prefix: str = "") -> dict[str, object]:
    """Leaves by dotted path."""
    out: dict[str, object] = {}
    for k, v in tree.items():
        path = f"{prefix}.{k}" if prefix else k
        out |= flat(v, path) if isinstance(v, dict) and v else {path: v}
    return out


def rebuilt(leaves: dict[str, object]) -> dict:
    """The tree of such leaves."""
    out: dict = {}
    for path, v in leaves.items():
        at = out
        *inner, last = path.split(".")
        for part in inner:
            at = at.setdefault(part, {})
        at[last] = v
    return out


def digest(tree: object, ignored: tuple[str, ...] = ("device",)) -> str:
    """Eight hex digits of a description, device keys left out."""
    strip = lambda x: {k: strip(v) for k, v in x.items() if k not in ignored} if isinstance(x, dict) else [strip(v) for v in x] if isinstance(x, list) else x
    return hashlib.md5(json.dumps(strip(tree), sort_keys=True, default=str).encode()).hexdigest()[:8]


@dataclass
class Pipeline:
    """Steps of a run. dims: name -> table made of the whole set (ids, ranges), handed to steps that ask for them."""

    meta: list[Step] = field(default_factory=list)
    features: list[Step] = field(default_factory=list)
    dims: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    sampler: dict = field(default_factory=dict)
    batch: dict = field(default_factory=dict)
    ignored: tuple[str, ...] = ()

    @classmethod
    def from_tree(cls, tree: dict, picks: list[str] | None = None, dims: dict | None = None) -> Pipeline:
        """A pipeline from a description: {meta: [{name: .., parameter: ..}], features: [..], sampler: {..}, batch: {..},
        ignored: [..]}."""
        t = chosen(tree, picks or [])
        make = lambda items: [REGISTRY[x["name"]].with_parameters(**{k: v for k, v in x.items() if k != "name"}) for x in items]
        return cls(make(t.get("meta", [])), make(t.get("features", [])), dims or {}, t.get("sampler", {}), t.get("batch", {}), tuple(t.get("ignored", ())))

    def check(self, columns: list[str]) -> frozenset[str]:
        return check(without_columns([*self.meta, *self.features], self.ignored), columns)

    def samples(self, df: DataFrame) -> DataFrame:
        """All samples with their features, as one plan. Steps with a parameter `dims` get the dimension tables."""
        rows = apply(df, without_columns(self.meta, self.ignored))
        tables = {k: f(rows) for k, f in self.dims.items()}
        steps = [s.with_parameters(dims=tables) if "dims" in s.run.__code__.co_varnames[: s.run.__code__.co_argcount] else s for s in without_columns(self.features, self.ignored)]
        return apply(rows, steps)

    def batches(self, df: DataFrame) -> DataFrame:
        """Samples in batches (batch_id, row_in_batch, is_last), padded where the description says so."""
        rows, s = self.samples(df), self.sampler
        key = s.get("key", "uid")
        if s.get("by_length"):
            out = rows.join(samplers.bucketed_batches(rows, key, s["by_length"], s.get("size", 32), s.get("seed", 0)), key)
        else:
            out = ordering.sequential_batches(rows, key, s.get("size", 32))
        for column, pad in self.batch.get("pad", {}).items():
            out = collate.padded(out, "batch_id", column, pad, self.batch.get("multiple", 1)).withColumnRenamed("length", f"{column}_length").drop("relative_length")
        return out
