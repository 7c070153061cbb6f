"""Pipelines from JSON: registered functions called by name, never evaluated code.

A call is an object with one key, the function's name, whose value holds its arguments; "${name}" stands for
a registered object or a named cache entry; a stage inherits keys that it lacks from the stages before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from typing import Any

REGISTRY: dict[str, Any] = {}


def register(function: Callable) -> Callable:
    """Makes a function known by its name, which must be new."""
    if REGISTRY.setdefault(function.__name__, function) is not function:
        raise ValueError(f"{function.__name__} is registered already")
    return function


def strip_comments(text: str) -> str:
    """JSON text without # and // comments, whole lines or after blanks, outside strings."""
    out = []
    for line in text.splitlines():
        quoted = k = 0
        while k < len(line):
            if line[k] == "\\" and quoted:
                k += 1
            elif line[k] == '"':
                quoted ^= 1
            elif not quoted and (line[k] == "#" or line.startswith("//", k)) and not line[:k].rstrip(" \t,{}[]").endswith(":"):
                break
            k += 1
        out.append(line[:k])
    return "\n".join(out)


class Config:
    def __init__(self, stages: list[dict] | dict, registry: Mapping[str, Any] = REGISTRY):
        stages = [stages] if isinstance(stages, dict) else stages
        self.registry, self._cache = registry, {}
        self.stages: list[dict] = []
        for stage in stages:
            self.stages.append({**(self.stages[-1] if self.stages else {}), **stage})

    @classmethod
    def from_text(cls, text: str, registry: Mapping[str, Any] = REGISTRY) -> Config:
        return cls(json.loads(strip_comments(text)), registry)

    def overwrite(self, section: str, key: str, value: Any) -> Config:
        """A copy in which every `key` below `section`, at any depth, has the value."""

        def walk(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: value if k == key else walk(v) for k, v in x.items()}
            return [walk(v) for v in x] if isinstance(x, list) else x

        return Config([{k: walk(v) if k == section else v for k, v in s.items()} for s in self.stages], self.registry)

    def get(self, section: str, stage: int = 0) -> Any:
        return self.resolve(self.stages[stage][section], stage)

    def cached(self, name: str, stage: int = 0) -> Any:
        """An object of the stage's `cache` section, built once."""
        if (stage, name) not in self._cache:
            self._cache[stage, name] = self.resolve(self.stages[stage]["cache"][name], stage)
        return self._cache[stage, name]

    def resolve(self, x: Any, stage: int = 0) -> Any:
        if isinstance(x, str) and (found := re.fullmatch(r"\$\{([\w.]+)\}", x)):
            name = found[1]
            if name in self.stages[stage].get("cache", {}):
                return self.cached(name, stage)
            if name not in self.registry:
                raise KeyError(f"{name} is not registered")
            return self.registry[name]
        if isinstance(x, list):
            return [self.resolve(v, stage) for v in x]
        if isinstance(x, dict):
            if len(x) == 1 and (name := next(iter(x))) in self.registry:
                given = x[name]
                if isinstance(given, dict):
                    return self.registry[name](**{k: self.resolve(v, stage) for k, v in given.items()})
                return self.registry[name](*[self.resolve(v, stage) for v in (given if isinstance(given, list) else [given])])
            return {k: self.resolve(v, stage) for k, v in x.items()}
        return x


def chain(df: Any, steps: Mapping[str, list[Callable]], parts: list[Any] | None = None) -> Any:
    """Steps applied to a table, or to those of `parts` that a key such as "0", "1:3" or "0,2" names."""
    if parts is None:
        for step in steps.get("0", []):
            df = step(df)
        return df
    out = list(parts)
    for key, todo in steps.items():
        for piece in key.split(","):
            low, _, high = piece.partition(":")
            span = range(int(low or 0), int(high or len(out)) if ":" in piece else int(low) + 1)
            for i in span:
                for step in todo:
                    out[i] = step(out[i])
    return out


def swizzle(values: tuple | list | dict, order: Any) -> Any:
    """Values picked, repeated or nested by the numbers or names in `order`."""
    return tuple(swizzle(values, o) for o in order) if isinstance(order, (tuple, list)) else values[order]


def flatten_tuples(parts: list, drop_none: bool = True) -> tuple:
    out = [x for p in parts for x in (p if isinstance(p, (tuple, list)) else (p,))]
    return tuple(x for x in out if x is not None) if drop_none else tuple(out)


def row(inputs: list, layers: list[Callable | None]) -> list:
    """Each layer on its own input; None passes it on."""
    return [x if f is None else f(x) for f, x in zip(layers, inputs)]


def sequential(x: Any, layers: list[Callable]) -> Any:
    for f in layers:
        x = f(*x) if isinstance(x, tuple) else f(x)
    return x
