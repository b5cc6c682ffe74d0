"""Pipeline settings: a nested mapping from a dict or a JSON or YAML file, with overrides, checked against a schema before any work
starts; and the components it names, run in order."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Component:
    name: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    detector: Component | None
    generators: tuple[Component, ...]
    synthesis: dict


class Schema:
    """What a setting may be. kind: 'map' (of the named parts), 'list' (of one part), 'component' or 'any'."""

    def __init__(self, kind: str = "any", parts: dict[str, Schema] | None = None, of: Schema | None = None):
        self.kind, self.parts, self.of = kind, parts or {}, of

    def read(self, raw: Any, where: str) -> Any:
        return getattr(self, f"_{self.kind}")(raw, where)

    def _any(self, raw: Any, where: str) -> Any:
        return deepcopy(raw)

    def _map(self, raw: Any, where: str) -> dict:
        raw = {} if raw is None else raw
        if not isinstance(raw, dict):
            raise ValueError(f"{where}: a mapping is needed")
        if unknown := sorted(set(raw) - set(self.parts)):
            raise ValueError(f"{where}: unknown settings {unknown}; there are {sorted(self.parts)}")
        return {k: part.read(raw[k], f"{where}.{k}".lstrip(".")) for k, part in self.parts.items() if k in raw}

    def _list(self, raw: Any, where: str) -> tuple:
        return tuple(self.of.read(x, f"{where}[{i}]") for i, x in enumerate(raw or []))

    def _component(self, raw: Any, where: str) -> Component | None:
        if raw in (None, "", "none"):
            return None
        raw = {"name": raw} if isinstance(raw, str) else raw
        if not isinstance(raw, dict) or not raw.get("name") or set(raw) - {"name", "params"}:
            raise ValueError(f"{where}: a name, or a mapping with a name and params, is needed")
        return Component(str(raw["name"]), dict(raw.get("params") or {}))


SYNTHESIS = Schema("map", {k: Schema() for k in ("continuous", "sustained_mask_min_events", "sustained_mask_min_coverage")})
PIPELINE = Schema("map", {"detector": Schema("component"), "generators": Schema("list", of=Schema("component")), "synthesis": SYNTHESIS})


def read_file(path: str | Path) -> dict:
    """The mapping in a JSON file, or in a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: no YAML reader is installed; the same settings can be JSON") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def merged(base: Any, over: Any) -> Any:
    """Mappings are merged key by key; anything else is replaced."""
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return deepcopy(over)
    return {k: merged(base[k], over[k]) if k in base and k in over else deepcopy(over.get(k, base.get(k))) for k in base | over}


def pipeline(raw: dict | str | Path, overrides: dict | None = None) -> Pipeline:
    """Settings with overrides. A detector of another name takes the place of the old one with its params; generators are replaced
    as a list."""
    raw, over = (read_file(raw) if isinstance(raw, (str, Path)) else raw), dict(overrides or {})
    wrap = lambda x: {"name": x} if isinstance(x, str) else x
    old, new = wrap(raw.get("detector")) or {}, wrap(over.get("detector")) or {}
    if new.get("name") not in (None, old.get("name")):
        raw = {k: v for k, v in raw.items() if k != "detector"}
    elif "detector" in over and over["detector"] is not None:
        raw, over = raw | {"detector": old}, over | {"detector": new}
    got = PIPELINE.read(merged(raw, over), "")
    generators = got.get("generators", ())
    if None in generators:
        raise ValueError("generators: each needs a name")
    return Pipeline(got.get("detector"), generators, got.get("synthesis", {}))


class Registry:
    """Named DataFrame -> DataFrame operators that a pipeline's components refer to. A name with a colon is a function of a module
    outside, module:function, imported when it is asked for."""

    def __init__(self):
        self.known: dict[str, Callable] = {}

    def add(self, name: str, make: Callable) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = make

    def make(self, c: Component) -> Callable:
        if ":" in c.name:
            module, _, function = c.name.partition(":")
            return getattr(importlib.import_module(module), function)(**c.params)
        if c.name not in self.known:
            raise ValueError(f"no component {c.name!r}; there are {sorted(self.known)}")
        return self.known[c.name](**c.params)


def run(settings: Pipeline, registry: Registry, signal: DataFrame, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """events, and a track under each generator's name. The detector makes events of the signal; without one they are given. All
    components are made before any is run, so a wrong name costs no work; two generators of one name are refused."""
    names = [g.name for g in settings.generators]
    if twice := sorted({n for n in names if names.count(n) > 1} | ({"events"} & set(names))):
        raise ValueError(f"outputs {twice} would be written twice")
    detect = registry.make(settings.detector) if settings.detector else None
    makers = {g.name: registry.make(g) for g in settings.generators}
    if detect is None and events is None:
        raise ValueError("without a detector events are needed")
    found = detect(signal) if detect else events
    return {"events": found} | {name: make(signal, found) for name, make in makers.items()}
