"""Extension points: collectors, value scorers, formatters and edge weights by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from quillspan.functions.symbols import EDGE_WEIGHTS
from quillspan.operators.budget import artifact_value
from quillspan.operators.emit import FORMATTERS, EngineError

# Which collectors a preset runs.
ALL = ("files-manifest", "topology", "import-graph", "exports", "schema-index", "ts-config", "type-metrics", "duplication")
PRESETS = {"ts-pnpm": ALL, "ts-npm": ALL, "ts-simple": ("files-manifest", "topology", "exports", "type-metrics"), "py-poetry": ("files-manifest", "topology"), "rust-cargo": ("files-manifest", "topology"), "default": ("files-manifest",)}


@runtime_checkable
class Collector(Protocol):
    """Something that turns the tables of a run into artifacts."""

    name: str

    def collect(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]: ...


@dataclass
class Registry:
    """Collectors by name, and the hooks a run uses."""

    collectors: dict[str, Collector] = field(default_factory=dict)
    presets: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PRESETS))
    value: Callable[[], Column] = artifact_value
    formatters: dict = field(default_factory=lambda: dict(FORMATTERS))
    edge_weights: dict[str, float] = field(default_factory=lambda: dict(EDGE_WEIGHTS))

    def register(self, collector: Collector, *presets: str) -> None:
        self.collectors[collector.name] = collector
        for p in presets:
            self.presets[p] = tuple(dict.fromkeys((*self.presets.get(p, ()), collector.name)))

    def for_preset(self, preset: str) -> list[Collector]:
        """The collectors of a preset; an unknown preset runs the default ones. One that a preset names but nobody registered is an error."""
        names = self.presets.get(preset, self.presets["default"])
        missing = [n for n in names if n not in self.collectors]
        if missing:
            raise EngineError("E201", f"no collector is registered as {', '.join(missing)}")
        return [self.collectors[n] for n in names]


def choose_preset(languages: set[str], tool: str | None) -> tuple[str, float]:
    """(preset, confidence) for what was detected; the first rule that holds."""
    if tool == "pnpm" and "typescript" in languages:
        return "ts-pnpm", 0.95
    if tool in ("npm", "yarn") and "typescript" in languages:
        return "ts-npm", 0.85
    if "python" in languages:
        return "py-poetry", 0.7
    if "rust" in languages:
        return "rust-cargo", 0.8
    if "typescript" in languages:
        return "ts-simple", 0.6
    return "default", 0.0
