"""Settings of a screen as a frozen tree; read from a mapping or a JSON or YAML file on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Profile:
    label: str
    threshold: float | None = None
    specific: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class Anchor:
    residues: tuple[str, ...] = ("CHD", "CHN")
    gaps: tuple[int, int] | None = None
    tolerance: float = 5.0
    penalty: float = 5.0
    min_occupancy: float = 0.5
    min_freq: float = 0.3
    cap: int = 40
    min_coverage: float = 0.5


@dataclass(frozen=True)
class Screen:
    profiles: tuple[Profile, ...] = ()
    anchor: Anchor = field(default_factory=Anchor)
    taxonomy_column: str | None = None
    batch_size: int = 1000
    max_overlap: float = 0.4
    window_genes: int = 12
    max_contigs: int = 200
    drop_archaea: bool = True

    def active(self) -> list[str]:
        """Labels of the profiles that are switched on; the others are never planned."""
        return [p.label for p in self.profiles if p.enabled]


def build(kind, data: dict):
    """An instance of ``kind`` from a mapping; unknown keys raise, as a typing error would hide."""
    known = {f.name for f in fields(kind)}
    if extra := set(data) - known:
        raise ValueError(f"unknown settings of {kind.__name__}: {sorted(extra)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def screen(data: dict) -> Screen:
    data = dict(data)
    data["profiles"] = tuple(build(Profile, p) for p in data.get("profiles", []))
    data["anchor"] = build(Anchor, data.get("anchor", {}))
    return build(Screen, data)


def load(path: str) -> Screen:
    """Settings of a file; YAML by its suffix, if a parser is installed."""
    with open(path) as f:
        if not path.endswith((".yaml", ".yml")):
            return screen(json.load(f))
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need a YAML parser; JSON does not") from e
        return screen(yaml.safe_load(f) or {})
