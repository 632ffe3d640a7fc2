"""Settings: defaults, overlaid by a JSON file, overlaid by given values."""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass

# Levels of an address and the largest distance at which each is shared.
LEVELS = ("u", "s", "r", "p", "n", "m", "e", "c", "a")
THRESHOLDS = (0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)
# Fixed values: (prior, chance of a sub-cluster hit if conserved, chance otherwise).
PRIORS = ((0.05, 0.99, 0.1), (0.02, 0.99, 0.2), (0.01, 0.99, 0.5))
FRAGMENTS = (487, 2000)


@dataclass(frozen=True)
class Settings:
    mismatch: float = 0.05
    kmer: int = 23
    sketch: int = 4000
    shard_capacity: int = 3_800_000_000
    min_freq: float = 0.0001
    min_num: float = 10.0
    workspace: str = "."
    catalog: str = "{workspace}/catalog"

    @classmethod
    def load(cls, path: str | None = None, **given) -> Settings:
        """Values take the type of the default; `{name}` in texts stands for another value."""
        found: dict = {}
        if path:
            with open(path) as f:
                found |= json.load(f)
        found |= {k: v for k, v in given.items() if v is not None}
        default = {f.name: f.default for f in dataclasses.fields(cls)}
        if unknown := set(found) - set(default):
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        values = default | {k: type(default[k])(v) for k, v in found.items()}
        fill = lambda v: re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]), v) if isinstance(v, str) else v
        return cls(**{k: fill(v) for k, v in values.items()})

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(dataclasses.asdict(self), f, indent=2, sort_keys=True)
