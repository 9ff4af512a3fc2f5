"""Hyper-parameters of the per-feature step functions."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

#: Allowed range of each parameter, both ends included.
BOUNDS = {
    "max_depth": (0, math.inf),
    "min_info_gain": (-1, 1),
    "min_leaf_size": (-1, 1),
    "weight": (0, 3),
    "sigmoid_exponent": (0, 1),
    "tail_sensitivity": (1, math.inf),
}
POWERS = (1, 3, 5)


@dataclass(frozen=True)
class StepParams:
    """-1 for min_info_gain or min_leaf_size means a tenth of the base value."""

    max_depth: int = 8
    min_info_gain: float = 1e-4
    min_leaf_size: float = 1e-4
    ignore_nan: bool = False
    weight: float = 1.0
    power_degree: int = 1
    sigmoid_exponent: float = 0.0
    tail_sensitivity: float = 1.0

    def __post_init__(self) -> None:
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in [{low}, {high}]")
        if self.power_degree not in POWERS:
            raise ValueError(f"power_degree must be one of {POWERS}")

    def updated(self, **changes) -> StepParams:
        return replace(self, **changes)

    def resolved(self, base: float) -> StepParams:
        tenth = min(abs(base) / 10, 1.0)
        return self.updated(**{k: tenth for k in ("min_info_gain", "min_leaf_size") if getattr(self, k) == -1})

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> StepParams:
        return StepParams(**json.loads(text))

    def activation(self, percent: float) -> float:
        """Weight of a leaf that holds `percent` of the rows."""
        v = percent**self.weight / 10 ** (2 * self.weight)
        half = 50.0**self.power_degree
        d = ((v * 100 - 50) ** self.power_degree + half) / (2 * half)
        if self.sigmoid_exponent < 1:
            return d
        return 1 / (1 + math.exp(-(d - 0.5) * 10**self.sigmoid_exponent))
