"""What every clustering kernel takes and returns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np


@dataclass
class Step:
    """An element of a trajectory."""

    cost: float
    action: dict[str, Any]
    state: dict[str, Any] = field(default_factory=dict)
    accepted: bool = True
    delta_cost: float | None = None


@dataclass
class Fit:
    """Labels (-1 is noise), anything else worth keeping, and the steps taken."""

    labels: np.ndarray
    extra: dict[str, Any] = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)


Kernel = Callable[..., Fit]
REGISTRY: dict[str, Kernel] = {}


def register(name: str) -> Callable[[Kernel], Kernel]:
    """Make a kernel `(x, k, rng, **params) -> Fit` known under a name; also open to users."""

    def add(kernel: Kernel) -> Kernel:
        REGISTRY[name.lower()] = kernel
        return kernel

    return add


def run(name: str, x: np.ndarray, k: int | None = None, seed: int = 0, **params: Any) -> Fit:
    """Fit a registered kernel; unknown parameters are passed on and may be ignored. Costs of steps get their differences."""
    fit = REGISTRY[name.lower()](np.asarray(x, dtype=np.float64), k, np.random.default_rng(seed), **params)
    fit.labels = np.asarray(fit.labels, dtype=np.int64)
    last = None
    for s in fit.steps:
        if s.delta_cost is None and last is not None:
            s.delta_cost = s.cost - last
        last = s.cost
    return fit
