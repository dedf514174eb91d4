"""Plain parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BBox:
    xmin: float
    ymin: float
    xmax: float
    ymax: float


@dataclass(frozen=True)
class Window:
    """A recurring annual window: ``days`` in all around each calendar day, over ``first`` to ``last`` year, both included."""

    first: int
    last: int
    days: int = 30

    @property
    def half(self) -> int:
        return -(-self.days // 2)


@dataclass(frozen=True)
class Compat:
    """Which reading of an ambiguous step to take; the default is the documented behaviour of the data's producers."""

    tauu_corrected: bool = False
    tauv_own_slope: bool = False
    extrapolated_either_side: bool = False


@dataclass(frozen=True)
class Disaggregation:
    lags: int = 48
    tolerance: float = 0.05
    confidence: float = 0.95
    clip: float = 0.99
    hours: int = 24
    seed: int = 7
