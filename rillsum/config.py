"""Runtime parameters of the sketches (frozen, so a plan can be cached by its config)."""

from __future__ import annotations

from dataclasses import dataclass

#: A lookup side with at most this many cells (8-byte id plus three counters each) is broadcast;
#: a larger one is joined by a shuffle.  The cell count of a sketch is fixed by its config.
BROADCAST_CELLS = 1 << 19


@dataclass(frozen=True)
class CountMinConfig:
    rows: int = 3
    length: int = 1 << 16
    alpha: float = 2e-4


@dataclass(frozen=True)
class CountSketchConfig:
    rows: int = 3
    length: int = 1 << 16
    alpha: float = 2e-4


@dataclass(frozen=True)
class UnivConfig:
    levels: int = 6
    rows: int = 3
    length: int = 1 << 16
    alpha: float = 2e-4
    level_seed: int = 199


@dataclass(frozen=True)
class LogBucketConfig:
    gamma: float = 1.001
    buckets: int = 1 << 16
    quantiles: tuple[float, ...] = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 0.999)


@dataclass(frozen=True)
class SpreadConfig:
    rows: int = 3
    length: int = 1 << 12
    registers: int = 63
    max_rank: int = 31
    min_rank: int = 0
    element_seed: int = 101


@dataclass(frozen=True)
class KeeperConfig:
    buckets: int = 12
    slots: int = 4
    seed: int = 101
