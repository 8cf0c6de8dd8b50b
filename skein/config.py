"""Parameters of a search; checked when made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    """factor and clip quantize; w pivots make a sketch; parts x bits make a projection; nc1, nc2, k are the three budgets."""

    dim: int = 64
    factor: float = 220.0
    w: int = 8
    parts: int = 16
    bits: int = 2
    q_range: float = 2.0
    p2: float = 2.5
    nq: int = 10
    nc1: int = 100
    nc2: int = 30
    k: int = 10

    def __post_init__(self):
        if not 1 <= self.w <= 62:
            raise ValueError("w must be between 1 and 62")
        if not 1 <= self.bits <= 8 or self.parts < 1 or self.dim < self.parts:
            raise ValueError("bits must be 1 to 8, and parts 1 to dim")
        if not 0 < self.k <= self.nc2 <= self.nc1:
            raise ValueError("budgets must fall: k <= nc2 <= nc1")

    @property
    def codes(self) -> int:
        return 1 << self.bits

    def axes(self, part: int) -> tuple[int, int]:
        """First axis and number of axes of a part; the first parts take what is left over."""
        size, more = divmod(self.dim, self.parts)
        return part * size + min(part, more), size + (part < more)
