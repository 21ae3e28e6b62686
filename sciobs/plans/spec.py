"""Specifications of queries, and the contract constants that bound what is returned."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Bounds of returned results. The DataFrames behind them are unbounded.
MAX_RESULT_ROWS = 100_000
MAX_SOURCE_ROWS = 10_000
MAX_PREVIEW_ROWS = 2_000
DEFAULT_PREVIEW_ROWS = 200
MAX_RASTER_PIXELS = 4_000_000
MAX_CUBE_CELLS = 100_000
MAX_RENDERED_POINTS = 1_000_000
MAX_VALUE_FIELDS = 8
MAX_COMPONENTS = 256
MAX_SUGGESTIONS = 12


class SpecError(ValueError):
    """A query that names what is not there or asks for what is not allowed."""


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Aggregate:
    function: str
    field: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}_{self.field or 'all'}"


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class TableQuery:
    select: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    order_by: list[Sort] = field(default_factory=list)
    limit: int = DEFAULT_PREVIEW_ROWS


@dataclass(frozen=True)
class AxisRange:
    """Half open; step at least 1."""

    start: int
    end: int
    step: int = 1


@dataclass(frozen=True)
class Affine:
    """x = a + b * column + c * row; y = d + e * column + f * row."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    @property
    def north_up(self) -> bool:
        return self.c == 0 and self.e == 0 and self.b > 0 and self.f < 0


@dataclass(frozen=True)
class Box:
    min_x: float
    min_y: float
    max_x: float
    max_y: float


@dataclass(frozen=True)
class ValueRole:
    field: str
    qc_field: str | None = None
    accepted: tuple[str, ...] = ()


@dataclass(frozen=True)
class Recipe:
    """Which columns of a table are trajectories and vertical profiles."""

    trajectory: str
    profile: str
    vertical: str
    values: tuple[ValueRole, ...]
    order: str = "source_index"
    latitude: str | None = None
    longitude: str | None = None
    positive_down: bool = True
    fills: tuple[str, ...] = ()
    vertical_range: tuple[float, float] | None = None
    points_per_profile: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.values) <= MAX_VALUE_FIELDS:
            raise SpecError(f"a recipe has 1 to {MAX_VALUE_FIELDS} value fields")
        if self.vertical_range is not None:
            low, high = self.vertical_range
            if not (low <= high and abs(low) != float("inf") and abs(high) != float("inf")):
                raise SpecError("the vertical range must be finite and ordered")
        if self.points_per_profile is not None and self.points_per_profile < 1:
            raise SpecError("points per profile must be positive")
