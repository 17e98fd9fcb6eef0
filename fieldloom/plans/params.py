"""Settings of detection and delineation, with ownership of what the caller set."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from ..functions.indices import FORMULAS
from ..operators.signature import STRICTNESS

UNSET: Any = object()


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def iso_date(x: Any, name: str) -> str | None:
    """ISO text of one date; years under 1000 are misread formats."""
    if x is None:
        return None
    try:
        day = x if isinstance(x, date) else date.fromisoformat(str(x))
    except ValueError as e:
        raise ValueError(f"{name} is no date like 2021-01-31: {x!r}") from e
    if day.year < 1000:
        raise ValueError(f"{name} has the year {day.year}")
    return day.isoformat()


def _pair(x: Any, name: str, low: float = -math.inf, high: float = math.inf) -> None:
    if not (isinstance(x, tuple | list) and len(x) == 2 and all(map(_number, x)) and low <= x[0] <= x[1] <= high):
        raise ValueError(f"{name} is two numbers in order")


def check_margins(x: Any) -> None:
    """Two margins in 0..1 in order; a third, 0 or 1, says which bound is inclusive and is needed when they are equal."""
    if not (isinstance(x, tuple | list) and len(x) in (2, 3) and all(map(_number, x)) and 0 <= x[0] <= x[1] <= 1):
        raise ValueError("perimeter_margins is two or three numbers in 0..1, the first two in order")
    if len(x) == 3 and x[2] not in (0, 1):
        raise ValueError("the third of perimeter_margins is 0 or 1")
    if len(x) == 2 and x[0] == x[1]:
        raise ValueError("equal perimeter_margins need a third value")


@dataclass(frozen=True)
class Params:
    """All settings; ``user_set`` names those the caller gave."""

    area_threshold: tuple[float, float] = (0.2, 0.7)
    area_sensitivity: float = 0.2
    local_alive_density: float = 0.2
    time_independent_windows: bool = True
    search_windows: Any = "all"
    search_index: str = "EVI2"
    min_windows_alive: int = 1
    search_start_date: str | None = None
    search_end_date: str | None = None
    perimeter_margins: tuple[float, ...] = (0.5, 0.9)
    trace_iter: int = 20
    multiple_areas: bool = False
    merge_separate_areas: bool = False
    area_separation_strict: Any = False
    interior_sensitivity: float | None = 0.1
    interior_threshold: tuple[float, float] = (0.1, 0.9)
    split_sensitivity: float | None = 0.05
    split_gate: int = 2
    split_linear: bool = False
    strictness: str = "balanced"
    s2_processing: str = "highest_baseline"
    user_set: frozenset[str] = field(default=frozenset(), compare=False)

    def __post_init__(self):
        _pair(self.area_threshold, "area_threshold")
        _pair(self.interior_threshold, "interior_threshold")
        check_margins(self.perimeter_margins)
        for name in ("time_independent_windows", "multiple_areas", "merge_separate_areas", "split_linear"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} is true or false")
        for name in ("min_windows_alive", "trace_iter", "split_gate"):
            if not _whole(getattr(self, name)) or getattr(self, name) < 1:
                raise ValueError(f"{name} is a positive whole number")
        if not _number(self.area_sensitivity) or self.area_sensitivity < 0:
            raise ValueError("area_sensitivity is a number from 0")
        if not _number(self.local_alive_density) or not 0 <= self.local_alive_density <= 1:
            raise ValueError("local_alive_density is a number in 0..1")
        if self.interior_sensitivity is not None and not (_number(self.interior_sensitivity) and 0 <= self.interior_sensitivity <= 1):
            raise ValueError("interior_sensitivity is None or a number in 0..1")
        if self.split_sensitivity is not None and not (_number(self.split_sensitivity) and self.split_sensitivity >= 0):
            raise ValueError("split_sensitivity is None or a number from 0")
        if self.search_windows != "all":
            w = self.search_windows
            if not isinstance(w, tuple | list) or not w or len(set(w)) != len(w) or not all(_whole(k) and k > 0 for k in w):
                raise ValueError("search_windows is 'all' or distinct positive whole numbers")
        s = self.area_separation_strict
        if not isinstance(s, bool) and not (isinstance(s, tuple | list) and len(s) == 2 and s[0] == 0 and _whole(s[1]) and s[1] > 0):
            raise ValueError("area_separation_strict is true, false or (0, n)")
        if self.search_index not in FORMULAS:
            raise ValueError(f"unknown search_index {self.search_index!r}")
        if self.strictness not in STRICTNESS:
            raise ValueError(f"strictness is one of {', '.join(STRICTNESS)}")
        if self.s2_processing not in ("highest_baseline", "lowest_baseline"):
            raise ValueError("s2_processing is highest_baseline or lowest_baseline")
        first, last = iso_date(self.search_start_date, "search_start_date"), iso_date(self.search_end_date, "search_end_date")
        if first and last and first > last:
            raise ValueError("search_start_date is after search_end_date")
        object.__setattr__(self, "search_start_date", first)
        object.__setattr__(self, "search_end_date", last)


DEFAULTS = Params()
FETCH_ONLY = ("search_index", "search_start_date", "search_end_date", "s2_processing")


def params(**given: Any) -> Params:
    """Settings that remember which names were given."""
    return Params(**given, user_set=frozenset(given))


def user_set(value: Params | dict | None) -> frozenset[str]:
    """Names a value owns: a plain dict owns all it has."""
    if value is None:
        return frozenset()
    return frozenset(value) if isinstance(value, dict) else value.user_set


def resolved(stored: Params, given: Params | dict | None = None, inline: dict[str, Any] | None = None, calibrated: float | None = None) -> Params:
    """Defaults < stored < calibration (only an unowned default) < given (owned or not default) < inline (UNSET: not given)."""
    values = {f.name: getattr(stored, f.name) for f in dataclasses.fields(Params) if f.name != "user_set"}
    owned = set(stored.user_set)
    if calibrated is not None and "area_sensitivity" not in owned and stored.area_sensitivity == DEFAULTS.area_sensitivity:
        values["area_sensitivity"] = calibrated
    if isinstance(given, dict):
        changed = dict(given)
    elif given is not None:
        changed = {k: getattr(given, k) for k in values if k in given.user_set or getattr(given, k) != getattr(DEFAULTS, k)}
    else:
        changed = {}
    changed |= {k: v for k, v in (inline or {}).items() if v is not UNSET}
    for name in FETCH_ONLY:
        if name in changed and changed[name] != values[name]:
            raise ValueError(f"{name} can only be set when scenes are fetched")
    return Params(**values | changed, user_set=frozenset(owned | set(changed)))
