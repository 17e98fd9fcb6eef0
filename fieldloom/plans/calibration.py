"""Calibration within one call: inputs that failed are remembered and not tried again before the call ends."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable
from typing import Any


def snapshot(**inputs: Any) -> str:
    """A name for what a calibration depends on: index, strictness, thresholds, period, prior."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()


class Invocation:
    """``with Invocation.begin(outer) as own``: the outermost call owns what is remembered, inner ones share it; it is forgotten at its end."""

    def __init__(self):
        self.made: dict[str, Any] = {}
        self.failed: dict[str, Exception] = {}
        self.depth = 0

    @classmethod
    def begin(cls, outer: Invocation | None = None) -> Invocation:
        return outer if outer is not None and outer.depth else cls()

    def __enter__(self) -> Invocation:
        self.depth += 1
        return self

    def __exit__(self, *error: object) -> None:
        self.depth -= 1
        if not self.depth:
            self.made.clear()
            self.failed.clear()

    def calibrated(self, key: str, make: Callable[[], Any], before: Any = None) -> Any:
        """What ``make`` gives for these inputs, made once; on failure what was there before, and no second try."""
        if key in self.made:
            return self.made[key]
        if key not in self.failed:
            try:
                self.made[key] = make()
                return self.made[key]
            except Exception as error:  # a failed calibration leaves the query as it was
                warnings.warn(f"calibration failed: {error}", stacklevel=2)
                self.failed[key] = error
        return before
