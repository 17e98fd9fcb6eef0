"""Chains of stages captured once and applied to any input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Stage:
    name: str
    function: Callable[..., Any]
    options: dict[str, Any] = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v!r}' for k, v in self.options.items())})"


@dataclass(frozen=True)
class Pipeline:
    """Stages in order; options are fixed when the stage is added, the input and context when it runs.  Printing runs nothing."""

    stages: tuple[Stage, ...] = ()

    def then(self, function: Callable[..., Any], **options: Any) -> Pipeline:
        return Pipeline((*self.stages, Stage(function.__name__, function, options)))

    def __call__(self, data: DataFrame, **context: Any) -> Any:
        if not self.stages:
            raise ValueError("the pipeline has no stages")
        for stage in self.stages:
            names = stage.function.__code__.co_varnames[: stage.function.__code__.co_argcount + stage.function.__code__.co_kwonlyargcount]
            data = stage.function(data, **{k: v for k, v in context.items() if k in names and k not in stage.options} | stage.options)
        return data

    def __repr__(self) -> str:
        return " -> ".join(map(repr, self.stages)) or "(empty)"
