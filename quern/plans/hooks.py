"""What watches operations: listeners, slow operations, repeated single reads."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Event:
    """An operation of a store; ``stage`` is initialized, executing, executed or failed.

    An executed read has its frame as ``result``, so a listener can look at its plan; ``plan`` is that as text.
    """

    stage: str
    store: str
    operation: str
    arguments: tuple
    seconds: float = 0.0
    error: BaseException | None = None
    result: Any = None

    @property
    def plan(self) -> str | None:
        return self.result._jdf.queryExecution().toString() if isinstance(self.result, DataFrame) else None


@dataclass
class Hooks:
    """Listeners, called in order; after a failure in reverse order, so that the last to begin is the first to end."""

    listeners: list[Callable[[Event], None]] = field(default_factory=list)

    def run(self, store: str, operation: str, arguments: tuple, work: Callable):
        if not self.listeners:
            return work()
        began = time.monotonic()

        def tell(stage: str, error: BaseException | None = None, back: bool = False, result: Any = None):
            event = Event(stage, store, operation, arguments, time.monotonic() - began, error, result)
            for listener in reversed(self.listeners) if back else self.listeners:
                listener(event)

        tell("initialized")
        tell("executing")
        try:
            result = work()
        except BaseException as error:
            tell("failed", error, back=True)
            raise
        tell("executed", back=True, result=result)
        return result


class SlowOperations:
    """Keeps operations that took longer than ``seconds``."""

    def __init__(self, seconds: float):
        self.seconds, self.found = seconds, []

    def __call__(self, event: Event) -> None:
        if event.stage in ("executed", "failed") and event.seconds >= self.seconds:
            self.found.append(event)


class RepeatedReads:
    """Operations that ran ``threshold`` times or more with different arguments: reads that one eager load would replace."""

    def __init__(self, threshold: int = 10):
        self.threshold, self.counts = threshold, Counter()
        self._seen: set = set()

    def __call__(self, event: Event) -> None:
        mark = (event.store, event.operation, repr(event.arguments))
        if event.stage == "executed" and mark not in self._seen:
            self._seen.add(mark)
            self.counts[mark[:2]] += 1

    @property
    def suspects(self) -> list[tuple[str, str]]:
        return [k for k, n in self.counts.items() if n >= self.threshold]
