"""Stage events with timings."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

Observer = Callable[[str, str, dict], None]


class Stages:
    """Context managers that tell an observer of a stage's start, end or error, and keep its seconds."""

    def __init__(self, observer: Observer | None = None, clock: Callable[[], float] = time.monotonic):
        self.observer, self.clock = observer, clock
        self.timings: list[tuple[str, float]] = []

    def tell(self, stage: str, event: str, **details: object) -> None:
        if self.observer is not None:
            self.observer(stage, event, details)

    @contextmanager
    def __call__(self, stage: str) -> Iterator[None]:
        begun = self.clock()
        self.tell(stage, "start")
        try:
            yield
        except BaseException as e:
            self.tell(stage, "error", error=str(e))
            raise
        finally:
            self.timings.append((stage, self.clock() - begun))
        self.tell(stage, "end", seconds=self.timings[-1][1])


def logging_observer(logger: logging.Logger | None = None) -> Observer:
    log = logger or logging.getLogger("tessera")

    def tell(stage: str, event: str, details: dict) -> None:
        log.log(logging.ERROR if event == "error" else logging.INFO, "%s %s %s", stage, event, details or "")

    return tell
