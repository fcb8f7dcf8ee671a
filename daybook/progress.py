"""Progress events: operators report what happens, the caller decides how it looks."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

KINDS = ("start", "tick", "done", "note", "warn")


@dataclass(frozen=True)
class Event:
    """start, tick and done belong to a task; note and warn are messages. ``count`` is the total at the start, what is done at a tick."""

    kind: str
    task: str | None = None
    count: int | None = None
    text: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(self.kind)


Reporter = Callable[[Event], None]


def silent(event: Event) -> None:
    """Reports nothing."""


def to_stderr(event: Event) -> None:
    told = (event.task, None if event.count is None else str(event.count), event.text)
    print(f"{event.kind}: " + " ".join(x for x in told if x), file=sys.stderr)


def observed(df: DataFrame, task: str, report: Reporter) -> tuple[DataFrame, Callable[[], int]]:
    """df that counts its rows on their way to an action, and a function to call after it: reports the task as done, returns the rows."""
    seen = Observation()
    report(Event("start", task))

    def finish() -> int:
        n = seen.get["n"]
        report(Event("done", task, n, "rows"))
        return n

    return df.observe(seen, F.count(F.lit(1)).alias("n")), finish
