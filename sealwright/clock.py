"""Clocks: the system's, and one that stands still until it is moved."""

from __future__ import annotations

import datetime
import time
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Clock(Protocol):
    def now(self) -> datetime.datetime: ...

    def monotonic(self) -> float: ...


class SystemClock:
    def now(self) -> datetime.datetime:
        return datetime.datetime.now(datetime.UTC)

    def monotonic(self) -> float:
        return time.monotonic()


class FixedClock:
    """Both readings stay as they are but for advance()."""

    def __init__(self, start: datetime.datetime = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)):
        if start.tzinfo is None:
            raise ValueError("a clock's time needs a time zone")
        self._now, self._elapsed = start, 0.0

    def now(self) -> datetime.datetime:
        return self._now

    def monotonic(self) -> float:
        return self._elapsed

    def advance(self, seconds: float) -> None:
        if seconds < 0:
            raise ValueError("a clock doesn't run backwards")
        self._now += datetime.timedelta(seconds=seconds)
        self._elapsed += seconds


def stamp(clock: Clock) -> Column:
    """The clock's time as one literal, the same in all rows of a run."""
    return F.lit(clock.now())
