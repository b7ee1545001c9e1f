"""Admission by a sliding window: at most ``most`` admitted requests of a class in any ``window``.

Only admitted requests count. A stamp exactly ``window`` old still counts; an older one does not.
"""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.plans.errors import CatalogError


class Window:
    """The stamps of one class; at most ``most`` of them."""

    def __init__(self, most: int, window: int, stamps: list[int] | None = None):
        self.most, self.window, self.stamps = most, window, deque(stamps or ())

    def admit(self, now: int) -> int | None:
        """None if admitted, else the oldest stamp that counts."""
        while self.stamps and self.stamps[0] < now - self.window:
            self.stamps.popleft()
        if len(self.stamps) >= self.most:
            return self.stamps[0]
        self.stamps.append(now)
        return None


def retry_after(oldest: int, now: int, window: int, per_second: int = 1000) -> int:
    return max(1, math.ceil((oldest + window - now) / per_second))


class Limiter:
    """A driver's own budgets, by class, a minute each."""

    def __init__(self, limits: dict[str, int], clock: Callable[[], float] = time.time):
        self.limits, self.clock = limits, clock
        self.windows = {name: Window(most, 60_000) for name, most in limits.items()}

    def acquire(self, name: str) -> None:
        now = int(self.clock() * 1000)
        oldest = self.windows[name].admit(now)
        if oldest is not None:
            wait = retry_after(oldest, now, 60_000)
            raise CatalogError("rate_limited", f"the budget of {self.limits[name]} {name} requests a minute is spent; try again in {wait} s", endpoint=name, limit=self.limits[name], retryAfter=wait)


def verdicts(events: DataFrame, key: str, ts: str, event: str, most: int, window_s: int) -> DataFrame:
    """(key, event, admitted, retry_after_s) of each event, events of a key in order of time and id.

    Sorted rows stream through a task, which holds the stamps of one key: at most ``most`` of them, however
    many events a key has. Rows with a null time are left out.
    """
    window = window_s * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_key, state = object(), None
        for batch in batches:
            admitted, waits = [], []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                if state is None or k != now_key:
                    now_key, state = k, Window(most, window)
                oldest = state.admit(t)
                admitted.append(oldest is None)
                waits.append(None if oldest is None else retry_after(oldest, t, window, 1_000_000))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("e"), pa.array(admitted, pa.bool_()), pa.array(waits, pa.int64())], [key, event, "admitted", "retry_after_s"])

    rows = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event).alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.repartition("k").sortWithinPartitions("k", "t", "e").mapInArrow(run, f"{key} {kinds['k']}, {event} {kinds['e']}, admitted boolean, retry_after_s long")
