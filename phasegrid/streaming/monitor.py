"""Watching a running stream: counters, and when to stop it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class RunMonitor(StreamingQueryListener):
    """Collects rows and duration of every micro-batch (the last 100 are kept)."""

    def __init__(self) -> None:
        self.rows, self.batches = 0, 0
        self.timings: list[float] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.timings = (self.timings + [float(event.progress.durationMs.get("triggerExecution", 0))])[-100:]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@dataclass
class StopRule:
    """Stop after a number of packets, a duration, or too many polls without progress."""

    max_packets: int = 0          # 0: no limit
    max_seconds: float = 0.0      # 0: no limit
    stagnant_polls: int = 4
    clock: Callable[[], float] = time.time
    _started: float | None = field(default=None, repr=False)
    _last: int = field(default=-1, repr=False)
    _still: int = field(default=0, repr=False)

    def reason(self, packets: int) -> str | None:
        now = self.clock()
        if self._started is None:
            self._started = now
        self._still = self._still + 1 if packets == self._last else 0
        self._last = packets
        if self.max_packets and packets >= self.max_packets:
            return "packet limit"
        if self.max_seconds and now - self._started >= self.max_seconds:
            return "duration"
        if self._still > self.stagnant_polls:
            return "stagnant"
        return None


def watch(query: StreamingQuery, monitor: RunMonitor, rule: StopRule, poll_seconds: float = 5.0) -> str:
    """Poll until the rule fires or the query ends; returns why."""
    while not query.awaitTermination(poll_seconds):
        why = rule.reason(monitor.rows)
        if why:
            query.stop()
            return why
    return "finished"
