"""Progress as JSON lines, from metrics that Spark gathers in the pass that does the work."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

Emit = Callable[[str], None]


def line(status: str, current: int | None = None, total: int | None = None, **more: object) -> str:
    """One JSON line; a percentage where both numbers are there and the total isn't 0."""
    out: dict[str, object] = {"status": status}
    if current is not None:
        out["current"] = current
    if total is not None:
        out |= {"total": total} | ({"percentage": 100 * current // total} if total and current is not None else {})
    return json.dumps(out | more)


class Steps:
    """The steps of a job: each is a write whose rows are measured as they go by, and ends with a line."""

    def __init__(self, emit: Emit):
        self.emit = emit

    def done(self, status: str, df: DataFrame, write: Callable[[DataFrame], object], total: int | None = None, **metrics: Column) -> dict:
        """Write the frame, say how many rows it had, and return the metrics; the rows are computed once."""
        from pyspark.sql import functions as F

        seen = Observation(status)
        try:
            write(df.observe(seen, F.count(F.lit(1)).alias("current"), *[c.alias(n) for n, c in metrics.items()]))
        except Exception as e:
            self.emit(line("error", message=str(e)))
            raise
        got = dict(seen.get)
        self.emit(line(status, total=total, **got))
        return got


class Listener(StreamingQueryListener):
    """A line for what each micro-batch of a stream has observed, and one for its end."""

    def __init__(self, emit: Emit, total: int | None = None):
        self.emit, self.total, self.current = emit, total, 0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.emit(line("started"))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        for name, metrics in event.progress.observedMetrics.items():
            got = metrics.asDict()
            self.current += got.get("current") or 0
            self.emit(line(name, self.current, self.total, batch=event.progress.batchId, **{k: v for k, v in got.items() if k != "current"}))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        """Nothing to say."""

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.emit(line("error", message=event.exception) if event.exception else line("complete", self.current, self.total))
