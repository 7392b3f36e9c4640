"""Progress and observed metrics of streams, handed to a push function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class MetricsListener(StreamingQueryListener):
    """Calls ``push(name, value, labels)`` for every micro-batch: rows, lag, state and observed metrics."""

    def __init__(self, push: Callable[[str, float, dict[str, str]], None]):
        self.push = push

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.push("stream_started", 1.0, {"query": str(event.name or event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        labels = {"query": str(p.name or p.id)}
        self.push("batch_id", float(p.batchId), labels)
        self.push("input_rows", float(p.numInputRows or 0), labels)
        for name, ms in (p.durationMs or {}).items():
            self.push("duration_ms", float(ms), labels | {"phase": name})
        for op in p.stateOperators or []:
            self.push("state_rows", float(op.numRowsTotal), labels | {"operator": op.operatorName})
        for name, row in (p.observedMetrics or {}).items():
            for key, value in row.asDict().items():
                if value is not None:
                    self.push(key, float(value), labels | {"observation": name})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.push("stream_idle", 1.0, {"query": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.push("stream_ended", 1.0, {"query": str(event.id)})
