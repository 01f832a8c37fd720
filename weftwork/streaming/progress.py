"""Progress of the index stream: a listener that keeps an event for each batch and passes it on."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener

EVENTS = "batch long, rows long, seconds double, rows_per_second double, total_rows long, remaining_files long"


class BatchEvents(StreamingQueryListener):
    """Events of the query of one name: batch, rows, seconds, rows a second, rows so far, files that wait."""

    def __init__(self, name: str, tell: Callable[[dict], None] | None = None):
        self.name, self.tell, self.events, self.own, self.over = name, tell, [], None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.own = str(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) != self.own or not p.numInputRows:
            return
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        waiting = [int(s.metrics.get("numFilesOutstanding", 0)) for s in p.sources if s.metrics]
        total = p.numInputRows + (self.events[-1]["total_rows"] if self.events else 0)
        one = {"batch": p.batchId, "rows": p.numInputRows, "seconds": seconds, "rows_per_second": round(p.numInputRows / seconds, 3) if seconds else 0.0, "total_rows": total, "remaining_files": sum(waiting)}
        self.events.append(one)
        if self.tell:
            self.tell(one)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.own:
            self.over.set()
