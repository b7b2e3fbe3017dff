"""Progress of streaming queries as plain records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Tells a callback what each batch read and how long it took, and how queries end."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell({"stage": "started", "name": event.name})

    def onQueryProgress(self, event):
        p = event.progress
        self.tell({"stage": "batch", "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event):
        self.tell({"stage": "idle", "name": None})

    def onQueryTerminated(self, event):
        self.tell({"stage": "failed" if event.exception else "done", "name": None, "reason": event.exception})
