"""What a stream reports while it runs, and how it is stopped."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class ProgressRows(StreamingQueryListener):
    """Keeps the last report of each query (later ones replace it) and how it ended: DONE or ERROR."""

    def __init__(self):
        self.last: dict[str, dict] = {}
        self.ended: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {"batch": -1, "rows": 0}

    def onQueryProgress(self, event) -> None:
        self.last[str(event.progress.id)] = {"batch": event.progress.batchId, "rows": event.progress.numInputRows}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = "ERROR" if event.exception else "DONE"


def cancel(query: StreamingQuery) -> None:
    """Stops a stream between batches; what was committed stays, and a new start goes on from there."""
    query.stop()
