"""Counts that a stream reports with its progress: observed metrics and late rows, without a second pass."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql.streaming import StreamingQueryListener


class StreamCounts(StreamingQueryListener):
    """Adds up, by query id, the observed metrics of each batch, and as ``late`` the rows that a watermark dropped.

    ``spark.streams.addListener(counts)`` begins; the totals are those of this listener's lifetime.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._totals: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self._batches: dict[str, set[tuple[str, int]]] = defaultdict(set)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            run, own = (str(progress.runId), progress.batchId), self._totals[str(progress.id)]
            if run in self._batches[str(progress.id)]:
                return  # a batch may be reported more than once
            self._batches[str(progress.id)] = {run}
            for row in (progress.observedMetrics or {}).values():
                for name, n in row.asDict().items():
                    own[name] += int(n or 0)
            for operator in progress.stateOperators or []:
                own["late"] += int(operator.numRowsDroppedByWatermark or 0)

    def totals(self, query_id) -> dict[str, int]:
        with self._lock:
            return dict(self._totals[str(query_id)])
