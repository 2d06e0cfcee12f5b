"""Suites on arriving data without a pass of their own: measures are gathered on the way to the sink."""

from __future__ import annotations

import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Condition

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tablecheck.operators.checks import Rule
from tablecheck.operators.observed import Observed
from tablecheck.sources.stores import replace_partitions


class ObservedStream(StreamingQueryListener):
    """``stream`` with the measures of ``rules`` attached, and a listener that judges and stores them batch by batch.

    Start a query on ``.stream`` with whatever sink it has; each batch's results are then appended under ``results_path`` with
    the batch's number, as ``check_stream`` stores them. A batch is read once, by its sink. Results follow the
    batch's commit: a driver that dies in between leaves a batch without results, where ``check_stream`` repeats it.
    Rules that need a pass of their own are refused.
    """

    def __init__(self, stream: DataFrame, rules: list[Rule], results_path: str):
        self.spark, self.path = stream.sparkSession, results_path
        self.observed = Observed(stream, rules)
        if self.observed.others:
            raise ValueError(f"not measured on passing rows: {', '.join(rule.name for _, rule in self.observed.others)}")
        self.name = f"suite_{uuid.uuid4().hex}"
        self.stream = stream.observe(self.name, *self.observed.columns)
        self._writer = ThreadPoolExecutor(1)  # in the order of batches, and not on the thread that events come on
        self._writes: list[Future] = []
        self._ended: set[str] = set()
        self._change = Condition()
        self.spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and event.progress.numInputRows > 0:
            with self._change:
                self._writes = [w for w in self._writes if not w.done() or w.exception()]
                self._writes.append(self._writer.submit(self._store, event.progress.batchId, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def _store(self, batch: int, values: dict) -> None:
        found = self.observed.results(self.spark, values).withColumn("batch_id", F.lit(batch))
        replace_partitions(found.coalesce(1), self.path, "batch_id")

    def finish(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Waits until a query has ended and all its results are stored; raises what went wrong there."""
        query.awaitTermination()
        with self._change:
            if not self._change.wait_for(lambda: str(query.runId) in self._ended, timeout):
                raise TimeoutError("the end of the query was not told")
            writes = list(self._writes)
        for write in writes:
            write.result()

    def close(self) -> None:
        self.spark.streams.removeListener(self)
        self._writer.shutdown()
