"""What a query reports of itself: metrics of a table on its way, and the life of streams as event lines."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Metrics of telemetry rows, in SQL.
CALL_METRICS = {
    "calls": "count(*)", "failures": "count_if(not success)", "tokens_in": "sum(prompt_tokens)", "tokens_out": "sum(completion_tokens)", "cost": "sum(cost)", "latency_ms": "sum(latency_ms)",
}


def observed(calls: DataFrame, name: str = "calls", metrics: dict[str, str] = CALL_METRICS) -> tuple[DataFrame, Observation | str]:
    """``calls`` and where their metrics come out once they were written: an ``Observation`` of a batch, of a
    stream the name under which each micro-batch's progress carries them."""
    columns = [F.expr(m).alias(k) for k, m in metrics.items()]
    if calls.isStreaming:
        return calls.observe(name, *columns), name
    seen = Observation(name)
    return calls.observe(seen, *columns), seen


Emit = Callable[[dict], None]


class Lines:
    """Events as JSON lines, appended to a file of the driver or passed to a writer such as ``print``."""

    def __init__(self, to: str | Callable[[str], None]):
        self.to, self.lock = to, threading.Lock()

    def __call__(self, event: dict) -> None:
        line = json.dumps(event, sort_keys=True)
        with self.lock:
            if callable(self.to):
                self.to(line)
            else:
                with open(self.to, "a") as f:
                    f.write(line + "\n")


class Tee:
    """Every event to several emitters; one that fails doesn't keep the others from it."""

    def __init__(self, *emitters: Emit):
        self.emitters, self.failed = emitters, 0

    def __call__(self, event: dict) -> None:
        for e in self.emitters:
            try:
                e(event)
            except Exception:  # noqa: BLE001 - reporting must not end a query
                self.failed += 1


class StreamEvents(StreamingQueryListener):
    """Starts, micro-batches with their observed metrics, and ends of a session's streams as events."""

    def __init__(self, emit: Emit):
        self.emit = emit

    def onQueryStarted(self, event) -> None:
        self.emit({"type": "pipeline_start", "query": str(event.id), "run": str(event.runId), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed_ = {k: r.asDict(recursive=True) for k, r in (p.observedMetrics or {}).items()}
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self.emit({"type": "processing_done", "query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "state_rows": state, "observed": json.loads(json.dumps(observed_, default=str))})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        done = event.exception is None
        self.emit({"type": "completed" if done else "error", "query": str(event.id), **({} if done else {"error": str(event.exception)[:1000]})})


def listen(spark: SparkSession, emit: Emit) -> StreamEvents:
    """Emit the session's stream events from now on; ``spark.streams.removeListener`` ends it."""
    out = StreamEvents(emit)
    spark.streams.addListener(out)
    return out
