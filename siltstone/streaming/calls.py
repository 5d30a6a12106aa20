"""Telemetry of streamed model calls: one fact a call, when its stream closes or falls silent.

Events are ``EVENTS``: a call opens (who asks, for what), pieces of its answer come, and it closes or fails.  The
streaming form keeps a small state for each open call, in event time; a call without a word for ``silent`` is a
fact with an error.  After its fact a call's further events are late and count nowhere; its state goes
once the watermark has passed them.  The batch form gives the same facts over recorded events.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EVENTS = (
    "call_id string, seq long, at timestamp, event string, source string, stage string, chunk_index int, retry_attempt int, model string, "
    "prompt_chars long, piece string, prompt_tokens long, completion_tokens long, error string"
)
FACTS = (
    "call_id string, source string, stage string, chunk_index int, retry_attempt int, model string, prompt_tokens long, completion_tokens long, "
    "prompt_chars long, completion_chars long, latency_ms long, success boolean, error string, timestamp timestamp"
)
#: What a call that fell silent is said to have died of.
SILENT = "no event before the time limit"
_OUT = FACTS.replace("timestamp timestamp", "ms long")
_STATE = (
    "opened long, last long, closed boolean, source string, stage string, chunk_index int, retry_attempt int, model string, prompt_chars long, "
    "completion_chars long, prompt_tokens long, completion_tokens long"
)


class CallFacts(StatefulProcessor):
    """State: (opened, last, closed, the call's own columns, sums).  Times are milliseconds."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("call", _STATE)

    def _fact(self, key, s, at, error):
        names = [c.split()[0] for c in _OUT.split(", ")]
        value = {
            "call_id": key[0], "source": s["source"], "stage": s["stage"], "chunk_index": s["chunk_index"], "retry_attempt": s["retry_attempt"], "model": s["model"], "prompt_tokens": s["prompt_tokens"],
            "completion_tokens": s["completion_tokens"], "prompt_chars": s["prompt_chars"], "completion_chars": s["completion_chars"], "latency_ms": at - s["opened"], "success": error is None,
            "error": error, "ms": at,
        }
        out = pd.DataFrame({n: [value[n]] for n in names})
        return out.astype({"chunk_index": "Int32", "retry_attempt": "Int32"})

    def handleInputRows(self, key, rows, timerValues):
        names = [c.split()[0] for c in _STATE.split(", ")]
        s = dict(zip(names, self.state.get())) if self.state.exists() else None
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").to_dict("records"):
            if s and s["closed"]:
                continue  # late
            at = int(e["ms"])
            s = s or dict.fromkeys(names) | {"opened": at, "closed": False, "prompt_chars": 0, "completion_chars": 0, "prompt_tokens": 0, "completion_tokens": 0}
            s["opened"], s["last"] = min(s["opened"], at), max(s["last"] or at, at)
            for c in ("source", "stage", "chunk_index", "retry_attempt", "model"):
                if not pd.isna(e[c]):
                    s[c] = int(e[c]) if c in ("chunk_index", "retry_attempt") else e[c]
            for c in ("prompt_chars", "prompt_tokens", "completion_tokens"):
                s[c] += 0 if pd.isna(e[c]) else int(e[c])
            s["completion_chars"] += 0 if pd.isna(e["piece"]) else len(e["piece"].encode())
            if e["event"] in ("close", "error"):
                s["closed"] = True
                yield self._fact(key, s, at, None if e["event"] == "close" else (e["error"] if isinstance(e["error"], str) else "error"))
        if s:
            self.state.update(tuple(s[n] for n in names))
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(s["last"] + self.silent_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = dict(zip([c.split()[0] for c in _STATE.split(", ")], self.state.get()))
        if not s["closed"]:
            yield self._fact(key, s, s["last"] + self.silent_ms, SILENT)
        self.state.clear()

    def close(self) -> None:
        pass


def call_facts(events: DataFrame, silent: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Streamed ``EVENTS`` -> streamed ``FACTS``.  Needs the RocksDB state store."""
    ms = pd.Timedelta(silent) // pd.Timedelta("1ms")
    known = events.where("call_id is not null and at is not null").withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    got = known.groupBy("call_id").transformWithStateInPandas(CallFacts(int(ms)), _OUT, "append", "eventTime")
    return got.withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")


def recorded_facts(events: DataFrame, silent: str = "10 minutes", until=None) -> DataFrame:
    """Recorded ``EVENTS`` -> ``FACTS``: a call counts up to the first event that closes it.  Calls still open are
    facts if they fell silent before ``until`` (a timestamp), else they are left out."""
    ms = int(pd.Timedelta(silent) // pd.Timedelta("1ms"))
    ends = "event in ('close', 'error')"
    known = events.where("call_id is not null and at is not null")
    first = known.where(ends).groupBy("call_id").agg(F.expr("min_by(struct(seq, at, event, error), seq)").alias("e"))
    own = known.join(first, "call_id", "left").where("e is null or seq <= e.seq")
    last = lambda c: F.expr(f"max_by({c}, seq) filter (where {c} is not null)").alias(c)
    got = own.groupBy("call_id").agg(
        *[last(c) for c in ("source", "stage", "chunk_index", "retry_attempt", "model")], *[F.expr(f"coalesce(sum({c}), 0L)").alias(c) for c in ("prompt_tokens", "completion_tokens", "prompt_chars")],
        F.expr("coalesce(sum(cast(octet_length(piece) as bigint)), 0L)").alias("completion_chars"), F.min("at").alias("opened"), F.max("at").alias("last"), F.first("e").alias("e"),
    )
    stop = f"if(e is null, timestamp_millis(unix_millis(last) + {ms}), e.at)"
    kept = got.where("e is not null") if until is None else got.where(f"e is not null or timestamp_millis(unix_millis(last) + {ms}) <= timestamp'{until}'")
    error = f"case when e is null then '{SILENT}' when e.event = 'error' then coalesce(e.error, 'error') end"
    return kept.selectExpr(
        "call_id", "source", "stage", "chunk_index", "retry_attempt", "model", "prompt_tokens", "completion_tokens", "prompt_chars", "completion_chars",
        f"unix_millis({stop}) - unix_millis(opened) as latency_ms", f"{error} is null as success", f"{error} as error", f"timestamp_millis(unix_millis({stop})) as timestamp",
    )
