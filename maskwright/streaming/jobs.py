"""The same work on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from maskwright.operators.overrides import ACTIONS
from maskwright.operators.rules import Rule
from maskwright.plans.pipelines import redact_rows
from maskwright.sources.sink import write_once


def stream_redact(blocks: DataFrame, rules: list[Rule], terms: list[str] = (), default: str = "*") -> DataFrame:
    """Redacted blocks as they come; nothing is kept between batches."""
    return redact_rows(blocks, rules, terms, default)


OVERRIDE_OUT = "hit_id string, action string, scope string, promoted_at timestamp, deleted boolean"
DECISION = "action string, scope string, promoted_at timestamp"
#: How long a session's decision holds without being written again.
SESSION_HOURS = 12


PROVIDER, ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


class Decisions(StatefulProcessor):
    """One decision for each hit. A session's decision is forgotten ``session_ms`` after it was last written; a permanent one stays."""

    def __init__(self, session_ms: int) -> None:
        self.session_ms = session_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.permanent = handle.getValueState("permanent", DECISION)
        self.session = handle.getValueState("session", DECISION, ttlDurationMs=self.session_ms)

    def _held(self) -> tuple | None:
        return self.permanent.get() or self.session.get()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held() or (None, None, None)
        write, cut, promotes = (-1, *held), -1, []  # what is held counts as written before all rows; only promotes behind the last write are kept
        for part in rows:
            seq = part["seq"]
            cut = max(cut, seq[part["op"] == "revert"].max(), key=lambda x: -1 if pd.isna(x) else x)
            own = part[part["op"].isin(ACTIONS)]
            if len(own) and (last := own.loc[own["seq"].idxmax()])["seq"] > write[0]:
                write = (last["seq"], last["op"], last["scope"], last["ts"] if last["scope"] == "permanent" else None)
            on = part[(part["op"] == "promote") & (seq > max(write[0], cut))]
            promotes = [p for p in promotes if p[0] > max(write[0], cut)] + list(zip(on["seq"], on["ts"]))
        _, action, scope, at = write if write[0] > cut or cut < 0 else (None, None, None, None)
        if action and scope != "permanent" and promotes:
            scope, at = "permanent", min(promotes)[1]
        at = None if at is None or pd.isna(at) else pd.Timestamp(at).to_pydatetime()
        self.session.clear()
        self.permanent.clear()
        if action:
            (self.permanent if scope == "permanent" else self.session).update((action, scope, at))
        if action and scope != "permanent":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.session_ms + 1)
        yield self._row(key, action, scope, at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._held() is None:
            yield self._row(key, None, None, None)

    def _row(self, key: tuple, action: str | None, scope: str | None, at) -> pd.DataFrame:
        return pd.DataFrame({"hit_id": [key[0]], "action": [action], "scope": [scope], "promoted_at": [at], "deleted": [action is None]}).astype({"promoted_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def stream_overrides(events: DataFrame, session_hours: float = SESSION_HOURS, timers: bool = False) -> DataFrame:
    """Current decision of each hit touched in a batch, from the log so far. A row with ``deleted`` takes its hit out. State is one decision per
    hit_id; a session's one ends after ``session_hours``, and a timer sends a row with ``deleted`` for it.

    Sets two session settings, which the query takes over when it starts: state in RocksDB, which this state needs; and whether there are batches
    without data. With ``timers`` there are, so timers are sent in time, but such a stream never ends by itself; else they come with the next data.
    """
    conf = events.sparkSession.conf
    conf.set(PROVIDER, ROCKS_DB)
    conf.set(EMPTY_BATCHES, str(timers).lower())
    return events.groupBy("hit_id").transformWithStateInPandas(Decisions(int(session_hours * 3_600_000)), OVERRIDE_OUT, "Update", "ProcessingTime")


def stream_to_sink(df: DataFrame, path: str, run_id: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes into the sink once by run and batch id: a batch that is delivered again, as after a lost checkpoint, changes nothing."""
    job = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return job.foreachBatch(lambda rows, k: write_once(rows, path, run_id, k) and None).start()


def stream_filter(hits: DataFrame, read_tables: Callable[[], dict[str, DataFrame]], apply: Callable[..., DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch with the lists and decisions of its time: ``read_tables`` is asked anew for every batch."""
    return hits.writeStream.foreachBatch(lambda batch, k: write(apply(batch, **read_tables()), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(hits: DataFrame, ts: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Hits by rule and tumbling window; rows behind the watermark are dropped."""
    return hits.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "rule_name").agg(F.count("*").alias("hits")).select(F.col("w.start").alias("window_start"), "rule_name", "hits")


def stream_dedupe_hits(hits: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each hit once: a replayed page emits nothing new within the watermark."""
    return hits.withWatermark(ts, late).dropDuplicatesWithinWatermark(["hit_id"])
