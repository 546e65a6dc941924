"""Updates event by event, with each customer's totals in the state store.

A stateful processor keeps a customer's count, sum, newest time and last event
between micro-batches; what it emits are numbers, and labels are Columns on
them. Events of a micro-batch are taken in the order of ``seq``, so micro-batches
that come in that order give what one pass over all events gives, however they
are cut, and so does a stream that ends and starts again from its checkpoint.
A task holds the events of one customer that one micro-batch brings
(``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bound that), never more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.functions.columns import epoch, whole_days
from tessella.streaming.state import scores, segment5

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_TOTALS = "frequency bigint, monetary double, newest double, last_ts double"
_HELD = "seq bigint, value double, ts double"
EMITTED = "customer_id bigint, seq bigint, ts double, frequency bigint, monetary double, late boolean, before_ts double, before_frequency bigint, before_monetary double"


class Totals(StatefulProcessor):
    """Counts and sums of a customer up to each event, and those before it.

    ``lateness``: an event is late if it is older, by more seconds than this,
    than the newest that came before it; late events count like others.
    ``ttl_ms``: a customer without an event for so long (wall clock) is
    forgotten; 0 keeps all. ``hold``: events wait until a customer has so many,
    or for ``hold_ms`` (wall clock) from the first one on; 1 lets all through.
    """

    def __init__(self, lateness: float, ttl_ms: int, hold: int, hold_ms: int):
        self.lateness, self.ttl_ms, self.hold, self.hold_ms = lateness, ttl_ms, hold, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS, self.ttl_ms or None)
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[["seq", "value", "ts"]]
        if self.hold <= 1:
            yield self._updates(key, new)
            return
        waiting = list(self.held.get()) if self.held.exists() else []
        if len(waiting) + len(new) >= self.hold:
            self._stop_timers()
            self.held.clear()
            yield self._updates(key, pd.concat([_frame(waiting), new]) if waiting else new)
            return
        if not waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)
        self.held.appendList([tuple(r) for r in new.astype(object).itertuples(index=False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = list(self.held.get()) if self.held.exists() else []
        self.held.clear()
        if waiting:
            yield self._updates(key, _frame(waiting))

    def _stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def _updates(self, key, events: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values("seq", kind="stable")
        known = self.totals.get() if self.totals.exists() else None
        count, total, newest, last = known if known else (0, 0.0, float("-inf"), None)
        values, times = events["value"].fillna(0.0).tolist(), events["ts"].astype(float).tolist()
        rows = []
        for seq, value, ts in zip(events["seq"].tolist(), values, times, strict=True):
            before = (last, count, total) if count else (None, None, None)
            count, total, late = count + 1, total + value, ts < newest - self.lateness
            newest, last = max(newest, ts), ts
            rows.append((key[0], seq, ts, count, total, late, *before))
        self.totals.update((count, total, newest, last))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EMITTED.split(", ")]).astype({"before_frequency": "Int64"})


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in rows], columns=["seq", "value", "ts"])


def updates(events: DataFrame, as_of: str, lateness: float = 3600.0, ttl_ms: int = 0, hold: int = 1, hold_ms: int = 1_000) -> DataFrame:
    """For each event of a stream (customer_id, seq, value, ts): the customer's label before and after it, and whether it was late.

    Null values count as 0; events without a customer share the state of -1.
    With ``ttl_ms`` or ``hold`` the stream watches the clock: it makes batches
    for as long as it runs, so the trigger ``availableNow`` doesn't end it;
    take ``processingTime``, or ``once`` for one batch.
    """
    rows = events.select(F.coalesce(F.col("customer_id").cast("bigint"), F.lit(-1)).alias("customer_id"), F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("double").alias("value"), epoch(F.col("ts")).cast("double").alias("ts"))
    clock = "processingTime" if ttl_ms or hold > 1 else "none"
    found = rows.groupBy("customer_id").transformWithStateInPandas(Totals(lateness, ttl_ms, hold, hold_ms), EMITTED, "append", clock)
    return labelled(found, as_of)


def labelled(found: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp").cast("bigint")
    label = lambda p: segment5(*scores(whole_days(now - F.col(f"{p}ts").cast("bigint")), F.col(f"{p}frequency"), F.col(f"{p}monetary")))
    before = F.when(F.col("before_ts").isNotNull(), label("before_"))
    out = found.withColumns({"new_segment": label(""), "previous_segment": before})
    changed = F.coalesce(F.col("previous_segment") != F.col("new_segment"), F.lit(True))
    return out.select("customer_id", "seq", "previous_segment", "new_segment", changed.alias("changed"), F.lit(0.85).alias("confidence"), "late", *[c.split()[0] for c in EMITTED.split(", ") if c.split()[0] not in ("customer_id", "seq", "late")])


def start(rows: DataFrame, checkpoint: str, sink: str | Callable[[DataFrame, int], None], **trigger):
    """Starts a stream of ``updates`` into a Parquet folder, where each event comes out once, or into a function of (rows, batch number).

    The stream's state is kept in RocksDB; the session's setting is as it was afterwards.
    """
    conf, (name, provider) = rows.sparkSession.conf, PROVIDER
    old = conf.get(name, None)
    conf.set(name, provider)
    try:
        writer = rows.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True}))
        return (writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)).start()
    finally:
        conf.unset(name) if old is None else conf.set(name, old)
