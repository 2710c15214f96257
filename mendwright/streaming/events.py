"""An extension: daily counts and dismissals over a stream of events, bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def first_alerts(events: DataFrame, key: str = "event_id", hold: str = "7 days") -> DataFrame:
    """Each alert once within the time that a dismissal holds; older state goes."""
    return events.withWatermark("ts", hold).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end into memory and returns the table (for tests and small inputs)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


#: How long a dismissal holds, in milliseconds. State of this kind needs the RocksDB store.
HOLD_MS = 7 * 24 * 3600 * 1000
STORE, STORE_CLASS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Held(StatefulProcessor):
    """The state of one alert: whether there is one, and until when its dismissal holds (0: it isn't dismissed)."""

    def __init__(self, hold: int) -> None:
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "there boolean, until long")

    def _known(self) -> tuple[bool, int]:
        return tuple(self.state.get()) if self.state.exists() else (False, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        there, until = self._known()
        shown = []
        for kind, at in sorted(((k, int(t.timestamp() * 1000)) for frame in rows for k, t in zip(frame["kind"], frame["ts"], strict=True)), key=lambda x: (x[1], x[0])):
            if until and at >= until:  # the dismissal is over, though its timer hasn't come yet
                if there:
                    shown.append((until, "back"))
                until = 0
            if kind == "dismiss":
                until = at + self.hold
            elif not there or not until:
                there = True
                if not until:
                    shown.append((at, "new"))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if until:
            self.handle.registerTimer(until)
        self.state.update((there, until))
        yield _shown(key, shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        there, until = self._known()
        self.state.update((there, 0))
        yield _shown(key, [(until, "back")] if there and until else [])

    def close(self) -> None:
        pass


def _shown(key: tuple, rows: list[tuple[int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"id": pd.Series([key[0]] * len(rows), dtype=object), "shown_at": pd.to_datetime([t for t, _ in rows], unit="ms", utc=True), "why": pd.Series([w for _, w in rows], dtype=object)})


def alerts_with_dismissals(events: DataFrame, delay: str = "1 hour", hold_ms: int = HOLD_MS) -> DataFrame:
    """(id, shown_at, why) over a stream (id, kind, ts) of alerts and dismissals (``kind`` ``dismiss``).

    An alert is shown when it comes (``new``) unless it is dismissed; a dismissal hides it for ``hold_ms`` from its time on, then the
    alert comes back by itself (``back``), once, when the watermark passes that time. A dismissal anew holds from then on. Rows without an id or a
    time are left out, repeated rows change nothing but ``new`` ones, which are shown again; dismissing what isn't there holds as well.
    """
    events.sparkSession.conf.set(STORE, STORE_CLASS)
    own = events.where("id is not null and ts is not null").select("id", F.coalesce("kind", F.lit("alert")).alias("kind"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    kind = own.schema["id"].dataType.simpleString()
    return own.groupBy("id").transformWithStateInPandas(_Held(hold_ms), f"id {kind}, shown_at timestamp, why string", "append", "EventTime")
