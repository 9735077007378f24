"""Live jobs over event files. Back-pressure is by files per trigger; no event is dropped.

Keyed folds keep their state in the stream's state store (`transformWithStateInPandas` over RocksDB) and append a row to
their target whenever the state of a key changes; `newest_rows` reads the last row of each key. States are ordered by event
time and id, so late and shuffled events give the rows of the batch folds in `state`. The burst and highlight jobs
need a watermark, because a burst can only close, and a highlight only expire, when no earlier event can still come:
what is open at the watermark of the last event stays open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from . import state

EVENT_SCHEMA = "event_id bigint, repo_hash string, ts timestamp, event string, layer string, node_id string, value double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 64) -> DataFrame:
    """Event stream of a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def subscribe(events: DataFrame, repo_hash: str) -> DataFrame:
    return events.where(F.col("repo_hash") == repo_hash)


class KeyedFold(StatefulProcessor):
    """One state row per key. A subclass names its `STATE` schema and gives `folded` (state or None, event -> state)
    and `shown` (state -> output values behind the key and the number of the change)."""

    STATE = ""
    OUTPUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = [f.split()[0] for f in self.STATE.split(", ")]
        self.columns = [f.split()[0] for f in self.OUTPUT.split(", ")]
        self.held = handle.getValueState("held", f"{self.STATE}, change bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.held.get() if self.held.exists() else None
        now = None if before is None else dict(zip(self.fields, before))
        started = None if now is None else dict(now)
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            for event in part.to_dict("records"):
                now = self.folded(now, event)
        if now is None or now == started:
            return
        change = 1 if before is None else before[-1] + 1
        self.held.update((*[now[f] for f in self.fields], change))
        shown = self.shown(now)
        if shown is not None:
            yield pd.DataFrame([(*key, *shown, change)], columns=self.columns)

    def folded(self, now: dict | None, event: dict) -> dict | None:
        raise NotImplementedError

    def shown(self, now: dict) -> Iterable | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Activities(KeyedFold):
    """Activity by id: a later event overwrites, a status only when it has one, the first arrival stays."""

    STATE = "at bigint, id bigint, query_type string, task string, status_at bigint, status_id bigint, status string, first_at bigint, first_id bigint"
    OUTPUT = "repo_hash string, activity_id string, query_type string, task string, at bigint, status string, first_at bigint, first_id bigint, change bigint"

    def folded(self, now, event):
        order = (event["at"], event["event_id"])
        now = dict(now) if now else dict.fromkeys(self.fields)
        if now["at"] is None or order > (now["at"], now["id"]):
            now.update(at=order[0], id=order[1], query_type=event["query_type"], task=event["task"])
        if event["status"] is not None and (now["status_at"] is None or order > (now["status_at"], now["status_id"])):
            now.update(status_at=order[0], status_id=order[1], status=event["status"])
        if now["first_at"] is None or order < (now["first_at"], now["first_id"]):
            now.update(first_at=order[0], first_id=order[1])
        return now

    def shown(self, now):
        return [now[c] for c in ("query_type", "task", "at", "status", "first_at", "first_id")]


class Runs(KeyedFold):
    """Run by id: `new -> running -> finished`, by event time. Steps before the start (or without one) do not count.

    Steps earlier than the start known so far wait in a list, since a still earlier start may come late.
    """

    STATE = "start_at bigint, start_id bigint, steps bigint, end_at bigint, end_id bigint, end_status string"
    OUTPUT = "repo_hash string, run_id string, started_at bigint, n_steps bigint, status string, change bigint"

    def init(self, handle):
        super().init(handle)
        self.early = handle.getListState("early", "at bigint, id bigint")

    def folded(self, now, event):
        order = (event["at"], event["event_id"])
        now = dict(now) if now else dict.fromkeys(self.fields, None) | {"steps": 0}
        start = (now["start_at"], now["start_id"])
        if event["event"] == "agent_run_started" and (start[0] is None or order < start):
            now.update(start_at=order[0], start_id=order[1])
            waiting = [tuple(w) for w in self.early.get()]
            now["steps"] += sum(w >= order for w in waiting)
            left = [w for w in waiting if w < order]
            if left:
                self.early.put(left)
            elif waiting:
                self.early.clear()
        elif event["event"] == "agent_step":
            if start[0] is not None and order >= start:
                now["steps"] += 1
            else:
                self.early.appendValue(order)
        elif event["event"] == "agent_run_finished" and (now["end_at"] is None or order > (now["end_at"], now["end_id"])):
            now.update(end_at=order[0], end_id=order[1], end_status=event["status"])
        return now

    def shown(self, now):
        if now["start_at"] is None:
            return None
        ended = now["end_at"] is not None and (now["end_at"], now["end_id"]) >= (now["start_at"], now["start_id"]) and now["end_status"] is not None
        return [now["start_at"], now["steps"], now["end_status"] if ended else "running"]


class Newest(KeyedFold):
    """The newest event of a key."""

    STATE = "at bigint, event_id bigint, event string"
    OUTPUT = "repo_hash string, layer string, node_id string, event string, event_id bigint, at bigint, change bigint"

    def folded(self, now, event):
        order = (event["at"], event["event_id"])
        if now and order <= (now["at"], now["event_id"]):
            return now
        return {"at": order[0], "event_id": order[1], "event": event["event"]}

    def shown(self, now):
        return [now["event"], now["event_id"], now["at"]]


class Highlights(StatefulProcessor):
    """A highlight is written as `live` when it arrives and as `expired` when the watermark passes its end; then its state goes."""

    OUTPUT = "repo_hash string, event_id bigint, node_ids array<string>, expires_at bigint, state string, change bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "node_ids array<string>, expires_at bigint")

    def row(self, key: tuple, node_ids: list, expires_at: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, list(node_ids), expires_at, "expired" if expired else "live", 1 + expired)], columns=[c.split()[0] for c in self.OUTPUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if self.held.exists():  # repeated
            return
        event = next(p for p in rows if len(p)).iloc[0]
        ends = -(-int(event["expires_at"]) // 1000)
        if ends <= timerValues.getCurrentWatermarkInMs():
            yield self.row(key, event["node_ids"], int(event["expires_at"]), True)
            return
        self.held.update((list(event["node_ids"]), int(event["expires_at"])))
        self.handle.registerTimer(ends)
        yield self.row(key, event["node_ids"], int(event["expires_at"]), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.held.exists():
            node_ids, expires_at = self.held.get()
            self.held.clear()
            yield self.row(key, node_ids, expires_at, True)

    def close(self) -> None:
        pass


def stated(events: DataFrame, keys: list[str], processor: StatefulProcessor, time_mode: str = "None") -> DataFrame:
    """Rows that a keyed processor writes; `at` is the event time in microseconds."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode=time_mode)


def appended(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to a folder of Parquet files (written exactly once) until the input is used up."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_rows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last row that a keyed job wrote for each key."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "change").alias("r")).select(*keys, "r.*").drop("change")


def timed(events: DataFrame, *columns: str) -> DataFrame:
    return events.select(*columns, F.unix_micros("ts").alias("at"))


def run_latest(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The newest change of each (repo_hash, layer, node_id)."""
    return appended(stated(timed(events, "repo_hash", "layer", "node_id", "event", "event_id"), ["repo_hash", "layer", "node_id"], Newest()), target, checkpoint)


def run_activity(activity: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Activity rows (`state.fold_activity` without the cut) of a stream of (repo_hash, ts, event_id, activity_id, query_type, task, status)."""
    rows = timed(activity, "repo_hash", "activity_id", "event_id", "query_type", "task", "status")
    return appended(stated(rows, ["repo_hash", "activity_id"], Activities()), target, checkpoint)


def run_runs(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run rows (`state.fold_runs`) of a stream of (repo_hash, run_id, ts, event_id, event, status)."""
    rows = timed(events, "repo_hash", "run_id", "event_id", "event", "status")
    return appended(stated(rows, ["repo_hash", "run_id"], Runs()), target, checkpoint)


def run_highlights(highlights: DataFrame, target: str, checkpoint: str, lateness: str = "10 seconds") -> StreamingQuery:
    """`live` and `expired` rows of a stream of (repo_hash, ts, event_id, ttl_ms, node_ids)."""
    life = F.coalesce("ttl_ms", F.lit(state.HIGHLIGHT_MS)).cast("bigint")
    rows = highlights.withWatermark("ts", lateness).withColumn("expires_at", F.unix_micros("ts") + life * 1000)
    return appended(stated(rows, ["repo_hash", "event_id"], Highlights(), "EventTime"), target, checkpoint)


def run_activity_highlights(activity: DataFrame, nodes_folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Node ids of the names of a stream of (repo_hash, activity_id, names); the stored nodes (repo_hash, label, id) are read anew for each batch.

    A batch writes its own folder, so a repeated batch replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        nodes = batch.sparkSession.read.parquet(nodes_folder)
        state.activity_highlights(batch, nodes).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{target}/batch={batch_id}")

    return activity.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_bursts(events: DataFrame, target: str, checkpoint: str, gap: str = "100 milliseconds", lateness: str = "10 seconds") -> StreamingQuery:
    """One refresh row per burst of changes of a layer, written once the watermark has passed its end."""
    changes = events.where(F.col("event").isin("node_added", "node_updated", "edge_added")).withWatermark("ts", lateness)
    return appended(state.refresh_bursts(changes, gap), target, checkpoint)
