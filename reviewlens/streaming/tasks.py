"""Task streams: routing, expiry, priority, idempotency, task states, results, sessions, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from reviewlens.sources.shared import folder

TASK = "task_id string, request_id string, mode string, hotfix boolean, project_dir string, created_at bigint, diff_entries array<struct<file_path:string,content:string,token_count:int>>, allowed_files array<string>"
# Minutes until a message is dead, and the states of a task.
TASK_MINUTES, RESULT_MINUTES, SESSION_MINUTES = 10, 60, 10
TRANSITIONS = {"created": "PENDING", "started": "RUNNING", "completed": "COMPLETED", "failed": "FAILED"}


def routing_key(mode: Column) -> Column:
    return F.concat(F.lit("review."), F.lower(mode), F.lit(".task"))


def queue(key: Column) -> Column:
    """ST1: the queue that a routing key is bound to; null where none is."""
    return F.when(key.isin("review.multi_agent.task", "review.agent.task"), "agent").when(key.rlike(r"^review\.pipeline(\..*)?$"), "pipeline").when(key.rlike(r"^review\.simple(\..*)?$"), "simple").when(key.rlike(r"^review\.result(\..*)?$"), "result")


def priority(hotfix: Column) -> Column:
    """ST3."""
    return F.when(F.coalesce(hotfix, F.lit(False)), 9).otherwise(5)


def messages(values: DataFrame) -> DataFrame:
    """SRC16: JSON values to task rows; values that aren't JSON objects of a task have a null ``task_id``."""
    out = values.select(F.from_json("value", TASK).alias("t")).select("t.*")
    return out.withColumn("request_id", F.coalesce(F.nullif("request_id", F.lit("")), "task_id")).withColumn("priority", priority(F.col("hotfix"))).withColumn("queue", queue(routing_key(F.col("mode"))))


def read_queue(spark, folder: str) -> DataFrame:
    """SRC16: a folder of JSON lines as a stream of messages."""
    return messages(spark.readStream.text(folder))


def publish(tasks: DataFrame, folder: str) -> None:
    """SRC16: task rows as JSON lines, one file set a call."""
    tasks.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def dead(created: Column, now: Column, minutes: int = TASK_MINUTES) -> Column:
    """ST2."""
    return created < now - F.expr(f"INTERVAL {minutes} MINUTES")


def split_dead(tasks: DataFrame, now: Column, minutes: int = TASK_MINUTES) -> tuple[DataFrame, DataFrame]:
    """ST2: live messages by priority, and the dead letters."""
    late = dead(F.col("created"), now, minutes)
    return tasks.where(~late).orderBy(F.desc("priority"), "created"), tasks.where(late)


class Expiry(StatefulProcessor):
    """ST2 as a stream: the messages that wait, each with the millisecond in which it dies, and a timer for the first of these.

    A message that is taken leaves the list. When event time has passed the timer, what is due is emitted as dead
    letters, and the timer is set for the next. The list is read and written once a batch or timer.
    """

    def __init__(self, minutes: int):
        self.after = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", "message_id string, died_at bigint")

    def _set(self, left: dict[str, int], timer: int | None) -> None:
        if left:
            self.waiting.put(list(left.items()))
        elif self.waiting.exists():
            self.waiting.clear()
        first = min(left.values(), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = dict(self.waiting.get()) if self.waiting.exists() else {}
        timer, taken = min(left.values(), default=None), []
        for frame in rows:
            frame = frame[frame["message_id"].notna()]
            fresh = frame[~frame["taken"]]
            at = fresh["ts"].to_numpy().astype("datetime64[ms]").astype("int64") + self.after
            left.update(zip(fresh["message_id"], at.tolist(), strict=True))
            taken += frame.loc[frame["taken"], "message_id"].tolist()
        # a message may come after its own taking in a batch
        for m in taken:
            left.pop(m, None)
        self._set(left, timer)
        yield self._letters(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs(), dict(self.waiting.get()) if self.waiting.exists() else {}
        self._set({m: at for m, at in waiting.items() if at > now}, None)
        yield self._letters(key, [(m, at) for m, at in waiting.items() if at <= now])

    @staticmethod
    def _letters(key, dead: list[tuple[str, int]]) -> pd.DataFrame:
        out = pd.DataFrame({"queue": [key[0]] * len(dead), "message_id": [m for m, _ in dead], "died_at": pd.to_datetime([at for _, at in dead], unit="ms")})
        return out.astype({"queue": object, "message_id": object, "died_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def dead_letters(messages: DataFrame, queue: str, minutes: int = TASK_MINUTES, late: str = "0 seconds", spread: int = 16) -> DataFrame:
    """ST2 as a stream: (``message_id``, ``queue``, ``ts``, ``taken``) to the messages that nobody took in time, once event time has reached their end.

    Needs the RocksDB state store. A queue's messages wait in ``spread`` lists by their id, so that a full
    queue is not one task's.
    """
    seen = messages.withWatermark("ts", late).select(F.col(queue).cast("string").alias("queue"), F.pmod(F.xxhash64("message_id"), F.lit(spread)).alias("part"), "message_id", "ts", "taken")
    return seen.groupBy("queue", "part").transformWithStateInPandas(Expiry(minutes), "queue string, message_id string, died_at timestamp", "Append", "EventTime")


class Requests(StatefulProcessor):
    """ST4 as a stream: the hash of a key's first request, until a timer of event time ends its life; requests are compared a batch of rows at a time."""

    def __init__(self, minutes: int):
        self.live = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "request_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame.sort_values("ord", kind="stable")
            outcome = pd.Series("duplicate", frame.index)
            made = not self.first.exists()
            if made:
                self.first.update((frame["request_hash"].iloc[0],))
                self.handle.registerTimer(int(frame["ts"].iloc[0].timestamp() * 1000) + self.live)
            first = self.first.get()[0]
            same = frame["request_hash"].isna() if first is None else frame["request_hash"] == first
            outcome[~same] = "conflict"
            if made:
                outcome.iloc[0] = "created"
            yield pd.DataFrame({"key": key[0], "ord": frame["ord"], "outcome": outcome})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield pd.DataFrame({"key": [], "ord": [], "outcome": []}).astype({"key": object, "ord": "int64", "outcome": object})

    def close(self) -> None:
        pass


def idempotent_stream(requests: DataFrame, minutes: int = 24 * 60, late: str = "0 seconds") -> DataFrame:
    """ST4 as a stream: (``key``, ``request_hash``, ``ord``, ``ts``) with ``outcome``, as ``idempotent`` gives it: the first to arrive creates.

    A key is free again when event time is ``minutes`` past its first request. Within what Spark hands over at a
    time the order is ``ord``; a hot key passes through as a stream of slices. Needs the RocksDB state store.
    """
    narrow = requests.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "request_hash", F.col("ord").cast("long").alias("ord"), "ts")
    return narrow.groupBy("key").transformWithStateInPandas(Requests(minutes), "key string, ord long, outcome string", "Append", "EventTime")


def idempotent(requests: DataFrame) -> DataFrame:
    """ST4: (``key``, ``request_hash``, ``ord``) with ``outcome``: created, duplicate, or conflict where the hash differs from the first.

    The first request of each key is one partial aggregate; a hot key's rows never meet.
    """
    first = requests.groupBy("key").agg(F.min_by("request_hash", "ord").alias("_hash"), F.min("ord").alias("_ord"))
    out = requests.join(first, "key")
    outcome = F.when(F.col("ord") == F.col("_ord"), "created").when(F.col("request_hash") == F.col("_hash"), "duplicate").otherwise("conflict")
    return out.withColumn("outcome", outcome).drop("_hash", "_ord")


def latest_state(events: DataFrame) -> DataFrame:
    """ST5 in batch: each task's status by its last transition, its time, and when it began and ended."""
    last = F.max_by("status", F.struct("ts", "event_id"))
    return events.groupBy("task_id").agg(last.alias("status"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("transitions"), F.min(F.when(F.col("status") == "RUNNING", F.col("ts"))).alias("started_at"))


#: ST5: from which states a status may be entered.
ALLOWED = {"PENDING": (None,), "RUNNING": ("PENDING",), "COMPLETED": ("RUNNING",), "FAILED": ("PENDING", "RUNNING")}


class TaskStates(StatefulProcessor):
    """ST5 as a stream: a task's state, advanced only by allowed transitions; others are reported and change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for r in frame.itertuples():
            now = self.state.get()[0] if self.state.exists() else None
            ok = now in ALLOWED.get(r.status, ())
            if ok:
                self.state.update((r.status,))
            out.append((key[0], r.event_id, now, r.status, ok))
        yield pd.DataFrame(out, columns=["task_id", "event_id", "before", "status", "applied"])

    def close(self) -> None:
        pass


def task_states(events: DataFrame) -> DataFrame:
    """ST5: needs the RocksDB state store."""
    return events.groupBy("task_id").transformWithStateInPandas(TaskStates(), "task_id string, event_id bigint, before string, status string, applied boolean", "Append", "None")


class Breaker(StatefulProcessor):
    """ST9: a caller's last calls as list state; whether the breaker is open after each."""

    def __init__(self, size: int = 10, least: int = 5, rate: float = 0.5):
        self.size, self.least, self.rate = size, least, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getListState("calls", "failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [bool(x[0]) for x in self.calls.get()]
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "call_id"]).itertuples():
            last = [*last, bool(r.failed)][-self.size :]
            out.append((key[0], r.call_id, len(last), sum(last) / len(last), len(last) >= self.least and sum(last) / len(last) >= self.rate))
        self.calls.put([(x,) for x in last])
        yield pd.DataFrame(out, columns=["caller", "call_id", "calls", "failure_rate", "open"])

    def close(self) -> None:
        pass


def breaker_states(calls: DataFrame, **settings) -> DataFrame:
    return calls.groupBy("caller").transformWithStateInPandas(Breaker(**settings), "caller string, call_id bigint, calls int, failure_rate double, open boolean", "Append", "None")


def results(received: DataFrame, tasks: DataFrame) -> DataFrame:
    """ST6, JN16: (``task_id``, ``payload``) with ``route``: dead_letter for blank ids, ignored for unknown tasks, else applied."""
    known = tasks.select("task_id", F.lit(True).alias("_known"))
    out = received.join(known, "task_id", "left")
    route = F.when(F.trim(F.coalesce("task_id", F.lit(""))) == "", "dead_letter").when(F.col("_known").isNull(), "ignored").otherwise("applied")
    return out.withColumn("route", route).drop("_known")


def live_sessions(sessions: DataFrame, now: Column, minutes: int = SESSION_MINUTES) -> DataFrame:
    """ST7: sessions live from their creation, whatever their use."""
    return sessions.where(F.col("created_at") > now - F.expr(f"INTERVAL {minutes} MINUTES"))


def in_active_sessions(resources: DataFrame, sessions: DataFrame) -> DataFrame:
    """Resources of sessions that still live."""
    return resources.join(sessions.select("session_id"), "session_id", "left_semi")


def first_seen(stream: DataFrame, key: str, event_time: str, horizon: str = "10 minutes") -> DataFrame:
    """ST4 as a stream: the first message of each key within the horizon."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums by window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Extension: a user's runs of events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a Parquet table of the shared folder.

    A batch is one folder, overwritten if it is run again, so each row counts once; in complete mode
    the last batch is the table. State and progress lie beside them. Runs never share a folder.
    """
    spark = stream.sparkSession
    root, last = folder(spark, name), []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        last.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*([f"{root}/batch={last[-1]}"] if mode == "complete" else [f"{root}/batch={n}" for n in sorted(set(last))]))


def stream_table(spark, folder: str, name: str, schema: StructType) -> DataFrame:
    """The Parquet files of a folder with that name as a stream; times without zone become UTC times, which watermarks need."""
    out = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out
