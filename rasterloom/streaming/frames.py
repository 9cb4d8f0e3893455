"""Live frames as Structured Streaming jobs: source, latest slot, lock machine, replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FRAME_SCHEMA = "camera long, generation long, frame_id long, ts timestamp, lines int, m1 double, m2 double, m3 double, m4 double"


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Frames that arrive as JSON files; a deployment reads the same schema from Kafka."""
    return spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest_only(process: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of each camera only the newest frame of a batch is
    processed, the frames between are dropped."""

    def batch(frames: DataFrame, batch_id: int) -> None:
        rest = [c for c in frames.columns if c != "camera"]
        newest = frames.groupBy("camera").agg(F.max_by(F.struct(*rest), F.struct("generation", "frame_id")).alias("f"))
        process(newest.select("camera", "f.*"), batch_id)

    return batch


def throttled(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 2.0):
    """Starts a query that handles the newest frames at a fixed delay."""
    return stream.writeStream.foreachBatch(latest_only(sink)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def slot_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for `latest_only`: each batch overwrites its own folder, so that a batch which
    runs again after a restart leaves the table as it was."""

    def write(newest: DataFrame, batch_id: int) -> None:
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def slots(spark: SparkSession, path: str) -> DataFrame:
    """What `slot_sink` has written: the newest frames of each batch."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


LOCK_SCHEMA = "camera long, generation long, frame_id long, ts timestamp, action string, locked_frame long"
IDLE_MS = 3_600_000


def relative_spread(history: list[list[float]], floor: float = 0.03) -> float | None:
    """80th percentile of deviation over mean, of the metrics whose mean matters."""
    x = np.array(history, float)
    mean, std = x.mean(axis=0), x.std(axis=0)
    use = mean > floor
    return float(np.percentile(std[use] / mean[use], 80)) if use.any() else None


class LockMachine(StatefulProcessor):
    """A camera's state: its slot (generation, stable since, locked frame, timer) as a value,
    its last frames' metrics as a list, and an event-time timer that drops both when the
    camera has been idle. A frame that comes later than that finds no state either, whether
    or not the watermark was there first."""

    def __init__(self, lock_on_first: bool, hold_seconds: float, rows: int, limit: float, least_lines: int, idle_ms: int):
        self.rule, self.idle = (lock_on_first, hold_seconds, rows, limit, least_lines), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "generation long, since double, locked long, timer long")
        self.frames = handle.getListState("frames", "m1 double, m2 double, m3 double, m4 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lock_on_first, hold_seconds, most, limit, least_lines = self.rule
        generation, since, locked, timer = self.slot.get() if self.slot.exists() else (None, None, None, None)
        history = [list(f) for f in self.frames.get()] if self.frames.exists() else []
        out, end = [], timer
        for f in pd.concat(list(rows)).sort_values(["ts", "frame_id"]).itertuples():
            now = f.ts.value // 1_000_000
            if end is not None and now > end:
                generation, history, since, locked = None, [], None, None
            end = max(end or 0, now + self.idle)
            if generation is not None and f.generation < generation:
                out.append((key[0], f.generation, f.frame_id, f.ts, "stale", None))
                continue
            if generation is None or f.generation > generation:
                generation, history, since, locked = int(f.generation), [], None, None
            at = f.ts.timestamp()
            if locked is not None:
                action = "locked"
            elif f.lines < least_lines:
                history, since, action = [], None, "clear"
            elif lock_on_first:
                locked, action = int(f.frame_id), "lock"
            else:
                history = [*history, [f.m1, f.m2, f.m3, f.m4]][-most:]
                spread = relative_spread(history) if len(history) >= 3 else None
                action = "wait"
                if spread is None or spread >= limit:
                    since = None
                elif since is None:
                    since = at
                elif at - since >= hold_seconds:
                    locked, action = int(f.frame_id), "lock"
            out.append((key[0], f.generation, f.frame_id, f.ts, action, locked))
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(end)
        self.slot.update((generation, since, locked, end))
        if history:
            self.frames.put([tuple(map(float, h)) for h in history])
        elif self.frames.exists():
            self.frames.clear()
        found = pd.DataFrame(out, columns=["camera", "generation", "frame_id", "ts", "action", "locked_frame"])
        yield found.assign(locked_frame=found["locked_frame"].astype("Int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.slot.clear()
        self.frames.clear()
        yield from ()

    def close(self) -> None:
        pass


def lock_machine(frames: DataFrame, lock_on_first: bool = True, hold_seconds: float = 3.0, rows: int = 12, limit: float = 0.10, least_lines: int = 2, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """One action a frame: ``clear`` (too few lines), ``wait``, ``lock`` and, while locked,
    ``locked`` with the frame that the snapshot holds. A frame of an older generation is
    ``stale``; a newer generation starts over, and so does a camera that was idle for longer
    than `idle_ms`. Needs the RocksDB state store."""
    machine = LockMachine(lock_on_first, hold_seconds, rows, limit, least_lines, idle_ms)
    return frames.withWatermark("ts", late).groupBy("camera").transformWithStateInPandas(machine, LOCK_SCHEMA, "Append", "EventTime")


RESULT_SCHEMA = "camera long, generation long, frame_id long, ts timestamp, reset boolean"


class Generations(StatefulProcessor):
    """A camera's newest generation; it never goes back, so it has no timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "generation long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (newest,) = self.newest.get() if self.newest.exists() else (None,)
        pdf = pd.concat(list(rows)).sort_values(["ts", "frame_id"])
        before = pdf["generation"].cummax().shift()
        before = before.fillna(-1 if newest is None else newest).clip(lower=-1 if newest is None else newest)
        self.newest.update((int(max(before.iloc[-1], pdf["generation"].iloc[-1])),))
        kept = pdf.assign(reset=pdf["generation"] > before)[pdf["generation"] >= before]
        yield kept[["camera", "generation", "frame_id", "ts", "reset"]]

    def close(self) -> None:
        pass


def current_results(results: DataFrame) -> DataFrame:
    """Results (camera, generation, frame_id, ts) of the camera's newest generation so far;
    those of older ones, which began before a reset, are dropped. `reset` marks the first of
    a generation. Generations count from 0."""
    return results.groupBy("camera").transformWithStateInPandas(Generations(), RESULT_SCHEMA, "Append", "None")


def matched_replies(requests: DataFrame, replies: DataFrame, timeout: str = "30 seconds") -> DataFrame:
    """Requests (request_id, sent) with their reply (reply_to, received, result) if it
    came in time; the others come out with null results once the watermark passes."""
    asked, told = requests.withWatermark("sent", timeout), replies.withWatermark("received", timeout)
    in_time = (F.col("request_id") == F.col("reply_to")) & (F.col("received") >= F.col("sent")) & (F.col("received") <= F.col("sent") + F.expr(f"interval {timeout}"))
    return asked.join(told, in_time, "left_outer").select("request_id", "sent", "received", "result")
