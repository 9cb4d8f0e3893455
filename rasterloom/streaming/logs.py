"""Keyed logs as stateful streams: rate limits, chunk uploads, revisions, deduplication."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.ranges import located


class Limiter(StatefulProcessor):
    """A client's admitted times of the trailing window, and a timer at the last one's end:
    a client that is silent for a window keeps no state."""

    def __init__(self, most: int, seconds: float):
        self.most, self.micros = most, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = deque(t for (t,) in self.times.get()) if self.times.exists() else deque()
        pdf = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        admitted = []
        for now in pdf["ts"].astype("datetime64[us]").astype("int64"):
            while times and times[0] <= now - self.micros:
                times.popleft()
            admitted.append(len(times) < self.most)
            if admitted[-1]:
                times.append(int(now))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        end = (times[-1] + self.micros) // 1000 + 1
        self.handle.registerTimer(end)
        self.timer.update((end,))
        self.times.put([(t,) for t in times])
        yield pdf.assign(admitted=admitted)[["client", "request_id", "ts", "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.timer.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, most: int = 300, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Requests (client, request_id, ts) with `admitted`: at most `most` admitted ones in
    a trailing window; rejected ones don't count. Needs the RocksDB state store."""
    schema = f"client {requests.schema['client'].dataType.simpleString()}, request_id long, ts timestamp, admitted boolean"
    return requests.withWatermark("ts", late).groupBy("client").transformWithStateInPandas(Limiter(most, seconds), schema, "Append", "EventTime")


class Uploads(StatefulProcessor):
    """An upload's received bytes, whether it is complete, its last time and its timer. An
    upload has expired when its next chunk comes after the TTL, or the watermark passes it."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", "received long, done boolean, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        received, done, last = self.state.get() if self.state.exists() else (0, False, None)
        if last is not None:
            self.handle.deleteTimer(last + self.ttl)
        out = []
        for c in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            now = c.ts.value // 1_000_000
            if last is not None and now > last + self.ttl:
                if not done:
                    out.append((key[0], -1, "expired", received))
                received, done = 0, False
            last = now
            if done or c.offset != received:
                status = "conflict"
            elif c.offset + c.length > c.total:
                status = "overflow"
            else:
                received += int(c.length)
                done = received == c.total
                status = "complete" if done else "accepted"
            out.append((key[0], c.seq, status, received))
        self.state.update((received, bool(done), int(last)))
        self.handle.registerTimer(int(last) + self.ttl)
        yield pd.DataFrame(out, columns=["upload_id", "seq", "status", "received"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        received, done, last = self.state.get()
        self.state.clear()
        if not done:
            yield pd.DataFrame([(key[0], -1, "expired", received)], columns=["upload_id", "seq", "status", "received"])

    def close(self) -> None:
        pass


def assembled_chunks(chunks: DataFrame, ttl_ms: int = 6 * 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Chunks (upload_id, seq, offset, length, total, ts) of ordered uploads with a status:
    ``accepted`` at the expected offset, ``complete`` with the last byte, ``conflict`` with
    the offset that is expected, ``overflow`` beyond the total; ``expired``, with seq -1, for
    an upload that was not complete when the TTL had passed since its last chunk. A chunk
    after that begins anew. Needs the RocksDB state store."""
    schema = "upload_id string, seq long, status string, received long"
    return chunks.withWatermark("ts", late).groupBy("upload_id").transformWithStateInPandas(Uploads(ttl_ms), schema, "Append", "EventTime")


def revision_log(edits: DataFrame) -> DataFrame:
    """Edits (image_id, seq, base, status) with `accepted` and `current`: an edit counts
    iff its base is the current revision, which it raises by 1."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        out = []
        for e in pd.concat(list(pdfs)).sort_values("seq").itertuples():
            accepted = e.base == now
            now += int(accepted)
            out.append((key[0], e.seq, accepted, now))
        state.update((now,))
        yield pd.DataFrame(out, columns=["image_id", "seq", "accepted", "current"])

    return edits.groupBy("image_id").applyInPandasWithState(fold, "image_id long, seq long, accepted boolean, current long", "now long", "append", GroupStateTimeout.NoTimeout)


def first_seen(files: DataFrame, key: str = "sha256", ts: str = "ts", keep: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return files.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


class BucketedTable:
    """A table kept current by merges: rows are dealt to buckets by a hash of their key, and a
    merge rewrites only the buckets that its rows touch. `manifests` holds one small file a
    batch with each bucket's newest version; a batch that runs again starts from the manifest
    before it and writes the same again."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets
        self.schema = schema

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Newest version of each bucket, as of the last batch (before `before`)."""
        system, name = located(f"{self.path}/manifests")
        files = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
        batches = [int(f.base_name) for f in files if f.base_name.isdigit()]
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return {}
        with system.open_input_stream(f"{name}/{max(batches)}") as file:
            return {int(k): v for k, v in json.loads(file.read()).items()}

    def rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/bucket={b}/version={v}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.rows(self.manifest())

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """The last row of each key, by `order`, among those of the table and `rows`."""
        others = [c for c in self.rows({}).columns if c != self.key]
        last = lambda df: df.groupBy(self.key).agg(F.max_by(F.struct(*others), self.order).alias("_r")).select(self.key, "_r.*")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        rows = last(rows.select(self.key, *others)).persist()
        try:
            touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # at most `buckets`
            known = self.manifest(batch_id)
            now = last(self.rows({b: known[b] for b in touched if b in known}).unionByName(rows)).withColumn("bucket", bucket)
            # dynamic: buckets that the batch does not touch stay as they are
            now.repartition("bucket").withColumn("version", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
        finally:
            rows.unpersist()
        system, name = located(f"{self.path}/manifests")
        system.create_dir(name, recursive=True)
        with system.open_output_stream(f"{name}/_{batch_id}") as out:
            out.write(json.dumps(known | dict.fromkeys(touched, batch_id)).encode())
        system.move(f"{name}/_{batch_id}", f"{name}/{batch_id}")


def status_upserts(table: BucketedTable):
    """A foreachBatch function that keeps a table of statuses current: the last event of each
    id wins, also over what the table holds, so that a batch can be run again."""
    return table.merge
