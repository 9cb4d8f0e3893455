"""Stateful streams over the tables (ST2 to ST7, ST10).

Rows arrive in slices by time. After each slice the stream is started anew from its
checkpoint and runs over what is there, so that state, watermarks and sinks go through
several micro-batches and restarts; results do not depend on the cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.graph import folder
from ..streaming import frames as S
from ..streaming import logs
from . import views
from .registry import query

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICES = 3


def _cuts(rows: DataFrame, ts: str) -> list[int]:
    """Times, in microseconds, that cut the rows' span into `SLICES` equal parts."""
    low, high = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    return [low + (high - low) * i // SLICES for i in range(1, SLICES)] if low is not None else []


def _slice(ts: str | Column, cuts: list[int]) -> Column:
    """The number of cuts that a time has reached."""
    at = F.unix_micros(ts)
    return sum((F.when(at >= c, 1).otherwise(0) for c in cuts), F.lit(0))


_SLICE = "(SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events)"
_NTH = " + ".join(f"(epoch_us(ts) >= low + (high - low) * {i} // {SLICES})::INT" for i in range(1, SLICES))


def _replayed(parts: list[tuple[DataFrame, str]], write: Callable[[], DataStreamWriter], checkpoint: str) -> None:
    """Appends each source's rows slice by slice (column `_slice`) to its folder, and runs
    the stream from its checkpoint after each."""
    spark = parts[0][0].sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        for i in range(SLICES):
            for rows, path in parts:
                rows.where(F.col("_slice") == i).drop("_slice").write.mode("append").json(path)
            write().option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _result(rows: DataFrame, schema: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What `build` yields over the stream of `rows`, as a table."""
    spark, path = rows.sparkSession, folder(rows.sparkSession, name)
    rows.limit(0).drop("_slice").write.json(f"{path}/in")
    out = build(spark.readStream.schema(schema).json(f"{path}/in"))
    _replayed([(rows, f"{path}/in")], lambda: out.writeStream.format("parquet").option("path", f"{path}/rows"), f"{path}/state")
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose generation rises each week, with a tenth that began before the rise."""
    rows = views.frames(spark, sf_dir)
    week = F.expr("unix_micros(ts) div 604800000000")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("generation", week - F.when(F.col("frame_id") % 10 == 0, 1).otherwise(0))
    return rows.select("camera", "generation", "frame_id", "ts", F.col("lines").cast("int").alias("lines"), "m1", "m2", "m3", "m4").withColumn("_slice", _slice("ts", _cuts(rows, "ts")))


_LIVE = """live AS (SELECT camera, epoch_us(ts) // 604800000000 - (frame_id % 10 = 0)::INT AS generation, frame_id, ts, lines FROM frames),
seen AS (SELECT *, max(generation) OVER (PARTITION BY camera ORDER BY ts, frame_id) AS newest, max(generation) OVER (PARTITION BY camera ORDER BY ts, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM live)"""


@query("frames", sql=f"""SELECT {_NTH} AS batch, camera, arg_max(frame_id, (generation, frame_id)) AS frame_id, max(generation) AS generation
FROM (SELECT camera, epoch_us(ts) // 604800000000 - (frame_id % 10 = 0)::INT AS generation, frame_id, ts FROM frames), {_SLICE} GROUP BY ALL""")
def st2_latest_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest frame of each camera in each micro-batch; frames between are dropped."""
    path, rows = folder(spark, "latest"), _frames(spark, sf_dir)
    rows.limit(0).drop("_slice").write.json(f"{path}/in")
    stream = S.read_frames(spark, f"{path}/in", 1000)
    _replayed([(rows, f"{path}/in")], lambda: stream.writeStream.foreachBatch(S.latest_only(S.slot_sink(f"{path}/rows"))), f"{path}/state")
    return S.slots(spark, f"{path}/rows").select(F.col("batch").cast("int").alias("batch"), "camera", "frame_id", "generation")


_IDLE_MS = 7_200_000


@query("frames", sql=f"""WITH live AS (SELECT camera, epoch_us(ts) // 604800000000 - (frame_id % 10 = 0)::INT AS generation, frame_id, ts, lines,
  epoch_ms(ts) - coalesce(epoch_ms(lag(ts) OVER (PARTITION BY camera ORDER BY ts, frame_id)), 0) > {_IDLE_MS} AS idle FROM frames),
spans AS (SELECT *, sum(idle::INT) OVER (PARTITION BY camera ORDER BY ts, frame_id) AS span FROM live),
seen AS (SELECT *, max(generation) OVER (PARTITION BY camera, span ORDER BY ts, frame_id) AS newest FROM spans),
first AS (SELECT camera, span, generation, min((ts, frame_id)) AS top FROM seen WHERE generation = newest AND lines >= 2 GROUP BY ALL)
SELECT s.frame_id, CASE WHEN s.generation < newest THEN 'stale' WHEN top IS NULL OR (s.ts, s.frame_id) < top THEN 'clear' WHEN (s.ts, s.frame_id) = top THEN 'lock' ELSE 'locked' END AS action,
  CASE WHEN s.generation = newest AND (s.ts, s.frame_id) >= top THEN top[2] END AS locked_frame
FROM seen s LEFT JOIN first f ON f.camera = s.camera AND f.span = s.span AND f.generation = s.generation""")
def st3_lock_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's action, with the first good frame of a generation locked; cameras start
    over after two idle hours."""
    found = _result(_frames(spark, sf_dir), S.FRAME_SCHEMA, lambda f: S.lock_machine(f, idle_ms=_IDLE_MS), "locks")
    return found.select("frame_id", "action", "locked_frame")


@query("frames", sql=f"WITH {_LIVE} SELECT camera, generation, frame_id, before IS NULL OR generation > before AS reset FROM seen WHERE generation = newest")
def st4_current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the newest generation so far; those that began before a reset are dropped."""
    found = _result(_frames(spark, sf_dir), S.FRAME_SCHEMA, lambda f: S.current_results(f.select("camera", "generation", "frame_id", "ts")), "results")
    return found.select("camera", "generation", "frame_id", "reset")


@query(sql="SELECT event_id AS request_id, CASE WHEN event_id % 3 <> 0 AND event_id % 40 < 31 THEN event_id % 4 END AS reply FROM events")
def st5_replies_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests joined, as streams, with the replies that came within 30 seconds; the others
    come out without one once the watermark has passed them. A last request and a last
    reply, a day after all others, move the watermark."""
    events = views.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    top, cuts = folder(spark, "replies"), _cuts(events, "ts")
    end = events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).where("ts IS NOT NULL")
    asked = events.select(F.col("event_id").alias("request_id"), F.col("ts").alias("sent")).unionByName(end.select(F.lit(-1).cast("long").alias("request_id"), F.col("ts").alias("sent")))
    late = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 40)
    told = events.where("event_id % 3 <> 0").select(F.col("event_id").alias("reply_to"), late.alias("received"), (F.col("event_id") % 4).alias("result"))
    told = told.unionByName(end.select(F.lit(-2).cast("long").alias("reply_to"), F.col("ts").alias("received"), F.lit(0).cast("long").alias("result")))
    # a reply comes in its request's slice, though it is a little later
    parts = [(asked.withColumn("_slice", _slice("sent", cuts)), f"{top}/asked"), (told.withColumn("_slice", _slice(F.col("received") - F.make_dt_interval(secs=F.when(F.col("reply_to") >= 0, F.col("reply_to") % 40).otherwise(0)), cuts)), f"{top}/told")]
    for rows, path in parts:
        rows.limit(0).drop("_slice").write.json(path)
    requests = spark.readStream.schema("request_id long, sent timestamp").json(f"{top}/asked")
    replies = spark.readStream.schema("reply_to long, received timestamp, result long").json(f"{top}/told")
    out = S.matched_replies(requests, replies)
    _replayed(parts, lambda: out.writeStream.format("parquet").option("path", f"{top}/rows"), f"{top}/state")
    return spark.read.schema(out.schema).parquet(f"{top}/rows").where("request_id >= 0").select("request_id", F.col("result").alias("reply"))


@query(sql="""WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, i, event_id, times, ok) AS (
  SELECT DISTINCT user_id, 0::BIGINT, -1::BIGINT, []::BIGINT[], FALSE FROM n
  UNION ALL SELECT user_id, i, event_id, CASE WHEN len(kept) < 3 THEN list_append(kept, tick) ELSE kept END, len(kept) < 3
  FROM (SELECT n.user_id, n.i, n.event_id, n.tick, [t FOR t IN f.times IF t > n.tick - 172800000000] AS kept FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1))
SELECT user_id AS client, event_id AS request_id, ok AS admitted FROM f WHERE i > 0""")
def st6_admission_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three admitted requests of a client in any two days."""
    events = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = events.withColumn("_slice", _slice("ts", _cuts(events, "ts")))
    found = _result(rows, "client long, request_id long, ts timestamp", lambda r: logs.rate_limited(r, 3, 172_800), "limits")
    return found.select("client", "request_id", "admitted")


_TTL_HOURS = 60


@query(sql=f"""WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_ms(ts) AS tick, event_id % 4 * 10 AS start, CASE WHEN event_id % 11 = 0 THEN 50 ELSE 10 END AS length,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, i, event_id, tick, received, done, status, lost) AS (
  SELECT DISTINCT user_id, 0::BIGINT, -1::BIGINT, NULL::BIGINT, 0::BIGINT, FALSE, '', NULL::BIGINT FROM n
  UNION ALL SELECT user_id, i, event_id, tick, CASE WHEN status IN ('accepted', 'complete') THEN was + 10 ELSE was END, was_done OR status = 'complete', status, lost
  FROM (SELECT *, CASE WHEN was_done OR start <> was THEN 'conflict' WHEN start + length > 40 THEN 'overflow' WHEN was + length = 40 THEN 'complete' ELSE 'accepted' END AS status
    FROM (SELECT n.*, CASE WHEN n.tick > f.tick + {_TTL_HOURS * 3_600_000} THEN 0 ELSE f.received END AS was, CASE WHEN n.tick > f.tick + {_TTL_HOURS * 3_600_000} THEN FALSE ELSE f.done END AS was_done,
      CASE WHEN n.tick > f.tick + {_TTL_HOURS * 3_600_000} AND NOT f.done THEN f.received END AS lost FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)))
SELECT user_id::VARCHAR AS upload_id, event_id AS seq, status, received FROM f WHERE i > 0
UNION ALL SELECT user_id::VARCHAR, -1, 'expired', lost FROM f WHERE lost IS NOT NULL
UNION ALL SELECT user_id::VARCHAR, -1, 'expired', received FROM (SELECT *, max(i) OVER (PARTITION BY user_id) AS last FROM f) WHERE i = last AND NOT done AND i > 0""")
def st7_chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of four chunks, by the user's events; what stays open expires. A last upload, a
    month after all others, moves the watermark past them."""
    events = views.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    cuts = _cuts(events, "ts")
    length = F.when(F.col("event_id") % 11 == 0, 50).otherwise(10).cast("long")
    rows = events.select(F.col("user_id").cast("string").alias("upload_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 * 10).alias("offset"), length.alias("length"), F.lit(40).cast("long").alias("total"), "ts")
    zero = F.lit(0).cast("long")
    last = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).where("ts IS NOT NULL").select(F.lit("end").alias("upload_id"), *[zero.alias(c) for c in ("seq", "offset", "length", "total")], "ts")
    rows = rows.unionByName(last).withColumn("_slice", _slice("ts", cuts))
    found = _result(rows, "upload_id string, seq long, offset long, length long, total long, ts timestamp", lambda c: logs.assembled_chunks(c, _TTL_HOURS * 3_600_000), "uploads")
    return found.where("upload_id <> 'end'")


@query("annotations", sql="SELECT image_id, arg_max(status, event_id) AS status, arg_max(note, event_id) AS note FROM annotations GROUP BY image_id")
def st10_streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after all batches, each of which rewrote the buckets it touched."""
    log = views.annotations(spark, sf_dir)
    path, schema = folder(spark, "statuses"), "image_id long, event_id long, status string, note string"
    rows = log.withColumn("_slice", _slice(F.col("ts").cast("timestamp"), _cuts(log.withColumn("ts", F.col("ts").cast("timestamp")), "ts"))).select("image_id", "event_id", "status", "note", "_slice")
    rows.limit(0).drop("_slice").write.json(f"{path}/in")
    stream = spark.readStream.schema(schema).json(f"{path}/in")
    table = logs.BucketedTable(spark, f"{path}/table", schema, "image_id", "event_id", 16)
    _replayed([(rows, f"{path}/in")], lambda: stream.writeStream.foreachBatch(logs.status_upserts(table)), f"{path}/state")
    return table.read().select("image_id", "status", "note")
