"""Streaming jobs over file sources, run to the end of what is available."""

import datetime
import json

from pyspark.sql import functions as F

from rasterloom.streaming import frames as S
from rasterloom.streaming import logs as L

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def feed(path, batches):
    path.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        (path / f"{i:03d}.json").write_text("\n".join(json.dumps({k: (T0 + datetime.timedelta(seconds=v)).isoformat() if k in ("ts", "sent", "received") else v for k, v in r.items()}) for r in rows))
        import os

        os.utime(path / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def frame(i, at, lines=3, generation=0, m=0.5):
    return {"camera": 1, "generation": generation, "frame_id": i, "ts": at, "lines": lines, "m1": m, "m2": m, "m3": m, "m4": m}


def test_latest_slot_drops_frames_between(spark, tmp_path):
    path, seen = feed(tmp_path / "f", [[frame(1, 0), frame(2, 1)], [frame(5, 2), frame(4, 3)]]), []
    q = S.read_frames(spark, path).writeStream.foreachBatch(S.latest_only(lambda df, _: seen.append(df.first().frame_id))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [2, 5]


def test_lock_on_first_good_frame_and_generations(spark, tmp_path):
    path = feed(tmp_path / "f", [[frame(1, 0, lines=1), frame(2, 1)], [frame(3, 2), frame(4, 3, generation=1, lines=1)], [frame(5, 4), frame(6, 5, generation=1)]])
    got = {r.frame_id: (r.action, r.locked_frame) for r in run(S.lock_machine(S.read_frames(spark, path)), "lock1", tmp_path)}
    assert got == {1: ("clear", None), 2: ("lock", 2), 3: ("locked", 2), 4: ("clear", None), 5: ("stale", None), 6: ("lock", 6)}


def test_lock_needs_stable_seconds(spark, tmp_path):
    path = feed(tmp_path / "f", [[frame(i, i) for i in range(8)]])
    got = {r.frame_id: r.action for r in run(S.lock_machine(S.read_frames(spark, path), lock_on_first=False), "lock2", tmp_path)}
    assert [got[i] for i in range(8)] == ["wait"] * 5 + ["lock", "locked", "locked"]


def test_replies_in_time(spark, tmp_path):
    asked = feed(tmp_path / "a", [[{"request_id": 1, "sent": 0}, {"request_id": 2, "sent": 1}], [{"request_id": 3, "sent": 500}], [{"request_id": 4, "sent": 900}]])
    told = feed(tmp_path / "b", [[{"reply_to": 1, "received": 5, "result": "ok"}, {"reply_to": 2, "received": 90, "result": "late"}], [{"reply_to": 3, "received": 501, "result": "ok"}], [{"reply_to": 9, "received": 900, "result": "x"}]])
    out = S.matched_replies(stream(spark, asked, "request_id long, sent timestamp"), stream(spark, told, "reply_to long, received timestamp, result string"))
    got = {r.request_id: r.result for r in run(out, "replies", tmp_path)}
    assert got[1] == "ok" and got[2] is None and got[3] == "ok"


def test_rate_limit(spark, tmp_path):
    rows = [{"client": "c", "request_id": i, "ts": at} for i, at in enumerate([0, 1, 2, 3, 61, 62, 62.5])]
    out = L.rate_limited(stream(spark, feed(tmp_path / "r", [rows[:4], rows[4:]]), "client string, request_id long, ts timestamp"), most=2)
    got = {r.request_id: r.admitted for r in run(out, "rate", tmp_path)}
    assert [got[i] for i in range(7)] == [True, True, False, False, True, True, False]


def test_chunks(spark, tmp_path):
    c = lambda seq, offset, length, at: {"upload_id": "u", "seq": seq, "offset": offset, "length": length, "total": 10, "ts": at}
    rows = [[c(0, 0, 4, 0), c(1, 5, 2, 1)], [c(2, 4, 9, 2), c(3, 4, 6, 3)], [c(4, 0, 1, 4)]]
    out = L.assembled_chunks(stream(spark, feed(tmp_path / "c", rows), "upload_id string, seq long, offset long, length long, total long, ts timestamp"))
    got = {r.seq: (r.status, r.received) for r in run(out, "chunks", tmp_path)}
    assert got == {0: ("accepted", 4), 1: ("conflict", 4), 2: ("overflow", 4), 3: ("complete", 10), 4: ("conflict", 10)}


def test_revisions(spark, tmp_path):
    rows = [[{"image_id": 1, "seq": 1, "base": 0, "status": "a"}, {"image_id": 1, "seq": 2, "base": 0, "status": "b"}], [{"image_id": 1, "seq": 3, "base": 1, "status": "c"}]]
    got = run(L.revision_log(stream(spark, feed(tmp_path / "e", rows), "image_id long, seq long, base long, status string")), "revisions", tmp_path)
    assert sorted((r.seq, r.accepted, r.current) for r in got) == [(1, True, 1), (2, False, 1), (3, True, 2)]


def test_dedupe_and_upserts(spark, tmp_path):
    rows = [[{"sha256": "x", "ts": 0}, {"sha256": "y", "ts": 1}], [{"sha256": "x", "ts": 2}]]
    got = run(L.first_seen(stream(spark, feed(tmp_path / "d", rows), "sha256 string, ts timestamp")), "first", tmp_path)
    assert sorted(r.sha256 for r in got) == ["x", "y"]
    events = [[{"review_id": "r1", "status": "approved", "notes": "n", "seq": 1}], [{"review_id": "r1", "status": "rejected", "notes": "m", "seq": 3}, {"review_id": "r2", "status": "pending", "notes": "", "seq": 2}]]
    src = stream(spark, feed(tmp_path / "s", events), "review_id string, status string, notes string, seq long")
    table = L.BucketedTable(spark, str(tmp_path / "table"), "review_id string, status string, notes string, seq long", "review_id", "seq")
    src.writeStream.foreachBatch(L.status_upserts(table)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.review_id, r.status) for r in table.read().collect()) == [("r1", "rejected"), ("r2", "pending")]


def test_a_merge_rewrites_its_buckets_only_and_can_run_again(spark, tmp_path):
    table = L.BucketedTable(spark, str(tmp_path / "t"), "k long, v string, seq long", "k", "seq", 8)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string, seq long")
    assert table.read().count() == 0
    table.merge(rows(*[(i, "a", i) for i in range(200)]), 0)
    first = table.manifest()
    assert len(first) == 8 and table.read().count() == 200
    for _ in range(2):  # the second run is the same batch again
        table.merge(rows((3, "b", 1000), (3, "old", 5), (7, "late", 1)), 1)
        changed = {b for b, v in table.manifest().items() if v == 1}
        assert 1 <= len(changed) <= 2 and all(v == 0 for b, v in table.manifest().items() if b not in changed)
        got = {r.k: r.v for r in table.read().collect()}
        assert len(got) == 200 and got[3] == "b" and got[7] == "a"
    assert {p.name for p in (tmp_path / "t").glob("bucket=*/version=1")} == {"version=1"} and len(list((tmp_path / "t").glob("bucket=*/version=1"))) == len(changed)
    table.merge(rows(), 2)
    assert table.read().count() == 200


def test_a_batch_that_runs_again_leaves_the_slots_as_they_were(spark, tmp_path):
    sink = S.latest_only(S.slot_sink(str(tmp_path / "slots")))
    rows = spark.createDataFrame([(1, 0, 5, 0.5), (1, 1, 2, 0.25), (2, 0, 9, 0.0)], "camera long, generation long, frame_id long, m1 double")
    for batch in (0, 0, 1):
        sink(rows, batch)
    got = sorted((r.batch, r.camera, r.frame_id) for r in S.slots(spark, str(tmp_path / "slots")).collect())
    assert got == [(0, 1, 2), (0, 2, 9), (1, 1, 2), (1, 2, 9)]


def test_an_idle_camera_starts_over(spark, tmp_path):
    far = S.IDLE_MS // 1000 * 3
    path = feed(tmp_path / "f", [[frame(1, 0)], [frame(2, far) | {"camera": 2}], [frame(3, far + 1, lines=1)]])
    got = {r.frame_id: r.action for r in run(S.lock_machine(S.read_frames(spark, path)), "idle", tmp_path)}
    assert got == {1: "lock", 2: "lock", 3: "clear"}  # without the timer, frame 3 would be locked


def test_results_from_before_a_reset_are_dropped(spark, tmp_path):
    path = feed(tmp_path / "f", [[frame(1, 0), frame(2, 1, generation=2)], [frame(3, 2, generation=1), frame(4, 3, generation=2)], [frame(5, 4, generation=3), frame(6, 5)]])
    got = {r.frame_id: r.reset for r in run(S.current_results(S.read_frames(spark, path)), "current", tmp_path)}
    assert got == {1: True, 2: True, 4: False, 5: True}


def test_uploads_expire(spark, tmp_path):
    c = lambda u, seq, offset, at: {"upload_id": u, "seq": seq, "offset": offset, "length": 5, "total": 10, "ts": at}
    hour = 3600
    rows = [[c("a", 0, 0, 0), c("b", 1, 0, 1), c("b", 2, 5, 2)], [c("c", 3, 0, 7 * hour)], [c("a", 4, 5, 8 * hour), c("c", 5, 5, 13 * hour)], [c("d", 6, 0, 30 * hour)]]
    out = L.assembled_chunks(stream(spark, feed(tmp_path / "c", rows), "upload_id string, seq long, offset long, length long, total long, ts timestamp"))
    got = sorted((r.upload_id, r.seq, r.status, r.received) for r in run(out, "expiry", tmp_path))
    # a expires before its second chunk, which then is out of place, and once more; b is complete
    assert got == [("a", -1, "expired", 0), ("a", -1, "expired", 5), ("a", 0, "accepted", 5), ("a", 4, "conflict", 0), ("b", 1, "accepted", 5), ("b", 2, "complete", 10), ("c", 3, "accepted", 5), ("c", 5, "complete", 10), ("d", 6, "accepted", 5)]


def test_a_silent_client_keeps_no_state(spark, tmp_path):
    rows = [[{"client": 1, "request_id": 0, "ts": 0}], [{"client": 2, "request_id": 1, "ts": 5000}], [{"client": 3, "request_id": 2, "ts": 9000}]]
    out = L.rate_limited(stream(spark, feed(tmp_path / "r", rows), "client long, request_id long, ts timestamp"), most=1)
    assert all(r.admitted for r in run(out, "silent", tmp_path))
    state = spark.read.format("statestore").option("stateVarName", "timer").load(str(tmp_path / "silent"))
    assert {r[0] for r in state.select("key.client").collect()} == {3}
