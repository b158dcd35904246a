from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators.assignment import greedy_pairs
from sightline.plans import streams
from sightline.sources import tables as t
from sightline.streaming import arrivals, runtime, tracker

SCHEMA = tracker.INPUT


def det(lane, x, cells, n=50):
    return {"lane": lane, "area": len(cells), "placed": n > 10, "pos": [x, 0.0, 0.0], "cells": set(cells), "weight": 1 / (1 + np.exp(-(len(cells) - tracker.AREA_ANCHOR) / tracker.AREA_SCALE))}


def test_birth_match_retire_and_revival():
    s = tracker.fresh()
    rows, reason, _ = tracker.step(s, [det(0, 0.0, range(20)), det(1, 5.0, range(100, 120))], (0.0, 0.5))
    assert reason == "init" and [r["tid"] for r in rows] == [0, 1] and all(r["encode"] for r in rows)
    rows, reason, _ = tracker.step(s, [det(0, 0.1, range(2, 22))], (0.0, 0.5))
    assert reason == "" and rows[0]["tid"] == 0 and not rows[0]["new"]
    for _ in range(5):
        tracker.step(s, [], (0.0, 0.5))
    assert [k["tid"] for k in s["tracks"] if k["alive"]] == [0]
    rows, _, revived = tracker.step(s, [det(0, 5.05, range(100, 120))], (0.0, 0.5))
    assert rows[0]["new"] and rows[0]["tid"] == 2 and revived == 1  # retired tracks never match again


def test_far_detection_is_vetoed_and_unplaced_needs_overlap():
    s = tracker.fresh()
    tracker.step(s, [det(0, 0.0, range(20))], (0.0, 0.5))
    rows, _, _ = tracker.step(s, [det(0, 1.0, range(20))], (0.0, 0.5))
    assert rows[0]["new"]
    t = tracker.fresh()
    tracker.step(t, [det(0, 0.0, range(20), n=3)], (0.0, 0.5))
    assert not tracker.step(t, [det(0, 9.0, range(10, 30))], (0.0, 0.5))[0][0]["new"]
    assert tracker.step(t, [det(0, 9.0, range(500, 520), n=3)], (0.0, 0.5))[0][0]["new"]


def test_keyframe_gate_uses_previous_novelty_and_minimum_gap():
    s, got = tracker.fresh(), []
    for f in range(14):
        got.append(tracker.step(s, [det(0, 0.0, range(20))], (0.5 if f == 2 else 0.0, 0.5))[1])
    assert got[0] == "init" and not any(got[1:])  # novelty of frame 2 is seen at frame 3, too early
    s, got = tracker.fresh(), []
    for f in range(14):
        got.append(tracker.step(s, [det(0, 0.0, range(20))], (0.5 if f == 6 else 0.0, 0.5))[1])
    assert [i for i, r in enumerate(got) if r] == [0, 7] and got[7] == "cov"


def test_birth_keyframe_encodes_only_new_tracks():
    s, seen = tracker.fresh(), []
    for f in range(16):
        dets = [det(0, 0.0, range(20))] + ([det(1, 3.0, range(50, 70))] if f >= 2 else [])
        rows, reason, _ = tracker.step(s, dets, (0.0, 0.5))
        seen.append((reason, [r["tid"] for r in rows if r["encode"]]))
    fired = [(i, r, t) for i, (r, t) in enumerate(seen) if r]
    assert fired[0] == (0, "init", [0])
    assert fired[1][1:] == ("birth", [1])


def frames(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for q in (1, 2):
        for f in range(n):
            for lane in range(rng.integers(1, 4)):
                c = int(rng.integers(0, 3)) * 40 + f % 5
                rows.append((q, f, lane, 20, 50, float(c) / 200, 0.0, 1.0, list(range(c, c + 20)), float(f % 7) / 10, 0.5))
    return rows


def timed(df):
    """One frame a minute; rows of a frame come at its start and later."""
    at = F.col("frame") * 60_000_000 + 86_400_000_000
    seen = F.timestamp_micros(at + F.coalesce(F.col("lane"), F.lit(0)) * 1_000_000)
    return df.withColumns({"end_us": at + 60_000_000, "event_time": seen})


def tracked(spark, path, schema, files=None, delay="1 hour"):
    stream, ending = runtime.watermarked(runtime.folder_stream(spark, str(path), schema, max_files=files), "event_time", delay)
    return runtime.drain_to_end(tracker.track(stream), ending, "event_time", "tracked")


def plain_tracks(rows):
    """Every sequence run frame by frame."""
    out = []
    for q in sorted({r[0] for r in rows}):
        s = tracker.fresh()
        for f in sorted({r[1] for r in rows if r[0] == q}):
            part = sorted((r for r in rows if r[:2] == (q, f)), key=lambda r: r[2])
            dets = [det(r[2], r[5], r[8]) | {"area": r[3], "pos": list(r[5:8]), "weight": 1 / (1 + np.exp(-(r[3] - tracker.AREA_ANCHOR) / tracker.AREA_SCALE))} for r in part]
            got, reason, revived = tracker.step(s, dets, part[0][9:11])
            alive = sum(k["alive"] for k in s["tracks"])
            out += [(q, f, r["lane"], r["tid"], r["new"], reason, r["encode"], alive, revived) for r in got]
    return sorted(out)


def test_tracks_do_not_depend_on_files_their_order_or_batches(spark, tmp_path):
    """A file a trigger, in any order, with frames split over files, gives the tracks of a plain loop."""
    rows = frames(30)
    want = plain_tracks(rows)
    df = timed(spark.createDataFrame(rows, SCHEMA))
    parts = {
        "ordered": [F.col("frame").between(10 * i, 10 * i + 9) for i in range(3)],
        "split": [F.col("lane") == 2, F.col("lane") == 0, F.col("lane") == 1],
        "shuffled": [F.pmod(F.xxhash64("sequence", "frame", "lane"), F.lit(4)) == i for i in (2, 0, 3, 1)],
    }
    for name, tests in parts.items():
        for test in tests:
            df.where(test).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        for files in (None, 1):
            got = tracked(spark, tmp_path / name, df.schema, files)
            assert sorted(map(tuple, got.collect())) == want, (name, files)


def test_rows_later_than_the_delay_are_an_error(spark, tmp_path):
    df = timed(spark.createDataFrame(frames(60), SCHEMA))
    for test in ("frame >= 30", "frame < 2", "frame BETWEEN 2 AND 29"):
        df.where(test).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(RuntimeError, match="later than the delay"):
        tracked(spark, tmp_path / "in", df.schema, 1, "1 minute")


def events_in_files(spark, folder, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(parts):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(str(folder))
    schema = events.schema
    stream = runtime.folder_stream(spark, str(folder), schema, max_files=1)
    return stream.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), t.micros("ts").alias("ts_us"), "user_id", "event_type", "value"
    )


@pytest.mark.parametrize("name", ["pose", "latch", "tracker", "sync"])
def test_stream_queries_give_the_same_rows_over_many_batches(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(streams, "DELAY", "60 days")
    of = {"pose": streams.pose_lookup_of, "latch": streams.latch_of, "tracker": lambda e: streams.tracked_of(e, "t"), "sync": streams.synchronised_of}[name]
    one = of(streams.event_stream(spark, "/root/testdata/sf0.001"))
    many = of(events_in_files(spark, tmp_path / "in", 4))
    assert one.count() > 20
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_latch_holds_rows_until_the_first_value(spark, tmp_path):
    schema = "sequence long, stamp_us long, event_id long, is_value boolean, value double, event_time timestamp"
    rows = [(1, 10, 1, False, None), (1, 50, 2, True, 7.0), (1, 60, 3, False, None), (1, 40, 4, True, 5.0), (2, 5, 5, False, None)]
    second = 1_000_000
    df = spark.createDataFrame([(q, s * second, e, v, x) for q, s, e, v, x in rows], schema.rsplit(",", 1)[0])
    df = df.withColumn("event_time", F.timestamp_micros("stamp_us"))
    for e in (3, 1, 2, 4, 5):
        df.where(f"event_id = {e}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, ending = runtime.watermarked(runtime.folder_stream(spark, str(tmp_path / "in"), df.schema, max_files=1), "event_time", "1 hour")
    got = runtime.drain_to_end(arrivals.first_value_latch(stream), ending, "event_time", "latch")
    assert sorted(map(tuple, got.collect())) == [(1, 10 * second, 1, 5.0), (1, 60 * second, 3, 5.0)]


def test_shared_cells_match_plain_counts():
    rng = np.random.default_rng(1)
    dets, tracks = ([{"cells": set(rng.integers(0, 60, 20).tolist())} for _ in range(n)] for n in (4, 3))
    got = tracker.shared_cells(dets, tracks)
    assert got.tolist() == [[len(d["cells"] & k["cells"]) for k in tracks] for d in dets]


def test_gate_table():
    assert tracker.gate_reason(False, True, True, False, False) == "init"
    assert tracker.gate_reason(True, True, True, True, False) == "cov"
    assert tracker.gate_reason(True, True, True, False, True) == ""
    assert tracker.gate_reason(True, False, True, True, True) == "birth"
    assert tracker.gate_reason(True, False, True, True, False) == "" == tracker.gate_reason(True, False, False, True, True)


def test_recorder_refuses_used_folder(spark, tmp_path):
    df = spark.createDataFrame(frames(2), SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    s = runtime.folder_stream(spark, str(tmp_path / "in"), df.schema)
    runtime.record(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    try:
        runtime.record(s, str(tmp_path / "out"), str(tmp_path / "cp2"))
        raise AssertionError("second recording must be refused")
    except FileExistsError:
        pass


def test_fan_out_writes_every_sink(spark, tmp_path):
    df = spark.createDataFrame(frames(3), SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    s = runtime.folder_stream(spark, str(tmp_path / "in"), df.schema)
    sinks = [runtime.folder_sink(str(tmp_path / n)) for n in ("a", "b")]
    runtime.fan_out(s, str(tmp_path / "cp"), sinks).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == df.count()


def test_synchroniser_pairs_one_to_one_from_short_queues(spark, tmp_path):
    """A burst of one kind pushes its oldest out; ties go to the earlier message; nothing is paired twice."""
    second = 1_000_000
    sent = [(10, 1, False), (11, 2, False), (12, 3, False), (13, 4, True), (14, 5, True), (15, 6, True), (30, 7, True), (32, 8, True), (31, 9, False)]
    schema = "sequence long, stamp_us long, event_id long, is_second boolean"
    df = spark.createDataFrame([(1, s * second, e, b) for s, e, b in sent], schema).withColumn("event_time", F.timestamp_micros("stamp_us"))
    for i in (2, 0, 1):
        df.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, ending = runtime.watermarked(runtime.folder_stream(spark, str(tmp_path / "in"), df.schema, max_files=1), "event_time", "1 hour")
    got = runtime.drain_to_end(arrivals.synchronised(stream, 5 * second), ending, "event_time", "sync")
    assert sorted((r.a_id, r.b_id, r.apart_us) for r in got.collect()) == [(2, 5, 3 * second), (3, 4, second), (9, 7, second)]


def test_few_pairs_score_like_many():
    """One by one or as arrays, a pair has the same score and the same partner."""
    rng = np.random.default_rng(4)

    def some(n):
        return [
            {"cells": set(rng.integers(0, 40, rng.integers(1, 30)).tolist()), "area": int(rng.integers(1, 600)), "weight": float(rng.random()),
             "pos": [float(rng.integers(0, 8)) / 10, 0.0, float("nan") if rng.random() < 0.1 else 1.0], "placed": bool(rng.random() < 0.7)}
            for _ in range(n)
        ]

    for _ in range(60):
        dets, tracks = some(int(rng.integers(1, 6))), some(int(rng.integers(0, 8)))
        want = tracker.pair_scores(dets, tracks)
        assert [[tracker.pair_score(d, k) for k in tracks] for d in dets] == want.tolist()
        assert tracker.matched(dets, tracks) == (dict(greedy_pairs(want, -0.5)) if want.size else {})


def test_held_rows_come_back_as_they_went(spark):
    """A held row is a line of text: nulls, line ends and numbers that are not finite survive; many rows are few elements."""
    row = (1, 2_000_001, None, True, float("nan"), datetime(2024, 1, 1))
    df = spark.createDataFrame([row, (1, 3, 7, False, -0.1, datetime(2024, 1, 1)), (1, 4, 8, False, float("-inf"), datetime(2024, 1, 1))],
                               "sequence long, stamp_us long, event_id long, is_pose boolean, value double, event_time timestamp")
    got = arrivals.waiting(df, F.col("stamp_us"), arrivals._PoseLookup.fields).collect()
    assert [r.due for r in got] == [2001, 1, 1]
    parsed = [arrivals._PoseLookup().parsed(r.payload) for r in got]
    assert parsed[0][:3] == (2_000_001, None, True) and np.isnan(parsed[0][3])
    assert parsed[1:] == [(3, 7, False, -0.1), (4, 8, False, float("-inf"))]
    assert len(arrivals._elements([(i, "{}") for i in range(2 * arrivals.HELD_ROWS + 1)])) == 3
