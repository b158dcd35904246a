"""Structured Streaming runs over the event table, drained to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.plans.registry import query
from sightline.sources import tables as t
from sightline.streaming import arrivals, runtime, tracker


#: How far events may be out of order between micro-batches; rows later than that are an error.
DELAY = "2 days"


def event_stream(spark, sf):
    e = runtime.table_stream(spark, sf, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), t.micros("ts").alias("ts_us"),
        "user_id", "event_type", "value",
    )


@query("stream_recorder", f"WITH {t.ARRIVALS_SQL} SELECT topic, count(*) AS n_rows, count(DISTINCT stamp_ns) AS n_stamps FROM arr GROUP BY topic")
def stream_recorder(spark, sf):
    """Arrival log written by a stream, then counted."""
    s = event_stream(spark, sf).select(
        F.col("event_type").alias("topic"), (F.col("user_id") * 100000 + t.day_of("ts_us")).alias("stamp_ns"),
        F.col("ts_us").alias("recv_us"), F.col("event_id").alias("seq"),
    )
    log = runtime.drain(s, "arrival-log")
    return log.groupBy("topic").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("stamp_ns").alias("n_stamps"))


@query("stream_first_arrivals", f"WITH {t.ARRIVALS_SQL} SELECT DISTINCT topic, stamp_ns FROM arr")
def stream_first_arrivals(spark, sf):
    s = event_stream(spark, sf).select(
        "event_time", F.col("event_type").alias("topic"), (F.col("user_id") * 100000 + t.day_of("ts_us")).alias("stamp_ns")
    )
    return runtime.drain(arrivals.first_arrivals(s, "2 days"), "first-arrivals").select("topic", "stamp_ns")


@query("stream_pairs", """SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id
  AND a.event_type = 'error' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTES AND a.ts + INTERVAL 30 MINUTES""")
def stream_pairs(spark, sf):
    """Interval join of two streams."""
    a = event_stream(spark, sf).where("event_type = 'error'").select("event_time", "user_id", F.col("event_id").alias("a_id"))
    b = event_stream(spark, sf).where("event_type = 'click'").select("event_time", "user_id", F.col("event_id").alias("b_id"))
    j = arrivals.stamp_pairs(a, b, ["user_id"], "30 MINUTES", "1 hour")
    return runtime.drain(j.select(F.col("a.user_id").alias("user_id"), "a_id", "b_id"), "stream-pairs")


@query("stream_pose_lookup", """SELECT e.event_id, e.user_id AS sequence, epoch_us(e.ts) AS stamp_us, epoch_us(c.ts) AS pose_us, c.value AS pose_value
FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON e.user_id = c.user_id AND e.ts >= c.ts""")
def stream_pose_lookup(spark, sf):
    """The latest click at or before every error of a user, whatever files and batches they come in."""
    return pose_lookup_of(event_stream(spark, sf))


def pose_lookup_of(events):
    held, ending = runtime.watermarked(events.where("event_type IN ('error', 'click')"), "event_time", DELAY)
    s = held.select(
        F.col("user_id").alias("sequence"), F.col("ts_us").alias("stamp_us"), "event_id",
        (F.col("event_type") == "click").alias("is_pose"), "value", "event_time",
    )
    return runtime.drain_to_end(arrivals.pose_lookup(s), ending, "event_time", "pose-lookup")


@query("stream_latch", """SELECT c.user_id AS sequence, epoch_us(c.ts) AS stamp_us, c.event_id, s.latched
FROM events c JOIN (SELECT user_id, arg_min(value, (ts, event_id)) AS latched FROM events WHERE event_type = 'signup' GROUP BY user_id) s
  ON c.user_id = s.user_id AND c.event_type = 'click'""")
def stream_latch(spark, sf):
    """Clicks with the value of the first signup of their user; clicks before it are held until it comes."""
    return latch_of(event_stream(spark, sf))


def latch_of(events):
    held, ending = runtime.watermarked(events.where("event_type IN ('signup', 'click')"), "event_time", DELAY)
    s = held.select(
        F.col("user_id").alias("sequence"), F.col("ts_us").alias("stamp_us"), "event_id",
        (F.col("event_type") == "signup").alias("is_value"), "value", "event_time",
    )
    return runtime.drain_to_end(arrivals.first_value_latch(s), ending, "event_time", "latch")


SLOP_US = 6 * 3600 * 1_000_000


# Message by message: the queues of a user are lists, the nearest waiting message is the partner.
@query("stream_sync", f"""WITH RECURSIVE ms AS (SELECT user_id AS s, epoch_us(ts) AS t, event_id AS id, event_type = 'click' AS b,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'click', event_id) AS k FROM events WHERE event_type IN ('error', 'click')),
rc AS (SELECT DISTINCT s, 0::BIGINT AS k, []::STRUCT(t BIGINT, id BIGINT)[] AS qa, []::STRUCT(t BIGINT, id BIGINT)[] AS qb,
    NULL::BIGINT AS a_id, NULL::BIGINT AS b_id, NULL::BIGINT AS apart_us FROM ms
  UNION ALL
  SELECT s, k, CASE WHEN b THEN left_ ELSE kept END, CASE WHEN b THEN kept ELSE left_ END,
    CASE WHEN best IS NOT NULL THEN CASE WHEN b THEN best.id ELSE id END END, CASE WHEN best IS NOT NULL THEN CASE WHEN b THEN id ELSE best.id END END, best.d
  FROM (SELECT *, CASE WHEN best IS NULL THEN list_append(own, {{'t': t, 'id': id}}) ELSE own END AS kept,
      CASE WHEN best IS NULL THEN others ELSE list_filter(others, lambda x: x.id <> best.id) END AS left_
    FROM (SELECT *, list_min(list_transform(list_filter(others, lambda x: abs(x.t - t) <= {SLOP_US}), lambda x: {{'d': abs(x.t - t), 't': x.t, 'id': x.id}})) AS best
      FROM (SELECT m.s, m.k, m.t, m.id, m.b, CASE WHEN len(mine) > 1 THEN mine[len(mine):len(mine)] ELSE mine END AS own, others
        FROM (SELECT m.s, m.k, m.t, m.id, m.b, CASE WHEN m.b THEN rc.qb ELSE rc.qa END AS mine, CASE WHEN m.b THEN rc.qa ELSE rc.qb END AS others
          FROM rc JOIN ms m ON m.s = rc.s AND m.k = rc.k + 1) m))))
SELECT s AS sequence, a_id, b_id, apart_us FROM rc WHERE a_id IS NOT NULL""")
def stream_sync(spark, sf):
    """Errors and clicks of a user within six hours paired one to one by a synchroniser with queues of two."""
    return synchronised_of(event_stream(spark, sf))


def synchronised_of(events):
    held, ending = runtime.watermarked(events.where("event_type IN ('error', 'click')"), "event_time", DELAY)
    s = held.select(
        F.col("user_id").alias("sequence"), F.col("ts_us").alias("stamp_us"), "event_id",
        (F.col("event_type") == "click").alias("is_second"), "event_time",
    )
    return runtime.drain_to_end(arrivals.synchronised(s, SLOP_US), ending, "event_time", "synchronised")


def detections(events):
    """Detections of a stream of events: sequence = user, frame = six hours, lane = event."""
    frame = F.floor(F.col("ts_us") / (6 * 3600 * 1_000_000)).cast("long")
    start = F.pmod(F.col("user_id") * 7 + F.floor(F.col("value") / 40), F.lit(300)).cast("long")
    size = (F.lit(15) + F.floor(F.col("value") / 10)).cast("long")
    return events.select(
        F.col("user_id").alias("sequence"),
        frame.alias("frame"),
        F.col("event_id").alias("lane"),
        size.alias("area"),
        F.floor("value").cast("long").alias("n_points"),
        (F.col("user_id") * 0.01 + F.floor(F.col("value") / 100) * 0.2).alias("x"),
        F.lit(0.0).alias("y"),
        F.lit(1.0).alias("z"),
        F.sequence(start, start + size - 1).alias("cells"),
        (F.pmod(frame, F.lit(7)) / 10.0).alias("novelty"),
        F.lit(0.5).alias("valid_frac"),
        ((frame + 1) * (6 * 3600 * 1_000_000)).alias("end_us"),
        "event_time",
    )


def tracked_of(events, name, only_emitted=False):
    """Tracked detections of an event stream, or just those of its keyframes."""
    held, ending = runtime.watermarked(events, "event_time", DELAY)
    rows = tracker.track(detections(held))
    return runtime.drain_to_end(tracker.emitted(rows) if only_emitted else rows, ending, "event_time", name)


@query("stream_tracker")
def stream_tracker(spark, sf):
    """Tracker and keyframe gate over all events."""
    return tracked_of(event_stream(spark, sf), "tracker")


@query("stream_emissions")
def stream_emissions(spark, sf):
    """Keyframe emissions per reason."""
    rows = tracked_of(event_stream(spark, sf), "emissions", only_emitted=True)
    return rows.groupBy("keyframe").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("encode").alias("n_encoded"))


@query("stream_drops", "SELECT 0::BIGINT AS n_dropped, count(*) AS n_sent FROM events")
def stream_drops(spark, sf):
    """Source rows that did not reach the sink."""
    got = runtime.drain(event_stream(spark, sf).select("event_id"), "sink")
    sent = t.table(spark, sf, "events").select("event_id")
    lost = runtime.dropped(sent, got, ["event_id"]).agg(F.count(F.lit(1)).alias("n_dropped")).withColumn("_k", F.lit(0))
    total = sent.agg(F.count(F.lit(1)).alias("n_sent")).withColumn("_k", F.lit(0))
    return lost.join(total, "_k").drop("_k")


@query("stream_episodes", """WITH e AS (SELECT user_id, ts, epoch_us(ts) // 86400000000 AS frame, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
n AS (SELECT *, sum((p IS NULL OR ts - p >= INTERVAL 2 DAYS)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e)
SELECT user_id, min(frame) AS first_frame, max(frame) AS last_frame, least(max(frame) + 2, (SELECT max(frame) FROM e)) AS emit_frame, count(*) AS n_rows FROM n GROUP BY user_id, s""")
def stream_episodes(spark, sf):
    """Episodes closed by the watermark, then those the end of the data closes."""
    rows = lambda df: df.select("event_time", "user_id", t.day_of("ts_us").alias("frame"))
    closed = runtime.drain(arrivals.session_episodes(rows(event_stream(spark, sf)), ["user_id"], 1, 86400, "1 day"), "episodes")
    seen = t.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("event_time"), t.micros("ts").alias("ts_us"), "user_id")
    return closed.unionByName(arrivals.flushed_episodes(rows(seen), closed, ["user_id"], 1, 86400))
