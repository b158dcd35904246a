"""Arrival logs, flow time, as-of joins, episodes and other time-keyed reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import ordered, temporal
from sightline.plans.registry import query
from sightline.sources import profiles
from sightline.sources import tables as t

FLOW_OUT, FLOW_IN = "error", ["click", "view"]

_FLOW_SQL = f"""WITH {t.ARRIVALS_SQL},
first_arr AS (SELECT topic, stamp_ns, arg_min(recv_us, seq) AS recv_us FROM arr GROUP BY ALL),
flow AS (SELECT o.stamp_ns, o.recv_us - greatest(a.recv_us, b.recv_us) AS flow_us
  FROM first_arr o JOIN first_arr a USING (stamp_ns) JOIN first_arr b USING (stamp_ns)
  WHERE o.topic = 'error' AND a.topic = 'click' AND b.topic = 'view')"""


@query("first_arrivals", f"""WITH {t.ARRIVALS_SQL}
SELECT topic, stamp_ns, arg_min(recv_us, seq) AS recv_us, min(seq) AS seq FROM arr GROUP BY topic, stamp_ns""")
def first_arrivals(spark, sf):
    return temporal.first_arrivals(t.arrivals(spark, sf))


@query("topic_counts", f"""WITH {t.ARRIVALS_SQL}
SELECT topic, count(*) AS n_arrivals, count(DISTINCT stamp_ns) AS n_stamps FROM arr GROUP BY topic""")
def topic_counts(spark, sf):
    return temporal.topic_counts(t.arrivals(spark, sf))


@query("flow_times", _FLOW_SQL + " SELECT stamp_ns, flow_us FROM flow")
def flow_times(spark, sf):
    return temporal.flow_times(t.arrivals(spark, sf), FLOW_OUT, FLOW_IN)


@query("flowtime_stats", _FLOW_SQL + """
SELECT count(*) AS n, sum(flow_us) / count(*) / 1e6 AS mean_s, max(flow_us) / 1e6 AS max_s,
       round(quantile_cont(flow_us, 0.5) / 1e6, 9) AS median_s, round(quantile_cont(flow_us, 0.9) / 1e6, 9) AS p90_s,
       round(quantile_cont(flow_us, 0.99) / 1e6, 9) AS p99_s
FROM flow""")
def flowtime_stats(spark, sf):
    return profiles.flow_report(t.arrivals(spark, sf), FLOW_OUT, FLOW_IN)


@query("run_drops", f"""WITH {t.ARRIVALS_SQL},
c AS (SELECT topic, count(*) AS n_raw, count(DISTINCT stamp_ns) AS n_stamps FROM arr GROUP BY topic),
played AS (SELECT max(n_stamps) AS n FROM c WHERE topic IN ('click', 'view'))
SELECT topic, n AS frames_played, n_raw AS sets_received, greatest(0, n - n_raw) AS dropped_raw,
       greatest(0, n - n_stamps) AS dropped_scored
FROM c, played""")
def run_drops(spark, sf):
    """Frames played is the largest distinct-stamp count of the input topics."""
    topics = Window.partitionBy(F.lit(0))  # one row per topic
    played = F.max(F.when(F.col("topic").isin(FLOW_IN), F.col("n_stamps"))).over(topics)
    zero = F.lit(0).cast("long")
    return temporal.topic_counts(t.arrivals(spark, sf)).withColumn("frames_played", played).select(
        "topic",
        "frames_played",
        F.col("n_arrivals").alias("sets_received"),
        F.greatest(zero, F.col("frames_played") - F.col("n_arrivals")).alias("dropped_raw"),
        F.greatest(zero, F.col("frames_played") - F.col("n_stamps")).alias("dropped_scored"),
    )


@query("topic_sequence", f"""WITH {t.ARRIVALS_SQL}
SELECT topic, seq, row_number() OVER (PARTITION BY topic ORDER BY recv_us, seq) - 1 AS topic_seq FROM arr""")
def topic_sequence(spark, sf):
    a = t.arrivals(spark, sf).select("topic", "recv_us", "seq")
    return temporal.running_number(a, ["topic"], ["recv_us", "seq"], "topic_seq").select("topic", "seq", "topic_seq")


_PAIR_SQL = """WITH ev AS (SELECT user_id, epoch_us(ts) AS ts_us, event_type, value, event_id FROM events),
err AS (SELECT * FROM ev WHERE event_type = 'error'), clk AS (SELECT * FROM ev WHERE event_type = 'click')"""


@query("asof_pose", _PAIR_SQL + """
SELECT err.event_id, err.user_id, err.ts_us, clk.ts_us AS pose_us, clk.value AS pose_value
FROM err ASOF LEFT JOIN clk ON err.user_id = clk.user_id AND err.ts_us >= clk.ts_us""")
def asof_pose(spark, sf):
    s = t.signals(spark, sf)
    left = s.where("event_type = 'error'").select("user_id", "ts_us", "event_id")
    right = s.where("event_type = 'click'").select("user_id", F.col("ts_us").alias("pose_us"), "value", "event_id")
    j = temporal.asof_backward(left, right, ["user_id"], "ts_us", "pose_us", ["value"], "event_id")
    return j.select(
        "event_id", "user_id", "ts_us", F.col("pose_us_match").alias("pose_us"), F.col("match_value").alias("pose_value")
    )


_BRACKET = """, b AS (SELECT err.user_id, err.ts_us, clk.ts_us AS t0, clk.value AS v0
  FROM (SELECT DISTINCT user_id, ts_us FROM err) err ASOF LEFT JOIN clk
  ON err.user_id = clk.user_id AND err.ts_us >= clk.ts_us),
c AS (SELECT b.*, clk.ts_us AS t1, clk.value AS v1
  FROM b ASOF LEFT JOIN clk ON b.user_id = clk.user_id AND b.ts_us <= clk.ts_us)"""


@query("pose_interpolation", _PAIR_SQL + _BRACKET + """
SELECT user_id, ts_us, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0
  ELSE v0 + (v1 - v0) * (CAST(ts_us - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE)) END AS value FROM c""")
def pose_interpolation(spark, sf):
    s = t.signals(spark, sf)
    return temporal.interpolate(
        s.where("event_type = 'click'"), s.where("event_type = 'error'"), ["user_id"], "ts_us", "value"
    )


@query("pose_gap", _PAIR_SQL + _BRACKET + """
SELECT user_id, ts_us, least(ts_us - t0, t1 - ts_us) AS gap FROM c""")
def pose_gap(spark, sf):
    s = t.signals(spark, sf)
    return temporal.nearest_gap(s.where("event_type = 'click'"), s.where("event_type = 'error'"), ["user_id"], "ts_us")


SLOP_US = 6 * 3600 * 1_000_000


@query("approx_time_pairs", _PAIR_SQL + f""",
near_a AS (SELECT DISTINCT err.user_id, err.ts_us AS a_time,
    arg_min(clk.ts_us, (abs(err.ts_us - clk.ts_us), clk.ts_us)) OVER (PARTITION BY err.user_id, err.ts_us) AS b_time
  FROM err JOIN clk USING (user_id)),
near_b AS (SELECT DISTINCT clk.user_id, clk.ts_us AS b_time,
    arg_min(err.ts_us, (abs(err.ts_us - clk.ts_us), err.ts_us)) OVER (PARTITION BY clk.user_id, clk.ts_us) AS a_time
  FROM err JOIN clk USING (user_id))
SELECT user_id, a_time, b_time FROM near_a JOIN near_b USING (user_id, a_time, b_time)
WHERE abs(a_time - b_time) <= {SLOP_US}""")
def approx_time_pairs(spark, sf):
    s = t.signals(spark, sf)
    return temporal.mutual_pairs(
        s.where("event_type = 'error'"), s.where("event_type = 'click'"), ["user_id"], "ts_us", SLOP_US
    )


GAP = 1

EPISODE_SQL = f"""{t.SEGMENTS_SQL},
fr AS (SELECT DISTINCT gt_object_id, frame_idx FROM seg WHERE n_pixels >= 1),
lg AS (SELECT *, lag(frame_idx) OVER (PARTITION BY gt_object_id ORDER BY frame_idx) AS prev FROM fr),
num AS (SELECT *, sum(CASE WHEN prev IS NULL OR frame_idx - prev - 1 > {GAP} THEN 1 ELSE 0 END)
  OVER (PARTITION BY gt_object_id ORDER BY frame_idx) AS episode FROM lg),
eps AS (SELECT gt_object_id, CAST(episode AS BIGINT) AS episode, min(frame_idx) AS first_frame,
  max(frame_idx) AS last_frame, count(*) AS n_frames_observed FROM num GROUP BY ALL),
emitted AS (SELECT *, least(last_frame + {GAP} + 1, mx) AS emit_frame, last_frame + {GAP} + 1 > mx AS flushed
  FROM eps, (SELECT max(frame_idx) AS mx FROM seg)),
tracks AS (SELECT *, row_number() OVER (ORDER BY emit_frame, gt_object_id, first_frame) AS tracklet_id FROM emitted)"""


def tracklet_rows(spark, sf):
    """Episodes with closing frame and tracklet id."""
    seg = t.segments(spark, sf)
    eps = temporal.episodes(seg.where("n_pixels >= 1"), ["gt_object_id"], "frame_idx", GAP)
    last = seg.agg(F.max("frame_idx").alias("_mx")).withColumn("_k", F.lit(0))
    eps = eps.withColumn("_k", F.lit(0)).join(F.broadcast(last), "_k")  # one row
    return temporal.number_tracklets(temporal.emission(eps, GAP, F.col("_mx")), "gt_object_id").drop("_k", "_mx")


@query("episodes", f"""WITH {EPISODE_SQL}
SELECT gt_object_id, episode, first_frame, last_frame, n_frames_observed FROM eps""")
def episodes(spark, sf):
    seg = t.segments(spark, sf)
    return temporal.episodes(seg.where("n_pixels >= 1"), ["gt_object_id"], "frame_idx", GAP)


@query("tracklets", f"""WITH {EPISODE_SQL}
SELECT tracklet_id, gt_object_id, first_frame, last_frame, n_frames_observed, emit_frame,
       CAST(flushed AS INT) AS flushed FROM tracks""")
def tracklets(spark, sf):
    return tracklet_rows(spark, sf).select(
        "tracklet_id", "gt_object_id", "first_frame", "last_frame", "n_frames_observed", "emit_frame",
        F.col("flushed").cast("int").alias("flushed"),
    )


@query("keyframes_in_window", """WITH o AS (SELECT epoch_us(o_orderdate) // 86400000000 AS day FROM orders),
w AS (SELECT l_partkey, min(epoch_us(l_shipdate) // 86400000000) AS first_day,
             max(epoch_us(l_shipdate) // 86400000000) AS last_day FROM lineitem GROUP BY l_partkey),
per AS (SELECT day, count(*) AS c FROM o GROUP BY day)
SELECT l_partkey, first_day, last_day, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_in_window
FROM w LEFT JOIN per ON day BETWEEN first_day AND last_day GROUP BY ALL""")
def keyframes_in_window(spark, sf):
    """Orders placed inside the shipping window of each part."""
    o = t.table(spark, sf, "orders").select(t.micros("o_orderdate").alias("us"))
    o = o.select(t.day_of("us").alias("day"))
    li = t.table(spark, sf, "lineitem").select("l_partkey", t.micros("l_shipdate").alias("us"))
    w = li.groupBy("l_partkey").agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    w = w.select("l_partkey", t.day_of("_a").alias("first_day"), t.day_of("_b").alias("last_day"))
    return temporal.count_in_intervals(o, w, "day", "first_day", "last_day", "n_in_window").select(
        "l_partkey", "first_day", "last_day", "n_in_window"
    )


MARGIN = 1


@query("active_tracklets", f"""WITH {EPISODE_SQL},
kf AS (SELECT DISTINCT user_id AS gt_object_id, epoch_us(ts) // 86400000000 AS frame_idx FROM events
  WHERE event_type = 'purchase')
SELECT kf.gt_object_id, kf.frame_idx, tracks.tracklet_id FROM kf JOIN tracks
ON kf.gt_object_id = tracks.gt_object_id AND kf.frame_idx BETWEEN first_frame - {MARGIN} AND last_frame + {MARGIN}""")
def active_tracklets(spark, sf):
    """Keyframes joined to the tracklets active there, with a margin on both ends."""
    kf = t.segments(spark, sf).where("event_type = 'purchase'").select("gt_object_id", "frame_idx").distinct()
    tr = tracklet_rows(spark, sf).select("gt_object_id", "tracklet_id", "first_frame", "last_frame")
    j = temporal.interval_join(kf, tr, ["gt_object_id"], "frame_idx", "first_frame", "last_frame", MARGIN)
    return j.select("gt_object_id", "frame_idx", "tracklet_id")


@query("id_switches", """WITH e AS (SELECT user_id, event_type, ts, event_id,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type <> 'error')
SELECT user_id, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> event_type) AS n_switches,
       count(DISTINCT event_type) AS n_values, count(*) AS n_rows FROM e GROUP BY user_id""")
def id_switches(spark, sf):
    """Changes between consecutive non-null ids; 'error' stands for no id."""
    s = t.signals(spark, sf).withColumn("track", F.when(F.col("event_type") != "error", F.col("event_type")))
    return temporal.switches(s, ["user_id"], ["ts_us", "event_id"], "track")


POINT_CAP = 12


@query("csr_offsets", f"""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, CAST(coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS BIGINT) AS start FROM c""")
def csr_offsets(spark, sf):
    """Start offset of each order's rows in one flat array."""
    c = t.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    s = ordered.sliced(c, [], ["l_orderkey"])
    return ordered.prefix_sum(s, [], ["l_orderkey"], F.col("n"), "start", inclusive=False).drop(ordered.SLICE)


@query("point_budget", f"""WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS cum FROM c)
SELECT l_partkey, l_suppkey, n, CAST(least(cum, {POINT_CAP}) - least(cum - n, {POINT_CAP}) AS BIGINT) AS n_kept FROM w""")
def point_budget(spark, sf):
    """Counts per observation trimmed so that a frame carries at most the budget."""
    c = t.table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    s = ordered.sliced(c, ["l_partkey"], ["l_suppkey"])
    w = ordered.prefix_sum(s, ["l_partkey"], ["l_suppkey"], F.col("n"), "cum")
    cap = F.lit(POINT_CAP).cast("long")
    return w.select(
        "l_partkey", "l_suppkey", "n", (F.least("cum", cap) - F.least(F.col("cum") - F.col("n"), cap)).alias("n_kept")
    )
