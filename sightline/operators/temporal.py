"""Time-keyed operators: arrivals, flow time, as-of joins, episodes, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ordered import SLICE, carry, global_row_number, prefix_sum, sliced


# ------------------------------------------------------------------ arrivals

def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """First receive time per (topic, stamp); partial aggregation, no sort."""
    return arrivals.groupBy("topic", "stamp_ns").agg(
        F.min_by("recv_us", "seq").alias("recv_us"), F.min("seq").alias("seq")
    )


def topic_counts(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_arrivals"), F.countDistinct("stamp_ns").alias("n_stamps")
    )


def flow_times(arrivals: DataFrame, out_topic: str, in_topics: Sequence[str]) -> DataFrame:
    """Output receive time minus the latest input receive time, per exact stamp.

    The multiway equi join on the stamp is a single conditional aggregation, so
    the log is shuffled once per grouping level and never joined to itself.
    """
    ins = list(in_topics)
    firsts = first_arrivals(arrivals.where(F.col("topic").isin([out_topic, *ins])))
    is_in = F.col("topic").isin(ins)
    return (
        firsts.groupBy("stamp_ns")
        .agg(
            F.max(F.when(F.col("topic") == out_topic, F.col("recv_us"))).alias("out_us"),
            F.max(F.when(is_in, F.col("recv_us"))).alias("in_us"),
            F.count_if(is_in).alias("n_in"),
        )
        .where(F.col("out_us").isNotNull() & (F.col("n_in") == len(ins)))
        .select("stamp_ns", (F.col("out_us") - F.col("in_us")).alias("flow_us"))
    )


# --------------------------------------------------------------- as-of joins

def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    tie: str,
) -> DataFrame:
    """Each left row with the latest right row at or before its time.

    Both sides are first reduced to one row per (key, time); the right side
    keeps the row with the greatest ``tie``.
    """
    keys = list(keys)
    latest = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.max_by(F.struct(F.col(right_time).alias("at"), *payload), F.col(tie)).alias("_p")
    )
    stamps = left.select(*keys, F.col(left_time).alias("_t")).distinct()
    probe = stamps.withColumn("_left", F.lit(True)).join(latest, [*keys, "_t"], "full")
    filled = carry(sliced(probe, keys, ["_t"]), keys, ["_t"], F.col("_p"), "_m").where("_left")
    picked = filled.select(
        *keys,
        F.col("_t").alias(left_time),
        F.col("_m.at").alias(f"{right_time}_match"),
        *[F.col(f"_m.{c}").alias(f"match_{c}") for c in payload],
    )
    return left.join(picked, [*keys, left_time], "left")


def bracket(series: DataFrame, probes: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Distinct probe times with the series sample before and after each."""
    keys = list(keys)
    samples = series.groupBy(*keys, F.col(time).alias("_t")).agg(
        F.max_by(F.struct(F.col(time).alias("at"), *values), F.struct(*values)).alias("_p")
    )
    probe = (
        probes.select(*keys, F.col(time).alias("_t")).distinct().withColumn("_left", F.lit(True))
    ).join(samples, [*keys, "_t"], "full")
    s = sliced(probe, keys, ["_t"])
    s = carry(s, keys, ["_t"], F.col("_p"), "before")
    s = carry(s, keys, ["_t"], F.col("_p"), "after", reverse=True)
    return s.where("_left").select(*keys, F.col("_t").alias(time), "before", "after")


def interpolate(series: DataFrame, probes: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Linear interpolation of ``value`` at the probe times, clamped at both ends."""
    b = bracket(series, probes, keys, time, [value])
    t0, t1 = F.col("before.at"), F.col("after.at")
    v0, v1 = F.col(f"before.{value}"), F.col(f"after.{value}")
    frac = (F.col(time) - t0).cast("double") / F.when(t1 > t0, (t1 - t0).cast("double"))
    out = (
        F.when(t0.isNull(), v1)
        .when(t1.isNull() | (t1 == t0), v0)
        .otherwise(v0 + (v1 - v0) * frac)
    )
    return b.select(*keys, time, out.alias(value))


def nearest_gap(series: DataFrame, probes: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Distance in time from each probe to the nearest sample on either side."""
    b = bracket(series, probes, keys, time, [])
    back = F.col(time) - F.col("before.at")
    ahead = F.col("after.at") - F.col(time)
    return b.select(*keys, time, F.least(back, ahead).alias("gap"))


def mutual_pairs(
    a: DataFrame, b: DataFrame, keys: Sequence[str], time: str, slop: int
) -> DataFrame:
    """One-to-one pairs of two streams: each stamp is the other's nearest, within ``slop``.

    Ties go to the earlier stamp.
    """
    keys = list(keys)

    def nearest(probes: DataFrame, series: DataFrame, src: str, dst: str) -> DataFrame:
        br = bracket(series, probes, keys, time, [])
        back = F.col(time) - F.col("before.at")
        ahead = F.col("after.at") - F.col(time)
        pick = F.when(ahead.isNull() | (back <= ahead), F.col("before.at")).otherwise(F.col("after.at"))
        return br.select(*keys, F.col(time).alias(src), pick.alias(dst)).where(F.col(dst).isNotNull())

    ab = nearest(a, b, "a_time", "b_time")
    ba = nearest(b, a, "b_time", "a_time")
    return ab.join(ba, [*keys, "a_time", "b_time"]).where(F.abs(F.col("a_time") - F.col("b_time")) <= slop)


# ------------------------------------------------------------------ episodes

def episode_rows(seen: DataFrame, keys: Sequence[str], frame: str, gap: int) -> DataFrame:
    """Distinct (key, frame) rows with their episode number; a new one starts
    when more than ``gap`` frames are missing in between."""
    keys = list(keys)
    frames = sliced(seen.select(*keys, frame).distinct(), keys, [frame])
    prev = carry(frames, keys, [frame], F.col(frame), "_prev", inclusive=False)
    starts = prev.withColumn("_new", F.coalesce(F.col(frame) - F.col("_prev") - 1 > gap, F.lit(True)))
    numbered = prefix_sum(starts, keys, [frame], F.col("_new").cast("long"), "episode")
    return numbered.drop(SLICE, "_prev", "_new")


def episodes(seen: DataFrame, keys: Sequence[str], frame: str, gap: int) -> DataFrame:
    return (
        episode_rows(seen, keys, frame, gap)
        .groupBy(*keys, "episode")
        .agg(
            F.min(frame).alias("first_frame"),
            F.max(frame).alias("last_frame"),
            F.count(F.lit(1)).alias("n_frames_observed"),
        )
    )


def emission(eps: DataFrame, gap: int, last_frame: Column) -> DataFrame:
    """Closing frame of each episode and whether the end of the data closed it."""
    due = F.col("last_frame") + gap + 1
    return eps.withColumn("emit_frame", F.least(due, last_frame)).withColumn("flushed", due > last_frame)


def number_tracklets(eps: DataFrame, object_col: str) -> DataFrame:
    """Ids from 1 in order of (closing frame, object, first frame)."""
    return global_row_number(eps, ["emit_frame", object_col, "first_frame"], "tracklet_id")


# ----------------------------------------------------------------- intervals

def count_in_intervals(points: DataFrame, intervals: DataFrame, time: str, lo: str, hi: str, out: str) -> DataFrame:
    """Number of points with lo <= time <= hi for each interval.

    Counted as a difference of two cumulative counts, so no (point, interval)
    pair is ever produced.
    """
    per_t = points.groupBy(F.col(time).alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    ends = intervals.select((F.col(lo) - 1).alias("_t")).union(intervals.select(F.col(hi).alias("_t"))).distinct()
    grid = per_t.join(ends.withColumn("_end", F.lit(True)), "_t", "full")
    cum = prefix_sum(sliced(grid, [], ["_t"]), [], ["_t"], F.coalesce("_c", F.lit(0)), "_cum").where("_end")
    at = cum.select("_t", "_cum")
    below = at.select((F.col("_t") + 1).alias(lo), F.col("_cum").alias("_lo_cum"))
    above = at.select(F.col("_t").alias(hi), F.col("_cum").alias("_hi_cum"))
    return (
        intervals.join(below, lo, "left")
        .join(above, hi, "left")
        .withColumn(out, F.col("_hi_cum") - F.col("_lo_cum"))
        .drop("_lo_cum", "_hi_cum")
    )


def _dyadic_pieces(lo: Column, hi: Column, levels: Column) -> Column:
    """The at most two pieces a level, (level, place), that together cover the whole numbers lo..hi once.

    A piece of level k at place i covers i * 2^k up to the next multiple.
    """

    def of_level(k: Column) -> Column:
        # Of what the levels below leave: the first piece that has no left half, the last without a right one.
        first = -F.call_function("shiftright", -lo, k)
        stop = F.call_function("shiftright", hi + 1, k)
        piece = lambda at: F.struct(k.cast("int").alias("level"), at.alias("place"))
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        none = F.array().cast("array<struct<level:int,place:bigint>>")
        left = F.when((first < stop) & odd(first), F.array(piece(first))).otherwise(none)
        right = F.when((first < stop) & odd(stop), F.array(piece(stop - 1))).otherwise(none)
        return F.concat(left, right)

    return F.flatten(F.transform(levels, of_level))


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, lo: str, hi: str, margin: int = 0
) -> DataFrame:
    """Points joined to the intervals [lo - margin, hi + margin] that hold them; times are whole numbers.

    An interval of n times is cut into at most 2 log2(n) dyadic pieces, and a
    point carries its piece of every level, so the join is an equi join on
    (keys, level, place) that gives each pair once, however long lifetimes
    are. Levels reach as far as the longest interval needs.
    """
    keys = list(keys)
    cut = intervals.withColumns({"_lo": (F.col(lo) - margin).cast("long"), "_hi": (F.col(hi) + margin).cast("long")})
    longest = cut.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0] or 1
    levels = F.sequence(F.lit(0), F.lit(max(int(longest), 1).bit_length()))
    pieces = cut.withColumn("_p", F.explode(_dyadic_pieces(F.col("_lo"), F.col("_hi"), levels)))
    pieces = pieces.withColumns({"_level": F.col("_p.level"), "_place": F.col("_p.place")}).drop("_p", "_lo", "_hi")
    placed = points.withColumn("_level", F.explode(levels))
    placed = placed.withColumn("_place", F.call_function("shiftright", F.col(time).cast("long"), F.col("_level")))
    return placed.join(pieces, [*keys, "_level", "_place"]).drop("_level", "_place")


# ------------------------------------------------------------------ switches

def switches(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per key: changes between consecutive non-null values."""
    keys = list(keys)
    rows = sliced(df.where(F.col(value).isNotNull()).select(*keys, *order, value), keys, order)
    prev = carry(rows, keys, order, F.col(value), "_prev", inclusive=False)
    return prev.groupBy(*keys).agg(
        F.count_if(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(value))).alias("n_switches"),
        F.countDistinct(value).alias("n_values"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based running sequence number inside each key."""
    s = sliced(df, keys, order)
    return prefix_sum(s, keys, order, F.lit(1).cast("long"), out, inclusive=False).drop(SLICE)
