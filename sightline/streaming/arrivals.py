"""Streaming forms of the time-keyed operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def first_arrivals(arrivals: DataFrame, delay: str) -> DataFrame:
    """First message per (topic, stamp); repeats inside the delay are dropped."""
    return arrivals.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["topic", "stamp_ns"])


def stamp_pairs(a: DataFrame, b: DataFrame, keys: list[str], slop: str, delay: str) -> DataFrame:
    """Pairs of two streams whose times differ by at most ``slop``.

    Inputs have an ``event_time``; both sides keep state only for delay + slop.
    """
    left = a.withWatermark("event_time", delay).alias("a")
    right = b.withWatermark("event_time", delay).alias("b")
    near = F.expr(
        f"b.event_time >= a.event_time - INTERVAL {slop} AND b.event_time <= a.event_time + INTERVAL {slop}"
    )
    same = None
    for k in keys:
        c = F.col(f"a.{k}") == F.col(f"b.{k}")
        same = c if same is None else same & c
    return left.join(right, near if same is None else same & near)


def session_episodes(seen: DataFrame, keys: list[str], gap_frames: int, frame_seconds: int, delay: str) -> DataFrame:
    """Episodes closed by a gap; emitted when the watermark passes their end.

    The session end equals the closing frame last + gap + 1. Sessions still open
    when the stream ends are those of ``flushed_episodes``.
    """
    return _sessions(seen.withWatermark("event_time", delay), keys, gap_frames, frame_seconds)


def _sessions(seen: DataFrame, keys: list[str], gap_frames: int, frame_seconds: int) -> DataFrame:
    w = F.session_window("event_time", f"{(gap_frames + 1) * frame_seconds} seconds")
    g = seen.groupBy(*keys, w.alias("w")).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n_rows")
    )
    return g.select(*keys, "first_frame", "last_frame", (F.col("last_frame") + gap_frames + 1).alias("emit_frame"), "n_rows")


def flushed_episodes(seen: DataFrame, closed: DataFrame, keys: list[str], gap_frames: int, frame_seconds: int) -> DataFrame:
    """The episodes an ended stream left open, closed by the end of the data at the latest.

    ``seen`` are the recorded rows of the stream, ``closed`` what it emitted;
    only rows behind the last closed episode of a key are looked at.
    """
    done = closed.groupBy(*keys).agg(F.max("last_frame").alias("_done"))
    rest = seen.join(done, keys, "left").where(F.col("_done").isNull() | (F.col("frame") > F.col("_done"))).drop("_done")
    end = seen.agg(F.max("frame")).first()[0]
    return _sessions(rest, keys, gap_frames, frame_seconds).withColumn("emit_frame", F.least("emit_frame", F.lit(end)))


# ------------------------------------------------------- state behind the watermark

#: Rows in one element of the list of a key.
HELD_ROWS = 1000


def waiting(rows: DataFrame, stamp_us: Column, fields: tuple[str, ...], time: str = "event_time") -> DataFrame:
    """(sequence, due, payload, ``time``) for a ``_Waiting`` state.

    ``due`` is the first whole millisecond at which nothing up to the stamp can
    come any more. The fields of a row travel and wait as one text, as a worker
    takes rows in value by value.
    """
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.select("sequence", F.ceil(stamp_us / 1000).cast("long").alias("due"), payload.alias("payload"), time)


class _Waiting(StatefulProcessor):
    """Rows of a key are held in a list and let go, in order of their stamps, once the watermark has passed them.

    Whatever the files, their order and the batches they came in, ``release``
    sees the same rows in the same order. The list holds what is younger than
    the watermark, so its size is bounded by the delay. An element of it is a
    text with a line a row, and few elements are read and written.
    """

    fields: tuple[str, ...]
    #: Fields that are numbers with a fraction; text stands for those that are not finite.
    doubles: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows string")

    def release(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def parsed(self, payload: str) -> tuple:
        row = json.loads(payload)
        for name in self.doubles:
            if isinstance(row[name], str):
                row[name] = float(row[name])
        return tuple(map(row.__getitem__, self.fields))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        some = [(r[1], r[2]) for r in rows]
        self.held.appendList(_elements(some))
        self.handle.registerTimer(min(some)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for (element,) in self.held.get():
            for line in element.split("\n"):
                due, _, payload = line.partition(" ")
                if int(due) <= now:
                    ready.append(self.parsed(payload))
                else:
                    later.append((int(due), payload))
        if not ready:
            return
        if later:
            self.held.put(_elements(later))
            self.handle.registerTimer(min(later)[0])
        else:
            self.held.clear()
        yield from self.release(key, ready)

    def close(self) -> None:
        pass


def _elements(rows: list[tuple[int, str]]) -> list[tuple[str]]:
    lines = [f"{due} {payload}" for due, payload in rows]
    return [("\n".join(lines[i : i + HELD_ROWS]),) for i in range(0, len(lines), HELD_ROWS)]


_POSE = Row("sequence", "stamp_us", "event_id", "pose_us", "pose_value")
_LATCHED = Row("sequence", "stamp_us", "event_id", "latched")
_PAIRED = Row("sequence", "a_id", "b_id", "apart_us")


class _PoseLookup(_Waiting):
    """The latest pose at or before each image; of the poses let go only the latest is kept."""

    fields = ("stamp_us", "event_id", "is_pose", "value")
    doubles = ("value",)

    def init(self, handle):
        super().init(handle)
        self.latest = handle.getValueState("latest", "stamp_us long, value double")

    def release(self, key, rows):
        pose = tuple(self.latest.get()) if self.latest.exists() else None
        # Poses lead images of the same stamp.
        for stamp, event, is_pose, value in sorted(rows, key=lambda r: (r[0], not r[2], r[1])):
            if is_pose:
                pose = stamp, value
            elif pose is not None:
                yield _POSE(key[0], stamp, event, *pose)
        if pose is not None:
            self.latest.update(pose)


_POSE_OUT = "sequence long, stamp_us long, event_id long, pose_us long, pose_value double"


def pose_lookup(rows: DataFrame) -> DataFrame:
    """As-of lookup that waits for the watermark, so every pose that can matter has come.

    rows: (sequence, stamp_us, event_id, is_pose, value) with a watermark.
    Images before the first pose are skipped. Poses of one stamp: the one with
    the largest event id counts.
    """
    held = waiting(rows, F.col("stamp_us"), _PoseLookup.fields)
    return held.groupBy("sequence").transformWithState(_PoseLookup(), _POSE_OUT, "Append", "EventTime")


class _Latch(_Waiting):
    """The first value of a key, by time, for all its rows; rows wait until it is known, later values are ignored."""

    fields = ("stamp_us", "event_id", "is_value", "value")
    doubles = ("value",)

    def init(self, handle):
        super().init(handle)
        self.latched = handle.getValueState("latched", "value double")
        self.early = handle.getListState("early", "stamp_us long, event_id long")

    def release(self, key, rows):
        known = self.latched.exists()
        value = self.latched.get()[0] if known else None
        waiting = []
        for stamp, event, is_value, new in sorted(rows):
            if is_value and not known:
                known, value = True, new
                self.latched.update((new,))
                waiting = [tuple(r) for r in self.early.get()] + waiting
                self.early.clear()
            elif not is_value:
                waiting.append((stamp, event))
        if not known:
            self.early.appendList(waiting)
            return
        for stamp, event in waiting:
            yield _LATCHED(key[0], stamp, event, value)


_LATCH_OUT = "sequence long, stamp_us long, event_id long, latched double"


def first_value_latch(rows: DataFrame) -> DataFrame:
    """Rows with the first value of their sequence; those before it are held until it comes.

    rows: (sequence, stamp_us, event_id, is_value, value) with a watermark. A
    sequence without a value keeps its rows in state.
    """
    held = waiting(rows, F.col("stamp_us"), _Latch.fields)
    return held.groupBy("sequence").transformWithState(_Latch(), _LATCH_OUT, "Append", "EventTime")


QUEUE = 2


class _Synchroniser(_Waiting):
    """Pairs of two kinds of messages, one to one, from a short queue of each; what falls out of a queue is never paired."""

    fields = ("stamp_us", "event_id", "is_second")

    def __init__(self, slop_us: int, size: int):
        self.slop_us, self.size = slop_us, size

    def init(self, handle):
        super().init(handle)
        self.queues = handle.getListState("queues", "stamp_us long, event_id long, is_second boolean")

    def release(self, key, rows):
        queued = [tuple(r) for r in self.queues.get()]
        for stamp, event, second in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
            own = [m for m in queued if m[2] == second][1 - self.size :] + [(stamp, event, second)]
            others = [m for m in queued if m[2] != second]
            near = min(((abs(m[0] - stamp), *m) for m in others if abs(m[0] - stamp) <= self.slop_us), default=None)
            if near:
                partner = near[1:]
                first, last = (partner, own[-1]) if second else (own[-1], partner)
                yield _PAIRED(key[0], first[1], last[1], near[0])
                own, others = own[:-1], [m for m in others if m != partner]
            queued = own + others
        self.queues.put(queued)


_SYNC_OUT = "sequence long, a_id long, b_id long, apart_us long"


def synchronised(rows: DataFrame, slop_us: int, size: int = QUEUE) -> DataFrame:
    """Messages of two kinds paired in order of their stamps, each at most once.

    rows: (sequence, stamp_us, event_id, is_second) with a watermark. A message
    enters the queue of its kind, which lets its oldest go beyond ``size``, and
    is paired with the nearest waiting message of the other kind within the
    slop, the earlier of two as near; both leave their queues. Of messages of
    one stamp the first kind comes first, then the smaller id.
    """
    held = waiting(rows, F.col("stamp_us"), _Synchroniser.fields)
    return held.groupBy("sequence").transformWithState(_Synchroniser(slop_us, size), _SYNC_OUT, "Append", "EventTime")
