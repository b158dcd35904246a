"""Benchmark profiles of the modules: inputs, outputs and what a recording keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import temporal
from sightline.operators.quantiles import exact_quantiles
from sightline.session import durable

# Topics per module.
INPUTS = {
    "seg": ["/camera/rgb"],
    "clip": ["/camera/rgb", "/segment_image"],
    "geobuilder": ["/camera/depth", "/segment_image", "/pose"],
}
OUTPUTS = {
    "seg": "/segment_image",
    "clip": "/instance_embedding_set",
    "geobuilder": "/instance_3d_set",
    "geotracker": "/tracklet_set",
    "associator": "/association_decision_set",
    "updater": "/object_update_set",
    "graphcore": "/local_object_graph_snapshot",
}


def flow_report(arrivals: DataFrame, out_topic: str, in_topics: list[str]) -> DataFrame:
    """n, mean, median, p90, p99 and max flow time in seconds; only n = 0 without matches."""
    flow = durable(temporal.flow_times(arrivals, out_topic, in_topics), "flow-times")
    q = exact_quantiles(flow, [], "flow_us", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    a = flow.agg(
        F.count(F.lit(1)).alias("n"),
        (F.try_divide(F.sum("flow_us"), F.count(F.lit(1))) / 1e6).alias("mean_s"),
        (F.max("flow_us") / 1e6).alias("max_s"),
    )
    secs = q.select(*[F.round(F.col(c) / 1e6, 9).alias(f"{c}_s") for c in ("median", "p90", "p99")])
    return a.withColumn("_k", F.lit(0)).join(secs.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")


def module_report(module: str, arrivals: DataFrame, frames_played: int | None = None) -> DataFrame:
    """One row: flow times and drops; modules without agreed inputs report arrivals only."""
    counts = temporal.topic_counts(arrivals)
    if module not in INPUTS:
        return counts
    played = (
        F.lit(frames_played) if frames_played is not None
        else F.coalesce(F.max(F.when(F.col("topic").isin(INPUTS[module]), F.col("n_stamps"))), F.lit(0))
    )
    got = F.coalesce(F.max(F.when(F.col("topic") == OUTPUTS[module], F.col("n_arrivals"))), F.lit(0))
    c = counts.agg(played.cast("long").alias("frames_played"), got.alias("sets_received"))
    c = c.withColumn("frames_dropped", F.greatest(F.lit(0).cast("long"), F.col("frames_played") - F.col("sets_received")))
    flow = flow_report(arrivals, OUTPUTS[module], INPUTS[module])
    return c.withColumn("_k", F.lit(0)).join(flow.withColumn("_k", F.lit(0)), "_k").drop("_k")


SCORERS: dict[str, Callable[..., DataFrame]] = {
    m: (lambda arrivals, frames_played=None, m=m: module_report(m, arrivals, frames_played)) for m in OUTPUTS
}
