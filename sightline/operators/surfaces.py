"""Surface geometry between clouds: accuracy, completeness, Chamfer, F-score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import rules
from sightline.operators.nearest import nearest
from sightline.operators.quantiles import exact_quantiles
from sightline.operators.voxels import XYZ, downsample
from sightline.session import durable


def both_ways(preds: DataFrame, truths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, d): prediction points to the truth, and back; points are kept distinct."""
    keys = list(keys)
    a = nearest(preds, truths, keys, out="d").select(*keys, F.lit("pred").alias("side"), "d")
    b = nearest(truths, preds, keys, out="d").select(*keys, F.lit("gt").alias("side"), "d")
    return a.unionByName(b)


def chamfer(preds: DataFrame, truths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean distances in centimetres; keys without points on one side drop out."""
    keys = list(keys)
    acc = F.avg(F.when(F.col("side") == "pred", F.col("d"))) * 100
    com = F.avg(F.when(F.col("side") == "gt", F.col("d"))) * 100
    m = both_ways(preds, truths, keys).groupBy(*keys).agg(acc.alias("accuracy_cm"), com.alias("completeness_cm"))
    return m.withColumn("chamfer_l1_cm", (F.col("accuracy_cm") + F.col("completeness_cm")) / 2)


def f_score(preds: DataFrame, truths: DataFrame, keys: Sequence[str], tau: float) -> DataFrame:
    """Precision, recall and F at ``tau`` on clouds thinned to half of it (strict, no slack)."""
    keys = list(keys)
    a = durable(downsample(preds, keys, tau / 2).select(*keys, *XYZ), "thin-pred")
    b = durable(downsample(truths, keys, tau / 2).select(*keys, *XYZ), "thin-gt")
    def share(points: DataFrame, others: DataFrame, name: str) -> DataFrame:
        # Only partners within the bound are searched; points without one count in the total alone.
        hits = nearest(points, others, keys, bound=tau, out="d", stored=True).groupBy(*keys).agg(F.count(F.lit(1)).alias("_h"))
        total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return total.join(hits, keys, "left").select(*keys, (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias(name))

    m = share(a, b, "p").join(share(b, a, "r"), keys)
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return m.withColumn("f", f)


def column_stats(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and median of each metric over the rows that have it."""
    long = rows.unpivot(list(keys) or [F.lit(0).alias("_k")], list(metrics), "metric", "value").where("value IS NOT NULL")
    by = [*keys, "metric"]
    mean = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return mean.join(exact_quantiles(long, by, "value", {"median": 0.5}), by)


def skip_reason(matched_ignored, label_missing, label_empty, gt_points, pred_points):
    """First reason a row is left out of the geometry report, NULL when it is scored."""
    return (
        F.when(matched_ignored, "ignored_match")
        .when(label_missing, "label_png_missing")
        .when(label_empty, "gt_label_empty")
        .when(gt_points == 0, "gt_no_depth_in_range")
        .when(pred_points == 0, "pred_empty_in_range")
    )


def spread_text(values, digits: int = 2):
    """'min~max' over a group, for status lines."""
    lo, hi = F.format_number(F.min(values), digits), F.format_number(F.max(values), digits)
    return F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("~"), hi))


def cut_range(points: DataFrame, camera: Sequence, max_range: float) -> DataFrame:
    """Flag points inside the range, bound included."""
    d2 = None
    for c, o in zip(XYZ, camera):
        e = (F.col(c) - o) * (F.col(c) - o)
        d2 = e if d2 is None else d2 + e
    return points.withColumn("range_m", F.sqrt(d2)).withColumn("in_range", F.col("range_m") <= max_range)


STATUS_THRESHOLDS = {"f20": (0.90, 0.75), "pq": (0.70, 0.50)}  # fixed reading thresholds


def verdict(kind: str, worst):
    good, fair = STATUS_THRESHOLDS[kind]
    return F.when(worst >= good, "good").when(worst >= fair, "fair").otherwise("poor")


def novelty(samples: DataFrame, keys: Sequence[str], valid, unknown, seen) -> DataFrame:
    """Share of newly seen depth samples among the valid, known ones, and the known share."""
    known = valid & ~unknown
    g = samples.groupBy(*keys).agg(
        F.count_if(known & ~seen).alias("n_new"), F.count_if(known).alias("n_known"), F.count(F.lit(1)).alias("n")
    )
    return g.withColumn("novelty", rules.ratio_or_zero(F.col("n_new"), F.col("n_known"))).withColumn(
        "valid_frac", F.col("n_known") / F.col("n")
    )
