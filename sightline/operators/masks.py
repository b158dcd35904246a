"""Label rasters and masks: overlap counts, matching, panoptic scores.

Cells are reduced to (frame, prediction, truth) counts by one partial
aggregation; everything after that works on a few rows per frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import rules
from sightline.operators.assignment import assign
from sightline.session import durable

VOID = 0


# ------------------------------------------------------- label image against label image

def label_counts(raster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels per (keys, pred, gt): the only pass over the pixels."""
    return raster.groupBy(*keys, "pred", "gt").agg(F.count(F.lit(1)).alias("n"))


def label_pairs(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IoU of every overlapping (pred, gt) label pair; label 0 takes part in no area.

    Areas are summed over the few label pairs of a frame.
    """
    area_pred = F.sum("n").over(Window.partitionBy(*keys, "pred"))
    area_gt = F.sum("n").over(Window.partitionBy(*keys, "gt"))
    return (
        counts.withColumns({"area_pred": area_pred, "area_gt": area_gt})
        .where("pred <> 0 AND gt <> 0")
        .withColumn("iou", F.col("n") / (F.col("area_pred") + F.col("area_gt") - F.col("n")))
    )


def frame_mask_iou(raster: DataFrame, keys: Sequence[str], floor: float = 0.0) -> DataFrame:
    """Mean IoU over the ground truths of a frame after greedy matching; 1 without ground truth."""
    keys = list(keys)
    counts = durable(label_counts(raster, keys), "label-counts")
    got = assign(label_pairs(counts, keys), keys, "pred", "gt", "iou", F.col("iou") > floor, "greedy")
    got = got.groupBy(*keys).agg(F.sum("iou").alias("_s"), F.count(F.lit(1)).alias("n_matched"))
    sizes = counts.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("gt") != 0, F.col("gt"))).alias("n_gt"),
        F.countDistinct(F.when(F.col("pred") != 0, F.col("pred"))).alias("n_pred"),
    )
    mean = F.when(F.col("n_gt") > 0, F.coalesce("_s", F.lit(0.0)) / F.col("n_gt")).otherwise(1.0)
    return sizes.join(got, keys, "left").select(
        *keys, "n_gt", "n_pred", F.coalesce("n_matched", F.lit(0)).alias("n_matched"), mean.alias("mean_matched_iou")
    )


# ------------------------------------------------------- overlapping masks against labels

def mask_hits(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(frame, pred, cell, gt) for all mask cells; cells without a label count as void."""
    return masks.join(labels, ["frame", "cell"], "left").na.fill(VOID, ["gt"])


def mask_pairs(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per overlapping (frame, pred, gt); void inside a mask leaves the union."""
    n = hits.groupBy("frame", "pred", "gt").agg(F.count(F.lit(1)).alias("inter"))
    of_mask = Window.partitionBy("frame", "pred")  # the labels under one mask
    n = n.withColumns(
        {
            "area_pred": F.sum("inter").over(of_mask),
            "void": F.coalesce(F.sum(F.when(F.col("gt") == VOID, F.col("inter"))).over(of_mask), F.lit(0)),
        }
    )
    per_gt = gt_areas(labels)
    union = F.col("area_pred") + F.col("area_gt") - F.col("inter") - F.col("void")
    return (
        n.where(F.col("gt") != VOID)
        .join(per_gt, ["frame", "gt"])
        .withColumn("iou", F.when(union > 0, F.col("inter") / union).otherwise(0.0))
        .withColumn("covers_gt", 2 * F.col("inter") >= F.col("area_gt"))
        .withColumn("inside_gt", 2 * F.col("inter") >= F.col("area_pred"))
    )


def gt_areas(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("gt") != VOID).groupBy("frame", "gt").agg(F.count(F.lit(1)).alias("area_gt"))


def pred_areas(hits: DataFrame) -> DataFrame:
    return hits.groupBy("frame", "pred").agg(
        F.count(F.lit(1)).alias("area_pred"), F.count_if(F.col("gt") == VOID).alias("void")
    )


def match_thetas(pairs: DataFrame, thetas: Sequence[float]) -> DataFrame:
    """Most matches, then best IoU sum, for each threshold (IoU strictly above it)."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thetas]))
    long = pairs.select("frame", "pred", "gt", "iou", levels.alias("theta"))
    return assign(long, ["frame", "theta"], "pred", "gt", "iou", F.col("iou") > F.col("theta"), "most_then_best")


def gt_rows(
    hits: DataFrame, labels: DataFrame, pairs: DataFrame, matches: DataFrame, theta: float, area_min: int
) -> DataFrame:
    """One row per (frame, gt): status, best IoU, matched prediction, fragment cover."""
    mergers = pairs.where("covers_gt").groupBy("frame", "pred").agg((F.count(F.lit(1)) >= 2).alias("merger"))
    frags = pairs.where("inside_gt").select("frame", "pred", "gt")
    # Cells of the truth inside any of its fragments; masks may share cells.
    cover = (
        hits.join(frags, ["frame", "pred", "gt"], "left_semi")
        .select("frame", "gt", "cell").distinct()
        .groupBy("frame", "gt").agg(F.count(F.lit(1)).alias("frag_cells"))
    )
    n_frags = frags.groupBy("frame", "gt").agg(F.count(F.lit(1)).alias("n_frags"))
    facts = (
        pairs.join(mergers, ["frame", "pred"], "left")
        .groupBy("frame", "gt")
        .agg(
            F.max("iou").alias("best_iou"),
            F.min_by("pred", F.struct(-F.col("iou"), F.col("pred"))).alias("best_pred"),
            F.bool_or(F.col("merger") & F.col("covers_gt")).alias("merged"),
        )
    )
    own = matches.where(F.col("theta") == theta).select("frame", "gt", F.col("pred").alias("matched_pred"))
    status = rules.gt_status(
        F.col("matched_pred").isNotNull(),
        F.coalesce("merged", F.lit(False)),
        F.col("n_frags"),
        2 * F.col("frag_cells") >= F.col("area_gt"),
        F.col("best_iou"),
        theta,
    )
    return (
        gt_areas(labels)
        .join(facts, ["frame", "gt"], "left")
        .join(n_frags, ["frame", "gt"], "left")
        .join(cover, ["frame", "gt"], "left")
        .join(own, ["frame", "gt"], "left")
        .na.fill(0, ["n_frags", "frag_cells"])
        .na.fill(0.0, ["best_iou"])
        .withColumn("status", status)
        .withColumn("eligible", F.col("area_gt") >= area_min)
        .withColumn("split_cover", F.when(F.col("n_frags") >= 2, F.col("frag_cells") / F.col("area_gt")).otherwise(0.0))
        .na.fill(-1, ["matched_pred", "best_pred"])
    )


def pred_rows(hits: DataFrame, pairs: DataFrame, matches: DataFrame, theta: float, area_min: int) -> DataFrame:
    """One row per (frame, pred): status, IoU, the truth it is booked to."""
    facts = pairs.groupBy("frame", "pred").agg(
        F.max("iou").alias("best_iou"),
        F.min_by("gt", F.struct(-F.col("inter"), F.col("gt"))).alias("most_overlap"),
        (F.count_if("covers_gt") >= 2).alias("merger"),
    )
    own = (
        matches.where(F.col("theta") == theta)
        .join(pairs.select("frame", "pred", "gt", "area_gt"), ["frame", "pred", "gt"])
        .select("frame", "pred", F.col("gt").alias("matched_gt"), F.col("iou").alias("matched_iou"), "area_gt")
    )
    status = (
        F.when(F.col("matched_gt").isNotNull() & (F.col("area_gt") >= area_min), "tp")
        .when(F.col("matched_gt").isNotNull(), "tp_small")
        .when(2 * F.col("void") > F.col("area_pred"), "ignore")
        .otherwise("fp")
    )
    return (
        pred_areas(hits)
        .join(facts, ["frame", "pred"], "left")
        .join(own, ["frame", "pred"], "left")
        .withColumn("status", status)
        .withColumn("iou", F.coalesce("matched_iou", "best_iou", F.lit(0.0)))
        .withColumn("assigned_gt", F.coalesce("matched_gt", "most_overlap"))
        .na.fill(False, ["merger"])
        .drop("best_iou", "matched_iou", "most_overlap", "area_gt")
    )


def pred_group(pairs: DataFrame, preds: DataFrame, is_human: Column) -> DataFrame:
    """Book each prediction to 'human' or 'static'.

    The matched truth decides; otherwise the truth with most overlap; a tie
    between both kinds goes to the kind with more overlap in total.
    """
    p = pairs.withColumn("_h", is_human)
    top = p.groupBy("frame", "pred").agg(F.max("inter").alias("_top"))
    sides = (
        p.join(top, ["frame", "pred"])
        .groupBy("frame", "pred")
        .agg(
            F.bool_or((F.col("inter") == F.col("_top")) & F.col("_h")).alias("_top_h"),
            F.bool_or((F.col("inter") == F.col("_top")) & ~F.col("_h")).alias("_top_s"),
            F.sum(F.when(F.col("_h"), F.col("inter")).otherwise(0)).alias("_sum_h"),
            F.sum(F.when(~F.col("_h"), F.col("inter")).otherwise(0)).alias("_sum_s"),
        )
    )
    own = p.select("frame", "pred", F.col("gt").alias("matched_gt"), F.col("_h").alias("_own"))
    human = F.coalesce(
        F.col("_own"),
        F.when(F.col("_top_h") & F.col("_top_s"), F.col("_sum_h") > F.col("_sum_s")).otherwise(F.col("_top_h")),
        F.lit(False),
    )
    return (
        preds.join(own, ["frame", "pred", "matched_gt"], "left")
        .join(sides, ["frame", "pred"], "left")
        .withColumn("group", F.when(human, "human").otherwise("static"))
        .drop("_own", "_top_h", "_top_s", "_sum_h", "_sum_s")
    )


def summary(gts: DataFrame, preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, precision, SQ, RQ, PQ and the mean best IoU of the misses."""
    by = list(by)
    key = by or ["_k"]
    g = (gts if by else gts.withColumn("_k", F.lit(0))).where("eligible").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_gt"),
        F.count_if(F.col("status") == "tp").alias("n_tp"),
        F.avg(F.when(F.col("status") != "tp", F.col("best_iou"))).alias("mean_best_iou_fn"),
    )
    p = (preds if by else preds.withColumn("_k", F.lit(0))).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_pred"),
        F.count_if(F.col("status") == "fp").alias("n_fp"),
        F.count_if(F.col("status").isin("tp", "fp")).alias("_counted"),
        F.count_if(F.col("status") == "tp").alias("_tp_pred"),
        F.avg(F.when(F.col("status") == "tp", F.col("iou"))).alias("_sq"),
    )
    fn = F.col("n_gt") - F.col("n_tp")
    den = F.col("n_tp") + F.lit(0.5) * F.col("n_fp") + F.lit(0.5) * fn
    out = (
        g.join(p, key, "full")
        .na.fill(0, ["n_gt", "n_tp", "n_pred", "n_fp", "_counted", "_tp_pred"])
        .withColumn("n_fn", fn)
        .withColumn("precision", rules.ratio_or_zero(F.col("n_tp"), F.col("_counted")))
        .withColumn("sq", F.coalesce("_sq", F.lit(0.0)))
        .withColumn("rq", F.when(den > 0, F.col("n_tp") / den).otherwise(0.0))
        .withColumn("pq", F.col("sq") * F.col("rq"))
        .drop("_counted", "_tp_pred", "_sq")
    )
    return out if by else out.drop("_k")


def recall_at(gts: DataFrame, matches: DataFrame, thetas: Sequence[float]) -> DataFrame:
    """Recall of the eligible truths at every given threshold, 0 where nothing matches."""
    el = gts.where("eligible")
    every = el.sparkSession.createDataFrame([(float(x),) for x in thetas], "theta double")
    total = el.agg(F.count(F.lit(1)).alias("n_gt")).withColumn("_k", F.lit(0))
    hit = (
        matches.join(el.select("frame", "gt"), ["frame", "gt"], "left_semi")
        .groupBy("theta").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    return (
        every.join(hit, "theta", "left").withColumn("_k", F.lit(0)).join(total, "_k").drop("_k")
        .na.fill(0, ["n_hit"])
        .withColumn("recall", rules.ratio_or_zero(F.col("n_hit"), F.col("n_gt")))
    )


def boxes(labels: DataFrame, width: int) -> DataFrame:
    """Bounding box, shorter side and border contact of each label; cell = v * width + u."""
    c = labels.where(F.col("gt") != VOID).select(
        "frame", "gt", F.floor(F.col("cell") / width).alias("v"), (F.col("cell") % width).alias("u")
    )
    return c.groupBy("frame", "gt").agg(
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"),
        F.count(F.lit(1)).alias("vis_px"),
    ).withColumn("min_dim", F.least(F.col("u1") - F.col("u0") + 1, F.col("v1") - F.col("v0") + 1))


def resample_cells(labels: DataFrame, src_w: int, src_h: int, dst_w: int, dst_h: int) -> DataFrame:
    """Nearest-centre resampling: destination cell i reads source floor((i + 0.5) * src / dst).

    The destination cells that read a source row and column are enumerated from
    the row, so only (frame, label) cells that are read survive.
    """

    def reads(pos: Column, src: int, dst: int) -> Column:
        scale = src / dst
        first = F.ceil(pos / F.lit(scale) - 0.5).cast("long")
        last = (F.ceil((pos + 1) / F.lit(scale) - 0.5) - 1).cast("long")
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    c = labels.withColumn("_v", F.floor(F.col("cell") / src_w)).withColumn("_u", F.col("cell") % src_w)
    c = c.withColumn("v", F.explode(reads(F.col("_v"), src_h, dst_h)))
    c = c.withColumn("u", F.explode(reads(F.col("_u"), src_w, dst_w)))
    return c.select("frame", (F.col("v") * dst_w + F.col("u")).alias("cell"), "gt")
