"""Tolerant 3D matching of predicted voxel sets to ground-truth surfaces.

Inputs are distinct voxel centres: predictions (frame, pred, x, y, z) and
surfaces (frame, gt, x, y, z). Distances come from bounded nearest joins, once
per position however many predictions share it; everything after that is
counting per (frame, gt, pred).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import rules
from sightline.operators.assignment import assign
from sightline.operators.nearest import nearest
from sightline.operators.voxels import XYZ
from sightline.session import durable

POS = ["frame", *XYZ]


def tau_name(tau: float) -> int:
    """Tolerance in whole centimetres, as used in column names."""
    return int(round(tau * 100))


class Scene:
    """Distances and ownership of one set of frames (written once, read by every report).

    ``preds`` and ``truths`` are written tables of distinct voxel centres.
    """

    def __init__(self, preds: DataFrame, truths: DataFrame, taus: Sequence[float], main: float, size: float):
        self.preds, self.truths, self.taus, self.main, self.size = preds, truths, tuple(taus), main, size
        reach = max(taus)
        self.to_gt = durable(
            nearest(preds.select(*POS), truths, ["frame"], leaf=size, bound=reach, per=["gt"], out="d", stored=True), "pred-to-gt"
        )
        self.to_pred = durable(
            nearest(truths.select(*POS), preds, ["frame"], leaf=size, bound=reach, per=["pred"], out="d", stored=True), "gt-to-pred"
        )
        # Owner of a position: the nearest truth within the main tolerance, ties to the lowest number.
        near = self.to_gt.where(rules.within(F.col("d"), main))
        best = near.groupBy(*POS).agg(F.min("d").alias("_m"))
        self.owner = durable(
            near.join(best, POS)
            .where(F.col("d") <= F.col("_m") + rules.TIE_M)
            .groupBy(*POS)
            .agg(F.min("gt").alias("owner")),
            "owners",
        )
        self._exclusive = None

    def n_pred(self) -> DataFrame:
        return self.preds.groupBy("frame", "pred").agg(F.count(F.lit(1)).alias("n_vox"))

    def n_gt(self) -> DataFrame:
        return self.truths.groupBy("frame", "gt").agg(F.count(F.lit(1)).alias("n_gt_vox"))

    def owned(self) -> DataFrame:
        """Voxels of each prediction owned by each truth."""
        return (
            self.preds.join(self.owner, POS)
            .groupBy("frame", "pred", F.col("owner").alias("gt"))
            .agg(F.count(F.lit(1)).alias("near"))
        )

    def void(self) -> DataFrame:
        """Prediction voxels without a surface nearby."""
        return (
            self.n_pred()
            .join(self.owned().groupBy("frame", "pred").agg(F.sum("near").alias("_s")), ["frame", "pred"], "left")
            .select("frame", "pred", "n_vox", (F.col("n_vox") - F.coalesce("_s", F.lit(0))).alias("void"))
        )

    def exclusive(self) -> DataFrame:
        """(frame, gt, voxel, pred) where the prediction covers the surface voxel exclusively.

        One of the nearest prediction voxels must belong to the prediction and be
        owned by this truth; all predictions tied for nearest cover.
        """
        if self._exclusive is None:
            own = self.preds.join(self.owner, POS).withColumnRenamed("owner", "gt")
            d = nearest(
                self.truths, own, ["frame", "gt"], leaf=self.size, bound=self.main, per=["pred"], out="dj", stored=True
            )
            lowest = self.to_pred.groupBy(*POS).agg(F.min("d").alias("dall"))
            rows = d.join(lowest, POS).where(
                rules.within(F.col("dj"), self.main) & (F.col("dj") <= F.col("dall") + rules.TIE_M)
            )
            self._exclusive = durable(rows.select("frame", "gt", "pred", *XYZ), "exclusive-cover")
        return self._exclusive

    def _within_counts(self, dist: DataFrame, owner: DataFrame, keys: Sequence[str], stem: str) -> DataFrame:
        counts = [F.count_if(rules.within(F.col("d"), t)).alias(f"{stem}_{tau_name(t)}") for t in self.taus]
        return owner.join(dist, POS).groupBy(*keys).agg(*counts)

    def pairs(self) -> DataFrame:
        """One row per (frame, gt, pred) that come within the largest tolerance of each other."""
        keys = ["frame", "gt", "pred"]
        p = self._within_counts(self.to_gt, self.preds, keys, "np")
        r = self._within_counts(self.to_pred, self.truths, keys, "nr")
        x = self.exclusive().groupBy(*keys).agg(F.count(F.lit(1)).alias("nrx"))
        out = (
            p.join(r, keys, "left")
            .join(self.owned(), keys, "left")
            .join(x, keys, "left")
            .join(self.n_pred(), ["frame", "pred"])
            .join(self.n_gt(), ["frame", "gt"])
            .na.fill(0)
        )
        for t in self.taus:
            n = tau_name(t)
            prec = F.col(f"np_{n}") / F.greatest(F.col("n_vox"), F.lit(1))
            rec = F.col(f"nr_{n}") / F.greatest(F.col("n_gt_vox"), F.lit(1))
            out = out.withColumn(f"iou_{n}", g.tolerant_iou(prec, rec))
        return out


def by_tau(pairs: DataFrame, taus: Sequence[float]) -> DataFrame:
    """Long form: one row per pair and tolerance."""
    cells = [
        F.struct(
            F.lit(tau_name(t)).alias("tau_cm"),
            F.col(f"np_{tau_name(t)}").alias("n_p"),
            F.col(f"nr_{tau_name(t)}").alias("n_r"),
            F.col(f"iou_{tau_name(t)}").alias("iou"),
        )
        for t in taus
    ]
    keep = ["frame", "gt", "pred", "n_vox", "n_gt_vox"]
    return pairs.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*")


def match(long: DataFrame, threshold: float = rules.MATCH_IOU) -> DataFrame:
    """Best IoU sum over pairs at or above the threshold, per frame and tolerance."""
    return assign(long, ["frame", "tau_cm"], "gt", "pred", "iou", rules.is_match(F.col("iou"), threshold))


def with_duplicates(long: DataFrame, matches: DataFrame, threshold: float = rules.MATCH_IOU) -> DataFrame:
    """The counting policy: an unmatched prediction above the threshold also counts, for its best truth."""
    left = long.join(matches, ["frame", "tau_cm", "pred"], "left_anti").where(rules.is_match(F.col("iou"), threshold))
    extra = left.groupBy("frame", "tau_cm", "pred").agg(
        F.min(F.struct((-F.col("iou")).alias("_n"), F.col("gt"))).alias("_b")
    )
    extra = extra.select("frame", "tau_cm", F.col("_b.gt").alias("gt"), "pred", (-F.col("_b._n")).alias("iou"))
    return matches.unionByName(extra)


def gt_status(scene: Scene, pairs: DataFrame, matches: DataFrame, threshold: float = rules.MATCH_IOU) -> DataFrame:
    """Status of every (frame, gt) at the main tolerance."""
    n = tau_name(scene.main)
    covers = (2 * F.col("nrx") >= F.col("n_gt_vox")) & (F.col("nrx") > 0)
    inside = (2 * F.col("near") >= F.col("n_vox")) & (F.col("near") > 0)
    p = pairs.withColumn("_covers", covers).withColumn("_inside", inside)
    mergers = p.where("_covers").groupBy("frame", "pred").agg((F.count(F.lit(1)) >= 2).alias("_merger"))
    iou = F.col(f"iou_{n}")
    facts = (
        p.join(mergers, ["frame", "pred"], "left")
        .groupBy("frame", "gt")
        .agg(
            F.max(iou).alias("best_iou"),
            F.min(F.when(iou > 0, F.struct((-iou).alias("_n"), F.col("pred")))).alias("_best"),
            F.count_if("_inside").alias("n_frags"),
            F.min(F.when(F.col("_merger") & F.col("_covers"), F.col("pred"))).alias("merged_pred"),
        )
    )
    frags = p.where("_inside").select("frame", "gt", "pred")
    cover = (
        scene.exclusive().join(frags, ["frame", "gt", "pred"], "left_semi")
        .select("frame", "gt", *XYZ).distinct()
        .groupBy("frame", "gt").agg(F.count(F.lit(1)).alias("frag_vox"))
    )
    own = matches.where(F.col("tau_cm") == n).select(
        "frame", "gt", F.col("pred").alias("matched_pred"), F.col("iou").alias("match_iou")
    )
    return (
        scene.n_gt()
        .join(facts, ["frame", "gt"], "left")
        .join(cover, ["frame", "gt"], "left")
        .join(own, ["frame", "gt"], "left")
        .na.fill(0, ["n_frags", "frag_vox"])
        .na.fill(0.0, ["best_iou"])
        .withColumn("best_pred", F.coalesce("_best.pred", F.lit(-1)))
        .withColumn(
            "status",
            rules.gt_status(
                F.col("matched_pred").isNotNull(),
                F.col("merged_pred").isNotNull(),
                F.col("n_frags"),
                2 * F.col("frag_vox") >= F.col("n_gt_vox"),
                F.col("best_iou"),
                threshold,
            ),
        )
        .withColumn("split_cover", F.when(F.col("n_frags") >= 2, F.col("frag_vox") / F.col("n_gt_vox")).otherwise(0.0))
        .drop("_best")
        .na.fill(-1, ["merged_pred", "matched_pred"])
    )


def with_presence(status: DataFrame, present: Column) -> DataFrame:
    """Final status: truths that are not present are ignored, matched or not."""
    final = (
        F.when(present, F.col("status"))
        .when(F.col("matched_pred") >= 0, "ignored_match")
        .otherwise("not_present")
    )
    return status.withColumn("present", present).withColumn("status", final)


def pred_outcome(
    scene: Scene, pairs: DataFrame, matches: DataFrame, present: DataFrame, threshold: float = rules.MATCH_IOU
) -> DataFrame:
    """Outcome of every (frame, pred): tp, ignored_match, fp or excluded, with TIDE error.

    ``present`` holds the (frame, gt) that count.
    """
    n = tau_name(scene.main)
    here = present.select("frame", "gt", F.lit(True).alias("_present"))
    own = (
        matches.where(F.col("tau_cm") == n)
        .join(here, ["frame", "gt"], "left")
        .select("frame", "pred", F.col("gt").alias("matched_gt"), F.coalesce("_present", F.lit(False)).alias("credit"))
    )
    used = matches.where(F.col("tau_cm") == n).select("frame", "gt", F.lit(True).alias("_used"))
    n_valid = present.groupBy("frame").agg(F.count(F.lit(1)).alias("_nv"))
    iou = F.when(F.col("_present"), F.col(f"iou_{n}"))
    used_iou = F.when(F.col("_used"), iou)
    best = (
        pairs.join(here, ["frame", "gt"], "left")
        .join(used, ["frame", "gt"], "left")
        .groupBy("frame", "pred")
        .agg(
            F.max(iou).alias("_best"),
            F.max(used_iou).alias("_best_used"),
            F.min(F.when(F.col("_used") & F.col("_present"), F.struct((-used_iou).alias("_n"), F.col("gt")))).alias("_dupe"),
            F.coalesce(F.sum(F.when(F.col("_present").isNull(), F.col("near"))), F.lit(0)).alias("_ign"),
        )
    )
    rows = (
        scene.void()
        .join(own, ["frame", "pred"], "left")
        .join(best, ["frame", "pred"], "left")
        .join(n_valid, "frame", "left")
        .na.fill(0, ["_ign", "_nv"])
        .withColumn("_reason", rules.unmatched_reason(F.col("n_vox"), F.col("void"), F.col("_ign")))
    )
    matched = F.col("matched_gt").isNotNull()
    tide = rules.tide_error(F.col("_nv"), F.coalesce("_best", F.lit(0.0)), F.coalesce("_best_used", F.lit(-1.0)), threshold)
    return (
        rows.withColumn(
            "pred_status",
            F.when(matched & F.col("credit"), "tp")
            .when(matched, "ignored_match")
            .when(F.col("_reason") == "", "fp")
            .otherwise("excluded"),
        )
        .withColumn("excluded_reason", F.when(matched, "").otherwise(F.col("_reason")))
        .withColumn("tide_error", F.when(matched, "").otherwise(tide))
        .withColumn("dup_of", F.when(F.col("tide_error") == "dupe", F.col("_dupe.gt")))
        .withColumn("ignored", F.col("_ign"))
        .drop("_best", "_best_used", "_dupe", "_ign", "_nv", "_reason")
    )


def top_owners(scene: Scene) -> DataFrame:
    """The two truths owning most voxels of each prediction, with their shares."""
    ranked = scene.owned().join(scene.n_pred(), ["frame", "pred"])
    share = F.col("near") / F.greatest(F.col("n_vox"), F.lit(1))
    first = ranked.groupBy("frame", "pred", "n_vox").agg(
        F.min(F.struct((-F.col("near")).alias("n"), F.col("gt"), share.alias("s"))).alias("_a")
    )
    second = (
        ranked.join(first.select("frame", "pred", "_a"), ["frame", "pred"])
        .where(F.col("gt") != F.col("_a.gt"))
        .groupBy("frame", "pred")
        .agg(F.max(share).alias("second_frac"))
    )
    return first.join(second, ["frame", "pred"], "left").select(
        "frame", "pred", F.col("_a.gt").alias("top_gt"), F.col("_a.s").alias("top_frac"),
        F.coalesce("second_frac", F.lit(0.0)).alias("second_frac"),
    )


def match_accuracy(scene: Scene, matches: DataFrame, clouds: DataFrame) -> DataFrame:
    """Distance of every voxel of a matched prediction to the full cloud of its truth."""
    n = tau_name(scene.main)
    own = matches.where(F.col("tau_cm") == n).select("frame", "pred", "gt")
    vox = scene.preds.join(own, ["frame", "pred"])
    d = nearest(vox.select("gt", *XYZ), clouds, ["gt"], out="d")
    return vox.join(d, ["gt", *XYZ]).select("frame", "pred", "gt", "d")


def episode_coverage(scene: Scene, matches: DataFrame, credited: DataFrame, clouds: DataFrame) -> DataFrame:
    """Share of each truth's cloud within the main tolerance of any credited prediction."""
    n = tau_name(scene.main)
    own = matches.where(F.col("tau_cm") == n).join(credited, ["frame", "gt"], "left_semi").select("frame", "pred", "gt")
    vox = scene.preds.join(own, ["frame", "pred"]).select("gt", *XYZ).distinct()
    ref = clouds.select("gt", *XYZ).distinct()
    d = nearest(ref, vox, ["gt"], bound=scene.main, out="d")
    hit = d.where(rules.within(F.col("d"), scene.main)).groupBy("gt").agg(F.count(F.lit(1)).alias("_h"))
    total = ref.groupBy("gt").agg(F.count(F.lit(1)).alias("_n"))
    return (
        total.join(own.select("gt").distinct(), "gt", "left_semi")
        .join(hit, "gt", "left")
        .select("gt", (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("coverage"))
    )


def mode_reason(rows: DataFrame, keys: Sequence[str], status: str, order: Sequence[str], default: str) -> DataFrame:
    """Most frequent status per key; ties go to the one listed first."""
    rank = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(order)])
    counts = rows.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*keys).agg(
        F.min(F.when(rank.isNotNull(), F.struct((-F.col("_c")).alias("_n"), rank.alias("_r"), F.col(status)))).alias("_b")
    )
    return best.select(*keys, F.coalesce(F.col(f"_b.{status}"), F.lit(default)).alias("reason"))
