"""Decision rules shared by the 2D and 3D scorers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
DIST_EPS = 1e-5
RATIO_EPS = 2.220446049250313e-16
TIE_M = 1e-9
MATCH_IOU = 0.5
LOC_MIN_IOU = 0.1
AREA_MIN_PX = 1600
AREA_MIN_CELLS = 256
THETAS = (0.25, 0.5, 0.75)
TAUS_M = (0.1, 0.2, 0.5)
MAIN_TAU_M = 0.2
HUMAN_COLOURS = ("23d5ea",)
STATUS_ORDER = ("merged", "split", "low_iou", "missed")
LEVELS = ("easy", "moderate", "hard", "beyond")


def within(dist: Column, tau: float) -> Column:
    return dist < F.lit(tau - DIST_EPS)


def is_match(iou: Column, threshold: float = MATCH_IOU) -> Column:
    return iou >= F.lit(threshold - RATIO_EPS)


def is_loc(iou: Column, pos: float = MATCH_IOU) -> Column:
    """Localisation range, closed at both ends."""
    return iou.between(LOC_MIN_IOU - RATIO_EPS, pos + RATIO_EPS)


def is_human(colour: Column) -> Column:
    return F.regexp_replace(colour, "^#+", "").isin(*HUMAN_COLOURS)


def gt_status(matched: Column, merged: Column, n_frags: Column, frag_cover2: Column, best_iou: Column, pos: float) -> Column:
    """Why a ground truth is or is not found; ``frag_cover2`` = fragments cover at least half."""
    return (
        F.when(matched, "tp")
        .when(merged, "merged")
        .when((n_frags >= 2) & frag_cover2, "split")
        .when(is_loc(best_iou, pos), "low_iou")
        .otherwise("missed")
    )


def unmatched_reason(n: Column, void: Column, ignored: Column) -> Column:
    """Empty text for a false positive, otherwise the reason the prediction is left out.

    Exactly half on ignored ground is still a false positive.
    """
    return (
        F.when(n <= 0, "no_voxels_within_range")
        .when(2 * (void + ignored) <= n, "")
        .when(2 * void > n, "void")
        .when(2 * ignored > n, "ignored_gt")
        .otherwise("void+ignored_gt")
    )


def tide_error(n_valid: Column, best: Column, best_used: Column, pos: float = MATCH_IOU) -> Column:
    """Error kind of an unmatched prediction from its best IoU over valid and over used truths."""
    return (
        F.when(n_valid == 0, "bkg")
        .when(is_loc(best, pos), "loc")
        .when(best_used >= pos - RATIO_EPS, "dupe")
        .when(best <= LOC_MIN_IOU + RATIO_EPS, "bkg")
        .otherwise("other")
    )


def difficulty(min_dim: Column, trunc: Column, occ: Column, at_border: Column) -> Column:
    """0 easy, 1 moderate, 2 hard, 3 beyond; negative shares mean unknown."""
    unknown = trunc < 0
    t = F.when(unknown, 0.0).otherwise(trunc)
    o = F.when(occ < 0, 0.0).otherwise(occ)
    return (
        F.when((min_dim > 40) & (t <= 0.15) & (o <= 0.20) & ~(unknown & at_border), 0)
        .when((min_dim > 25) & (t <= 0.30) & (o <= 0.50), 1)
        .when((min_dim > 25) & (t <= 0.50), 2)
        .otherwise(3)
    )


def ratio(num: Column, den: Column) -> Column:
    """NULL when the denominator is 0."""
    return F.when(den != 0, num / den)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return num / F.greatest(den, F.lit(1))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)
