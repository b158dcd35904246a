"""Multi-object tracking scores: CLEAR, identity and HOTA.

Inputs, all keyed by ``seq`` and timestep ``t``:
truths (seq, t, gt), tracks (seq, t, trk) and pairs (seq, t, gt, trk, sim > 0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import rules
from sightline.operators.assignment import assign, best_total
from sightline.operators.ordered import SLICE, carry, prefix_sum, sliced
from sightline.session import durable

KEEP_BONUS = 1000.0
CHUNK_STEPS = 1024


# ------------------------------------------------------------ CLEAR matching

def active_steps(truths: DataFrame, tracks: DataFrame) -> DataFrame:
    """Timesteps with both truths and tracks, numbered per sequence from 0."""
    both = truths.select("seq", "t").distinct().join(tracks.select("seq", "t").distinct(), ["seq", "t"])
    s = sliced(both, ["seq"], ["t"])
    return prefix_sum(s, ["seq"], ["t"], F.lit(1).cast("long"), "step", inclusive=False).drop(SLICE)


def _solve_chunk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Match the timesteps of one chunk in order, given the pairs kept from before."""
    out = []
    kept = set(zip(right["gt"], right["trk"]))
    for step, rows in left.sort_values("step").groupby("step", sort=True):
        real = rows[rows["gt"].notna()]
        picks = []
        if len(real):
            g, gi = np.unique(real["gt"].to_numpy(), return_inverse=True)
            c, ci = np.unique(real["trk"].to_numpy(), return_inverse=True)
            w = np.zeros((len(g), len(c)))
            w[gi, ci] = real["sim"].to_numpy(float)
            sim = w.copy()
            for a, b in kept:
                i, j = np.searchsorted(g, a), np.searchsorted(c, b)
                if i < len(g) and j < len(c) and g[i] == a and c[j] == b and w[i, j] > 0:
                    w[i, j] += KEEP_BONUS
            picks = [(g[i], c[j], sim[i, j]) for i, j in best_total(w) if w[i, j] > 0]
        kept = {(a, b) for a, b, _ in picks}
        out += [(step, a, b, s) for a, b, s in picks]
    res = pd.DataFrame(out, columns=["step", "gt", "trk", "sim"])
    src = left if len(left) else right
    res.insert(0, "chunk", int(src["chunk"].iloc[0]))
    res.insert(0, "seq", src["seq"].iloc[0])
    return res.astype({"step": "int64", "gt": "int64", "trk": "int64", "sim": "float64"})


def clear_matches(
    pairs: DataFrame, steps: DataFrame, threshold: float = rules.MATCH_IOU, chunk_steps: int = CHUNK_STEPS
) -> DataFrame:
    """Matches of every active timestep, preferring the pairs of the one before.

    A sequence is cut into chunks of timesteps solved in parallel. Each chunk
    first assumes that nothing is kept from before; then the pairs at the end of
    each chunk are handed to the next and only chunks whose hand-over changed
    are solved again, until none changes. The result equals the step-by-step
    run, and a hand-over rarely matters beyond a few timesteps.
    """
    cand = pairs.where(rules.is_match(F.col("sim"), threshold)).select("seq", "t", "gt", "trk", "sim")
    cand = durable(
        steps.join(cand, ["seq", "t"], "left").withColumn("chunk", F.floor(F.col("step") / chunk_steps)).drop("t"),
        "clear-candidates",
    )
    schema = "seq long, chunk long, step long, gt long, trk long, sim double"
    empty = cand.select("seq", "chunk", "gt", "trk").where("false")

    def solve(rows: DataFrame, handed: DataFrame) -> DataFrame:
        return (
            rows.groupBy("seq", "chunk").cogroup(handed.groupBy("seq", "chunk")).applyInPandas(_solve_chunk, schema)
        )

    def hand_over(matches: DataFrame) -> DataFrame:
        last = (F.col("chunk") + 1) * chunk_steps - 1
        return matches.where(F.col("step") == last).select("seq", (F.col("chunk") + 1).alias("chunk"), "gt", "trk")

    def signature(handed: DataFrame) -> DataFrame:
        kept = F.sort_array(F.collect_list(F.struct("gt", "trk")))
        return handed.groupBy("seq", "chunk").agg(F.to_json(kept).alias("sig"))

    chunks = cand.select("seq", "chunk").distinct()
    matches = durable(solve(cand, empty), "clear-matches")
    used = signature(empty)
    while True:
        handed = durable(hand_over(matches).join(chunks, ["seq", "chunk"], "left_semi"), "clear-handed")
        now = signature(handed)
        old = used.select("seq", "chunk", F.col("sig").alias("old"))
        changed = now.join(old, ["seq", "chunk"], "full").where(~F.col("sig").eqNullSafe(F.col("old")))
        changed = durable(changed.select("seq", "chunk"), "clear-changed")
        if changed.isEmpty():
            break
        redo = cand.join(changed, ["seq", "chunk"], "left_semi")
        fresh = solve(redo, handed.join(changed, ["seq", "chunk"], "left_semi"))
        matches = durable(matches.join(changed, ["seq", "chunk"], "left_anti").unionByName(fresh), "clear-matches")
        used = now
    return steps.join(matches.drop("chunk"), ["seq", "step"]).select("seq", "t", "step", "gt", "trk", "sim")


# ------------------------------------------------------------- track events

def track_events(matches: DataFrame) -> DataFrame:
    """Per (seq, gt): matched steps, id switches, segments and distinct ids.

    ``step`` counts active timesteps, so a segment ends when a step is skipped.
    """
    rows = sliced(matches.select("seq", "gt", "step", "trk"), ["seq", "gt"], ["step"])
    prev = carry(rows, ["seq", "gt"], ["step"], F.struct("step", "trk"), "_p", inclusive=False)
    return prev.groupBy("seq", "gt").agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.count_if(F.col("_p").isNotNull() & (F.col("_p.trk") != F.col("trk"))).alias("idsw"),
        F.count_if(F.col("_p").isNull() | (F.col("_p.step") < F.col("step") - 1)).alias("segments"),
        F.countDistinct("trk").alias("n_ids"),
    )


def timeline(truths: DataFrame, matches: DataFrame) -> DataFrame:
    """Every truth at every timestep with its matched track, NULL when missed."""
    return truths.join(matches.select("seq", "t", "gt", "trk"), ["seq", "t", "gt"], "left")


def clear_metrics(truths: DataFrame, tracks: DataFrame, matches: DataFrame) -> DataFrame:
    ev = track_events(matches)
    per_gt = (
        truths.groupBy("seq", "gt").agg(F.count(F.lit(1)).alias("n"))
        .join(ev, ["seq", "gt"], "left")
        .na.fill(0)
    )
    mt = 5 * F.col("n_matched") >= 4 * F.col("n")
    pt = 5 * F.col("n_matched") >= F.col("n")
    g = per_gt.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n_gt_tracks"),
        F.sum("n").alias("gt_detections"),
        F.sum("n_matched").alias("TP"),
        F.sum("idsw").alias("IDSW"),
        F.sum(F.greatest(F.col("segments") - 1, F.lit(0))).alias("Frag"),
        F.count_if(mt).alias("MT"),
        F.count_if(pt & ~mt).alias("PT"),
        F.count_if(~pt).alias("ML"),
        F.count_if(5 * F.col("n_matched") == 4 * F.col("n")).alias("MT_ratio_eq_80"),
        F.avg(F.when(F.col("n_ids") > 0, F.col("n_ids"))).alias("mean_ids_per_track"),
    )
    p = tracks.groupBy("seq").agg(
        F.count(F.lit(1)).alias("pred_detections"), F.countDistinct("trk").alias("n_pred_ids")
    )
    fn = F.col("gt_detections") - F.col("TP")
    fp = F.col("pred_detections") - F.col("TP")
    counts = ["n_gt_tracks", "gt_detections", "TP", "IDSW", "Frag", "MT", "PT", "ML", "MT_ratio_eq_80"]
    return (
        g.join(p, "seq", "full").na.fill(0, [*counts, "pred_detections", "n_pred_ids"])
        .withColumns({"FN": fn, "FP": fp})
        .withColumn("MOTA", 1 - rules.ratio(F.col("FN") + F.col("FP") + F.col("IDSW"), F.col("gt_detections")))
    )


# ----------------------------------------------------------------- identity

def cooccurrence(pairs: DataFrame, threshold: float = rules.MATCH_IOU) -> DataFrame:
    return pairs.where(F.col("sim") >= threshold).groupBy("seq", "gt", "trk").agg(F.count(F.lit(1)).alias("n"))


def totals(truths: DataFrame, tracks: DataFrame) -> DataFrame:
    a = truths.groupBy("seq").agg(F.count(F.lit(1)).alias("n_gt"))
    b = tracks.groupBy("seq").agg(F.count(F.lit(1)).alias("n_trk"))
    return a.join(b, "seq", "full").na.fill(0)


def identity_metrics(
    truths: DataFrame, tracks: DataFrame, pairs: DataFrame, threshold: float = rules.MATCH_IOU
) -> DataFrame:
    """Track-level assignment of truths to ids by shared timesteps."""
    pot = cooccurrence(pairs, threshold)
    best = assign(pot, ["seq"], "gt", "trk", "n", F.col("n") > 0)
    idtp = best.groupBy("seq").agg(F.sum("n").cast("long").alias("IDTP"))
    n = totals(truths, tracks).join(idtp, "seq", "left").na.fill(0, ["IDTP"])
    return n.select(
        "seq",
        "IDTP",
        (F.col("n_trk") - F.col("IDTP")).alias("IDFP"),
        (F.col("n_gt") - F.col("IDTP")).alias("IDFN"),
        rules.ratio(2 * F.col("IDTP"), F.col("n_gt") + F.col("n_trk")).alias("IDF1"),
        rules.ratio(F.col("IDTP"), F.col("n_gt")).alias("IDR"),
        rules.ratio(F.col("IDTP"), F.col("n_trk")).alias("IDP"),
    )


# --------------------------------------------------------------------- HOTA

def alignment(truths: DataFrame, tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Global alignment of every (gt, trk): shared potential over the union of their lifetimes."""
    # Row and column sums of one timestep: few rows per window.
    row = F.sum("sim").over(Window.partitionBy("seq", "t", "gt"))
    col = F.sum("sim").over(Window.partitionBy("seq", "t", "trk"))
    den = F.col("_rs") + F.col("_cs") - F.col("sim")
    pot = (
        pairs.withColumns({"_rs": row, "_cs": col})
        .withColumn("_s", F.when(den > rules.RATIO_EPS, F.col("sim") / den).otherwise(0.0))
        .groupBy("seq", "gt", "trk").agg(F.sum("_s").alias("potential"))
    )
    ng = truths.groupBy("seq", "gt").agg(F.count(F.lit(1)).alias("n_gt"))
    nt = tracks.groupBy("seq", "trk").agg(F.count(F.lit(1)).alias("n_trk"))
    return (
        pot.join(ng, ["seq", "gt"]).join(nt, ["seq", "trk"])
        .withColumn("align", F.col("potential") / (F.col("n_gt") + F.col("n_trk") - F.col("potential")))
    )


def hota_matches(pairs: DataFrame, align: DataFrame, alpha: float = rules.MATCH_IOU) -> DataFrame:
    """Per-timestep assignment on alignment times similarity; similarities below alpha are dropped after."""
    scored = pairs.join(align.select("seq", "gt", "trk", "align"), ["seq", "gt", "trk"]).withColumn(
        "score", F.col("align") * F.col("sim")
    )
    got = assign(scored, ["seq", "t"], "gt", "trk", "score", F.col("score") > 0)
    return got.join(pairs, ["seq", "t", "gt", "trk"]).where(rules.is_match(F.col("sim"), alpha))


def hota_metrics(truths: DataFrame, tracks: DataFrame, matches: DataFrame) -> DataFrame:
    ng = truths.groupBy("seq", "gt").agg(F.count(F.lit(1)).alias("n_gt"))
    nt = tracks.groupBy("seq", "trk").agg(F.count(F.lit(1)).alias("n_trk"))
    m = matches.groupBy("seq", "gt", "trk").agg(F.count(F.lit(1)).alias("m"))
    m = m.join(ng, ["seq", "gt"]).join(nt, ["seq", "trk"])
    share = {
        "_a": F.col("m") * F.col("m") / (F.col("n_gt") + F.col("n_trk") - F.col("m")),
        "_r": F.col("m") * F.col("m") / F.col("n_gt"),
        "_p": F.col("m") * F.col("m") / F.col("n_trk"),
    }
    ass = m.groupBy("seq").agg(F.sum("m").alias("HOTA_TP"), *[F.sum(e).alias(k) for k, e in share.items()])
    n = totals(truths, tracks).join(ass, "seq", "left").na.fill(0, ["HOTA_TP"])
    tp = F.col("HOTA_TP")
    det = rules.ratio(tp, F.col("n_gt") + F.col("n_trk") - tp)
    return n.select(
        "seq",
        "HOTA_TP",
        (F.col("n_gt") - tp).alias("HOTA_FN"),
        (F.col("n_trk") - tp).alias("HOTA_FP"),
        det.alias("DetA"),
        rules.ratio(tp, F.col("n_gt")).alias("DetRe"),
        rules.ratio(tp, F.col("n_trk")).alias("DetPr"),
        rules.ratio(F.col("_a"), tp).alias("AssA"),
        rules.ratio(F.col("_r"), tp).alias("AssRe"),
        rules.ratio(F.col("_p"), tp).alias("AssPr"),
        F.when(det.isNotNull(), F.coalesce(F.sqrt(det * rules.ratio(F.col("_a"), tp)), F.lit(0.0))).alias("HOTA"),
    )


# ---------------------------------------------------------------- input rows

def tracking_inputs(
    gt_rows: DataFrame, outcomes: DataFrame, similarity: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Truths, tracks, pairs and removed predictions from 3D scoring rows.

    gt_rows     (seq, t, gt, present, is_human)
    outcomes    (seq, t, pred, trk, n_vox, void, ignored, matched_gt): ``ignored``
                counts voxels owned by truths that are not valid here
    similarity  (seq, t, gt, pred, sim)
    """
    valid = gt_rows.where("present AND NOT is_human").select("seq", "t", "gt")
    own = gt_rows.select("seq", "t", F.col("gt").alias("matched_gt"), "present", "is_human")
    o = outcomes.join(own, ["seq", "t", "matched_gt"], "left")
    why = (
        F.when(F.col("n_vox") <= 0, "no_voxels_within_range")
        .when(F.col("matched_gt").isNotNull() & F.col("is_human"), "matched_human_gt")
        .when(F.col("matched_gt").isNotNull() & ~F.col("present"), "matched_non_present_gt")
        .when(
            F.col("matched_gt").isNull()
            & (rules.unmatched_reason(F.col("n_vox"), F.col("void"), F.col("ignored")) != ""),
            "mostly_ignore_region",
        )
    )
    o = o.withColumn("reason", why)
    kept = o.where("reason IS NULL").select("seq", "t", "pred", "trk")
    pairs = (
        similarity.where("sim > 0").join(kept, ["seq", "t", "pred"]).join(valid, ["seq", "t", "gt"], "left_semi")
        .select("seq", "t", "gt", "trk", "sim")
    )
    removed = o.where("reason IS NOT NULL").select("seq", "t", "trk", "reason")
    return valid, kept.select("seq", "t", "trk"), pairs, removed
