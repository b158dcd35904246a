"""Scores of one stage fed to the next: 3D matches to tracking inputs to tracking scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import matching3d as m3
from sightline.operators import mot
from sightline.plans import detection as de
from sightline.plans import tracking as tk
from sightline.plans.registry import query
from sightline.session import durable

SEQUENCE = 50  # frames of a sequence
HUMAN = 5  # every fifth object is a person

_M = m3.tau_name(de.MAIN)

# Truths that count, predictions with the reason they do not, and the pairs of what is left.
_STAGE = f"""WITH {de.OUTCOME_SQL},
val AS (SELECT frame, gt FROM pres WHERE gt % {HUMAN} <> {HUMAN - 1}),
ig AS (SELECT o.frame, o.pred, sum(near)::BIGINT AS ignored FROM owned o LEFT JOIN val ON val.frame = o.frame AND val.gt = o.gt
  WHERE val.gt IS NULL GROUP BY ALL),
wy AS (SELECT vd.frame, vd.pred, CASE WHEN n_vox <= 0 THEN 'no_voxels_within_range'
    WHEN mm.gt % {HUMAN} = {HUMAN - 1} THEN 'matched_human_gt' WHEN mm.gt IS NOT NULL AND pres.gt IS NULL THEN 'matched_non_present_gt'
    WHEN mm.gt IS NULL AND 2 * (void + coalesce(ig.ignored, 0)) > n_vox THEN 'mostly_ignore_region' END AS reason
  FROM vd LEFT JOIN mm ON mm.frame = vd.frame AND mm.pred = vd.pred LEFT JOIN ig ON ig.frame = vd.frame AND ig.pred = vd.pred
  LEFT JOIN pres ON pres.frame = mm.frame AND pres.gt = mm.gt)
SELECT 'truth' AS kind, frame, gt, NULL::BIGINT AS trk, NULL::DOUBLE AS sim, NULL::VARCHAR AS reason FROM val
UNION ALL SELECT CASE WHEN reason IS NULL THEN 'track' ELSE 'removed' END, frame, NULL, pred, NULL, reason FROM wy
UNION ALL SELECT 'pair', frame, gt, pred, iou_{_M}, NULL FROM io JOIN val USING (frame, gt) JOIN (SELECT frame, pred FROM wy WHERE reason IS NULL) USING (frame, pred)
  WHERE iou_{_M} > 0"""

_SOURCE = f"""sg AS MATERIALIZED ({_STAGE}),
truths AS (SELECT frame // {SEQUENCE} AS seq, frame AS t, gt FROM sg WHERE kind = 'truth'),
tracks AS (SELECT frame // {SEQUENCE} AS seq, frame AS t, trk FROM sg WHERE kind = 'track'),
mpair AS (SELECT frame // {SEQUENCE} AS seq, frame AS t, gt, trk, sim FROM sg WHERE kind = 'pair')"""


def inputs(spark, sf):
    """Truths, tracks, pairs and removed predictions of the scored 3D scene."""
    scene, pairs, matches = de.scored(spark, sf)
    seq = F.floor(F.col("frame") / SEQUENCE).alias("seq")
    t = F.col("frame").alias("t")
    human = F.col("gt") % HUMAN == HUMAN - 1
    gt_rows = durable(
        scene.n_gt().select(seq, t, "gt", (F.col("n_gt_vox") >= de.PRESENT_MIN).alias("present"), human.alias("is_human")), "tracking-truths"
    )
    valid = gt_rows.where("present AND NOT is_human").select(F.col("t").alias("frame"), "gt")
    ignored = scene.owned().join(valid, ["frame", "gt"], "left_anti").groupBy("frame", "pred").agg(F.sum("near").alias("ignored"))
    main = matches.where(F.col("tau_cm") == int(_M)).select("frame", "pred", F.col("gt").alias("matched_gt"))
    outcomes = (
        scene.void().join(main, ["frame", "pred"], "left").join(ignored, ["frame", "pred"], "left").na.fill(0, ["ignored"])
        .select(seq, t, "pred", F.col("pred").alias("trk"), "n_vox", "void", "ignored", "matched_gt")
    )
    similarity = pairs.select(seq, t, "gt", "pred", F.col(f"iou_{_M}").alias("sim"))
    return tuple(durable(x, "tracking-inputs") for x in mot.tracking_inputs(gt_rows, outcomes, similarity))


@query("tracking_exclusions", f"SELECT frame // {SEQUENCE} AS seq, frame AS t, trk, reason FROM ({_STAGE}) WHERE kind = 'removed'")
def tracking_exclusions(spark, sf):
    """Predictions left out of tracking, with the first reason that holds."""
    return inputs(spark, sf)[3]


def _with_source(sql: str) -> str:
    """A tracking query over the scored scene instead of the event stream."""
    return f"RECURSIVE {_SOURCE},\nst AS" + sql.split("\nst AS", 1)[1]


@query("scored_tracking", f"WITH {_with_source(tk.CLEAR_SQL)}{tk._METRICS_SQL}")
def scored_tracking(spark, sf):
    """3D matching to tracking inputs to CLEAR totals, in one query."""
    truths, tracks, pairs, _ = inputs(spark, sf)
    steps = durable(mot.active_steps(truths, tracks), "steps")
    return mot.clear_metrics(truths, tracks, durable(mot.clear_matches(pairs, steps), "clear"))


@query("scored_identity", f"""WITH RECURSIVE {_SOURCE},
co AS{tk.IDENTITY_SQL.split(chr(10) + "co AS", 1)[1]}""")
def scored_identity(spark, sf):
    """Identity scores of the scored 3D scene."""
    return mot.identity_metrics(*inputs(spark, sf)[:3])
