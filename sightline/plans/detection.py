"""3D detection scores over the embedding surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import matching3d as m3
from sightline.operators import rules
from sightline.operators.quantiles import exact_quantiles
from sightline.plans.registry import query
from sightline.session import durable
from sightline.sources import tables as t

SIZE = 0.05
TAUS = (0.1, 0.16, 0.24)
MAIN = 0.16
PRESENT_MIN = 8

_D = "sqrt((p.x-g.x)*(p.x-g.x) + (p.y-g.y)*(p.y-g.y) + (p.z-g.z)*(p.z-g.z))"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE d < {tau} - 1e-5) AS {{s}}_{m3.tau_name(tau)}" for tau in TAUS)
_M = m3.tau_name(MAIN)

PAIRS_SQL = f"""{t.SURFACES_SQL.format(v=SIZE, spread=t.SPREAD)},
dd AS (SELECT frame, gt, pred, p.x AS px, p.y AS py, p.z AS pz, g.x AS gx, g.y AS gy, g.z AS gz, {_D} AS d
  FROM pv p JOIN gv g USING (frame)),
tog AS (SELECT frame, pred, px, py, pz, gt, min(d) AS d FROM dd GROUP BY ALL),
top AS (SELECT frame, gt, gx, gy, gz, pred, min(d) AS d FROM dd GROUP BY ALL),
p AS (SELECT frame, gt, pred, {_COUNTS.format(s='np')} FROM tog WHERE d < {max(TAUS)} GROUP BY ALL),
r AS (SELECT frame, gt, pred, {_COUNTS.format(s='nr')} FROM top WHERE d < {max(TAUS)} GROUP BY ALL),
dmin AS (SELECT frame, pred, px, py, pz, min(d) AS m FROM tog WHERE d < {MAIN} - 1e-5 GROUP BY ALL),
owner AS (SELECT frame, pred, px, py, pz, min(gt) AS gt FROM tog JOIN dmin USING (frame, pred, px, py, pz)
  WHERE d <= m + 1e-9 GROUP BY ALL),
owned AS (SELECT frame, pred, gt, count(*) AS near FROM owner GROUP BY ALL),
dall AS (SELECT frame, gt, gx, gy, gz, min(d) AS dall FROM top GROUP BY ALL),
dj AS (SELECT dd.frame, dd.gt, gx, gy, gz, dd.pred, min(d) AS dj FROM dd JOIN owner USING (frame, pred, px, py, pz, gt)
  GROUP BY ALL),
cover AS (SELECT frame, gt, pred, gx, gy, gz FROM dj JOIN dall USING (frame, gt, gx, gy, gz)
  WHERE dj < {MAIN} - 1e-5 AND dj <= dall + 1e-9),
x AS (SELECT frame, gt, pred, count(*) AS nrx FROM cover GROUP BY ALL),
npv AS (SELECT frame, pred, count(*) AS n_vox FROM pv GROUP BY ALL),
ngv AS (SELECT frame, gt, count(*) AS n_gt_vox FROM gv GROUP BY ALL),
pr AS (SELECT p.*, r.* EXCLUDE (frame, gt, pred), coalesce(near, 0) AS near, coalesce(nrx, 0) AS nrx, n_vox, n_gt_vox
  FROM p JOIN r USING (frame, gt, pred) LEFT JOIN owned USING (frame, gt, pred) LEFT JOIN x USING (frame, gt, pred)
  JOIN npv USING (frame, pred) JOIN ngv USING (frame, gt))"""


def _iou(tau: float) -> str:
    n = m3.tau_name(tau)
    p, r = f"(np_{n} / n_vox)", f"(nr_{n} / n_gt_vox)"
    return f"CASE WHEN {p} + {r} - {p} * {r} > 0 THEN {p} * {r} / ({p} + {r} - {p} * {r}) ELSE 0 END AS iou_{n}"


_IOUS = ", ".join(_iou(tau) for tau in TAUS)


def scene(spark, sf) -> m3.Scene:
    gt, pred = t.surfaces(spark, sf, SIZE)
    return m3.Scene(durable(pred, "preds"), durable(gt, "truths"), TAUS, MAIN, SIZE)


def scored(spark, sf):
    s = scene(spark, sf)
    pairs = durable(s.pairs(), "pairs3d")
    matches = m3.match(m3.by_tau(pairs, TAUS))
    return s, pairs, durable(matches, "matches3d")


def present_of(s: m3.Scene):
    return s.n_gt().where(F.col("n_gt_vox") >= PRESENT_MIN).select("frame", "gt")


@query("pair_stats", f"WITH {PAIRS_SQL} SELECT *, {_IOUS} FROM pr")
def pair_stats(spark, sf):
    return scene(spark, sf).pairs()


@query("void_share", f"""WITH {PAIRS_SQL}
SELECT frame, pred, n_vox, (n_vox - coalesce(s, 0))::BIGINT AS void
FROM npv LEFT JOIN (SELECT frame, pred, sum(near) AS s FROM owned GROUP BY ALL) USING (frame, pred)""")
def void_share(spark, sf):
    return scene(spark, sf).void()


@query("top_owners", f"""WITH {PAIRS_SQL}, s AS (SELECT frame, pred, gt, near, near / n_vox AS share,
  row_number() OVER (PARTITION BY frame, pred ORDER BY near DESC, gt) AS rn FROM owned JOIN npv USING (frame, pred))
SELECT frame, pred, max(gt) FILTER (WHERE rn = 1) AS top_gt, max(share) FILTER (WHERE rn = 1) AS top_frac,
  coalesce(max(share) FILTER (WHERE rn = 2), 0) AS second_frac FROM s GROUP BY ALL""")
def top_owners(spark, sf):
    return m3.top_owners(scene(spark, sf))


# The SQL side lists the candidate pairs; choosing among them is left to the solver.
@query("match_candidates", f"""WITH {PAIRS_SQL}, io AS (SELECT *, {_IOUS} FROM pr),
l AS ({' UNION ALL '.join(f"SELECT frame, gt, pred, {m3.tau_name(x)} AS tau_cm, iou_{m3.tau_name(x)} AS iou FROM io" for x in TAUS)})
SELECT tau_cm, count(*) AS n_pairs, count(*) FILTER (WHERE iou >= 0.5 - 2.220446049250313e-16) AS n_candidates,
  round(sum(iou), 6) AS sum_iou FROM l GROUP BY tau_cm""")
def match_candidates(spark, sf):
    long = m3.by_tau(scene(spark, sf).pairs(), TAUS)
    return long.groupBy("tau_cm").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(rules.is_match(F.col("iou"))).alias("n_candidates"),
        F.round(F.sum("iou"), 6).alias("sum_iou"),
    )


_EPS = "2.220446049250313e-16"
_LONG = " UNION ALL ".join(
    f"SELECT frame, {m3.tau_name(x)}::INT AS tau_cm, gt, pred, iou_{m3.tau_name(x)} AS iou FROM io" for x in TAUS
)

# Every way to give the truths of a frame, one after the other, a free candidate or none; the best total wins.
MATCH_SQL = f"""RECURSIVE {PAIRS_SQL}, io AS (SELECT *, {_IOUS} FROM pr), lg AS ({_LONG}),
ca AS (SELECT *, dense_rank() OVER (PARTITION BY frame, tau_cm ORDER BY gt) AS k FROM lg WHERE iou >= 0.5 - {_EPS}),
op AS (SELECT frame, tau_cm, gt, pred, iou, k FROM ca UNION ALL SELECT DISTINCT frame, tau_cm, gt, -1, 0.0, k FROM ca),
ch AS (SELECT DISTINCT frame, tau_cm, 0::BIGINT AS k, 0.0::DOUBLE AS total, []::STRUCT(gt BIGINT, pred BIGINT, iou DOUBLE)[] AS picks FROM ca
  UNION ALL
  SELECT c.frame, c.tau_cm, o.k, c.total + o.iou, CASE WHEN o.pred < 0 THEN c.picks ELSE list_append(c.picks, {{'gt': o.gt, 'pred': o.pred, 'iou': o.iou}}) END
  FROM ch c JOIN op o ON o.frame = c.frame AND o.tau_cm = c.tau_cm AND o.k = c.k + 1
    AND (o.pred < 0 OR len(list_filter(c.picks, lambda x: x.pred = o.pred)) = 0)),
fu AS (SELECT frame, tau_cm, arg_max(picks, (k, total)) AS picks FROM ch GROUP BY ALL),
mt AS (SELECT frame, tau_cm, p.gt AS gt, p.pred AS pred, p.iou AS iou FROM (SELECT frame, tau_cm, unnest(picks) AS p FROM fu)),
mm AS (SELECT frame, gt, pred, iou FROM mt WHERE tau_cm = {_M}),
pres AS (SELECT frame, gt FROM ngv WHERE n_gt_vox >= {PRESENT_MIN})"""

STATUS_SQL = f"""{MATCH_SQL},
cov AS (SELECT frame, pred, gt FROM pr WHERE 2 * nrx >= n_gt_vox AND nrx > 0),
mg AS (SELECT frame, pred FROM cov GROUP BY ALL HAVING count(*) >= 2),
ins AS (SELECT frame, gt, pred FROM pr WHERE 2 * near >= n_vox AND near > 0),
fv AS (SELECT frame, gt, count(*) AS frag_vox FROM (SELECT DISTINCT frame, gt, gx, gy, gz FROM cover JOIN ins USING (frame, gt, pred)) GROUP BY ALL),
fa AS (SELECT frame, gt, max(iou_{_M}) AS best_iou, arg_min(pred, (-iou_{_M}, pred)) FILTER (WHERE iou_{_M} > 0) AS best_pred FROM io GROUP BY ALL),
ni AS (SELECT frame, gt, count(*) AS n_frags FROM ins GROUP BY ALL),
mp AS (SELECT frame, gt, min(pred) AS merged_pred FROM cov JOIN mg USING (frame, pred) GROUP BY ALL),
st0 AS (SELECT frame, gt, n_gt_vox, coalesce(best_iou, 0) AS best_iou, coalesce(best_pred, -1) AS best_pred, coalesce(n_frags, 0) AS n_frags,
  coalesce(frag_vox, 0) AS frag_vox, coalesce(merged_pred, -1) AS merged_pred, coalesce(mm.pred, -1) AS matched_pred, mm.iou AS match_iou,
  n_gt_vox >= {PRESENT_MIN} AS present FROM ngv LEFT JOIN fa USING (frame, gt) LEFT JOIN ni USING (frame, gt) LEFT JOIN fv USING (frame, gt)
  LEFT JOIN mp USING (frame, gt) LEFT JOIN mm USING (frame, gt)),
st AS (SELECT *, CASE WHEN NOT present THEN CASE WHEN matched_pred >= 0 THEN 'ignored_match' ELSE 'not_present' END
  WHEN matched_pred >= 0 THEN 'tp' WHEN merged_pred >= 0 THEN 'merged' WHEN n_frags >= 2 AND 2 * frag_vox >= n_gt_vox THEN 'split'
  WHEN best_iou BETWEEN 0.1 - {_EPS} AND 0.5 + {_EPS} THEN 'low_iou' ELSE 'missed' END AS status,
  CASE WHEN n_frags >= 2 THEN frag_vox / n_gt_vox ELSE 0 END AS split_cover FROM st0)"""

OUTCOME_SQL = f"""{MATCH_SQL},
be AS (SELECT io.frame, io.pred, max(iou_{_M}) FILTER (WHERE pres.gt IS NOT NULL) AS best, max(iou_{_M}) FILTER (WHERE pres.gt IS NOT NULL AND mm.gt IS NOT NULL) AS best_used,
  arg_min(io.gt, (-iou_{_M}, io.gt)) FILTER (WHERE pres.gt IS NOT NULL AND mm.gt IS NOT NULL) AS dupe, coalesce(sum(near) FILTER (WHERE pres.gt IS NULL), 0)::BIGINT AS ignored
  FROM io LEFT JOIN pres ON pres.frame = io.frame AND pres.gt = io.gt LEFT JOIN (SELECT frame AS mf, gt FROM mm) mm ON mm.mf = io.frame AND mm.gt = io.gt GROUP BY io.frame, io.pred),
vd AS (SELECT frame, pred, n_vox, (n_vox - coalesce(s, 0))::BIGINT AS void FROM npv LEFT JOIN (SELECT frame, pred, sum(near) AS s FROM owned GROUP BY ALL) USING (frame, pred)),
o0 AS (SELECT vd.*, mm.gt AS matched_gt, CASE WHEN mm.gt IS NOT NULL THEN EXISTS (SELECT 1 FROM pres p WHERE p.frame = vd.frame AND p.gt = mm.gt) END AS credit,
  coalesce(be.best, 0) AS best, coalesce(be.best_used, -1) AS best_used, dupe, coalesce(ignored, 0) AS ignored,
  (SELECT count(*) FROM pres p WHERE p.frame = vd.frame) AS nv FROM vd LEFT JOIN mm USING (frame, pred) LEFT JOIN be USING (frame, pred)),
o1 AS (SELECT *, CASE WHEN n_vox <= 0 THEN 'no_voxels_within_range' WHEN 2 * (void + ignored) <= n_vox THEN '' WHEN 2 * void > n_vox THEN 'void'
    WHEN 2 * ignored > n_vox THEN 'ignored_gt' ELSE 'void+ignored_gt' END AS reason,
  CASE WHEN nv = 0 THEN 'bkg' WHEN best BETWEEN 0.1 - {_EPS} AND 0.5 + {_EPS} THEN 'loc' WHEN best_used >= 0.5 - {_EPS} THEN 'dupe'
    WHEN best <= 0.1 + {_EPS} THEN 'bkg' ELSE 'other' END AS tide FROM o0),
oc AS (SELECT frame, pred, n_vox, void, matched_gt, credit, ignored,
  CASE WHEN matched_gt IS NOT NULL THEN CASE WHEN credit THEN 'tp' ELSE 'ignored_match' END WHEN reason = '' THEN 'fp' ELSE 'excluded' END AS pred_status,
  CASE WHEN matched_gt IS NOT NULL THEN '' ELSE reason END AS excluded_reason, CASE WHEN matched_gt IS NOT NULL THEN '' ELSE tide END AS tide_error,
  CASE WHEN matched_gt IS NULL AND tide = 'dupe' THEN dupe END AS dup_of FROM o1)"""

_CLOUDS = "cl AS (SELECT DISTINCT gt, x, y, z FROM gv)"


@query("matches_3d", f"""WITH {MATCH_SQL} SELECT frame, tau_cm, gt, pred, iou FROM mt""")
def matches_3d(spark, sf):
    return scored(spark, sf)[2]


@query("matches_3d_counted", f"""WITH {MATCH_SQL},
ex AS (SELECT * FROM lg WHERE iou >= 0.5 - {_EPS} AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.frame = lg.frame AND mt.tau_cm = lg.tau_cm AND mt.pred = lg.pred))
SELECT frame, tau_cm, gt, pred, iou FROM mt UNION ALL SELECT frame, tau_cm, arg_min(gt, (-iou, gt)) AS gt, pred, max(iou) AS iou FROM ex GROUP BY frame, tau_cm, pred""")
def matches_3d_counted(spark, sf):
    """Matching under the policy that also counts duplicates."""
    _, pairs, matches = scored(spark, sf)
    return m3.with_duplicates(m3.by_tau(pairs, TAUS), matches)


@query("gt_status_3d", f"""WITH {STATUS_SQL} SELECT * FROM st""")
def gt_status_3d(spark, sf):
    s, pairs, matches = scored(spark, sf)
    st = m3.gt_status(s, pairs, matches)
    return m3.with_presence(st, F.col("n_gt_vox") >= PRESENT_MIN)


@query("pred_outcome_3d", f"""WITH {OUTCOME_SQL} SELECT * FROM oc""")
def pred_outcome_3d(spark, sf):
    s, pairs, matches = scored(spark, sf)
    return m3.pred_outcome(s, pairs, matches, present_of(s))


@query("tide_errors", f"""WITH {OUTCOME_SQL} SELECT pred_status, tide_error, count(*) AS n FROM oc GROUP BY ALL""")
def tide_errors(spark, sf):
    s, pairs, matches = scored(spark, sf)
    out = m3.pred_outcome(s, pairs, matches, present_of(s))
    return out.groupBy("pred_status", "tide_error").agg(F.count(F.lit(1)).alias("n"))


@query("match_accuracy", f"""WITH {MATCH_SQL}, {_CLOUDS},
ds AS (SELECT v.frame, v.pred, mm.gt, (SELECT min(sqrt((v.x-c.x)*(v.x-c.x)+(v.y-c.y)*(v.y-c.y)+(v.z-c.z)*(v.z-c.z))) FROM cl c WHERE c.gt = mm.gt) AS d
  FROM pv v JOIN mm USING (frame, pred))
SELECT frame, pred, gt, round(quantile_cont(d, 0.5) * 100, 9) AS dist_med_cm, round(avg(d) * 100, 9) AS dist_mean_cm, round(quantile_cont(d, 0.9) * 100, 9) AS dist_p90_cm,
  avg((d < {MAIN} - 1e-5)::INT) AS within_tau, avg((d < 1e-9)::INT) AS voxel_exact FROM ds GROUP BY ALL""")
def match_accuracy(spark, sf):
    """Median, mean and p90 distance of matched predictions to the full cloud of their truth."""
    s, _, matches = scored(spark, sf)
    clouds = s.truths.select("gt", "x", "y", "z").distinct()
    d = durable(m3.match_accuracy(s, matches, clouds), "match-distances")
    q = exact_quantiles(d, ["frame", "pred"], "d", {"p50": 0.5, "p90": 0.9})
    a = d.groupBy("frame", "pred", "gt").agg(
        F.avg("d").alias("mean_d"),
        F.avg(rules.within(F.col("d"), MAIN).cast("int")).alias("within_tau"),
        F.avg((F.col("d") < 1e-9).cast("int")).alias("voxel_exact"),
    )
    cm = {"dist_med_cm": "p50", "dist_mean_cm": "mean_d", "dist_p90_cm": "p90"}
    return a.join(q, ["frame", "pred"]).select(
        "frame", "pred", "gt", *[F.round(F.col(c) * 100, 9).alias(n) for n, c in cm.items()], "within_tau", "voxel_exact"
    )


@query("episode_coverage", f"""WITH {MATCH_SQL}, {_CLOUDS},
cr AS (SELECT mm.* FROM mm JOIN pres USING (frame, gt)),
cv AS (SELECT DISTINCT cr.gt, v.x, v.y, v.z FROM cr JOIN pv v USING (frame, pred)),
hx AS (SELECT c.gt, EXISTS (SELECT 1 FROM cv v WHERE v.gt = c.gt AND sqrt((v.x-c.x)*(v.x-c.x)+(v.y-c.y)*(v.y-c.y)+(v.z-c.z)*(v.z-c.z)) < {MAIN} - 1e-5) AS hit FROM cl c)
SELECT gt, avg(hit::INT) AS coverage FROM hx WHERE gt IN (SELECT gt FROM cr) GROUP BY gt""")
def episode_coverage(spark, sf):
    s, _, matches = scored(spark, sf)
    clouds = s.truths.select("gt", "x", "y", "z").distinct()
    return m3.episode_coverage(s, matches, present_of(s), clouds)


@query("episode_fold", f"""WITH {STATUS_SQL},
fo AS (SELECT gt, count(*) AS n_with_surface, count(*) FILTER (WHERE present) AS n_present, coalesce(max(best_iou) FILTER (WHERE present), 0) AS best_iou,
  count(*) FILTER (WHERE status = 'ignored_match') AS n_no_credit, count(*) FILTER (WHERE status = 'tp') AS n_tp, count(*) FILTER (WHERE status = 'merged') AS n_merged,
  count(*) FILTER (WHERE status = 'split') AS n_split, count(*) FILTER (WHERE status = 'low_iou') AS n_low_iou, count(*) FILTER (WHERE status = 'missed') AS n_missed FROM st GROUP BY gt),
ct AS (SELECT gt, {', '.join(f"count(*) FILTER (WHERE tau_cm = {m3.tau_name(x)}) AS credit_{m3.tau_name(x)}" for x in TAUS)} FROM mt JOIN pres USING (frame, gt) GROUP BY gt),
wc AS (SELECT gt, status, count(*) AS c FROM st WHERE present AND status <> 'tp' GROUP BY ALL),
wy AS (SELECT gt, arg_min(status, (-c, list_position(['merged', 'split', 'low_iou', 'missed'], status))) AS reason FROM wc GROUP BY gt)
SELECT fo.*, {', '.join(f"coalesce(credit_{m3.tau_name(x)}, 0) AS credit_{m3.tau_name(x)}" for x in TAUS)}, (coalesce(credit_{_M}, 0) > 0)::INT AS detected,
  CASE WHEN coalesce(credit_{_M}, 0) > 0 THEN '' WHEN n_present = 0 THEN 'no_kf' ELSE coalesce(reason, 'missed') END AS miss_reason
FROM fo LEFT JOIN ct USING (gt) LEFT JOIN wy USING (gt)""")
def episode_fold(spark, sf):
    """Per truth over all frames: credits per tolerance, best IoU, status counts and miss reason."""
    s, pairs, matches = scored(spark, sf)
    st = durable(m3.with_presence(m3.gt_status(s, pairs, matches), F.col("n_gt_vox") >= PRESENT_MIN), "gt-status")
    fold = st.groupBy("gt").agg(
        F.count(F.lit(1)).alias("n_with_surface"),
        F.count_if("present").alias("n_present"),
        F.max(F.when(F.col("present"), F.col("best_iou"))).alias("best_iou"),
        F.count_if(F.col("status") == "ignored_match").alias("n_no_credit"),
        *[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("tp", *rules.STATUS_ORDER)],
    )
    here = st.where("present").select("frame", "gt")
    credit = matches.join(here, ["frame", "gt"], "left_semi").groupBy("gt").pivot(
        "tau_cm", [m3.tau_name(x) for x in TAUS]
    ).count()
    credit = credit.select("gt", *[F.col(str(m3.tau_name(x))).alias(f"credit_{m3.tau_name(x)}") for x in TAUS])
    why = m3.mode_reason(
        st.where("present AND status <> 'tp'"), ["gt"], "status", rules.STATUS_ORDER, "missed"
    )
    main = F.coalesce(f"credit_{_M}", F.lit(0))
    return (
        fold.join(credit, "gt", "left").join(why, "gt", "left")
        .withColumn("detected", (main > 0).cast("int"))
        .withColumn(
            "miss_reason",
            F.when(main > 0, "").when(F.col("n_present") == 0, "no_kf").otherwise(F.coalesce("reason", F.lit("missed"))),
        )
        .na.fill(0).drop("reason")
    )


@query("tau_sensitivity", f"""WITH {MATCH_SQL}, ts AS (SELECT unnest({[m3.tau_name(x) for x in TAUS]})::INT AS tau_cm),
al AS (SELECT (SELECT count(DISTINCT gt) FROM gv) AS n_gt, (SELECT count(*) FROM npv) AS n_obs),
fd AS (SELECT tau_cm, count(DISTINCT gt) AS n_found FROM mt JOIN pres USING (frame, gt) GROUP BY tau_cm), ht AS (SELECT tau_cm, count(*) AS n_hit FROM mt GROUP BY tau_cm)
SELECT tau_cm, coalesce(n_found, 0) AS n_found, n_gt, coalesce(n_hit, 0) AS n_hit, n_obs, coalesce(n_found, 0) / n_gt AS recall, coalesce(n_hit, 0) / n_obs AS obs_match_rate
FROM ts CROSS JOIN al LEFT JOIN fd USING (tau_cm) LEFT JOIN ht USING (tau_cm)""")
def tau_sensitivity(spark, sf):
    """Recall over truths and match rate over predictions for each tolerance."""
    s, _, matches = scored(spark, sf)
    n_gt = s.truths.select("gt").distinct().agg(F.count(F.lit(1)).alias("n_gt")).withColumn("_k", F.lit(0))
    n_obs = s.n_pred().agg(F.count(F.lit(1)).alias("n_obs")).withColumn("_k", F.lit(0))
    credited = matches.join(present_of(s), ["frame", "gt"], "left_semi")
    found = credited.groupBy("tau_cm").agg(F.countDistinct("gt").alias("n_found"))
    hit = matches.groupBy("tau_cm").agg(F.count(F.lit(1)).alias("n_hit"))
    every = spark.createDataFrame([(m3.tau_name(x),) for x in TAUS], "tau_cm int")
    return (
        every.join(hit, "tau_cm", "left").join(found, "tau_cm", "left").na.fill(0).withColumn("_k", F.lit(0)).join(n_gt, "_k").join(n_obs, "_k")
        .select(
            "tau_cm", "n_found", "n_gt", "n_hit", "n_obs",
            rules.ratio(F.col("n_found"), F.col("n_gt")).alias("recall"),
            rules.ratio(F.col("n_hit"), F.col("n_obs")).alias("obs_match_rate"),
        )
    )
