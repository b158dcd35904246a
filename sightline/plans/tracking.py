"""Tracking scores over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import mot
from sightline.plans.registry import query
from sightline.session import durable
from sightline.sources import tables as t


def scene(spark, sf):
    return tuple(durable(x, "tracking") for x in t.tracking(spark, sf))


def clear(spark, sf):
    truths, tracks, pairs = scene(spark, sf)
    steps = durable(mot.active_steps(truths, tracks), "steps")
    return truths, tracks, durable(mot.clear_matches(pairs, steps), "clear")


@query("active_steps", f"""WITH {t.TRACKING_SQL},
b AS (SELECT DISTINCT seq, t FROM truths JOIN (SELECT DISTINCT seq, t FROM tracks) USING (seq, t))
SELECT seq, t, row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS step FROM b""")
def active_steps(spark, sf):
    truths, tracks, _ = t.tracking(spark, sf)
    return mot.active_steps(truths, tracks)


def _matchings(pairs: str, score: str) -> str:
    """CTEs that list all one-to-one selections from the pairs (seq, t, gt, trk, sim, ...) of a timestep with their total."""
    return f"""ck AS (SELECT *, {score} AS w, row_number() OVER (PARTITION BY seq, t ORDER BY gt, trk) AS k FROM {pairs}),
cn AS (SELECT seq, t, max(k) AS n FROM ck GROUP BY ALL),
en AS (SELECT seq, t, 0::BIGINT AS k, 0.0::DOUBLE AS total, []::STRUCT(gt BIGINT, trk BIGINT, sim DOUBLE)[] AS picks FROM st
  UNION ALL
  SELECT e.seq, e.t, c.k, e.total + x.take * c.w, CASE WHEN x.take = 1 THEN list_append(e.picks, {{'gt': c.gt, 'trk': c.trk, 'sim': c.sim}}) ELSE e.picks END
  FROM en e JOIN ck c ON c.seq = e.seq AND c.t = e.t AND c.k = e.k + 1, (SELECT unnest([0, 1]) AS take) x
  WHERE x.take = 0 OR len(list_filter(e.picks, lambda p: p.gt = c.gt OR p.trk = c.trk)) = 0),
ops AS (SELECT en.seq, en.t, total, picks FROM en LEFT JOIN cn USING (seq, t) WHERE en.k = coalesce(n, 0))"""


# Step by step: the best total of a timestep, pairs of the step before first.
CLEAR_SQL = f"""RECURSIVE {t.TRACKING_SQL},
st AS (SELECT seq, t, row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS step FROM
  (SELECT DISTINCT seq, t FROM truths JOIN (SELECT DISTINCT seq, t FROM tracks) USING (seq, t))),
cd AS (SELECT seq, t, gt, trk, sim FROM mpair JOIN st USING (seq, t) WHERE sim >= 0.5 - 2.220446049250313e-16),
{_matchings("cd", "sim")},
so AS (SELECT seq, step, t, total, picks FROM ops JOIN st USING (seq, t)),
tl AS (SELECT DISTINCT seq, -1::BIGINT AS step, []::STRUCT(gt BIGINT, trk BIGINT, sim DOUBLE)[] AS picks FROM st
  UNION ALL
  SELECT l.seq, o.step, arg_max(o.picks, o.total + {mot.KEEP_BONUS} * len(list_filter(o.picks, lambda p: len(list_filter(l.picks, lambda q: q.gt = p.gt AND q.trk = p.trk)) > 0)))
  FROM tl l JOIN so o ON o.seq = l.seq AND o.step = l.step + 1 GROUP BY l.seq, o.step),
mt AS (SELECT seq, t, step, p.gt AS gt, p.trk AS trk, p.sim AS sim FROM (SELECT seq, step, unnest(picks) AS p FROM tl) JOIN st USING (seq, step))"""

_METRICS_SQL = """, ev AS (SELECT seq, gt, count(*) AS n_matched, count(*) FILTER (WHERE pt <> trk) AS idsw,
  count(*) FILTER (WHERE ps IS NULL OR ps < step - 1) AS segments, count(DISTINCT trk) AS n_ids
  FROM (SELECT *, lag(trk) OVER w AS pt, lag(step) OVER w AS ps FROM mt WINDOW w AS (PARTITION BY seq, gt ORDER BY step)) GROUP BY ALL),
pg AS (SELECT seq, gt, n, coalesce(n_matched, 0) AS m, coalesce(idsw, 0) AS idsw, coalesce(segments, 0) AS segments, coalesce(n_ids, 0) AS n_ids
  FROM (SELECT seq, gt, count(*) AS n FROM truths GROUP BY ALL) LEFT JOIN ev USING (seq, gt)),
gg AS (SELECT seq, count(*) AS n_gt_tracks, sum(n)::BIGINT AS gt_detections, sum(m)::BIGINT AS TP, sum(idsw)::BIGINT AS IDSW, sum(greatest(segments - 1, 0))::BIGINT AS Frag,
  count(*) FILTER (WHERE 5 * m >= 4 * n) AS MT, count(*) FILTER (WHERE 5 * m >= n AND 5 * m < 4 * n) AS PT, count(*) FILTER (WHERE 5 * m < n) AS ML,
  count(*) FILTER (WHERE 5 * m = 4 * n) AS MT_ratio_eq_80, avg(n_ids) FILTER (WHERE n_ids > 0) AS mean_ids_per_track FROM pg GROUP BY seq),
pp AS (SELECT seq, count(*) AS pred_detections, count(DISTINCT trk) AS n_pred_ids FROM tracks GROUP BY seq)
SELECT gg.*, pred_detections, n_pred_ids, gt_detections - TP AS FN, pred_detections - TP AS FP,
  1 - ((gt_detections - TP) + (pred_detections - TP) + IDSW) / gt_detections AS MOTA FROM gg JOIN pp USING (seq)"""

# Of every truth only as many of its best ids can matter as there are truths.
IDENTITY_SQL = f"""WITH RECURSIVE {t.TRACKING_SQL},
co AS (SELECT seq, gt, trk, count(*) AS n FROM mpair WHERE sim >= 0.5 GROUP BY ALL),
gs AS (SELECT seq, gt, dense_rank() OVER (PARTITION BY seq ORDER BY gt) AS k FROM (SELECT DISTINCT seq, gt FROM co)),
tp AS (SELECT co.seq, co.gt, trk, n, gs.k FROM co JOIN gs USING (seq, gt)
  QUALIFY row_number() OVER (PARTITION BY co.seq, co.gt ORDER BY n DESC, trk) <= (SELECT max(k) FROM gs)),
op AS (SELECT seq, k, trk, n FROM tp UNION ALL SELECT DISTINCT seq, k, -1, 0 FROM tp),
ch AS (SELECT DISTINCT seq, 0::BIGINT AS k, 0::BIGINT AS total, []::BIGINT[] AS used FROM gs
  UNION ALL
  SELECT c.seq, o.k, c.total + o.n, CASE WHEN o.trk < 0 THEN c.used ELSE list_append(c.used, o.trk) END
  FROM ch c JOIN op o ON o.seq = c.seq AND o.k = c.k + 1 AND NOT list_contains(c.used, o.trk)),
bt AS (SELECT seq, max(total) AS IDTP FROM ch GROUP BY seq),
ng AS (SELECT seq, count(*) AS n_gt FROM truths GROUP BY seq), nt AS (SELECT seq, count(*) AS n_trk FROM tracks GROUP BY seq)
SELECT seq, coalesce(IDTP, 0) AS IDTP, n_trk - coalesce(IDTP, 0) AS IDFP, n_gt - coalesce(IDTP, 0) AS IDFN, 2 * coalesce(IDTP, 0) / (n_gt + n_trk) AS IDF1,
  coalesce(IDTP, 0) / n_gt AS IDR, coalesce(IDTP, 0) / n_trk AS IDP FROM ng JOIN nt USING (seq) LEFT JOIN bt USING (seq)"""

HOTA_SQL = f"""WITH RECURSIVE {t.TRACKING_SQL},
sc AS (SELECT *, sim / (sum(sim) OVER (PARTITION BY seq, t, gt) + sum(sim) OVER (PARTITION BY seq, t, trk) - sim) AS s FROM mpair),
po AS (SELECT seq, gt, trk, sum(s) AS potential FROM sc GROUP BY ALL),
ng AS (SELECT seq, gt, count(*) AS n_gt FROM truths GROUP BY ALL), nt AS (SELECT seq, trk, count(*) AS n_trk FROM tracks GROUP BY ALL),
al AS (SELECT seq, gt, trk, potential / (n_gt + n_trk - potential) AS align FROM po JOIN ng USING (seq, gt) JOIN nt USING (seq, trk)),
hp AS (SELECT seq, t, gt, trk, sim, align * sim AS score FROM mpair JOIN al USING (seq, gt, trk) WHERE align * sim > 0),
st AS (SELECT DISTINCT seq, t FROM hp), {_matchings("hp", "score")},
be AS (SELECT seq, t, arg_max(picks, total) AS picks FROM ops GROUP BY ALL),
hm AS (SELECT seq, p.gt AS gt, p.trk AS trk FROM (SELECT seq, unnest(picks) AS p FROM be) WHERE p.sim >= 0.5 - 2.220446049250313e-16),
ms AS (SELECT seq, gt, trk, count(*) AS m FROM hm GROUP BY ALL),
sh AS (SELECT seq, sum(m)::BIGINT AS tp, sum(m * m / (n_gt + n_trk - m)) AS a, sum(m * m / n_gt) AS r, sum(m * m / n_trk) AS p FROM ms JOIN ng USING (seq, gt) JOIN nt USING (seq, trk) GROUP BY seq),
tg AS (SELECT seq, sum(n_gt)::BIGINT AS g FROM ng GROUP BY seq), tt AS (SELECT seq, sum(n_trk)::BIGINT AS k FROM nt GROUP BY seq)
SELECT seq, tp AS HOTA_TP, g - tp AS HOTA_FN, k - tp AS HOTA_FP, tp / (g + k - tp) AS DetA, tp / g AS DetRe, tp / k AS DetPr,
  round(a / tp, 9) AS AssA, round(r / tp, 9) AS AssRe, round(p / tp, 9) AS AssPr, round(sqrt(tp / (g + k - tp) * (a / tp)), 9) AS HOTA
FROM tg JOIN tt USING (seq) JOIN sh USING (seq)"""


@query("clear_matches", f"WITH {CLEAR_SQL} SELECT seq, t, step, gt, trk, sim FROM mt")
def clear_matches(spark, sf):
    return clear(spark, sf)[2]


@query("clear_metrics", f"WITH {CLEAR_SQL}{_METRICS_SQL}")
def clear_metrics(spark, sf):
    truths, tracks, matches = clear(spark, sf)
    return mot.clear_metrics(truths, tracks, matches)


@query("match_timeline", f"WITH {CLEAR_SQL} SELECT seq, t, gt, mt.trk AS trk FROM truths LEFT JOIN (SELECT seq, t, gt, trk FROM mt) mt USING (seq, t, gt)")
def match_timeline(spark, sf):
    truths, _, matches = clear(spark, sf)
    return mot.timeline(truths, matches)


@query("cooccurrence", f"WITH {t.TRACKING_SQL} SELECT seq, gt, trk, count(*) AS n FROM mpair WHERE sim >= 0.5 GROUP BY ALL")
def cooccurrence(spark, sf):
    return mot.cooccurrence(t.tracking(spark, sf)[2])


@query("identity_metrics", IDENTITY_SQL)
def identity_metrics(spark, sf):
    truths, tracks, pairs = scene(spark, sf)
    return mot.identity_metrics(truths, tracks, pairs)


@query("global_alignment", f"""WITH {t.TRACKING_SQL},
s AS (SELECT *, sim / (sum(sim) OVER (PARTITION BY seq, t, gt) + sum(sim) OVER (PARTITION BY seq, t, trk) - sim) AS s
  FROM mpair),
pot AS (SELECT seq, gt, trk, sum(s) AS potential FROM s GROUP BY ALL),
ng AS (SELECT seq, gt, count(*) AS n_gt FROM truths GROUP BY ALL), nt AS (SELECT seq, trk, count(*) AS n_trk FROM tracks GROUP BY ALL)
SELECT seq, gt, trk, n_gt, n_trk, round(potential, 9) AS potential,
  round(potential / (n_gt + n_trk - potential), 9) AS align
FROM pot JOIN ng USING (seq, gt) JOIN nt USING (seq, trk)""")
def global_alignment(spark, sf):
    truths, tracks, pairs = t.tracking(spark, sf)
    a = mot.alignment(truths, tracks, pairs)
    return a.withColumns({c: F.round(c, 9) for c in ("potential", "align")})


@query("hota_metrics", HOTA_SQL)
def hota_metrics(spark, sf):
    truths, tracks, pairs = scene(spark, sf)
    align = durable(mot.alignment(truths, tracks, pairs), "alignment")
    out = mot.hota_metrics(truths, tracks, durable(mot.hota_matches(pairs, align), "hota-matches"))
    return out.withColumns({c: F.round(c, 9) for c in ("AssA", "AssRe", "AssPr", "HOTA")})


@query("track_events", """WITH d AS (SELECT user_id AS gt, epoch_us(ts) // 86400000000 AS step,
  arg_min(event_type, event_id) AS ty FROM events GROUP BY ALL),
m AS (SELECT 0 AS seq, gt, step, length(ty) AS trk FROM d WHERE ty <> 'error'),
l AS (SELECT *, lag(trk) OVER w AS pt, lag(step) OVER w AS ps FROM m WINDOW w AS (PARTITION BY gt ORDER BY step))
SELECT seq, gt, count(*) AS n_matched, count(*) FILTER (WHERE pt <> trk) AS idsw,
  count(*) FILTER (WHERE ps IS NULL OR ps < step - 1) AS segments, count(DISTINCT trk) AS n_ids FROM l GROUP BY ALL""")
def track_events(spark, sf):
    """Id switches and segments of one track per user; the first event of a day gives the id."""
    s = t.signals(spark, sf).withColumn("step", t.day_of("ts_us"))
    first = s.groupBy(F.col("user_id").alias("gt"), "step").agg(F.min_by("event_type", "event_id").alias("ty"))
    m = first.where("ty <> 'error'").select(F.lit(0).alias("seq"), "gt", "step", F.length("ty").alias("trk"))
    return mot.track_events(m)
