"""Ground-truth construction, checks and level reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import components as cc
from sightline.operators import ordered
from sightline.operators import rules
from sightline.operators import surfaces as sf_ops
from sightline.operators import temporal
from sightline.operators import truth as tr
from sightline.operators import voxels as vx
from sightline.operators.matching3d import mode_reason
from sightline.plans.flow import EPISODE_SQL, tracklet_rows
from sightline.plans.registry import query
from sightline.session import durable
from sightline.sources import tables as t

PROMOTE_PX, PROMOTE_FRAMES = 100, 3


def pixel_facts(spark, sf):
    s = t.segments(spark, sf)
    return s.select(F.col("gt_object_id").alias("object"), F.col("frame_idx").alias("frame"), F.col("n_pixels").alias("n_px"))


_ROLL = f"""WITH {t.SEGMENTS_SQL}, pf AS (SELECT gt_object_id AS object, frame_idx AS frame, sum(n_pixels)::BIGINT AS n_px
  FROM seg GROUP BY ALL),
roll AS (SELECT object, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames_seen,
  count(*) FILTER (WHERE n_px >= {PROMOTE_PX}) AS n_frames_promoting, max(n_px) AS max_px, sum(n_px)::BIGINT AS total_px
  FROM pf GROUP BY object)"""
_COLS = ["object", "first_frame", "last_frame", "n_frames_seen", "n_frames_promoting", "max_px", "total_px"]


def rollup(spark, sf):
    vox = t.points(spark, sf).select(F.col("cloud").alias("object"), *vx.XYZ)
    return tr.object_rollup(pixel_facts(spark, sf), vox, PROMOTE_PX)


@query("object_rollup", _ROLL + f", {t.POINTS_SQL}" + """
SELECT roll.*, n_points, min_x, max_z FROM roll LEFT JOIN
  (SELECT cloud AS object, count(*) AS n_points, min(x) AS min_x, max(z) AS max_z FROM pts GROUP BY ALL) e USING (object)""")
def object_rollup(spark, sf):
    return rollup(spark, sf).select(*_COLS, "n_points", "min_x", "max_z")


@query("promoted_objects", _ROLL + f"""
SELECT object, object % 7 AS colour, row_number() OVER (ORDER BY first_frame, object % 7, object) AS gt_object_id
FROM roll WHERE n_frames_promoting >= {PROMOTE_FRAMES}""")
def promoted_objects(spark, sf):
    r = tr.promoted(rollup(spark, sf), PROMOTE_FRAMES).withColumn("colour", F.col("object") % 7)
    return tr.number_objects(r).select("object", "colour", "gt_object_id")


@query("segment_ids", f"""WITH {t.SEGMENTS_SQL}, d AS (SELECT DISTINCT frame_idx, gt_object_id FROM seg)
SELECT frame_idx, gt_object_id, row_number() OVER (PARTITION BY frame_idx ORDER BY gt_object_id) AS segment_id FROM d""")
def segment_ids(spark, sf):
    """Dense object number inside each frame."""
    d = t.segments(spark, sf).select("frame_idx", "gt_object_id").distinct()
    return temporal.running_number(d, ["frame_idx"], ["gt_object_id"], "_n").select(
        "frame_idx", "gt_object_id", (F.col("_n") + 1).alias("segment_id")
    )


@query("segment_rollup", """SELECT epoch_us(ts) // 86400000000 AS frame, user_id AS object, count(*) AS n_points_strided,
  count(*) * 4 AS n_pixels, round(avg(value), 6) AS mean_depth_m, (NOT bool_or(value <= 8))::INT AS is_far
FROM events GROUP BY ALL""")
def segment_rollup(spark, sf):
    s = t.signals(spark, sf).select(
        t.day_of("ts_us").alias("frame"), F.col("user_id").alias("object"), F.col("value").alias("depth")
    )
    r = tr.segment_rollup(s, 8.0, 2)
    return r.withColumns({"mean_depth_m": F.round("mean_depth_m", 6), "is_far": F.col("is_far").cast("int")})


MAX_RANGE = 50.0


@query("tracklet_distances", f"""WITH {EPISODE_SQL},
ob AS (SELECT tracklet_id, epoch_us(ts) // 86400000000 AS frame, value AS dist FROM events JOIN tracks
  ON user_id = gt_object_id AND epoch_us(ts) // 86400000000 BETWEEN first_frame AND last_frame),
pf AS (SELECT tracklet_id, frame, count(*) FILTER (WHERE dist <= {MAX_RANGE}) AS n, count(*) FILTER (WHERE dist > {MAX_RANGE}) AS far,
  min(dist) FILTER (WHERE dist <= {MAX_RANGE}) AS mn, avg(dist) FILTER (WHERE dist <= {MAX_RANGE}) AS av FROM ob GROUP BY ALL)
SELECT tracklet_id, sum(n)::BIGINT AS n_raw, sum(far)::BIGINT AS n_far, min(mn) AS dist_min_m, round(avg(av), 9) AS dist_mean_m
FROM pf GROUP BY ALL""")
def tracklet_distances(spark, sf):
    """Distance facts per tracklet; the mean is the mean of the frame means."""
    tracks = durable(
        tracklet_rows(spark, sf).select("gt_object_id", "tracklet_id", "first_frame", "last_frame"), "tracklets"
    )
    s = t.signals(spark, sf).select(
        F.col("user_id").alias("gt_object_id"), t.day_of("ts_us").alias("frame"), F.col("value").alias("dist")
    )
    obs = temporal.interval_join(s, tracks, ["gt_object_id"], "frame", "first_frame", "last_frame")
    return tr.tracklet_rollup(obs, MAX_RANGE).withColumn("dist_mean_m", F.round("dist_mean_m", 9))


@query("mean_embedding", """WITH s AS (SELECT label, count(*) AS n, list(embedding) AS l FROM embeddings GROUP BY label),
d AS (SELECT label, n, i, (SELECT sum(CAST(v[i] AS DOUBLE)) FROM unnest(l) u(v)) / n AS m FROM s, range(1, 65) r(i)),
k AS (SELECT label, sqrt(sum(m * m)) AS l2 FROM d GROUP BY label)
SELECT label, n AS n_embedded, round(max(m / l2) FILTER (WHERE i = 1), 9) AS first_dim,
  round(max(m / l2), 9) AS max_dim, round(sum(m / l2 * m / l2), 9) AS sq_norm
FROM d JOIN k USING (label) GROUP BY label, n""")
def mean_embedding(spark, sf):
    """Mean vector per object, scaled to unit length."""
    e = tr.mean_embedding(t.table(spark, sf, "embeddings"), ["label"], "embedding", 64)
    return e.select(
        "label", "n_embedded", F.round(F.element_at("embedding", 1), 9).alias("first_dim"),
        F.round(F.array_max("embedding"), 9).alias("max_dim"),
        F.round(g.vector_dot(F.col("embedding"), F.col("embedding")), 9).alias("sq_norm"),
    )


@query("ceiling_cut", """WITH lo AS (SELECT min(l_extendedprice) AS z0 FROM lineitem),
h AS (SELECT floor((l_extendedprice - z0) / 500.0) AS b, count(*) AS c FROM lineitem, lo GROUP BY b)
SELECT max(z0 + b * 500.0) - 300.0 AS cut FROM h, lo WHERE c >= 0.05 * (SELECT max(c) FROM h)""")
def ceiling_cut(spark, sf):
    return tr.dense_top(t.table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", 500.0, 0.05, 300.0)


@query("extent_filter", f"""WITH {t.POINTS_SQL}, c AS (SELECT cloud * 100 + point_id % 50 AS id, x, y, z FROM pts),
b AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM c GROUP BY id)
SELECT coalesce(CASE WHEN x1 - x0 <= 0.04 OR y1 - y0 <= 0.04 OR z1 - z0 <= 0.04 THEN 'thin'
  WHEN z0 >= 0.1 - 0.15 THEN 'ceiling' END, 'kept') AS reason, count(*) AS n FROM b GROUP BY 1""")
def extent_filter(spark, sf):
    """Tracklets dropped for a degenerate axis or for lying at the ceiling."""
    p = t.points(spark, sf).withColumn("id", F.col("cloud") * 100 + F.col("point_id") % 50)
    e = vx.extents(p, ["id"])
    why = F.coalesce(tr.drop_reason(0.04, F.lit(0.1), 0.15), F.lit("kept"))
    return e.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("compact_objects", f"""WITH {t.POINTS_SQL}, b AS (SELECT cloud * 100 + point_id % 50 AS id, count(*) AS n,
  sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y)) + (max(z)-min(z))*(max(z)-min(z))) AS diag
  FROM pts GROUP BY 1) SELECT id, n AS n_points, diag FROM b WHERE diag <= 0.2""")
def compact_objects(spark, sf):
    p = t.points(spark, sf).withColumn("id", F.col("cloud") * 100 + F.col("point_id") % 50)
    e = vx.extents(p, ["id"])
    diag = g.norm([F.col(f"max_{c}") - F.col(f"min_{c}") for c in vx.XYZ])
    return e.select("id", "n_points", diag.alias("diag")).where("diag <= 0.2")


# ------------------------------------------------------------------- graph

@query("components", """SELECT o_orderkey AS v, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders
QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""")
def components(spark, sf):
    """Orders linked to the next order of the same customer; a customer is one long path."""
    o = t.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    s = ordered.sliced(o, ["o_custkey"], ["o_orderkey"])
    prev = ordered.carry(s, ["o_custkey"], ["o_orderkey"], F.col("o_orderkey"), "prev", inclusive=False)
    return cc.connected_components(prev.where("prev IS NOT NULL").select("prev", "o_orderkey"), "prev", "o_orderkey")


def instance_voxels(spark, sf, size=0.08):
    p = t.points(spark, sf)
    inst = p.withColumn("instance", F.col("cloud") * 3 + F.col("point_id") % 3).withColumn("colour", F.col("cloud") % 2)
    return vx.occupancy(inst, ["colour", "instance"], size)


@query("merge_instances")
def merge_instances(spark, sf):
    """Instances of one colour that occupy the same space, merged to a fixpoint."""
    return tr.merge_instances(instance_voxels(spark, sf), ["colour"], 0.8)


def scale_sql(points: str, key: str) -> str:
    """CTEs that join the points (key, point_id, x, y, z, radius) of a key whose cells touch in a grid both take part in.

    Names spread from points without an earlier neighbour; the earliest that arrives names the part.
    """
    return f"""sp AS (SELECT {key}, min(radius) AS r0, max(radius) AS r1 FROM {points} GROUP BY ALL),
el AS (SELECT p.*, k, r0 * pow(2.0::DOUBLE, k) AS cell FROM {points} p JOIN sp USING ({key}),
  LATERAL (SELECT unnest(generate_series(0, greatest(0, ceil(log2(r1 / r0) - 1e-12))::BIGINT)) AS k) WHERE radius >= r0 * pow(2.0::DOUBLE, k) / 2),
lo AS (SELECT {key}, k, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM el GROUP BY ALL),
ix AS (SELECT {key}, k, point_id, floor((x - x0) / cell)::BIGINT AS i, floor((y - y0) / cell)::BIGINT AS j, floor((z - z0) / cell)::BIGINT AS l FROM el JOIN lo USING ({key}, k)),
se AS (SELECT DISTINCT a.point_id AS a, b.point_id AS b FROM ix a JOIN ix b ON a.{key} = b.{key} AND a.k = b.k AND a.point_id <> b.point_id
  AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.l - b.l) <= 1),
sr AS (SELECT point_id AS root, point_id AS id FROM {points} p WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.a = p.point_id AND se.b < p.point_id)
  UNION SELECT sr.root, se.b FROM sr JOIN se ON se.a = sr.id),
sc AS (SELECT id AS point_id, min(root) AS part FROM sr GROUP BY id)"""


@query("multi_scale_components", f"""WITH RECURSIVE {t.POINTS_SQL}, pr AS (SELECT *, 0.06::DOUBLE + abs(x) * 0.4::DOUBLE AS radius FROM pts),
{scale_sql("pr", "cloud")},
su AS (SELECT cloud, part AS component, count(*) AS n_points, min([x, y, z]) AS least FROM pr JOIN sc USING (point_id) GROUP BY ALL)
SELECT cloud, component, n_points, row_number() OVER (PARTITION BY cloud ORDER BY n_points DESC, least) - 1 AS rank FROM su""")
def multi_scale_components(spark, sf):
    """3D parts per cloud with a link radius per point."""
    p = t.points(spark, sf).withColumn("radius", F.lit(0.06) + F.abs("x") * 0.4)
    edges = durable(tr.scale_edges(p, ["cloud"]), "scale-edges")
    comp = cc.connected_components(edges, "a", "b")
    return tr.order_components(p, comp, ["cloud"])


# ------------------------------------------------------------ votes, visibility

@query("component_votes", """WITH v AS (SELECT l_orderkey AS component, l_suppkey % 4 AS label, count(*) AS c FROM lineitem GROUP BY ALL),
s AS (SELECT component, sum(c)::BIGINT AS n_votes, arg_max(label, (c, -label)) AS winner, max(c) AS n_winner FROM v GROUP BY ALL)
SELECT component, n_votes, winner, n_winner, n_winner / n_votes AS support, (n_winner / n_votes >= 0.5)::INT AS dominates FROM s""")
def component_votes(spark, sf):
    li = t.table(spark, sf, "lineitem")
    v = li.select(F.col("l_orderkey").alias("component"), (F.col("l_suppkey") % 4).alias("label"))
    return tr.component_vote(v, ["component"], 0.5).withColumn("dominates", F.col("dominates").cast("int"))


@query("visibility", """SELECT l_orderkey // 256 AS frame, l_partkey % 40 AS episode, count(*) * 4 AS px_full,
  count(*) FILTER (WHERE l_quantity BETWEEN 3 AND 45) * 4 AS px_crop FROM lineitem GROUP BY ALL""")
def visibility(spark, sf):
    return visible(spark, sf)


def visible(spark, sf):
    li = t.table(spark, sf, "lineitem")
    s = li.select(
        F.floor(F.col("l_orderkey") / 256).alias("frame"), (F.col("l_partkey") % 40).alias("episode"), "l_quantity"
    )
    return tr.visible_pixels(s, ["frame", "episode"], F.col("l_quantity").between(3, 45), 2)


VIS_MIN = 80

_VIS = """WITH vis AS (SELECT l_orderkey // 256 AS frame, l_partkey % 40 AS episode, count(*) * 4 AS px_full,
  count(*) FILTER (WHERE l_quantity BETWEEN 3 AND 45) * 4 AS px_crop FROM lineitem GROUP BY ALL)"""


@query("visibility_rollup", _VIS + f"""
SELECT episode, count(*) FILTER (WHERE px_crop > 0) AS vis_frames_crop, max(px_crop) AS max_px_crop,
  count(*) FILTER (WHERE px_crop > 0 AND frame % 5 = 0) AS n_kf_while_visible,
  count(*) FILTER (WHERE px_crop >= {VIS_MIN}) AS frames_px_ge_min FROM vis GROUP BY episode""")
def visibility_rollup(spark, sf):
    v = visible(spark, sf)
    seen = F.col("px_crop") > 0
    return v.groupBy("episode").agg(
        F.count_if(seen).alias("vis_frames_crop"),
        F.max("px_crop").alias("max_px_crop"),
        F.count_if(seen & (F.col("frame") % 5 == 0)).alias("n_kf_while_visible"),
        F.count_if(F.col("px_crop") >= VIS_MIN).alias("frames_px_ge_min"),
    )


@query("occlusion", """WITH s AS (SELECT l_partkey AS ep, l_suppkey % 3 = 0 AS same, l_quantity / 10 AS depth, l_discount * 50 AS z FROM lineitem),
c AS (SELECT ep, count(*) FILTER (WHERE same AND depth > 0) AS n_visible,
  count(*) FILTER (WHERE NOT same AND depth > 0 AND depth < z - greatest(0.05, 0.03 * z)) AS n_hidden FROM s GROUP BY ep)
SELECT ep, n_visible, n_hidden, CASE WHEN n_visible + n_hidden > 0 THEN n_hidden / (n_visible + n_hidden) ELSE 0 END AS occ FROM c""")
def occlusion(spark, sf):
    li = t.table(spark, sf, "lineitem")
    s = li.select(
        F.col("l_partkey").alias("ep"), (F.col("l_suppkey") % 3 == 0).alias("same"),
        (F.col("l_quantity") / 10).alias("depth"), (F.col("l_discount") * 50).alias("z"),
    )
    return tr.occlusion(s, ["ep"])


_LEVEL = """CASE WHEN m > 40 AND (CASE WHEN tr < 0 THEN 0 ELSE tr END) <= 0.15 AND o <= 0.20 AND NOT (tr < 0 AND b) THEN 0
  WHEN m > 25 AND (CASE WHEN tr < 0 THEN 0 ELSE tr END) <= 0.30 AND o <= 0.50 THEN 1
  WHEN m > 25 AND (CASE WHEN tr < 0 THEN 0 ELSE tr END) <= 0.50 THEN 2 ELSE 3 END"""
_DIFF = f"""WITH src AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS m,
    CASE WHEN l_linenumber = 7 THEN -1.0 ELSE l_tax * 8 END AS tr, l_discount * 8 AS o, l_suppkey % 2 = 0 AS b,
    l_returnflag = 'R' AS hit FROM lineitem),
lv AS (SELECT *, {_LEVEL} AS level FROM src)"""


def levels(spark, sf):
    li = t.table(spark, sf, "lineitem")
    trunc = F.when(F.col("l_linenumber") == 7, F.lit(-1.0)).otherwise(F.col("l_tax") * 8)
    lv = rules.difficulty(F.col("l_quantity"), trunc, F.col("l_discount") * 8, F.col("l_suppkey") % 2 == 0)
    return li.select("l_partkey", lv.alias("level"), (F.col("l_returnflag") == "R").alias("hit"))


@query("difficulty_levels", _DIFF + " SELECT level, count(*) AS n FROM lv GROUP BY level")
def difficulty_levels(spark, sf):
    return levels(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("recall_by_level", _DIFF + """, x AS (SELECT unnest([0, 1, 2]) AS k, unnest(['easy', 'moderate', 'hard']) AS level_name)
SELECT level_name, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE hit) / count(*) AS rate
FROM lv JOIN x ON level <= k GROUP BY level_name""")
def recall_by_level(spark, sf):
    return tr.cumulative_levels(levels(spark, sf), "level", F.col("hit"))


@query("episode_recall_by_level", _DIFF + """, ep AS (SELECT l_partkey, min(level) AS level, bool_or(hit) AS hit FROM lv GROUP BY 1),
x AS (SELECT unnest([0, 1, 2]) AS k, unnest(['easy', 'moderate', 'hard']) AS level_name)
SELECT level_name, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE hit) / count(*) AS rate
FROM ep JOIN x ON level <= k GROUP BY level_name""")
def episode_recall_by_level(spark, sf):
    """Level of an episode = easiest of its instances."""
    ep = levels(spark, sf).groupBy("l_partkey").agg(F.min("level").alias("level"), F.bool_or("hit").alias("hit"))
    return tr.cumulative_levels(ep, "level", F.col("hit"))


@query("level_criteria", f"""WITH top AS (SELECT max(l_quantity)::BIGINT AS q FROM lineitem),
lo AS (SELECT i AS m, 0.0 AS tr, 0.0 AS o, false AS b FROM top, LATERAL (SELECT unnest(generate_series(0, q)) AS i)),
tt AS (SELECT q AS m, i / 100 AS tr, 0.0 AS o, false AS b FROM top, LATERAL (SELECT unnest(generate_series(0, 100)) AS i)),
oo AS (SELECT q AS m, 0.0 AS tr, i / 100 AS o, false AS b FROM top, LATERAL (SELECT unnest(generate_series(0, 100)) AS i)),
a AS (SELECT m, {_LEVEL} AS level FROM lo), c AS (SELECT tr, {_LEVEL} AS level FROM tt), d AS (SELECT o, {_LEVEL} AS level FROM oo),
x AS (SELECT unnest([0, 1, 2]) AS level)
SELECT x.level, (SELECT min(m) - 1 FROM a WHERE a.level <= x.level) AS min_dim_gt, (SELECT max(tr) FROM c WHERE c.level <= x.level) AS trunc_le,
  (SELECT CASE WHEN max(o) < 1 THEN max(o) END FROM d WHERE d.level <= x.level) AS occ_le FROM x""")
def level_criteria(spark, sf):
    """Limits of the level rule, read from the rule by probing it, up to the largest size there is."""
    top = t.table(spark, sf, "lineitem").agg(F.max("l_quantity").cast("long").alias("q"))
    zero, shares = F.lit(0.0), F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i / 100)
    at = lambda m, cut, hidden: rules.difficulty(m, cut, hidden, F.lit(False))
    probes = top.select(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("q")), lambda m: F.struct(m.alias("v"), at(m, zero, zero).alias("level"))).alias("m"),
        F.transform(shares, lambda s: F.struct(s.alias("v"), at(F.col("q"), s, zero).alias("level"))).alias("t"),
        F.transform(shares, lambda s: F.struct(s.alias("v"), at(F.col("q"), zero, s).alias("level"))).alias("o"),
    )
    lv = probes.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    within = lambda c: F.transform(F.filter(c, lambda p: p["level"] <= F.col("level")), lambda p: p["v"])
    most = F.array_max(within("o"))
    return lv.select(
        "level", (F.array_min(within("m")) - 1).alias("min_dim_gt"), F.array_max(within("t")).alias("trunc_le"),
        F.when(most < 1, most).alias("occ_le"),
    )


EDGES = (0, 400, 800, 1600, 3200, 6400, 100000, 1000000)
BINS = ("0-399", "400-799", "800-1599", "1600-3199", "3200-6399", "6400+", "empty")


@query("binned_recall", "WITH b AS (SELECT unnest(" + str(list(BINS)) + ") AS bin, unnest(" + str(list(EDGES[:-1]))
       + ") AS lo, unnest(" + str(list(EDGES[1:])) + """) AS hi),
r AS (SELECT n_chars, quality FROM labels JOIN documents USING (doc_id))
SELECT bin, count(n_chars) AS n, avg(quality) AS rate FROM b LEFT JOIN r ON n_chars >= lo AND n_chars < hi GROUP BY bin""")
def binned_recall(spark, sf):
    """Recall per size bin; the label counts as a detection."""
    d = t.table(spark, sf, "documents").select("doc_id", "n_chars")
    r = t.table(spark, sf, "labels").join(d, "doc_id")
    return tr.binned_rate(r, "n_chars", F.col("quality") == 1, EDGES, BINS)


@query("population_recall", """SELECT population, n, k, CASE WHEN n > 0 THEN k / n END AS rate FROM (
SELECT unnest(['all', 'detectable', 'large', 'toxic', 'none']) AS population,
 unnest([count(*), count(*) FILTER (WHERE n_chars >= 256), count(*) FILTER (WHERE n_chars >= 1600),
   count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE n_chars < 0)]) AS n,
 unnest([count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE n_chars >= 256 AND quality = 1),
   count(*) FILTER (WHERE n_chars >= 1600 AND quality = 1), count(*) FILTER (WHERE toxic = 1 AND quality = 1),
   count(*) FILTER (WHERE n_chars < 0 AND quality = 1)]) AS k
FROM labels JOIN documents USING (doc_id))""")
def population_recall(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", "n_chars")
    r = t.table(spark, sf, "labels").join(d, "doc_id")
    tests = {
        "all": F.lit(True), "detectable": F.col("n_chars") >= rules.AREA_MIN_CELLS,
        "large": F.col("n_chars") >= rules.AREA_MIN_PX, "toxic": F.col("toxic") == 1, "none": F.col("n_chars") < 0,
    }
    return tr.populations(r, tests, F.col("quality") == 1)


@query("presence_agreement", """WITH a AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS d FROM events WHERE event_type = 'click'),
b AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS d FROM events WHERE event_type = 'view'),
j AS (SELECT a.d IS NOT NULL AS ha, b.d IS NOT NULL AS hb FROM a FULL JOIN b ON a.user_id = b.user_id AND a.d = b.d)
SELECT count(*) AS n_union, count(*) FILTER (WHERE ha AND hb) AS n_both, count(*) FILTER (WHERE NOT hb) AS n_only_a,
  count(*) FILTER (WHERE NOT ha) AS n_only_b, (count(*) - count(*) FILTER (WHERE ha AND hb)) / count(*) AS disagreement FROM j""")
def presence_agreement(spark, sf):
    s = t.signals(spark, sf).withColumn("d", t.day_of("ts_us"))
    a, b = (s.where(F.col("event_type") == k).select("user_id", "d") for k in ("click", "view"))
    return tr.presence_agreement(a, b, ["user_id", "d"])


@query("track_reason", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC,
  list_position(['view', 'click', 'error'], event_type)) AS rn FROM c WHERE event_type IN ('view', 'click', 'error'))
SELECT u.user_id, coalesce(event_type, 'missed') AS reason FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN r ON r.user_id = u.user_id AND rn = 1""")
def track_reason(spark, sf):
    """Most frequent reason per track with a fixed order for ties."""
    s = t.signals(spark, sf).select("user_id", "event_type")
    return mode_reason(s, ["user_id"], "event_type", ("view", "click", "error"), "missed")


# ------------------------------------------------------------------- sampling

@query("top_k_lanes", """SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 8""")
def top_k_lanes(spark, sf):
    s = t.signals(spark, sf).select("user_id", "event_id", "value")
    return tr.top_k(s, ["user_id"], "value", "event_id", 8)


@query("best_frame", """SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1""")
def best_frame(spark, sf):
    """Representative row: largest value, first one on ties."""
    s = t.signals(spark, sf)
    return s.groupBy("user_id").agg(
        F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("event_id"), F.max("value").alias("value")
    )


@query("seeded_sample", """WITH m AS (SELECT user_id, event_id, ('0x' || substr(md5('7:' || event_id), 1, 12))::BIGINT AS h FROM events)
SELECT user_id, event_id FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) <= 5""")
def seeded_sample(spark, sf):
    s = t.signals(spark, sf).select("user_id", "event_id")
    return tr.seeded_sample(s, ["user_id"], "event_id", 5, 7)


@query("stride_sample", """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p,
  count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_id, p FROM n WHERE p % (CASE WHEN c > 20 THEN c // 20 + 1 ELSE 1 END) = 0""")
def stride_sample(spark, sf):
    """Every k-th row per key so that at most the limit remains."""
    s = t.signals(spark, sf).select("user_id", "event_id")
    n = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    num = temporal.running_number(s, ["user_id"], ["event_id"], "p").join(n, "user_id")
    return tr.stride_sample(num, "p", F.col("c"), 20).select("user_id", "event_id", "p")


@query("even_sample", """WITH d AS (SELECT DISTINCT epoch_us(o_orderdate) // 86400000000 AS day FROM orders),
n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS p, count(*) OVER () AS c FROM d),
s AS (SELECT DISTINCT CAST(floor(i * (c - 1) / 29) AS BIGINT) AS p FROM range(30) r(i), (SELECT count(*) AS c FROM d))
SELECT day, p FROM n JOIN s USING (p)""")
def even_sample(spark, sf):
    """Thirty evenly spaced frames of the sorted frame list."""
    d = t.table(spark, sf, "orders").select(t.micros("o_orderdate").alias("us")).select(t.day_of("us").alias("day")).distinct()
    num = durable(ordered.global_row_number(d, ["day"], "_n").select("day", (F.col("_n") - 1).alias("p")), "frames")
    picks = num.agg(F.max("p").alias("_m")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.floor(i * F.col("_m") / 29))).alias("p")
    ).distinct()
    return num.join(picks, "p").select("day", "p")


# ----------------------------------------------------------------- geometry

def cloud_pair(spark, sf):
    """Even vectors of each label as prediction, odd ones as truth."""
    p = t.points(spark, sf)
    a = p.where("point_id % 2 = 0").select("cloud", *vx.XYZ)
    b = p.where("point_id % 2 = 1").select("cloud", *vx.XYZ)
    return durable(a, "geo-pred"), durable(b, "geo-gt")


_GEO = f"""WITH {t.POINTS_SQL}, a AS (SELECT * FROM pts WHERE point_id % 2 = 0), b AS (SELECT * FROM pts WHERE point_id % 2 = 1)"""
_NN = "(SELECT min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))) FROM {r} q WHERE q.cloud = p.cloud)"


@query("chamfer", _GEO + f""", da AS (SELECT cloud, avg({_NN.format(r='b')}) * 100 AS acc FROM a p GROUP BY cloud),
db AS (SELECT cloud, avg({_NN.format(r='a')}) * 100 AS com FROM b p GROUP BY cloud)
SELECT cloud, round(acc, 6) AS accuracy_cm, round(com, 6) AS completeness_cm, round((acc + com) / 2, 6) AS chamfer_l1_cm
FROM da JOIN db USING (cloud)""")
def chamfer(spark, sf):
    c = sf_ops.chamfer(*cloud_pair(spark, sf), ["cloud"])
    return c.select("cloud", *[F.round(x, 6).alias(x) for x in ("accuracy_cm", "completeness_cm", "chamfer_l1_cm")])


_DOWN = """{n}l AS (SELECT cloud, min(x) x0, min(y) y0, min(z) z0 FROM {n} GROUP BY cloud),
{n}d AS (SELECT cloud, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {n} JOIN {n}l USING (cloud)
 GROUP BY cloud, floor((x - (x0 - 0.05)) / 0.1), floor((y - (y0 - 0.05)) / 0.1), floor((z - (z0 - 0.05)) / 0.1))"""


@query("f_score", _GEO + ", " + _DOWN.format(n="a") + ", " + _DOWN.format(n="b") + f""",
pa AS (SELECT cloud, avg(CASE WHEN {_NN.format(r='bd')} < 0.2 THEN 1 ELSE 0 END) AS p FROM ad p GROUP BY cloud),
pb AS (SELECT cloud, avg(CASE WHEN {_NN.format(r='ad')} < 0.2 THEN 1 ELSE 0 END) AS r FROM bd p GROUP BY cloud)
SELECT cloud, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pa JOIN pb USING (cloud)""")
def f_score(spark, sf):
    return sf_ops.f_score(*cloud_pair(spark, sf), ["cloud"], 0.2)


@query("column_stats", """WITH l AS (SELECT 'l_quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL
  SELECT 'l_tax', l_tax FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_discount > 0 THEN l_discount END FROM lineitem)
SELECT metric, round(avg(value), 9) AS mean, count(value) AS n, quantile_cont(value, 0.5) AS median FROM l
WHERE value IS NOT NULL GROUP BY metric""")
def column_stats(spark, sf):
    """Mean and median per metric, skipping blanks."""
    li = t.table(spark, sf, "lineitem").select(
        "l_quantity", "l_tax", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount")
    )
    s = sf_ops.column_stats(li, ["l_quantity", "l_tax", "l_discount"])
    return s.withColumn("mean", F.round("mean", 9))


@query("range_cut", f"""WITH {t.POINTS_SQL}, d AS (SELECT cloud, sqrt((x - 0.1)*(x - 0.1) + (y - 0.0)*(y - 0.0) + (z + 0.1)*(z + 0.1)) <= 0.2 AS near FROM pts)
SELECT cloud, count(*) FILTER (WHERE near) AS n_kept, count(*) FILTER (WHERE NOT near) AS n_far FROM d GROUP BY cloud""")
def range_cut(spark, sf):
    p = sf_ops.cut_range(t.points(spark, sf), [F.lit(0.1), F.lit(0.0), F.lit(-0.1)], 0.2)
    return p.groupBy("cloud").agg(F.count_if("in_range").alias("n_kept"), F.count_if(~F.col("in_range")).alias("n_far"))


@query("skip_reasons", """SELECT coalesce(CASE WHEN l_linenumber = 7 THEN 'ignored_match' WHEN l_returnflag = 'N' AND l_quantity > 40
  THEN 'label_png_missing' WHEN l_tax = 0 THEN 'gt_label_empty' WHEN l_discount = 0 THEN 'gt_no_depth_in_range'
  WHEN l_quantity = 1 THEN 'pred_empty_in_range' END, 'scored') AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def skip_reasons(spark, sf):
    li = t.table(spark, sf, "lineitem")
    why = sf_ops.skip_reason(
        F.col("l_linenumber") == 7, (F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40),
        F.col("l_tax") == 0, F.col("l_discount"), F.col("l_quantity") - 1,
    )
    return li.groupBy(F.coalesce(why, F.lit("scored")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("novelty", """SELECT l_orderkey // 64 AS frame, count(*) FILTER (WHERE q AND NOT u AND NOT s) AS n_new,
  count(*) FILTER (WHERE q AND NOT u) AS n_known, count(*) AS n,
  count(*) FILTER (WHERE q AND NOT u AND NOT s) / greatest(count(*) FILTER (WHERE q AND NOT u), 1) AS novelty,
  count(*) FILTER (WHERE q AND NOT u) / count(*) AS valid_frac
FROM (SELECT l_orderkey, l_quantity BETWEEN 5 AND 45 AS q, l_linestatus = 'F' AND l_tax < 0.02 AS u, l_discount <= 0.08 AS s FROM lineitem)
GROUP BY 1""")
def novelty(spark, sf):
    li = t.table(spark, sf, "lineitem").withColumn("frame", F.floor(F.col("l_orderkey") / 64))
    return sf_ops.novelty(
        li, ["frame"], F.col("l_quantity").between(5, 45),
        (F.col("l_linestatus") == "F") & (F.col("l_tax") < 0.02), F.col("l_discount") <= 0.08,
    )
