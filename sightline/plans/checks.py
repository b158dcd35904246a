"""Checks of ground truth and remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import text as tx
from sightline.operators import imaging as im
from sightline.operators import ordered
from sightline.operators import verify as vf
from sightline.operators import voxels as vx
from sightline.plans.registry import query
from sightline.plans.images import _HITS, episode_clouds, sample_points
from sightline.plans.truthset import instance_voxels
from sightline.session import durable
from sightline.sources import tables as t


@query("structural_checks", """WITH s AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS d, user_id FROM events),
m AS (SELECT (SELECT count(DISTINCT user_id) FROM s WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS unknown_ids,
  (SELECT max(n) FROM (SELECT d, count(*) AS n FROM s GROUP BY d)) AS max_segments,
  (SELECT count(*) FROM embeddings WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) > 1e-3) AS off_unit)
SELECT 'unknown_ids' AS "check", unknown_ids::DOUBLE AS value, 0.0 AS bound, (unknown_ids <= 0)::INT AS passed FROM m UNION ALL
SELECT 'max_segments', max_segments, 255.0, (max_segments <= 255)::INT FROM m UNION ALL
SELECT 'off_unit', off_unit, 0.0, (off_unit <= 0)::INT FROM m""")
def structural_checks(spark, sf):
    """Known ids, at most 255 segments per frame, unit vectors."""
    objects = t.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("gt_object_id"))
    row = vf.structural(t.segments(spark, sf), objects, t.table(spark, sf, "embeddings"), "embedding")
    return vf.check_rows(row, {"unknown_ids": ("<=", 0), "max_segments": ("<=", 255), "off_unit": ("<=", 0)})


@query("instance_separation", f"""WITH {t.POINTS_SQL},
v AS (SELECT DISTINCT cloud % 2 AS colour, cloud * 3 + point_id % 3 AS instance, CAST(floor(x / 0.08) AS BIGINT) AS i,
  CAST(floor(y / 0.08) AS BIGINT) AS j, CAST(floor(z / 0.08) AS BIGINT) AS k FROM pts),
n AS (SELECT instance, count(*) AS n FROM v GROUP BY 1),
h AS (SELECT DISTINCT p.colour, p.instance AS a, q.instance AS b, p.i, p.j, p.k FROM v p JOIN v q ON p.colour = q.colour AND p.instance <> q.instance
  AND (p.i-q.i)**2 + (p.j-q.j)**2 + (p.k-q.k)**2 < 2.25),
s AS (SELECT colour, a, b, count(*) AS c FROM h GROUP BY ALL)
SELECT colour, a, b, c / na.n AS share FROM s JOIN n na ON na.instance = a JOIN n nb ON nb.instance = b
WHERE (na.n < nb.n OR (na.n = nb.n AND a < b)) AND c / na.n > 0.2""")
def instance_separation(spark, sf):
    return vf.separation(instance_voxels(spark, sf), "colour", 0.2)


@query("cross_frame", f"""WITH {t.POINTS_SQL}, o AS (SELECT cloud AS object, point_id // 100 AS frame, x, y, z FROM pts),
e AS (SELECT object, min(frame) AS fa, max(frame) AS fb FROM (SELECT object, frame FROM o GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1 HAVING max(frame) - min(frame) >= 1),
d AS (SELECT o.object, frame, (SELECT min(sqrt((p.x-o.x)*(p.x-o.x)+(p.y-o.y)*(p.y-o.y)+(p.z-o.z)*(p.z-o.z))) FROM pts p WHERE p.cloud = (o.object + 1) % 10) AS d
  FROM o JOIN e ON o.object = e.object AND (frame = fa OR frame = fb)),
m AS (SELECT object, frame, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.9) AS p90 FROM d GROUP BY ALL)
SELECT object, round(max(med), 9) AS median_nn_m, round(max(p90), 9) AS p90_nn_m FROM m GROUP BY object""")
def cross_frame(spark, sf):
    """First and last view of each object against the cloud of the next one."""
    p = t.points(spark, sf)
    obs = p.select(F.col("cloud").alias("object"), F.floor(F.col("point_id") / 100).alias("frame"), *vx.XYZ)
    clouds = p.select(((F.col("cloud") + 9) % 10).alias("object"), *vx.XYZ)
    r = vf.cross_frame(obs, clouds, 1, 3)
    return r.withColumns({c: F.round(c, 9) for c in ("median_nn_m", "p90_nn_m")})


def _segment_clouds(spark, sf):
    p = t.points(spark, sf).withColumn("frame", F.floor(F.col("point_id") / 100)).withColumnRenamed("cloud", "segment_id")
    gt = p.where("point_id % 5 <> 0").withColumn("gt_object_id", F.col("segment_id") % 4)
    pred = p.where("point_id % 5 <> 1").withColumn("x", F.col("x") + 0.02)
    objects = p.select((F.col("segment_id") % 4).alias("gt_object_id"), *vx.XYZ)
    return pred.select("frame", "segment_id", *vx.XYZ), gt.select("frame", "segment_id", "gt_object_id", *vx.XYZ), objects


_CLOUD = f"""WITH {t.POINTS_SQL}, p AS (SELECT point_id // 100 AS frame, cloud AS segment_id, cloud % 4 AS o, point_id, x, y, z FROM pts),
gt AS (SELECT * FROM p WHERE point_id % 5 <> 0), pred AS (SELECT frame, segment_id, x + 0.02::DOUBLE AS x, y, z FROM p WHERE point_id % 5 <> 1),
a AS (SELECT DISTINCT frame, segment_id, floor(x/0.1) AS i, floor(y/0.1) AS j, floor(z/0.1) AS k FROM pred),
b AS (SELECT DISTINCT frame, segment_id, floor(x/0.1) AS i, floor(y/0.1) AS j, floor(z/0.1) AS k FROM gt),
na AS (SELECT frame, segment_id, count(*) AS na FROM a GROUP BY ALL), nb AS (SELECT frame, segment_id, count(*) AS nb FROM b GROUP BY ALL),
ab AS (SELECT frame, segment_id, count(*) AS c FROM a JOIN b USING (frame, segment_id, i, j, k) GROUP BY ALL),
own AS (SELECT DISTINCT frame, segment_id, o FROM gt),
d AS (SELECT pred.frame, pred.segment_id, (SELECT min(sqrt((q.x-pred.x)*(q.x-pred.x)+(q.y-pred.y)*(q.y-pred.y)+(q.z-pred.z)*(q.z-pred.z)))
   FROM p q WHERE q.o = own.o) AS d FROM pred JOIN own USING (frame, segment_id)),
od AS (SELECT frame, segment_id, avg((d > 0.015)::INT) AS outlier_ratio FROM d GROUP BY ALL),
sc AS (SELECT frame, segment_id, coalesce(c, 0) / (na + nb - coalesce(c, 0)) AS voxel_iou, outlier_ratio
  FROM na JOIN nb USING (frame, segment_id) LEFT JOIN ab USING (frame, segment_id) LEFT JOIN od USING (frame, segment_id))"""


@query("cloud_scores", _CLOUD + " SELECT frame, segment_id, voxel_iou, outlier_ratio FROM sc")
def cloud_scores(spark, sf):
    """Voxel IoU and outliers of every predicted segment."""
    return vf.cloud_score(*_segment_clouds(spark, sf), 0.1, 0.015)


@query("cloud_run_score", _CLOUD + """ SELECT round(avg(voxel_iou), 9) AS voxel_iou_mean, round(avg(outlier_ratio), 9) AS outlier_ratio_mean,
  count(*) AS segments_scored, count(*) / (SELECT count(*) FROM nb WHERE frame IN (SELECT frame FROM pred)) AS segment_recall FROM sc""")
def cloud_run_score(spark, sf):
    pred, gt, objects = _segment_clouds(spark, sf)
    s = vf.cloud_summary(vf.cloud_score(pred, gt, objects, 0.1, 0.015), gt, pred)
    return s.withColumns({c: F.round(c, 9) for c in ("voxel_iou_mean", "outlier_ratio_mean")})


@query("pixel_labels", _HITS + """,
be AS (SELECT component, pixel, arg_min(episode, (d, episode)) AS label FROM hits GROUP BY ALL),
vo AS (SELECT component, sum(c) AS n_votes, arg_max(label, (c, -label)) AS winner, max(c) AS n_winner
  FROM (SELECT component, label, count(*) AS c FROM be GROUP BY ALL) GROUP BY component),
pa AS (SELECT component, winner, CASE WHEN n_votes / n_samples < 0.5 THEN 'test' WHEN n_winner / n_votes >= 0.9 THEN 'fill' ELSE 'seed' END AS mode
  FROM vo JOIN (SELECT component, count(*) AS n_samples FROM sm GROUP BY component) USING (component)),
px AS (SELECT sm.*, pixel % 7 AS v, abs(x) * 20 AS range_m FROM sm),
ow AS (SELECT pixel, arg_min(episode, (dd, episode)) AS own FROM (SELECT sm.pixel, cl.episode,
    sqrt((sm.x-cl.x)*(sm.x-cl.x)+(sm.y-cl.y)*(sm.y-cl.y)+(sm.z-cl.z)*(sm.z-cl.z)) AS dd FROM sm JOIN cl ON sm.colour = cl.colour) WHERE dd < 0.06 GROUP BY pixel),
se AS (SELECT h.component, h.u, px.v, arg_min(h.episode, (h.d, h.episode)) AS episode FROM hits h JOIN px USING (pixel) GROUP BY ALL),
sd AS (SELECT px.pixel, arg_min(se.episode, ((px.u - se.u) * (px.u - se.u) + (px.v - se.v) * (px.v - se.v), se.episode)) AS seed FROM px JOIN se USING (component) GROUP BY px.pixel),
la AS (SELECT px.component, mode, CASE WHEN mode = 'fill' THEN winner + 1 WHEN mode = 'seed' OR range_m > 5.0 THEN seed + 1 ELSE coalesce(own + 1, 0) END AS label
  FROM px JOIN pa USING (component) LEFT JOIN sd USING (pixel) LEFT JOIN ow USING (pixel))
SELECT component, mode, label, count(*) AS n_px FROM la GROUP BY ALL""")
def pixel_labels(spark, sf):
    """Labels of all sampled pixels after voting, filling and per-pixel tests."""
    s = durable(sample_points(spark, sf), "samples")
    clouds = durable(episode_clouds(spark, sf), "clouds")
    hits = durable(im.cloud_hits(s, clouds), "hits")
    parts = im.label_parts(s, hits, 0.5, 0.9)
    px = s.withColumn("v", (F.col("pixel") % 7).cast("int")).withColumn("range_m", F.abs("x") * 20)
    own = vf.nearest_episode(s.select("pixel", "colour", *vx.XYZ), clouds.select("colour", "episode", *vx.XYZ))
    seeds = hits.join(px.select("pixel", "v"), "pixel").groupBy("component", "u", "v").agg(
        F.min_by("episode", F.struct("d", "episode")).alias("episode")
    )
    out = vf.label_pixels(px, parts, seeds, own, 5.0)
    return out.groupBy("component", "mode", "label").agg(F.count(F.lit(1)).alias("n_px"))


@query("label_pixel_counts", f"WITH {t.RASTER_SQL} SELECT frame, gt, count(*) AS n_px FROM gtc WHERE gt > 0 GROUP BY ALL")
def label_pixel_counts(spark, sf):
    labels = t.label_cells(t.rasters(spark, sf))
    return labels.where("gt > 0").groupBy("frame", "gt").agg(F.count(F.lit(1)).alias("n_px"))


@query("voxel_colours", """SELECT l_partkey AS voxel, round_even(avg(l_quantity), 0)::INT AS r, round_even(avg(l_linenumber * 30), 0)::INT AS g,
  round_even(avg(l_suppkey % 256), 0)::INT AS b FROM lineitem GROUP BY 1""")
def voxel_colours(spark, sf):
    li = t.table(spark, sf, "lineitem")
    rows = li.select(F.col("l_partkey").alias("voxel"), F.col("l_quantity").alias("r"), (F.col("l_linenumber") * 30).alias("g"), (F.col("l_suppkey") % 256).alias("b"))
    return vx.mean_colour(rows, ["voxel"])


@query("colour_counts", """WITH o AS (SELECT l_partkey, l_partkey % 97 AS colour, sum(l_quantity) AS px FROM lineitem GROUP BY ALL)
SELECT colour, count(*) AS n_instances, count(*) FILTER (WHERE px >= 700) AS n_promoted FROM o GROUP BY colour""")
def colour_counts(spark, sf):
    o = t.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("px"))
    return o.groupBy((F.col("l_partkey") % 97).alias("colour")).agg(
        F.count(F.lit(1)).alias("n_instances"), F.count_if(F.col("px") >= 700).alias("n_promoted")
    )


@query("object_recall", """WITH o AS (SELECT l_partkey, bool_or(l_returnflag = 'R' AND l_tax > 0.07) AS hit FROM lineitem GROUP BY 1)
SELECT count(*) AS n_objects, count(*) FILTER (WHERE hit) AS n_found, count(*) FILTER (WHERE hit) / count(*) AS recall FROM o""")
def object_recall(spark, sf):
    li = t.table(spark, sf, "lineitem")
    o = li.groupBy("l_partkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)).alias("hit"))
    return o.agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_if("hit").alias("n_found"), F.avg(F.col("hit").cast("int")).alias("recall")
    )


@query("object_metrics", """WITH c AS (SELECT l_partkey AS object, l_extendedprice AS dist FROM lineitem WHERE l_returnflag <> 'N'),
m AS (SELECT object, count(*) AS n_matched, quantile_cont(dist, 0.5) AS dist_median FROM c GROUP BY 1),
b AS (SELECT l_partkey AS object, arg_min(l_orderkey, (-l_quantity, l_orderkey)) AS best_kf, max(l_quantity) AS best_kf_px FROM lineitem GROUP BY 1)
SELECT object, coalesce(n_matched, 0) AS n_matched, dist_median, best_kf, best_kf_px FROM b LEFT JOIN m USING (object)""")
def object_metrics(spark, sf):
    li = t.table(spark, sf, "lineitem")
    credit = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1)
    obs = li.select(F.col("l_partkey").alias("object"), credit.alias("credit"), F.col("l_extendedprice").alias("dist"))
    best = li.select(F.col("l_partkey").alias("object"), F.col("l_orderkey").alias("kf"), F.col("l_quantity").alias("px"))
    return vf.object_metrics(obs, best)


@query("reasons_text", """WITH c AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'missed' ELSE event_type END AS l, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(CASE l WHEN 'missed' THEN 'not detected' ELSE l END || ' ' || n, ', ' ORDER BY n DESC, CASE l WHEN 'missed' THEN 'not detected' ELSE l END) AS reasons FROM c GROUP BY user_id""")
def reasons_text(spark, sf):
    s = t.signals(spark, sf)
    code = F.when(F.col("event_type") == "error", "missed").otherwise(F.col("event_type"))
    return vf.reasons_text(s, ["user_id"], "event_type", tx.label_of(code, tx.STATUS_NAMES))


@query("lane_stats", f"""WITH {t.RASTER_SQL}, px AS (SELECT frame, cell, min(gt) * 0.8::DOUBLE AS depth FROM raster GROUP BY ALL),
j AS (SELECT msk.frame, pred AS lane, depth FROM msk JOIN px USING (frame, cell))
SELECT frame, lane, count(*) AS area, count(*) FILTER (WHERE depth > 0.5 AND depth < 5) AS n_points,
  round(coalesce(avg(depth * 2) FILTER (WHERE depth > 0.5 AND depth < 5), 0), 9) AS mean_x,
  count(*) FILTER (WHERE depth > 0.5 AND depth < 5) / count(*) AS depth_valid_ratio FROM j GROUP BY ALL""")
def lane_stats(spark, sf):
    """Area, valid depth, centroid and valid share of every mask."""
    r = t.rasters(spark, sf)
    px = r.groupBy("frame", "cell").agg((F.min("gt") * 0.8).alias("depth"))
    px = px.select("frame", "cell", "depth", (F.col("depth") * 2).alias("x"), F.lit(0.0).alias("y"), F.col("depth").alias("z"))
    masks = t.mask_cells(r).withColumnRenamed("pred", "lane")
    s = im.lane_stats(masks, px, 0.5, 5.0)
    return s.select("frame", "lane", "area", "n_points", F.round("mean_x", 9).alias("mean_x"), "depth_valid_ratio")


@query("scattered_vectors", """SELECT d.doc_id, v.vec_id IS NOT NULL AS found, coalesce(round(CAST(v.embedding[1] AS DOUBLE), 9), 0) AS first_dim
FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id""")
def scattered_vectors(spark, sf):
    """Vectors at their detections, zeros where none was computed."""
    d = t.table(spark, sf, "documents").select("doc_id")
    v = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    )
    s = vf.scatter_vectors(d, v, ["doc_id"], 64)
    zero = F.array_max(F.transform("embedding", lambda x: F.abs(x))) > 0
    return s.select("doc_id", zero.alias("found"), F.round(F.element_at("embedding", 1), 9).alias("first_dim"))


@query("type_vectors", """WITH c AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM c)
SELECT p_partkey, i AS axis, 1.0::DOUBLE AS norm FROM part JOIN r USING (p_brand)""")
def type_vectors(spark, sf):
    """One unit axis per type, shared by its copies."""
    p = t.table(spark, sf, "part").select("p_partkey", "p_brand")
    v = vf.type_vectors(p, "p_brand", 64)
    return v.select(
        "p_partkey", (F.array_position("embedding", 1.0) - 1).alias("axis"),
        F.sqrt(g.vector_dot(F.col("embedding"), F.col("embedding"))).alias("norm"),
    )


@query("first_seen_ids", """WITH f AS (SELECT user_id, min(event_id) AS p FROM events GROUP BY 1)
SELECT user_id, row_number() OVER (ORDER BY p) - 1 AS dense_id FROM f""")
def first_seen_ids(spark, sf):
    return vf.first_seen_ids(t.signals(spark, sf), "user_id", "event_id")


@query("late_frames", """WITH s AS (SELECT user_id, min(event_id) AS s0, min(epoch_us(ts)) AS w0 FROM events GROUP BY 1)
SELECT user_id, count(*) AS n_frames, count(*) FILTER (WHERE epoch_us(ts) - (w0 + (event_id - s0) * 250000000.0) > 3600000000) AS lag_frames
FROM events JOIN s USING (user_id) GROUP BY user_id""")
def late_frames(spark, sf):
    """Frames that arrived more than an hour behind a replay of one event per 250 s."""
    return vf.late_frames(t.signals(spark, sf), ["user_id"], "event_id", "ts_us", 1 / 250000000.0, 3_600_000_000)


@query("run_window", """SELECT o_custkey, min(epoch_us(o_orderdate)) // 86400000000 AS first_day, max(epoch_us(o_orderdate)) // 86400000000 AS last_day
FROM orders GROUP BY 1 HAVING max(epoch_us(o_orderdate)) // 86400000000 >= 9500 AND min(epoch_us(o_orderdate)) // 86400000000 < 9900""")
def run_window(spark, sf):
    """Episodes that overlap a partial run."""
    o = t.table(spark, sf, "orders").select("o_custkey", t.micros("o_orderdate").alias("us")).withColumn("d", t.day_of("us"))
    e = o.groupBy("o_custkey").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    return vf.in_run(e, "first_day", "last_day", F.lit(9500), F.lit(9900))


@query("every_kth", """WITH n AS (SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS p, count(*) OVER () AS c FROM events)
SELECT user_id, event_id FROM n WHERE p % greatest(1, c // 40) = 0 AND p // greatest(1, c // 40) < 40""")
def every_kth(spark, sf):
    s = t.signals(spark, sf).select("user_id", "event_id")
    return vf.every_kth(s, ["user_id", "event_id"], 40)


@query("object_hues", "SELECT p_partkey, round((p_partkey * 0.61803398875::DOUBLE) % 1.0, 9) AS hue FROM part")
def object_hues(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", F.round(g.golden_hue(F.col("p_partkey")), 9).alias("hue"))


@query("similar_sentences", """WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^0-9A-Za-z]', '', 'g') AS a,
  regexp_replace(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), text), '[^0-9A-Za-z]', '', 'g') AS b FROM conversations)
SELECT conv_id, turn, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)
  OR 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) >= 0.7) AS same FROM c""")
def similar_sentences(spark, sf):
    """Turns that say nearly what the turn before says."""
    c = t.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    s = ordered.carry(ordered.sliced(c, ["conv_id"], ["turn"]), ["conv_id"], ["turn"], F.col("text"), "p", inclusive=False)
    return s.select("conv_id", "turn", tx.nearly_same(F.col("text"), F.coalesce("p", "text")).alias("same"))


@query("stamp_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, to_base64((user_id::VARCHAR)::BLOB) AS packed FROM events")
def stamp_text(spark, sf):
    e = t.table(spark, sf, "events")
    return e.select(
        "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("text"),
        F.base64(F.col("user_id").cast("string").cast("binary")).alias("packed"),
    )


@query("parameter_mismatch", """SELECT l_linenumber, count(*) FILTER (WHERE abs(l_extendedprice - l_extendedprice * (1 + l_discount * 3e-8)) > 1e-9 * greatest(l_extendedprice, 1)) AS n_different,
  count(*) AS n FROM lineitem GROUP BY 1""")
def parameter_mismatch(spark, sf):
    """Recorded against current parameters with tolerance."""
    li = t.table(spark, sf, "lineitem")
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_discount") * 3e-8)
    return li.groupBy("l_linenumber").agg(F.count_if(~vf.same_value(a, b)).alias("n_different"), F.count(F.lit(1)).alias("n"))
