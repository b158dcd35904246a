"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import text as tx
from sightline.operators import rules
from sightline.operators import runs
from sightline.plans.registry import query
from sightline.sources import tables as t


@query("pack_colours", """SELECT p_partkey, ((p_partkey % 256) << 16) | ((p_size * 5 % 256) << 8) | (p_partkey * 7 % 256) AS packed,
  p_partkey % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 7 % 256 AS b,
  lower(printf('%06x', ((p_partkey % 256) << 16) | ((p_size * 5 % 256) << 8) | (p_partkey * 7 % 256))) AS color_hex FROM part""")
def pack_colours(spark, sf):
    p = t.table(spark, sf, "part")
    packed = g.pack_rgb(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256)
    p = p.select("p_partkey", packed.alias("packed"))
    r, gg, b = g.unpack_rgb(F.col("packed"))
    return p.select("p_partkey", "packed", r.alias("r"), gg.alias("g"), b.alias("b"), g.colour_hex(F.col("packed")).alias("color_hex"))


@query("human_colours", """SELECT p_partkey FROM part WHERE lower(printf('%06x', p_partkey * 9241 % 16777216)) = '23d5ea'
  OR p_size = 7 AND p_partkey % 2 = 0""")
def human_colours(spark, sf):
    p = t.table(spark, sf, "part")
    colour = F.when((F.col("p_size") == 7) & (F.col("p_partkey") % 2 == 0), F.lit("#23d5ea")).otherwise(
        F.concat(F.lit("#"), g.colour_hex(F.col("p_partkey") * 9241 % 16777216))
    )
    return p.where(rules.is_human(colour)).select("p_partkey")


@query("stamp_parts", """SELECT event_id, epoch_us(ts) * 1000 // 1000000000 AS sec, epoch_us(ts) * 1000 % 1000000000 AS nanosec FROM events""")
def stamp_parts(spark, sf):
    s = t.signals(spark, sf)
    sec, ns = tx.stamp_parts(F.col("ts_us") * 1000)
    return s.select("event_id", sec.alias("sec"), ns.alias("nanosec"))


@query("unit_vectors", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12), 9) AS u1 FROM embeddings""")
def unit_vectors(spark, sf):
    e = t.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.element_at(g.unit_vector(F.col("embedding")), 1), 9).alias("u1"))


_Q = """WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  CAST(embedding[4] AS DOUBLE) AS w, CAST(embedding[5] AS DOUBLE) AS px, CAST(embedding[6] AS DOUBLE) AS py,
  CAST(embedding[7] AS DOUBLE) AS pz FROM embeddings),
u AS (SELECT vec_id, x/n AS x, y/n AS y, z/n AS z, w/n AS w, px, py, pz FROM (SELECT *, sqrt(x*x+y*y+z*z+w*w) AS n FROM q))"""


def poses(spark, sf):
    e = t.table(spark, sf, "embeddings")
    names = ("x", "y", "z", "w", "px", "py", "pz")
    return e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(names)])


@query("rotate_points", _Q + """
SELECT vec_id, round((1-2*(y*y+z*z))*px + 2*(x*y-z*w)*py + 2*(x*z+y*w)*pz + 1.0, 9) AS wx,
  round(2*(x*y+z*w)*px + (1-2*(x*x+z*z))*py + 2*(y*z-x*w)*pz + 2.0, 9) AS wy,
  round(2*(x*z-y*w)*px + 2*(y*z+x*w)*py + (1-2*(x*x+y*y))*pz + 3.0, 9) AS wz FROM u""")
def rotate_points(spark, sf):
    """Points taken from the camera frame to the world frame."""
    p = poses(spark, sf)
    rot = g.rotation_of([F.col(c) for c in "xyzw"])
    w = g.camera_to_world([F.col(c) for c in ("px", "py", "pz")], rot, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    return p.select("vec_id", *[F.round(v, 9).alias(n) for v, n in zip(w, ("wx", "wy", "wz"))])


@query("camera_roundtrip", "SELECT vec_id, round(CAST(embedding[5] AS DOUBLE), 6) AS px, round(CAST(embedding[6] AS DOUBLE), 6) AS py, round(CAST(embedding[7] AS DOUBLE), 6) AS pz FROM embeddings")
def camera_roundtrip(spark, sf):
    """To the world and back gives the point again."""
    p = poses(spark, sf)
    rot = g.rotation_of([F.col(c) for c in "xyzw"])
    shift = [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    w = g.camera_to_world([F.col(c) for c in ("px", "py", "pz")], rot, shift)
    back = g.world_to_camera(w, rot, shift)
    return p.select("vec_id", *[F.round(v, 6).alias(n) for v, n in zip(back, ("px", "py", "pz"))])


@query("slerp_poses", _Q + """, v AS (SELECT vec_id, x, y, z, w, w AS d FROM u),
a AS (SELECT *, CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END AS s, least(abs(d), 1.0) AS c FROM v),
k AS (SELECT *, CASE WHEN c > 0.9995 THEN 0.75 ELSE sin(0.75 * acos(c)) / sin(acos(c)) END AS wa,
  (CASE WHEN c > 0.9995 THEN 0.25 ELSE sin(0.25 * acos(c)) / sin(acos(c)) END) * s AS wb FROM a),
b AS (SELECT vec_id, wb * x AS bx, wb * y AS by_, wb * z AS bz, wa + wb * w AS bw FROM k)
SELECT vec_id, round(bx / sqrt(bx*bx+by_*by_+bz*bz+bw*bw), 9) AS qx, round(bw / sqrt(bx*bx+by_*by_+bz*bz+bw*bw), 9) AS qw FROM b""")
def slerp_poses(spark, sf):
    """A quarter of the way from no rotation to each pose."""
    p = poses(spark, sf)
    n = g.norm([F.col(c) for c in "xyzw"])
    unit = [F.col(c) / n for c in "xyzw"]
    q = g.slerp([F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)], unit, F.lit(0.25))
    return p.select("vec_id", F.round(q[0], 9).alias("qx"), F.round(q[3], 9).alias("qw"))


FX, FY, CX, CY = 400.0, 380.0, 320.0, 240.0


@query("project_pixels", f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey % 640 AS u, l_suppkey % 480 AS v,
  CASE WHEN l_quantity > 3 THEN l_quantity * 120 / 1000.0::DOUBLE END AS z FROM lineitem),
c AS (SELECT *, (u - {CX}) / {FX} * z AS x, (v - {CY}) / {FY} * z AS y FROM d WHERE z IS NOT NULL)
SELECT u, v, count(*) AS n, count(*) FILTER (WHERE abs({FX} * x / z + {CX} - u) < 1e-6 AND abs({FY} * y / z + {CY} - v) < 1e-6) AS n_back
FROM c GROUP BY ALL""")
def project_pixels(spark, sf):
    """Back-projection and projection of every valid pixel."""
    li = t.table(spark, sf, "lineitem")
    raw = F.when(F.col("l_quantity") > 3, F.col("l_quantity") * 120).otherwise(0.0)
    p = li.select((F.col("l_partkey") % 640).alias("u"), (F.col("l_suppkey") % 480).alias("v"), g.depth_metres(raw).alias("z"))
    p = p.where("z IS NOT NULL")
    cam = g.back_project(F.col("u"), F.col("v"), F.col("z"), FX, FY, CX, CY)
    pu, pv = g.project(cam, FX, FY, CX, CY, "rint")
    return p.groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((pu == F.col("u")) & (pv == F.col("v"))).alias("n_back")
    )


@query("footprints", f"""SELECT l_quantity AS z, round(pow(0.02 * {FX} / greatest(l_quantity / 10, 0.1), 2), 9) AS px,
  greatest(1, least(12, ceil(0.5 * 0.02 * {FX} / (l_quantity / 10))))::INT AS radius, count(*) AS n FROM lineitem GROUP BY l_quantity""")
def footprints(spark, sf):
    z = F.col("l_quantity") / 10
    return (
        t.table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("l_quantity").alias("z"), F.round(g.footprint_px(z, FX), 9).alias("px"), g.splat_radius(z, FX).alias("radius"), "n")
    )


@query("fused_scores", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 / (1 + exp(-(l_quantity - 25) / 8)) AS w, l_discount * 10 AS iou, l_tax * 12 AS c FROM lineitem)
SELECT l_partkey, l_suppkey, round(max(w * (1 + iou) + (1 - w) * c), 9) AS best FROM s GROUP BY ALL""")
def fused_scores(spark, sf):
    li = t.table(spark, sf, "lineitem")
    w = g.sigmoid_weight(F.col("l_quantity"), 25.0, 8.0)
    s = g.fused_score(w, F.col("l_discount") * 10, F.col("l_tax") * 12)
    return li.groupBy("l_partkey", "l_suppkey").agg(F.round(F.max(s), 9).alias("best"))


@query("counts_text", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || ':' || n, ';' ORDER BY event_type) AS counts FROM c GROUP BY user_id""")
def counts_text(spark, sf):
    c = t.signals(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return runs.encode_counts(c, ["user_id"], "event_type", "n")


@query("counts_map", "SELECT user_id, event_type AS item, count(*) AS n FROM events GROUP BY ALL")
def counts_map(spark, sf):
    """Encoded counts read back as rows."""
    c = t.signals(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    e = runs.encode_counts(c, ["user_id"], "event_type", "n")
    return e.select("user_id", F.explode(runs.decode_counts(F.col("counts"))).alias("item", "n")).withColumn("n", F.col("n").cast("long"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return t.signals(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("half_up_text", """SELECT l_extendedprice AS v, printf('%.1f', round(l_extendedprice::DECIMAL(18,2), 1)) AS text, count(*) AS n FROM lineitem GROUP BY 1""")
def half_up_text(spark, sf):
    """One decimal, halves away from zero, from the shortest decimal form."""
    return (
        t.table(spark, sf, "lineitem").groupBy(F.col("l_extendedprice").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .select("v", tx.fixed(F.col("v"), 1).alias("text"), "n")
    )


@query("percent_counts", """WITH c AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
SELECT l_partkey, n, k, ((2000 * k + n) // (2 * n)) / 10 AS pct FROM c""")
def percent_counts(spark, sf):
    c = t.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k")
    )
    return c.withColumn("pct", tx.percent_of_counts(F.col("k"), F.col("n")))


@query("recovered_counts", """WITH c AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
SELECT l_partkey, n, k AS recovered FROM c""")
def recovered_counts(spark, sf):
    """Numerators recovered from ratios stored with four digits."""
    c = t.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)), 4).alias("ratio")
    )
    return c.select("l_partkey", "n", tx.recover_count(F.col("ratio"), F.col("n")).alias("recovered"))


@query("url_stems", "SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pages")
def url_stems(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", tx.file_stem(F.col("url")).alias("stem"))


@query("finite_values", """SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_discount > 0 THEN 1 END) AS n_finite FROM lineitem GROUP BY 1""")
def finite_values(spark, sf):
    """Ratios over a zero denominator become missing values, never NaN."""
    li = t.table(spark, sf, "lineitem")
    v = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan")))
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count(rules.finite(v)).alias("n_finite"))


@query("status_names", """SELECT CASE event_type WHEN 'view' THEN 'detected' ELSE event_type END AS label, count(*) AS n FROM events GROUP BY 1""")
def status_names(spark, sf):
    """Codes shown by their display name; unknown codes stay."""
    s = t.signals(spark, sf)
    code = F.when(F.col("event_type") == "view", "tp").otherwise(F.col("event_type"))
    return s.groupBy(tx.label_of(code, tx.STATUS_NAMES).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("log_counts", """SELECT source, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3,}')) AS n_docs_with_numbers,
  sum(len(regexp_extract_all(text, '[0-9]{3,}')))::BIGINT AS n_numbers FROM documents GROUP BY source""")
def log_counts(spark, sf):
    """Pattern counts over whole texts."""
    d = t.table(spark, sf, "documents")
    return d.groupBy("source").agg(
        F.count_if(F.col("text").rlike("[0-9]{3,}")).alias("n_docs_with_numbers"),
        F.sum(F.regexp_count("text", F.lit("[0-9]{3,}"))).cast("long").alias("n_numbers"),
    )
