"""Voxel sets, nearest neighbours and surface geometry over the embedding clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import nearest as nn
from sightline.operators import voxels as vx
from sightline.operators.quantiles import exact_quantiles
from sightline.plans.registry import query
from sightline.sources import tables as t

VOXEL = 0.1

_KEY = "((CAST(floor(x / {v}) AS BIGINT) + 1048576) << 42) | ((CAST(floor(y / {v}) AS BIGINT) + 1048576) << 21) | (CAST(floor(z / {v}) AS BIGINT) + 1048576)"
VOX_SQL = f"WITH {t.POINTS_SQL}, vox AS (SELECT DISTINCT cloud, {_KEY.format(v=VOXEL)} AS voxel FROM pts)"


def cloud_voxels(spark, sf):
    return vx.occupancy(t.points(spark, sf), ["cloud"], VOXEL)


@query("voxel_occupancy", VOX_SQL + " SELECT cloud, voxel FROM vox")
def voxel_occupancy(spark, sf):
    return cloud_voxels(spark, sf)


@query("voxel_roundtrip", f"""WITH {t.POINTS_SQL}
SELECT DISTINCT cloud, CAST(floor(x / {VOXEL}) AS BIGINT) AS ix, CAST(floor(y / {VOXEL}) AS BIGINT) AS iy,
  CAST(floor(z / {VOXEL}) AS BIGINT) AS iz, (floor(x / {VOXEL}) + 0.5) * {VOXEL} AS cx FROM pts""")
def voxel_roundtrip(spark, sf):
    ix, iy, iz = g.voxel_index(F.col("voxel"))
    return cloud_voxels(spark, sf).select(
        "cloud", ix.alias("ix"), iy.alias("iy"), iz.alias("iz"), g.cell_centre(ix, VOXEL).alias("cx")
    )


@query("voxel_iou", VOX_SQL + """,
n AS (SELECT cloud, count(*) AS n FROM vox GROUP BY cloud),
i AS (SELECT p.cloud AS a, count(*) AS s FROM vox p JOIN vox q ON p.voxel = q.voxel AND q.cloud = (p.cloud + 1) % 10
      GROUP BY ALL)
SELECT na.cloud AS a, nb.cloud AS b, na.n AS n_a, nb.n AS n_b, coalesce(s, 0) AS n_shared,
       coalesce(s, 0) / (na.n + nb.n - coalesce(s, 0)) AS iou
FROM n na JOIN n nb ON nb.cloud = (na.cloud + 1) % 10 LEFT JOIN i ON i.a = na.cloud""")
def voxel_iou(spark, sf):
    """IoU of each cloud with the next one."""
    vox = cloud_voxels(spark, sf)
    pairs = vox.select(F.col("cloud").alias("a"), ((F.col("cloud") + 1) % 10).alias("b")).distinct()
    return vx.pair_iou(vox, "cloud", pairs).select("a", "b", "n_a", "n_b", "n_shared", "iou")


@query("voxel_intersect", VOX_SQL + """
SELECT voxel FROM vox WHERE cloud % 2 = 0 INTERSECT SELECT voxel FROM vox WHERE cloud % 2 = 1""")
def voxel_intersect(spark, sf):
    vox = cloud_voxels(spark, sf)
    return vox.where("cloud % 2 = 0").select("voxel").intersect(vox.where("cloud % 2 = 1").select("voxel"))


@query("voxel_difference", VOX_SQL + """
SELECT voxel FROM vox WHERE cloud % 2 = 0 EXCEPT SELECT voxel FROM vox WHERE cloud % 2 = 1""")
def voxel_difference(spark, sf):
    vox = cloud_voxels(spark, sf)
    odd = vox.where("cloud % 2 = 1").select("voxel")
    return vox.where("cloud % 2 = 0").select("voxel").distinct().join(odd, "voxel", "left_anti")


@query("voxel_union", VOX_SQL + " SELECT DISTINCT voxel FROM vox")
def voxel_union(spark, sf):
    return cloud_voxels(spark, sf).select("voxel").distinct()


@query("voxel_exact_share", VOX_SQL + """
SELECT p.cloud, avg(CASE WHEN q.voxel IS NULL THEN 0 ELSE 1 END) AS exact_share, count(*) AS n_voxels
FROM vox p LEFT JOIN (SELECT DISTINCT voxel FROM vox WHERE cloud < 5) q ON p.voxel = q.voxel GROUP BY p.cloud""")
def voxel_exact_share(spark, sf):
    """Share of each cloud's voxels that the first five clouds occupy exactly."""
    vox = cloud_voxels(spark, sf)
    ref = vox.where("cloud < 5").select("voxel", F.lit(1).alias("_hit")).distinct()
    return (
        vox.join(ref, "voxel", "left")
        .groupBy("cloud")
        .agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("exact_share"), F.count(F.lit(1)).alias("n_voxels"))
    )


def _touch_sql(limit: str) -> str:
    return VOX_SQL + f""",
ix AS (SELECT cloud, voxel, (voxel >> 42) AS i, ((voxel >> 21) & 2097151) AS j, (voxel & 2097151) AS k FROM vox),
hit AS (SELECT DISTINCT p.cloud AS a, q.cloud AS b, p.voxel FROM ix p JOIN ix q ON p.cloud <> q.cloud
  AND q.i BETWEEN p.i - 1 AND p.i + 1 AND q.j BETWEEN p.j - 1 AND p.j + 1 AND q.k BETWEEN p.k - 1 AND p.k + 1
  AND {limit}),
n AS (SELECT cloud AS a, count(*) AS n_a FROM vox GROUP BY cloud)
SELECT a, b, count(*) AS n_touch, n_a, count(*) / n_a AS share FROM hit JOIN n USING (a) GROUP BY a, b, n_a"""


@query("adjacent_overlap", _touch_sql("abs(q.i - p.i) + abs(q.j - p.j) + abs(q.k - p.k) <= 1"))
def adjacent_overlap(spark, sf):
    return vx.touch_share(cloud_voxels(spark, sf), "cloud", [], vx.FACE_STEPS).select("a", "b", "n_touch", "n_a", "share")


@query("near_overlap", _touch_sql("(q.i - p.i) ** 2 + (q.j - p.j) ** 2 + (q.k - p.k) ** 2 < 2.25"))
def near_overlap(spark, sf):
    """Share of voxels within 1.5 cells of another cloud."""
    return vx.touch_share(cloud_voxels(spark, sf), "cloud", [], vx.NEAR_STEPS).select("a", "b", "n_touch", "n_a", "share")


_DOWN = f"""WITH {t.POINTS_SQL}, lo AS (SELECT cloud, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM pts GROUP BY cloud),
down AS (SELECT cloud, CAST(floor((x - (x0 - 0.1)) / 0.2) AS BIGINT) AS ix,
  CAST(floor((y - (y0 - 0.1)) / 0.2) AS BIGINT) AS iy, CAST(floor((z - (z0 - 0.1)) / 0.2) AS BIGINT) AS iz,
  avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_points FROM pts JOIN lo USING (cloud) GROUP BY ALL)"""


@query("voxel_downsample", _DOWN + """
SELECT cloud, ix, iy, iz, n_points, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM down""")
def voxel_downsample(spark, sf):
    d = vx.downsample(t.points(spark, sf), ["cloud"], 0.2)
    return d.select("cloud", "ix", "iy", "iz", "n_points", *[F.round(c, 9).alias(c) for c in vx.XYZ])


@query("cloud_extents", f"""WITH {t.POINTS_SQL}
SELECT cloud, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, round(avg(x), 9) AS mean_x,
  min(y) AS min_y, max(y) AS max_y, round(avg(y), 9) AS mean_y, min(z) AS min_z, max(z) AS max_z,
  round(avg(z), 9) AS mean_z FROM pts GROUP BY cloud""")
def cloud_extents(spark, sf):
    e = vx.extents(t.points(spark, sf), ["cloud"])
    return e.withColumns({f"mean_{c}": F.round(f"mean_{c}", 9) for c in vx.XYZ})


_DIST = f"""WITH {t.POINTS_SQL}, d AS (SELECT p.point_id, p.cloud,
  min(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))) AS dist
  FROM pts p JOIN pts q ON q.cloud = (p.cloud + 1) % 10 GROUP BY ALL)"""


def next_cloud_distance(spark, sf):
    """Each point with its distance to the next cloud."""
    p = t.points(spark, sf)
    q = p.withColumn("target", (F.col("cloud") + 1) % 10)
    ref = p.select(F.col("cloud").alias("target"), *vx.XYZ)
    d = nn.nearest(q, ref, ["target"])
    return q.join(d, ["target", *vx.XYZ])


@query("nearest_distance", _DIST + " SELECT point_id, cloud, dist FROM d")
def nearest_distance(spark, sf):
    return next_cloud_distance(spark, sf).select("point_id", "cloud", "dist")


@query("outlier_ratio", _DIST + " SELECT cloud, avg(CASE WHEN dist > 0.1 THEN 1 ELSE 0 END) AS outlier_ratio FROM d GROUP BY cloud")
def outlier_ratio(spark, sf):
    d = next_cloud_distance(spark, sf)
    return d.groupBy("cloud").agg(F.avg((F.col("dist") > 0.1).cast("int")).alias("outlier_ratio"))


@query("alignment_percentiles", _DIST + """
SELECT cloud, round(quantile_cont(dist, 0.1), 9) AS p10, round(quantile_cont(dist, 0.5), 9) AS p50, round(quantile_cont(dist, 0.9), 9) AS p90,
  round(quantile_cont(dist, 0.99), 9) AS p99 FROM d GROUP BY cloud""")
def alignment_percentiles(spark, sf):
    d = next_cloud_distance(spark, sf)
    q = exact_quantiles(d, ["cloud"], "dist", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})
    return q.select("cloud", *[F.round(c, 9).alias(c) for c in ("p10", "p50", "p90", "p99")])


@query("label_transfer", f"""WITH {t.POINTS_SQL}, d AS (SELECT p.point_id, q.cloud AS owner, q.point_id AS owner_point,
  sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) AS dist
  FROM pts p JOIN pts q ON q.cloud < 5 WHERE p.cloud >= 5)
SELECT p.point_id, coalesce(m.owner, -1) AS owner FROM (SELECT point_id FROM pts WHERE cloud >= 5) p LEFT JOIN
 (SELECT point_id, arg_min(owner, (dist, owner)) AS owner FROM d WHERE dist < 0.1 GROUP BY point_id) m USING (point_id)""")
def label_transfer(spark, sf):
    """Nearest labelled point within 10 cm gives its label, otherwise none (-1)."""
    p = t.points(spark, sf)
    q = p.where("cloud >= 5")
    ref = p.where("cloud < 5").withColumnRenamed("cloud", "owner")
    d = nn.nearest(q, ref, [], bound=0.1, payload=["owner"])
    return q.join(d, list(vx.XYZ), "left").select("point_id", F.coalesce("owner", F.lit(-1)).alias("owner"))
