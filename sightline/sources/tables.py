"""Views of the given tables as perception entities.

Every adapter is a narrow projection of one parquet scan, so column pruning and
filters reach the files. All of them cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import use_utc

US_PER_DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def day_of(us: str):
    return F.floor(F.col(us) / F.lit(US_PER_DAY)).cast("long")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the timestamp as integer microseconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", micros("ts").alias("ts_us"), "user_id", "event_type", "value", "props")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival log: topic, stamp (source and day), receive time, sequence number."""
    s = signals(spark, sf_dir)
    return s.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") * 100000 + day_of("ts_us")).alias("stamp_ns"),
        F.col("ts_us").alias("recv_us"),
        F.col("event_id").alias("seq"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object segments per frame: object = user, frame = day, pixels = value."""
    s = signals(spark, sf_dir)
    return s.select(
        F.col("user_id").alias("gt_object_id"),
        day_of("ts_us").alias("frame_idx"),
        F.floor("value").cast("long").alias("n_pixels"),
        "event_type",
        "event_id",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds: one point per embedding, first three dimensions, cloud = label."""
    e = table(spark, sf_dir, "embeddings")
    dim = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    return e.select(
        F.col("label").cast("long").alias("cloud"),
        F.col("vec_id").alias("point_id"),
        dim[0].alias("x"),
        dim[1].alias("y"),
        dim[2].alias("z"),
    )


FRAME_ORDERS = 256
LABELS = 8


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rasters: a labelled pixel per line item, frame = block of orders, 0 = void.

    The ground truth comes from the part. The prediction repeats it for a share
    of the pixels and takes the supplier for the rest; every fourth frame merges
    neighbouring labels, splits them, or is mostly noise.
    """
    li = table(spark, sf_dir, "lineitem")
    gt, other, q = F.col("l_partkey") % LABELS, F.col("l_suppkey") % LABELS, F.col("l_quantity")
    frame = F.floor(F.col("l_orderkey") / FRAME_ORDERS).cast("long")
    kind = frame % 4
    pred = (
        F.when((kind == 0) & (q <= 35), gt)
        .when((kind == 1) & (q <= 44), gt - gt % 2)
        .when((kind == 2) & (q <= 20), gt)
        .when((kind == 2) & (q <= 44), gt + LABELS)
        .when((kind == 3) & (q <= 12), gt)
        .otherwise(other)
    )
    return li.select(
        frame.alias("frame"),
        gt.alias("gt"),
        pred.alias("pred"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cell"),
    )


def label_cells(raster: DataFrame) -> DataFrame:
    """One ground-truth label per cell."""
    return raster.groupBy("frame", "cell").agg(F.min("gt").alias("gt"))


def mask_cells(raster: DataFrame) -> DataFrame:
    """Cells of the predicted masks; masks may overlap."""
    return raster.where("pred > 0").select("frame", "pred", "cell").distinct()


SPREAD = 0.35


def surfaces(spark: SparkSession, sf_dir: str, size: float) -> tuple[DataFrame, DataFrame]:
    """Per frame: voxel centres of ground-truth surfaces and of predictions.

    Frame = block of 100 vectors, ground truth = label, shifted along x so that
    labels lie side by side. Predictions see jittered points, and a third of
    them goes to another id.
    """
    e = table(spark, sf_dir, "embeddings")
    dim = [F.element_at("embedding", i).cast("double") for i in range(1, 7)]
    label = F.col("label").cast("long")
    frame = F.floor(F.col("vec_id") / 100).cast("long").alias("frame")
    base = [dim[0] + label * F.lit(SPREAD), dim[1], dim[2]]
    pred = F.when(F.col("vec_id") % 3 < 2, label).otherwise((label * 3 + 1) % 12)

    def centres(ident, xyz):
        cells = [((F.floor(v / F.lit(size)) + F.lit(0.5)) * F.lit(size)).alias(c) for v, c in zip(xyz, "xyz")]
        return e.select(frame, ident, *cells).distinct()

    gt = centres(label.alias("gt"), base)
    moved = [b + d * F.lit(0.1) for b, d in zip(base, dim[3:])]
    return gt, centres(pred.cast("long").alias("pred"), moved)


SURFACES_SQL = """base AS (SELECT vec_id, CAST(floor(vec_id / 100.0) AS BIGINT) AS frame, CAST(label AS BIGINT) AS gt,
  CAST(CASE WHEN vec_id % 3 < 2 THEN label ELSE (label * 3 + 1) % 12 END AS BIGINT) AS pred,
  CAST(embedding[1] AS DOUBLE) + label * CAST({spread} AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS jx, CAST(embedding[5] AS DOUBLE) AS jy,
  CAST(embedding[6] AS DOUBLE) AS jz FROM embeddings),
gv AS (SELECT DISTINCT frame, gt, (floor(x / CAST({v} AS DOUBLE)) + 0.5) * CAST({v} AS DOUBLE) AS x,
  (floor(y / CAST({v} AS DOUBLE)) + 0.5) * CAST({v} AS DOUBLE) AS y,
  (floor(z / CAST({v} AS DOUBLE)) + 0.5) * CAST({v} AS DOUBLE) AS z FROM base),
pv AS (SELECT DISTINCT frame, pred,
  (floor((x + jx * CAST(0.1 AS DOUBLE)) / CAST({v} AS DOUBLE)) + 0.5) * CAST({v} AS DOUBLE) AS x,
  (floor((y + jy * CAST(0.1 AS DOUBLE)) / CAST({v} AS DOUBLE)) + 0.5) * CAST({v} AS DOUBLE) AS y,
  (floor((z + jz * CAST(0.1 AS DOUBLE)) / CAST({v} AS DOUBLE)) + 0.5) * CAST({v} AS DOUBLE) AS z FROM base)"""

RASTER_SQL = f"""base AS (SELECT CAST(floor(l_orderkey / {FRAME_ORDERS}.0) AS BIGINT) AS frame,
    l_partkey % {LABELS} AS gt, l_suppkey % {LABELS} AS other, l_quantity AS q, l_orderkey * 8 + l_linenumber AS cell
  FROM lineitem),
raster AS (SELECT frame, gt, cell, CASE WHEN frame % 4 = 0 AND q <= 35 THEN gt
    WHEN frame % 4 = 1 AND q <= 44 THEN gt - gt % 2
    WHEN frame % 4 = 2 AND q <= 20 THEN gt
    WHEN frame % 4 = 2 AND q <= 44 THEN gt + {LABELS}
    WHEN frame % 4 = 3 AND q <= 12 THEN gt ELSE other END AS pred FROM base),
gtc AS (SELECT frame, cell, min(gt) AS gt FROM raster GROUP BY ALL),
msk AS (SELECT DISTINCT frame, pred, cell FROM raster WHERE pred > 0)"""

POINTS_SQL = """pts AS (
  SELECT CAST(label AS BIGINT) AS cloud, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x,
         CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
  FROM embeddings)"""

ARRIVALS_SQL = """arr AS (
  SELECT event_type AS topic, user_id * 100000 + CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS stamp_ns,
         epoch_us(ts) AS recv_us, event_id AS seq
  FROM events)"""

SEGMENTS_SQL = """seg AS (
  SELECT user_id AS gt_object_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS frame_idx,
         CAST(floor(value) AS BIGINT) AS n_pixels, event_type, event_id
  FROM events)"""

STEP_US = 3 * 3600 * 1_000_000


def tracking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truths, tracks and similarities: sequence = user mod 10, timestep = three hours."""
    s = signals(spark, sf_dir)
    gt = F.floor(F.col("user_id") / 10) % 5
    late = F.floor(day_of("ts_us") / 10)
    trk = F.when(F.col("value") > 120, F.col("event_id") % 5 * 10).otherwise(gt * 10 + late % 4)
    rows = s.select(
        (F.col("user_id") % 10).alias("seq"),
        F.floor(F.col("ts_us") / STEP_US).cast("long").alias("t"),
        gt.cast("long").alias("gt"),
        trk.cast("long").alias("trk"),
        (F.lit(60.0) / (F.lit(60.0) + F.col("value"))).alias("sim"),
        "event_type",
    )
    truths = rows.where("event_type <> 'purchase'").select("seq", "t", "gt").distinct()
    tracks = rows.where("event_type <> 'error'").select("seq", "t", "trk").distinct()
    pairs = (
        rows.where("event_type NOT IN ('error', 'purchase')").groupBy("seq", "t", "gt", "trk").agg(F.max("sim").alias("sim"))
    )
    return truths, tracks, pairs


TRACKING_SQL = f"""mrow AS (SELECT user_id % 10 AS seq, CAST(floor(epoch_us(ts) / {STEP_US}) AS BIGINT) AS t,
  (user_id // 10) % 5 AS gt, CASE WHEN value > 120 THEN event_id % 5 * 10
    ELSE (user_id // 10) % 5 * 10 + (epoch_us(ts) // 86400000000 // 10) % 4 END AS trk,
  60.0::DOUBLE / (60.0::DOUBLE + value) AS sim, event_type FROM events),
truths AS (SELECT DISTINCT seq, t, gt FROM mrow WHERE event_type <> 'purchase'),
tracks AS (SELECT DISTINCT seq, t, trk FROM mrow WHERE event_type <> 'error'),
mpair AS (SELECT seq, t, gt, trk, max(sim) AS sim FROM mrow WHERE event_type NOT IN ('error', 'purchase') GROUP BY ALL)"""


IMAGE_W, IMAGE_H = 48, 48


def rgbd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour and depth images: a pixel per line item, frame = block of orders."""
    li = table(spark, sf_dir, "lineitem")
    n = IMAGE_W * IMAGE_H
    cell = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n
    px = li.select(
        F.floor(F.col("l_orderkey") / 512).cast("long").alias("frame"),
        F.floor(cell / IMAGE_W).cast("int").alias("v"),
        (cell % IMAGE_W).cast("int").alias("u"),
        (F.floor(cell / 400) % 3).alias("colour"),
        (F.lit(1.0) + F.floor(F.col("l_quantity") / 10) * 0.5).alias("depth"),
    )
    return px.groupBy("frame", "v", "u").agg(F.min("colour").alias("colour"), F.min("depth").alias("depth"))


RGBD_SQL = f"""rgbd AS (SELECT frame, cell // {IMAGE_W} AS v, cell % {IMAGE_W} AS u, min(cell // 400 % 3) AS colour,
  min(1.0::DOUBLE + floor(l_quantity / 10) * 0.5::DOUBLE) AS depth
  FROM (SELECT l_orderkey // 512 AS frame, (l_orderkey * 7 + l_linenumber) % {IMAGE_W * IMAGE_H} AS cell, l_quantity FROM lineitem)
  GROUP BY ALL)"""


def camera_poses(images: DataFrame) -> DataFrame:
    """One pose per frame: steps along x without turning."""
    zero = F.lit(0.0)
    return images.select("frame").distinct().select(
        "frame", (F.col("frame") * 0.05).alias("tx"), zero.alias("ty"), zero.alias("tz"),
        zero.alias("qx"), zero.alias("qy"), zero.alias("qz"), F.lit(1.0).alias("qw"),
    )
