"""Label and depth images as tiles, looked up at projected points.

A tile is one row (frame, ty, tx) with an array per channel, so an image of a
million pixels is a few hundred rows and a point meets one of them in an equi
join; no pixel row is shuffled with the points. Pixels an image does not have
are null in its tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import imaging as im
from sightline.operators import truth as tr
from sightline.operators.rules import ratio_or_zero
from sightline.operators.voxels import XYZ
from sightline.session import durable

TILE = 16
# Fixed values
NEAR_M = 0.1
DEPTH_MIN_M, DEPTH_MAX_M = 0.2, 5.0
SEEN_SHARE = 0.10
NOVELTY = 0.20
MIN_VALID = 0.10
KEYFRAME_GAP = 5


def tiled(pixels: DataFrame, channels: Sequence[str], tile: int = TILE) -> DataFrame:
    """Tiles of a pixel table (frame, v, u, channels); a pixel given twice counts once, by its smallest channels."""
    at = (F.col("v") % tile) * tile + F.col("u") % tile
    held = F.collect_list(F.struct(at.cast("int").alias("at"), *channels)).alias("_p")
    rows = pixels.groupBy("frame", F.floor(F.col("v") / tile).alias("ty"), F.floor(F.col("u") / tile).alias("tx")).agg(held)
    # Every step is a column of its own: an expression named inside a lambda is evaluated once per pixel.
    rows = rows.withColumn("_p", F.sort_array("_p"))
    first = F.filter("_p", lambda p, i: (i == 0) | (p["at"] != F.col("_p")[F.greatest(i - 1, F.lit(0))]["at"]))
    rows = rows.withColumn("_first", first)
    # Dense arrays: entry k is the pixel k of the tile.
    types = {c: pixels.schema[c].dataType for c in channels}
    places = F.sequence(F.lit(0), F.lit(tile * tile - 1))
    absent = F.transform(
        F.array_except(places, F.col("_first.at")), lambda k: F.struct(k.alias("at"), *[F.lit(None).cast(d).alias(c) for c, d in types.items()])
    )
    rows = rows.withColumn("_all", F.sort_array(F.concat("_first", absent)))
    return rows.select("frame", "ty", "tx", *[F.col(f"_all.{c}").alias(c) for c in channels])


def looked_up(points: DataFrame, tiles: DataFrame, channels: dict[str, str], frame: str = "frame", tile: int = TILE) -> DataFrame:
    """``points`` (frame, pv, pu inside the image) with the channels of the pixel they fall on, under new names."""
    keyed = points.withColumns({"_ty": F.floor(F.col("pv") / tile), "_tx": F.floor(F.col("pu") / tile)})
    own = tiles.select(F.col("frame").alias("_f"), F.col("ty").alias("_ty"), F.col("tx").alias("_tx"), *[F.col(c).alias(f"_c_{c}") for c in channels])
    at = ((F.col("pv") % tile) * tile + F.col("pu") % tile + 1).cast("int")
    found = keyed.join(own, (F.col(frame) == F.col("_f")) & (keyed["_ty"] == own["_ty"]) & (keyed["_tx"] == own["_tx"]), "left")
    picked = {new: F.element_at(f"_c_{c}", at) for c, new in channels.items()}
    return found.withColumns(picked).drop("_f", "_ty", "_tx", *[f"_c_{c}" for c in channels])


def occlusion(points: DataFrame, images: DataFrame, poses: DataFrame, cam: im.Camera, keys: Sequence[str]) -> DataFrame:
    """Occluded share of surface points, as the label and depth images of their frame tell.

    points: (frame, label, x, y, z in the world and ``keys``). A point before
    the camera and inside the image is visible where the pixel it falls on has
    its own label, hidden where another label lies clearly before it, and
    counts for neither elsewhere. Keys without a point inside are left out.
    """
    seen = im.reproject(points, poses, cam, "truncate").where(F.col("on_image") & (F.col("pz") > NEAR_M))
    samples = looked_up(seen, tiled(images, ["colour", "depth"]), {"colour": "_label", "depth": "_depth"})
    told = samples.select(
        *keys, F.coalesce(F.col("_label") == F.col("label"), F.lit(False)).alias("same"),
        F.coalesce("_depth", F.lit(0.0)).alias("depth"), F.col("pz").alias("z"),
    )
    return tr.occlusion(told, keys)


# ------------------------------------------------------------------- novelty

def novelty(pairs: DataFrame, points: DataFrame, tiles: DataFrame, poses: DataFrame, cam: im.Camera, n_grid: int) -> DataFrame:
    """(frame, anchor, n_new, n_known, novelty, valid_frac) of frames seen against an anchor frame.

    pairs: (frame, anchor). points: the sampled depth readings of each frame
    as world points with ``depth``. A reading is seen if the anchor's depth at
    the pixel it falls on agrees with its distance from the anchor within a
    tenth, unknown if the anchor has no reading there, and new otherwise.
    ``n_grid`` is the number of sampled places, with or without a reading.
    """
    at = points.join(pairs, "frame").withColumnRenamed("frame", "_frame").withColumnRenamed("anchor", "frame")
    there = im.reproject(at, poses, cam, "truncate")
    inside = F.col("on_image") & F.col("pz").between(DEPTH_MIN_M, DEPTH_MAX_M)
    there = there.withColumns({
        "_inside": inside, "pu": F.when(inside, F.col("pu")), "pv": F.when(inside, F.col("pv")),
    })
    told = looked_up(there, tiles, {"depth": "_old"})
    valid = F.col("depth").between(DEPTH_MIN_M, DEPTH_MAX_M)
    old_ok = F.coalesce(F.col("_old").between(DEPTH_MIN_M, DEPTH_MAX_M), F.lit(False))
    seen = F.col("_inside") & old_ok & F.coalesce(F.abs(F.col("_old") - F.col("pz")) <= SEEN_SHARE * F.col("pz"), F.lit(False))
    known = valid & ~(F.col("_inside") & ~old_ok)
    counts = told.groupBy(F.col("_frame").alias("frame"), F.col("frame").alias("anchor")).agg(
        F.count_if(known & ~seen).alias("n_new"), F.count_if(known).alias("n_known")
    )
    # A frame without a single reading is still a frame.
    both = pairs.join(counts, ["frame", "anchor"], "left").na.fill(0, ["n_new", "n_known"])
    return both.withColumn("novelty", ratio_or_zero(F.col("n_new"), F.col("n_known"))).withColumn(
        "valid_frac", F.col("n_known") / F.lit(n_grid)
    )


def anchored_novelty(
    frames: DataFrame, images: DataFrame, poses: DataFrame, cam: im.Camera, stride: int, tau: float = NOVELTY,
    min_valid: float = MIN_VALID, gap: int = KEYFRAME_GAP, window: int = 64,
) -> DataFrame:
    """(sequence, frame, anchor, keyframe, n_new, n_known, novelty, valid_frac) of every frame of every sequence.

    frames: (sequence, frame), frame numbers without holes. The first frame of
    a sequence is its anchor. A frame becomes the next anchor if the frame
    before it, seen against the anchor so far, was new enough and known enough,
    and the anchor is at least ``gap`` frames back; it is seen against itself. All sequences move on together, by one anchor or
    ``window`` frames a round, and a round looks only at those frames.
    """
    spark = frames.sparkSession
    tiles = durable(tiled(images, ["depth"]), "depth-tiles")
    points = durable(im.to_world(im.unproject(images, cam, stride), poses).select("frame", *XYZ, "depth"), "grid-points")
    n_grid = -(-cam.width // stride) * -(-cam.height // stride)
    last = frames.groupBy("sequence").agg(F.min("frame").alias("anchor"), F.max("frame").alias("_last"))
    open_ = durable(last.withColumn("_from", F.col("anchor")), "anchors")
    done: list[DataFrame] = []
    while not open_.isEmpty():
        spread = open_.select(
            "*", F.explode(F.sequence("_from", F.least(F.col("_from") + window - 1, F.col("_last")))).alias("frame")
        )
        told = durable(
            spread.join(novelty(spread.select("frame", "anchor"), points, tiles, poses, cam, n_grid), ["frame", "anchor"]),
            "anchor-round",
        )
        fires = (F.col("novelty") > tau) & (F.col("valid_frac") >= min_valid) & (F.col("frame") + 1 - F.col("anchor") >= gap)
        turn = told.groupBy("sequence").agg(F.min(F.when(fires, F.col("frame") + 1)).alias("_next"))
        turn = durable(turn, "anchor-turns")
        # Frames before the next anchor are settled.
        settled = told.join(turn, "sequence").where(F.col("_next").isNull() | (F.col("frame") < F.col("_next")))
        done.append(settled.select("sequence", "frame", "anchor", "n_new", "n_known", "novelty", "valid_frac"))
        moved = open_.join(turn, "sequence").select(
            "sequence", F.coalesce("_next", "anchor").alias("anchor"), "_last",
            F.coalesce("_next", F.col("_from") + window).alias("_from"),
        )
        open_ = durable(moved.where("_from <= _last"), "anchors")
    if not done:
        schema = "sequence long, frame long, anchor long, n_new long, n_known long, novelty double, valid_frac double, keyframe string"
        return spark.createDataFrame([], schema)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    first = last.select("sequence", F.col("anchor").alias("_first"))
    kind = F.when(F.col("frame") == F.col("_first"), "init").when(F.col("frame") == F.col("anchor"), "cov").otherwise("")
    return every.join(first, "sequence").withColumn("keyframe", kind).drop("_first")
