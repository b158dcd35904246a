"""Scans of recorded sequences, ground truth and run outputs.

Text tables use explicit schemas. Binary payloads are read file by file inside
tasks and turned into rows there, so the driver never holds them.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import flag
from sightline.operators.runs import content_digest
from sightline.operators.temporal import interval_join
from sightline.schema import DDL

# ---------------------------------------------------------------- text tables


def csv_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header; empty cells are NULL, an empty file has no rows."""
    return spark.read.schema(ddl).option("header", True).option("nullValue", "").option("enforceSchema", True).csv(path)


def entity(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the known entities from CSV (flags may be 0/1 or words) or Parquet."""
    if not path.endswith(".csv"):
        return spark.read.schema(DDL[name]).parquet(path)
    cols = [c.strip().split(" ", 1) for c in DDL[name].split(",")]
    raw = csv_table(spark, path, ", ".join(f"{n} string" if t == "boolean" else f"{n} {t}" for n, t in cols))
    return raw.select(*[flag(F.col(n)).alias(n) if t == "boolean" else F.col(n) for n, t in cols])


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: columns {missing} are missing, score the run again")
    return df


def open_sequence(spark: SparkSession, root: str) -> DataFrame:
    """Frames of a recording; the three image indexes must list the same stamps.

    The check is part of the plan: reading a frame that is not in all three fails.
    """
    out = None
    for name in ("rgb", "depth", "seg"):
        ix = csv_table(spark, f"{root}/{name}.csv", DDL["index"]).withColumnRenamed("filename", name)
        out = ix if out is None else out.join(ix, "stamp_ns", "full")
    whole = F.col("rgb").isNotNull() & F.col("depth").isNotNull() & F.col("seg").isNotNull()
    stamp = F.when(whole, F.col("stamp_ns")).otherwise(
        F.raise_error(F.concat(F.lit("stamp not in all indexes: "), F.col("stamp_ns").cast("string"))).cast("long")
    )
    return out.select(stamp.alias("stamp_ns"), "rgb", "depth", "seg")


def static_transforms(spark: SparkSession, path: str) -> DataFrame:
    """Last row wins for a repeated (frame, child) pair."""
    raw = csv_table(spark, path, DDL["tf_static"]).select(
        "*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                      F.monotonically_increasing_id().alias("i")).alias("_pos")
    )
    vals = [c for c in raw.columns if c not in ("frame_id", "child_frame_id", "_pos")]
    last = raw.groupBy("frame_id", "child_frame_id").agg(F.max_by(F.struct(*vals), "_pos").alias("_v"))
    return last.select("frame_id", "child_frame_id", "_v.*")


def poses(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Base or camera poses: (frame_idx, tx..qw) from the column family asked for."""
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    return csv_table(spark, path, DDL["gt_poses"]).select("frame_idx", *[F.col(f"{family}_{n}").alias(n) for n in names])


def seen_segments(spark: SparkSession, path: str) -> DataFrame:
    return entity(spark, path, "segments").where("n_pixels >= 1").select("gt_object_id", "frame_idx").distinct()


def tracklets(spark: SparkSession, path: str, ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Stored tracklets, only those asked for; columns left out are not read."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("tracklet_id").isin(ids)) if ids is not None else rows
    return rows.select(*columns) if columns else rows


def observed_points(observations: DataFrame, points: DataFrame) -> DataFrame:
    """Points of each observation by its slice: (obs, kf_index, tracklet_id) with what ``points`` has at (at, ...).

    ``at`` numbers the points from 0; an observation holds points_start and the points_num that follow.
    """
    slices = observations.where("points_num > 0").select(
        "obs", "kf_index", "tracklet_id", F.col("points_start").alias("_a"), (F.col("points_start") + F.col("points_num") - 1).alias("_b")
    )
    return interval_join(points, slices, [], "at", "_a", "_b").drop("_a", "_b")


def labels_of(spark: SparkSession, path: str, frames: DataFrame) -> DataFrame:
    """Label pixels of the frames asked for; a frame without a stored label image is an error, not an empty one."""
    labels = spark.read.schema(DDL["gt_labels"]).parquet(path)
    there = labels.select("frame").distinct().withColumn("_there", F.lit(True))
    asked = frames.select("frame").distinct().join(there, "frame", "left")
    checked = F.when(F.col("_there"), F.col("frame")).otherwise(
        F.raise_error(F.concat(F.lit("no label image of frame "), F.col("frame").cast("string"))).cast("int")
    )
    return labels.join(asked.select(checked.alias("frame")), "frame")


def label_provenance(spark: SparkSession, path: str, meta: str) -> DataFrame:
    """(version, recorded, digest, intact): what is said of stored labels and what they are, one row."""
    said = spark.read.schema("version string, digest string").option("multiLine", True).json(meta)
    labels = spark.read.schema(DDL["gt_labels"]).parquet(path).withColumn("_k", F.lit(0))
    own = content_digest(labels, ["_k"], ["frame", "v", "u", "value"]).select("_k", F.col("digest").alias("_own"))
    both = said.withColumn("_k", F.lit(0)).join(own, "_k", "left")
    return both.select("version", F.col("digest").alias("recorded"), F.col("_own").alias("digest"), F.col("digest").eqNullSafe(F.col("_own")).alias("intact"))


def optional_json(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    """One-document JSON, None when the file does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def summaries(spark: SparkSession, path: str, ddl: str, required: list[str]) -> DataFrame:
    """JSON documents, one per line; documents that lack a required field are refused."""
    docs = spark.read.schema(ddl).json(path)
    bad = None
    for c in required:
        b = F.col(c).isNull()
        bad = b if bad is None else bad | b
    key = F.when(bad, F.raise_error(F.lit("summary without required fields")).cast("string")).otherwise(F.col(required[0]).cast("string"))
    return docs.withColumn("_checked", key).where(F.col("_checked").isNotNull()).drop("_checked")


def pattern_counts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Number of log lines per file that match."""
    return (
        spark.read.text(path).where(F.col("value").rlike(pattern))
        .groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    )


def settings(text: str, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines; comments and blanks are skipped, the environment wins."""
    env = os.environ if env is None else env
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            k = k.removeprefix("export ").strip()
            out[k] = env.get(k, v.strip().strip("\"'"))
    return out


def camera_info(path: str) -> dict:
    """Intrinsics from YAML: K, D, width, height, frame."""
    import yaml

    with open(path) as f:
        d = yaml.safe_load(f)
    k = d.get("K", d.get("camera_matrix", {}))
    k = k["data"] if isinstance(k, dict) else k
    return {"K": [float(v) for v in k], "D": d.get("D", []), "width": d["width"], "height": d["height"],
            "frame_id": d.get("frame_id", "")}


def topic_spec(text: str) -> dict:
    """'topic=kind[:be]' of a recorder subscription."""
    topic, kind = text.split("=", 1)
    kind, _, mode = kind.partition(":")
    return {"topic": topic, "kind": kind, "best_effort": mode == "be"}


def stamp_of(kind: Column) -> Column:
    """Stamp column of a message by kind."""
    return (
        F.when(kind == "embedding_set", F.col("timestamp_ns"))
        .when(kind == "snapshot", F.col("updated_at_ns"))
        .otherwise(F.col("header_stamp_ns"))
    )


# --------------------------------------------------------------- binary files


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)\.[^./]*$", 1).cast("long").alias("frame")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(stem, "content")


def png_array(data: bytes) -> np.ndarray:
    """Pixels of a plain (not interlaced) 8 or 16 bit PNG."""
    pos, body, head = 8, b"", None
    while pos < len(data):
        size, kind = struct.unpack(">I4s", data[pos : pos + 8])
        chunk = data[pos + 8 : pos + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        pos += 12 + size
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or interlace:
        raise ValueError("PNG layout not supported")
    bpp = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), np.uint8)
    for y in range(h):
        mode, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * bpp, np.int64)
        if mode in (0, 2):
            out[y] = (line + (up if mode == 2 else 0)) & 255
            continue
        if mode == 1:
            out[y] = (np.cumsum(line.reshape(w, bpp), 0) & 255).reshape(-1)
            continue
        cur = np.zeros(w * bpp, np.int64)
        for x in range(w * bpp):
            a = cur[x - bpp] if x >= bpp else 0
            b, c = up[x], (up[x - bpp] if x >= bpp else 0)
            if mode == 3:
                guess = (a + b) // 2
            else:
                dist = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                guess = (a, b, c)[dist.index(min(dist))]
            cur[x] = (line[x] + guess) & 255
        out[y] = cur
    img = out.view(">u2").astype(np.uint16) if depth == 16 else out
    return img.reshape(h, w, channels) if channels > 1 else img.reshape(h, w)


def rasters(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(frame, v, u, value) of single-channel images; frame number = file stem."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, content in zip(b["frame"], b["content"]):
                img = png_array(bytes(content))
                v, u = np.indices(img.shape[:2])
                yield pd.DataFrame({"frame": frame, "v": v.ravel(), "u": u.ravel(), "value": img.ravel().astype(np.int64)})

    return _files(spark, path, glob).mapInPandas(decode, "frame long, v int, u int, value long")


def colour_rasters(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(frame, v, u, r, g, b) of RGB images."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, content in zip(b["frame"], b["content"]):
                img = png_array(bytes(content))
                v, u = np.indices(img.shape[:2])
                rgb = {c: img[..., i].ravel().astype(np.int64) for i, c in enumerate("rgb")}
                yield pd.DataFrame({"frame": frame, "v": v.ravel(), "u": u.ravel(), **rgb})

    return _files(spark, path, glob).mapInPandas(decode, "frame long, v int, u int, r long, g long, b long")


def frame_clouds(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """Ragged clouds (segment_ids, gt_object_ids, offsets, points) as one row per point."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, content in zip(b["frame"], b["content"]):
                z = np.load(io.BytesIO(bytes(content)))
                n = np.diff(z["offsets"])
                p = z["points"].astype(np.float64)
                yield pd.DataFrame(
                    {
                        "frame": frame,
                        "segment_id": np.repeat(z["segment_ids"].astype(np.int64), n),
                        "gt_object_id": np.repeat(z["gt_object_ids"].astype(np.int64), n),
                        "x": p[:, 0], "y": p[:, 1], "z": p[:, 2],
                    }
                )

    return _files(spark, path, glob).mapInPandas(
        decode, "frame long, segment_id long, gt_object_id long, x double, y double, z double"
    )


# ------------------------------------------------------------- binary columns


def mask_cells(rows: DataFrame, keys: list[str], bits: str, n_cells: int) -> DataFrame:
    """Set cells of packed bit masks, one row per cell."""

    @F.pandas_udf("array<int>")
    def unpack(col: pd.Series) -> pd.Series:
        return col.map(lambda b: np.flatnonzero(np.unpackbits(np.frombuffer(bytes(b), np.uint8))[:n_cells]))

    return rows.select(*keys, F.explode(unpack(bits)).alias("cell"))


def message_points(rows: DataFrame, keys: list[str], data: str, point_step: int) -> DataFrame:
    """Points of cloud messages with any point step; x, y, z are the first three floats."""

    @F.pandas_udf("array<struct<x:double,y:double,z:double>>")
    def unpack(col: pd.Series) -> pd.Series:
        def one(b):
            raw = np.frombuffer(bytes(b), np.uint8).reshape(-1, point_step)[:, :12]
            xyz = np.ascontiguousarray(raw).view("<f4").astype(float)
            return [{"x": p[0], "y": p[1], "z": p[2]} for p in xyz]

        return col.map(one)

    return rows.select(*keys, F.explode(unpack(data)).alias("_p")).select(*keys, "_p.*")


def tracklet_messages(rows: DataFrame) -> DataFrame:
    """Flat tracklet-set messages as one row per tracklet with its slice of points."""
    ends = F.aggregate(
        "points_num", F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    z = F.arrays_zip("tracklet_ids", "points_num", "depth_valid_ratio", "seg_conf")
    r = rows.withColumn("_e", ends).select("stamp_ns", "points", "_e", F.posexplode(z).alias("pos", "_z"))
    start = F.element_at("_e", F.col("pos") + 1)
    pts = F.slice("points", (start * 3 + 1).cast("int"), (F.col("_z.points_num") * 3).cast("int"))
    return r.select(
        "stamp_ns", F.col("_z.tracklet_ids").alias("tracklet_id"), F.col("_z.points_num").alias("points_num"),
        F.col("_z.depth_valid_ratio").alias("depth_valid_ratio"), F.col("_z.seg_conf").alias("seg_conf"),
        pts.alias("points"),
    )
