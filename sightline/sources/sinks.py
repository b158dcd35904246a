"""Writers of results: tables, documents, messages, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import runs
from sightline.operators.ordered import prefix_sum, sliced


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_entity(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace one entity; partitions keep scans of single sequences small."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], last: Sequence[str] = ()) -> None:
    """Fixed column order, late additions at the end, missing columns left blank."""
    names = [c for c in columns if c not in last] + list(last)
    cells = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]
    df.select(*cells).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document per row; NaN and infinities become null."""
    doubles = {n: t for n, t in df.dtypes if t in ("double", "float")}
    clean = {n: F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(F.col(n)) for n in doubles}
    df.withColumns(clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def wide_by_tau(df: DataFrame, keys: Sequence[str], tau: str, taus: Sequence[int], values: Sequence[str]) -> DataFrame:
    """Long rows per tolerance to columns named value@tau."""
    aggs = [F.max(F.when(F.col(tau) == t, F.col(v))).alias(f"{v}@{t}") for v in values for t in taus]
    return df.groupBy(*keys).agg(*aggs)


def digest_of(df: DataFrame) -> tuple[int, str]:
    """Row count and order-free digest of a whole table (one aggregated row)."""
    r = runs.content_digest(df.withColumn("_all", F.lit(0)), ["_all"], sorted(df.columns)).first()
    return (r["n_rows"], r["digest"]) if r else (0, "")


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write only when the content differs from what is stored. True when written."""
    spark = df.sparkSession
    if exists(spark, path) and digest_of(spark.read.schema(df.schema).parquet(path)) == digest_of(df):
        return False
    replace(df, path)
    return True


def replace(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap, so that readers never see a partial table."""
    fs, target = _fs(df.sparkSession, path)
    hadoop_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    old = hadoop_path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(hadoop_path(staged), target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not move the new table to {path}")
    if had:
        fs.delete(old, True)


def archive(df: DataFrame, root: str, run_id: str, provenance: dict[str, str]) -> None:
    """Snapshot of results under a run id with where they came from; ids are never reused."""
    cols = {k: F.lit(v) for k, v in provenance.items()}
    df.withColumns(cols).write.mode("errorifexists").parquet(f"{root}/run={run_id}")


def history(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots, oldest first by id."""
    return spark.read.parquet(root).orderBy("run")


def with_new_column(stored: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add a recomputed column to stored rows; a row without a partner fails the job."""
    new = [c for c in extra.columns if c not in keys]
    j = stored.drop(*new).join(extra.withColumn("_hit", F.lit(True)), list(keys), "left")
    ok = F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(F.lit("row counts differ")).cast("boolean"))
    return j.withColumn("_ok", ok).where("_ok").drop("_hit", "_ok")


def with_defaults(stored: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Upgrade of an older layout: missing columns get their default."""
    return stored.withColumns({c: e for c, e in defaults.items() if c not in stored.columns})


def check_capture(keyframes: DataFrame, observations: DataFrame, frames: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """(kf, fault) of everything in a capture that does not fit together; no row means it is whole.

    ``n_obs``      a keyframe announces another number of observations than are stored
    ``obs_start``  its observations do not begin where those of the keyframes before end
    ``points``     points of an observation do not begin where those before end, or are not all stored
    ``stamp``      its stamp is not that of its frame in ``frames`` (frame_idx, stamp_ns)
    """
    got = observations.groupBy(F.col("kf_index").alias("kf")).agg(F.count(F.lit(1)).alias("_stored"))
    both = keyframes.select("kf", "n_obs").join(got, "kf", "full").na.fill(0, ["n_obs", "_stored"])
    faults = [both.where("n_obs <> _stored").select("kf", F.lit("n_obs").alias("fault"))]

    def misplaced(rows: DataFrame, order: str, start: str, size: str, name: str) -> DataFrame:
        summed = prefix_sum(sliced(rows, [], [order]), [], [order], F.col(size), "_start", inclusive=False)
        return summed.where(~F.col(start).eqNullSafe(F.col("_start"))).select("kf", F.lit(name).alias("fault"))

    if "obs_start" in keyframes.columns:
        faults.append(misplaced(keyframes.select("kf", "obs_start", "n_obs"), "kf", "obs_start", "n_obs", "obs_start"))
    if points is not None:
        slices = observations.select(F.col("kf_index").alias("kf"), "obs", "points_start", "points_num")
        faults.append(misplaced(slices, "obs", "points_start", "points_num", "points"))
        end = points.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
        beyond = slices.withColumn("_k", F.lit(0)).join(end, "_k").where("points_start + points_num > _n")
        faults.append(beyond.select("kf", F.lit("points").alias("fault")))
    if frames is not None:
        known = frames.select("frame_idx", F.col("stamp_ns").alias("_stamp"))
        named = keyframes.select("kf", "frame_idx", "stamp_ns").join(known, "frame_idx", "left")
        faults.append(named.where(~F.col("stamp_ns").eqNullSafe(F.col("_stamp"))).select("kf", F.lit("stamp").alias("fault")))
    out = faults[0]
    for more in faults[1:]:
        out = out.unionByName(more)
    return out.distinct()


def tracklet_messages(rows: DataFrame) -> DataFrame:
    """Struct-of-arrays messages per stamp in tracklet order; a message holds one frame's tracklets."""
    packed = F.sort_array(F.collect_list(F.struct("tracklet_id", "points_num", "points", "depth_valid_ratio", "seg_conf")))
    m = rows.groupBy("stamp_ns").agg(packed.alias("_m"))
    take = {"tracklet_ids": "tracklet_id", "points_num": "points_num", "depth_valid_ratio": "depth_valid_ratio", "seg_conf": "seg_conf"}
    return m.select(
        "stamp_ns", *[F.col(f"_m.{c}").alias(n) for n, c in take.items()],
        F.flatten(F.col("_m.points")).alias("points"),
    )
