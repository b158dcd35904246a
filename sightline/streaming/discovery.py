"""Instance discovery over a stream of blobs; what is found lies in tables, cell by cell.

Every micro-batch is placed by ``instances.place_blobs`` against the cells owned
so far and adds the (sequence, colour, cell, instance) rows that are new. No
keyed state holds a sequence or a colour. A batch with blobs of a frame that was
placed before, or of an earlier one, places that group again from that frame on:
later decisions are voided and replaced, so files, their order and batches make
no difference. All tables have a folder per batch id and are read up to the
batch before, so a batch that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators.instances import KEYS, MIN_NEW_VOXELS, place_blobs
from sightline.session import durable, durable_path
from sightline.streaming import runtime

INPUT = "sequence long, colour long, frame long, n_px long, blob long, voxels array<long>"
TABLES = {
    "blobs": INPUT,
    "placed": "sequence long, colour long, frame long, n_px long, blob long, instance long, merged array<long>",
    "owned": "sequence long, colour long, cell long, instance long, first_frame long",
    "redone": "sequence long, colour long, since long",
}


def _matches(a: str, b: str, names: tuple[str, ...] = KEYS) -> Column:
    out = F.lit(True)
    for k in names:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


class Found:
    """Tables of one discovery below ``root``."""

    def __init__(self, spark: SparkSession, root: str, min_new: int = MIN_NEW_VOXELS):
        self.spark, self.root, self.min_new = spark, root, min_new
        for name in TABLES:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, batch long").parquet(f"{self.root}/{name}")

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def _owned(self, touched: DataFrame, batch_id: int) -> DataFrame:
        """Cells owned before the frames that this batch places."""
        own = self.read("owned").where(F.col("batch") < batch_id)
        again = self.read("redone").where(F.col("batch") < batch_id)
        later = (F.col("r.batch") > F.col("o.batch")) & (F.col("r.since") <= F.col("o.first_frame"))
        own = own.alias("o").join(again.alias("r"), _matches("o", "r") & later, "left_anti")
        near = own.alias("o").join(touched.alias("t"), _matches("o", "t") & (F.col("o.first_frame") < F.col("t.since")))
        return durable(near.select("o.*"), "discovery-owned")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Place one micro-batch."""
        self._write(batch.select(*[c.split()[0] for c in INPUT.split(", ")]), "blobs", batch_id)
        new = self.spark.read.parquet(f"{self.root}/blobs/batch={batch_id}")
        touched = durable(new.groupBy(*KEYS).agg(F.min("frame").alias("since")), "discovery-touched")
        first = touched.agg(F.min("since")).first()[0]
        past = self.read("blobs").where((F.col("batch") < batch_id) & (F.col("frame") >= F.lit(first).cast("long")))
        past = past.alias("p").join(touched.alias("t"), _matches("p", "t") & (F.col("p.frame") >= F.col("t.since")))
        past = durable(past.select("p.*").drop("batch"), "discovery-past")
        redone = touched.alias("t").join(past.alias("p"), _matches("t", "p"), "left_semi")
        known = self._owned(touched, batch_id)
        # Instances are numbered as they are founded, and each owned a cell in its first frame.
        counts = known.groupBy(*KEYS).agg((F.max("instance") + 1).alias("n"))
        placed, owned = place_blobs(new.unionByName(past), known, counts, self.min_new)
        fresh = owned.alias("o").join(known.alias("k"), _matches("o", "k", (*KEYS, "cell", "instance")), "left_anti")
        self._write(redone, "redone", batch_id)
        self._write(fresh, "owned", batch_id)
        self._write(placed, "placed", batch_id)

    def placed(self) -> DataFrame:
        """The decision of the last batch that placed a blob."""
        last = F.max("batch").over(Window.partitionBy(*KEYS, "frame", "blob"))
        return self.read("placed").withColumn("_last", last).where("batch = _last").drop("_last", "batch")


def discover(blobs: DataFrame, name: str = "discovery", min_new: int = MIN_NEW_VOXELS) -> DataFrame:
    """Blobs of a stream (columns of ``INPUT``) with their instance and merge partners, once it has ended.

    Instance numbers count per (sequence, colour); ties between instances in
    ``merged`` are resolved afterwards by connected components. A null frame is
    an error, as it has no place in the order; other nulls and empty voxels are
    treated as ``place_blobs`` says.
    """
    checked = blobs.withColumn("frame", F.coalesce("frame", F.raise_error(F.lit("a blob without a frame")).cast("long")))
    path = durable_path(blobs.sparkSession, name)
    found = Found(blobs.sparkSession, f"{path}/tables", min_new)
    runtime.fan_out(checked, f"{path}/checkpoint", [found.add]).awaitTermination()
    return found.placed()
