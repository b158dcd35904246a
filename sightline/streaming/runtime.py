"""Running streams to completion and reading what they wrote.

Sources are replayable files and sinks are parquet with a checkpoint, so a
restarted query continues without loss or duplicates. Micro-batches are bounded
by bytes, which bounds the rows any keyed state sees at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import durable_path, use_utc

BATCH_BYTES_CONF = "sightline.stream.bytesPerTrigger"
BATCH_BYTES = 8 << 30


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream over one of the given tables; the schema comes from the file footer."""
    use_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return folder_stream(spark, sf_dir, schema, f"{name}.parquet*", max_files)


def folder_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files is None:
        reader = reader.option("maxBytesPerTrigger", int(spark.conf.get(BATCH_BYTES_CONF, str(BATCH_BYTES))))
    else:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _empty(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(p) or len(fs.listStatus(p)) == 0


def record(stream: DataFrame, path: str, checkpoint: str, resume: bool = False):
    """Append a stream to a folder; a folder that already holds data is refused unless resuming."""
    if not resume and not _empty(stream.sparkSession, path):
        raise FileExistsError(f"{path} is not empty")
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, fail on any error, and return the written rows."""
    spark = stream.sparkSession
    path = durable_path(spark, name)
    q = record(stream, f"{path}/data", f"{path}/checkpoint")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


#: Event time of the row that ends a stream: later than any other.
END_OF_STREAM = "9999-01-01 00:00:00"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watermarked(stream: DataFrame, time: str, delay: str) -> tuple[DataFrame, str]:
    """``stream`` with a watermark, and a folder; a row written there ends the stream.

    The ending row moves the watermark behind everything, so that state that
    waits for it lets go of what it holds; it goes no further itself. The
    condition names the event time, which keeps it behind the watermark; other
    conditions belong on ``stream``, as they would be moved before it and take
    the ending row away.
    """
    spark = stream.sparkSession
    ending = durable_path(spark, "stream-end")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ending)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    end = spark.readStream.schema(stream.schema).parquet(ending)
    marked = stream.unionByName(end).withWatermark(time, delay)
    return marked.where(F.col(time) < F.lit(END_OF_STREAM).cast("timestamp")), ending


def _run(stream: DataFrame, path: str, resume: bool) -> None:
    """One run to the end of what is available; rows that came too late are an error, not a loss."""
    query = record(stream, f"{path}/data", f"{path}/checkpoint", resume)
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if late:
        raise RuntimeError(f"{late} rows came later than the delay of the watermark")


def drain_to_end(stream: DataFrame, ending: str, time: str, name: str) -> DataFrame:
    """Process everything available, end the stream, and return the written rows.

    ``stream`` comes from ``watermarked``. The second run goes on from the
    checkpoint of the first and finds just the row that ends the stream.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    path = durable_path(spark, name)
    _run(stream, path, False)
    row = spark.range(1).select(F.lit(END_OF_STREAM).cast("timestamp").alias(time))
    row.write.mode("append").parquet(ending)
    _run(stream, path, True)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def fan_out(stream: DataFrame, checkpoint: str, sinks: list[Callable[[DataFrame, int], None]]):
    """Hand every micro-batch to several sinks in order; the batch is computed once.

    A sink that failed gets the same batch id again, so sinks write by batch id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def folder_sink(root: str) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: one folder per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def dropped(sent: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """What the source had and the sink did not get."""
    return sent.join(received.select(*keys), keys, "left_anti")
