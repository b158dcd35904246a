"""Running values over ordered rows without one task per key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here
rows are range-partitioned by (key, order) into slices of even size, so a key
with a third of all rows is spread over a third of the slices. Each operator
then works in two levels: a window inside (key, slice), and a window over one
summary row per (key, slice). A key has at most as many summary rows as there
are slices, which bounds the second window whatever the data look like.

``order`` must identify rows within a key up to small tie groups; callers with
heavy duplicates aggregate them first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import durable

SLICE = "_slice"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by keys then order and record the slice of each row.

    The number of slices follows ``spark.sql.shuffle.partitions``; adaptive
    execution merges small neighbouring ranges before the slice is recorded.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id())
    return durable(ranged, "sliced")


def _summary_window(keys: Sequence[str], reverse: bool):
    order = F.col(SLICE).desc() if reverse else F.col(SLICE).asc()
    part = list(keys) if keys else [F.lit(0)]
    return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _local_window(keys: Sequence[str], order: Sequence[str], reverse: bool):
    by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys, SLICE).orderBy(*by)


def prefix_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, inclusive: bool = True
) -> DataFrame:
    """Exact running sum of ``value`` over a sliced table."""
    val = f"_{out}_v"
    base = df.withColumn(val, value)
    last = 0 if inclusive else -1
    here = F.sum(val).over(_local_window(keys, order, False).rowsBetween(Window.unboundedPreceding, last))
    start = (
        base.groupBy(*keys, SLICE)
        .agg(F.sum(val).alias("_t"))
        .withColumn("_start", F.sum("_t").over(_summary_window(keys, False)))
        .drop("_t")
    )
    zero = F.lit(0)
    return (
        base.withColumn("_here", here)
        .join(start, [*keys, SLICE], "left")
        .withColumn(out, F.coalesce("_here", zero) + F.coalesce("_start", zero))
        .drop(val, "_here", "_start")
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Nearest non-null ``value`` at or before each row (after it if ``reverse``).

    With ``inclusive=False`` the row itself is left out, which makes this a lag
    (or lead) over the rows that carry a value.
    """
    val = f"_{out}_v"
    base = df.withColumn(val, value)
    last = 0 if inclusive else -1
    here = F.last(val, ignorenulls=True).over(
        _local_window(keys, order, reverse).rowsBetween(Window.unboundedPreceding, last)
    )
    pick = F.min_by if reverse else F.max_by
    ends = (
        base.where(F.col(val).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(pick(val, F.struct(*order)).alias("_e"))
    )
    present = base.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        present.join(ends, [*keys, SLICE], "left")
        .withColumn("_before", F.last("_e", ignorenulls=True).over(_summary_window(keys, reverse)))
        .drop("_n", "_e")
    )
    return (
        base.withColumn("_here", here)
        .join(before, [*keys, SLICE], "left")
        .withColumn(out, F.coalesce("_here", "_before"))
        .drop(val, "_here", "_before")
    )


def global_row_number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based position in the total order given by ``order``, no single-task sort."""
    return prefix_sum(sliced(df, [], order), [], order, F.lit(1).cast("long"), out).drop(SLICE)
