"""Exact linear-interpolation percentiles for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer. This version counts distinct values first. While a group
has more of them than one task should order, it is cut into buckets by sketch
splitters, the buckets holding the wanted ranks are found from the bucket
totals, and only those are looked at further. What is left is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import durable

FANOUT = 64
TASK_VALUES = 2_000_000


def _ranks(spans: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Wanted ranks that fall into each span: the two neighbours of every position."""
    want = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in probs.items()])
    return (
        spans.withColumn("_q", F.explode(want))
        .withColumn("_pos", F.col("_q.p") * (F.col("_n") - 1))
        .withColumn("_rank", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_t")))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
    fanout: int = FANOUT, task_values: int = TASK_VALUES,
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> p in [0, 1])."""
    keys = list(keys)
    grp = keys or ["_g"]
    src = df if keys else df.withColumn("_g", F.lit(0))
    values = (
        src.where(F.col(value).isNotNull())
        .select(*grp, F.col(value).cast("double").alias("_v"))
        .groupBy(*grp, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", F.lit(""))
    )
    values = durable(values, "value-counts")
    cell = [*grp, "_b"]
    spans = values.groupBy(*cell).agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_d"))
    spans = spans.withColumns({"_start": F.lit(0).cast("long"), "_n": F.col("_t")})
    cuts = [i / fanout for i in range(1, fanout)]
    while (spans.agg(F.max("_d")).first()[0] or 0) > task_values:
        splits = values.groupBy(*cell).agg(F.percentile_approx("_v", cuts, fanout * 16).alias("_s"))
        part = F.size(F.filter("_s", lambda s: s < F.col("_v")))
        placed = values.join(splits, cell).select(
            *cell, F.concat("_b", F.lpad(part.cast("string"), 5, "0")).alias("_b2"), "_v", "_c"
        )
        parts = placed.groupBy(*cell, "_b2").agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_d"))
        # At most `fanout` rows per bucket.
        before = Window.partitionBy(*cell).orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        spans = parts.join(spans.select(*cell, "_start", "_n"), cell).select(
            *grp, F.col("_b2").alias("_b"), "_t", "_d", (F.col("_start") + F.col("_off")).alias("_start"), "_n"
        )
        needed = _ranks(spans, probs).select(*cell).distinct()
        spans = durable(spans.join(needed, cell, "left_semi"), "value-spans")
        values = placed.select(*grp, F.col("_b2").alias("_b"), "_v", "_c").join(needed, cell, "left_semi")
        values = durable(values, "value-counts")
    inside = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.join(spans, cell).withColumn("_hi", F.sum("_c").over(inside) + F.col("_start"))
    wanted = _ranks(spans, probs).select(*cell, F.col("_q.k").alias("_k"), "_pos", "_rank")
    hits = wanted.join(ranked.select(*cell, "_v", "_c", "_hi"), cell).where(
        (F.col("_rank") >= F.col("_hi") - F.col("_c")) & (F.col("_rank") < F.col("_hi"))
    )
    ends = hits.groupBy(*grp, "_k").agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.max(F.col("_pos") - F.floor("_pos")).alias("_f")
    )
    at = F.col("_a") * (1.0 - F.col("_f")) + F.col("_z") * F.col("_f")
    out = ends.groupBy(*grp).agg(*[F.max(F.when(F.col("_k") == k, at)).alias(k) for k in probs])
    return out if keys else out.drop("_g")
