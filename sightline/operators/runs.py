"""Results of runs: medians, comparison, provenance keys, upserts, text maps."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.quantiles import exact_quantiles
from sightline.session import durable


def flatten(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value) for the numeric columns that are present."""
    return rows.unpivot(list(keys), list(metrics), "metric", "value").where("value IS NOT NULL")


def run_medians(rows: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    """Median of every metric over the runs that have it."""
    long = flatten(rows, [run], metrics)
    n = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n_runs"))
    return exact_quantiles(long, ["metric"], "value", {"median": 0.5}).join(n, "metric")


def numeric_leaves(reports: DataFrame, keys: Sequence[str], report: str, most_levels: int = 64) -> DataFrame:
    """(keys, metric, value) for every number in nested JSON reports; ``metric`` is its path, joined by dots.

    Objects are opened level by level, all reports together. Truth values,
    texts, nulls and lists are not numbers; a report that is no JSON object,
    or null, has no leaves.
    """
    keys = list(keys)
    level = reports.select(*keys, F.lit("").alias("_path"), F.try_parse_json(F.col(report)).alias("_v"))
    found: list[DataFrame] = []
    for _ in range(most_levels):
        level = durable(level.withColumn("_kind", F.schema_of_variant("_v")).where("_kind LIKE 'OBJECT<%'"), "report-level")
        if found and level.isEmpty():
            break
        view = f"_report_level_{uuid.uuid4().hex}"
        level.createOrReplaceTempView(view)
        names = ", ".join(f"`{k}`" for k in keys)
        opened = reports.sparkSession.sql(
            f"SELECT {names}, concat(_path, e.key) AS metric, e.value AS _v, schema_of_variant(e.value) AS _kind "
            f"FROM {view}, LATERAL variant_explode(_v) AS e"
        )
        numbers = opened.where("_kind IN ('BIGINT', 'DOUBLE', 'FLOAT') OR _kind LIKE 'DECIMAL%'")
        found.append(numbers.select(*keys, "metric", F.variant_get("_v", "$", "double").alias("value")))
        level = opened.select(*keys, F.concat("metric", F.lit(".")).alias("_path"), "_v")
    else:
        raise RuntimeError(f"reports are nested deeper than {most_levels} levels")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def report_medians(reports: DataFrame, run: str, report: str) -> DataFrame:
    """Median of every numeric leaf over the runs whose report has it."""
    long = durable(numeric_leaves(reports, [run], report), "report-leaves")
    n = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n_runs"))
    return exact_quantiles(long, ["metric"], "value", {"median": 0.5}).join(n, "metric")


def compare(old: DataFrame, new: DataFrame, keys: Sequence[str], higher_better: Column) -> DataFrame:
    """Old and new value per key with the direction of the change; either side may be missing."""
    o = old.select(*keys, F.col("value").alias("old"))
    n = new.select(*keys, F.col("value").alias("new"))
    j = o.join(n, list(keys), "full")
    delta = F.col("new") - F.col("old")
    verdict = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(delta == 0, "same")
        .when((delta > 0) == higher_better, "better")
        .otherwise("worse")
    )
    return j.withColumn("delta", delta).withColumn("verdict", verdict)


def stale_parts(recorded: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts whose digest differs, appeared or vanished, with the reason."""
    r = recorded.select(*keys, F.col("digest").alias("old"), F.lit(True).alias("_r"))
    c = current.select(*keys, F.col("digest").alias("new"), F.lit(True).alias("_c"))
    reason = (
        F.when(F.col("_r").isNull(), "new")
        .when(F.col("_c").isNull(), "gone")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return r.join(c, list(keys), "full").select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


def content_digest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free digest of the rows of each group.

    Row digests are added in two parts, so a group of any size is reduced
    map-side; equal multisets of rows give equal digests.
    """
    sha = F.sha1(F.to_json(F.struct(*columns)))
    word = lambda at: F.conv(F.substring(sha, at, 12), 16, 10).cast("decimal(38,0)")
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(word(1)).alias("_a"), F.sum(word(13)).alias("_b")
    )
    return g.select(*keys, "n_rows", F.sha1(F.concat_ws(":", "n_rows", "_a", "_b")).alias("digest"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows of the same key."""
    return old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows present on one side only, with multiplicity."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# ------------------------------------------------------------------ text maps

def encode_counts(rows: DataFrame, keys: Sequence[str], item: str, count: str) -> DataFrame:
    """'item:count;item:count' in item order, zero counts left out; items are a small closed set."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(item), F.col(count))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p[item].cast("string"), F.lit(":"), p[count].cast("string"))), ";")
    return rows.where(F.col(count) > 0).groupBy(*keys).agg(text.alias("counts"))


def decode_counts(text: Column) -> Column:
    """Map from item text to count; empty text is an empty map."""
    return F.map_filter(F.str_to_map(text, F.lit(";"), F.lit(":")), lambda k, v: k != "")
