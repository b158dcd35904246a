"""Run reports: medians over runs, comparisons, digests, merges of results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import text as tx
from sightline.operators import runs
from sightline.operators import surfaces as sf_ops
from sightline.plans.registry import query
from sightline.sources import tables as t

_RUNS = """WITH r AS (SELECT o_orderpriority AS run, count(*)::DOUBLE AS n, max(o_totalprice) AS max_price, min(o_totalprice) AS min_price,
  count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS n_f FROM orders GROUP BY 1)"""
METRICS = ["n", "max_price", "min_price", "n_f"]


def run_rows(spark, sf):
    o = t.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.max("o_totalprice").alias("max_price"),
        F.min("o_totalprice").alias("min_price"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("n_f"),
    )


@query("run_medians", _RUNS + """, l AS (UNPIVOT r ON n, max_price, min_price, n_f INTO NAME metric VALUE value)
SELECT metric, quantile_cont(value, 0.5) AS median, count(*) AS n_runs FROM l GROUP BY metric""")
def run_medians(spark, sf):
    return runs.run_medians(run_rows(spark, sf), "run", METRICS)


def _year_values(spark, sf, flag):
    li = t.table(spark, sf, "lineitem").where(F.col("l_linestatus") == flag)
    return li.groupBy((F.col("l_partkey") % 100).alias("metric"), F.year("l_shipdate").cast("long").alias("year")).agg(
        F.max("l_extendedprice").alias("value")
    )


_SIDE = """(SELECT l_partkey % 100 AS metric, year(l_shipdate) AS year, max(l_extendedprice) AS value FROM lineitem
  WHERE l_linestatus = '{f}' GROUP BY ALL)"""


@query("compare_runs", f"""SELECT metric, year, o.value AS old, n.value AS new, n.value - o.value AS delta,
  CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' WHEN n.value = o.value THEN 'same'
    WHEN (n.value > o.value) = (metric % 2 = 0) THEN 'better' ELSE 'worse' END AS verdict
FROM {_SIDE.format(f='O')} o FULL JOIN {_SIDE.format(f='F')} n USING (metric, year)""")
def compare_runs(spark, sf):
    """Every metric of two runs; even metrics are better when higher."""
    return runs.compare(
        _year_values(spark, sf, "O"), _year_values(spark, sf, "F"), ["metric", "year"], F.col("metric") % 2 == 0
    )


@query("change_counts", f"""WITH c AS (SELECT CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed'
    WHEN n.value = o.value THEN 'same' WHEN (n.value > o.value) = (metric % 2 = 0) THEN 'better' ELSE 'worse' END AS verdict
  FROM {_SIDE.format(f='O')} o FULL JOIN {_SIDE.format(f='F')} n USING (metric, year))
SELECT verdict, count(*) AS n FROM c GROUP BY verdict""")
def change_counts(spark, sf):
    return compare_runs(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("delta_text", f"""WITH c AS (SELECT metric, year, o.value AS a, n.value AS b, round((n.value - o.value)::DECIMAL(18, 4), 2) AS d
  FROM {_SIDE.format(f='O')} o FULL JOIN {_SIDE.format(f='F')} n USING (metric, year))
SELECT metric, year, CASE WHEN a IS NULL OR b IS NULL THEN '-' ELSE CASE WHEN d > 0 THEN '+' ELSE '' END || printf('%.2f', d) || ' ' ||
  CASE WHEN d = 0 THEN 'same' WHEN d > 0 THEN 'better' ELSE 'worse' END END AS text FROM c""")
def delta_text(spark, sf):
    c = compare_runs(spark, sf)
    return c.select("metric", "year", tx.delta_text(F.col("old"), F.col("new"), True, 2).alias("text"))


@query("upsert_results", f"""SELECT metric, year, coalesce(n.value, o.value) AS value
FROM {_SIDE.format(f='O')} o FULL JOIN {_SIDE.format(f='F')} n USING (metric, year)""")
def upsert_results(spark, sf):
    return runs.upsert(_year_values(spark, sf, "O"), _year_values(spark, sf, "F"), ["metric", "year"])


@query("stale_groups", """WITH a AS (SELECT l_orderkey AS k, count(*) AS n, max(l_quantity) AS q, sum(l_partkey) AS s FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS k, count(*) AS n, max(l_quantity) AS q, sum(l_partkey) AS s FROM lineitem WHERE NOT (l_quantity = 50 AND l_linenumber = 1) GROUP BY 1)
SELECT CASE WHEN b.k IS NULL THEN 'gone' ELSE 'changed' END AS reason, count(*) AS n FROM a LEFT JOIN b USING (k)
WHERE b.k IS NULL OR a.n <> b.n GROUP BY 1""")
def stale_groups(spark, sf):
    """Order groups whose content digest changed after some rows were taken out."""
    li = t.table(spark, sf, "lineitem")
    cols = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    before = runs.content_digest(li, ["l_orderkey"], cols)
    after = runs.content_digest(li.where("NOT (l_quantity = 50 AND l_linenumber = 1)"), ["l_orderkey"], cols)
    return runs.stale_parts(before, after, ["l_orderkey"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("row_digests", """SELECT event_id, sha1(event_type || ':' || user_id) AS digest FROM events""")
def row_digests(spark, sf):
    s = t.signals(spark, sf)
    return s.select("event_id", F.sha1(F.concat_ws(":", "event_type", "user_id")).alias("digest"))


@query("recheck_differences", """SELECT 'left' AS side, count(*) AS n FROM lineitem WHERE l_tax > 0.07""")
def recheck_differences(spark, sf):
    """Stored rows against a recomputation that lost some of them."""
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax")
    d = runs.differences(li, li.where("l_tax <= 0.07"))
    return d.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("status_spread", """WITH r AS (SELECT o_orderpriority AS run, o_orderstatus AS st, count(*) FILTER (WHERE o_totalprice > 200000) / count(*) AS v
  FROM orders GROUP BY ALL)
SELECT st AS status, min(v) AS worst, max(v) AS best, CASE WHEN min(v) >= 0.70 THEN 'good' WHEN min(v) >= 0.50 THEN 'fair' ELSE 'poor' END AS verdict
FROM r GROUP BY st""")
def status_spread(spark, sf):
    """Range over runs; the worst run decides."""
    o = t.table(spark, sf, "orders")
    r = o.groupBy("o_orderpriority", F.col("o_orderstatus").alias("status")).agg(
        (F.count_if(F.col("o_totalprice") > 200000) / F.count(F.lit(1))).alias("v")
    )
    g = r.groupBy("status").agg(F.min("v").alias("worst"), F.max("v").alias("best"))
    return g.withColumn("verdict", sf_ops.verdict("pq", F.col("worst")))


@query("status_pivot", """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
  count(*) FILTER (WHERE event_type = 'view') AS "view" FROM events GROUP BY user_id""")
def status_pivot(spark, sf):
    """Status counts per object as columns."""
    s = t.signals(spark, sf)
    return s.groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count().na.fill(0)


@query("density_grid", """SELECT floor(CAST(embedding[1] AS DOUBLE) / 0.05)::BIGINT AS cx, floor(CAST(embedding[2] AS DOUBLE) / 0.05)::BIGINT AS cy,
  count(*) AS n, count(DISTINCT label) AS n_objects FROM embeddings GROUP BY ALL""")
def density_grid(spark, sf):
    p = t.points(spark, sf)
    return p.groupBy(F.floor(F.col("x") / 0.05).alias("cx"), F.floor(F.col("y") / 0.05).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cloud").alias("n_objects")
    )


@query("area_histogram", """WITH h AS (SELECT least(floor(o_totalprice / 2000), 511)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1)
SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cum FROM h""")
def area_histogram(spark, sf):
    """512 bins with cumulative counts; the bin count bounds the window."""
    h = t.table(spark, sf, "orders").groupBy(
        F.least(F.floor(F.col("o_totalprice") / 2000), F.lit(511)).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("cum", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin")))
