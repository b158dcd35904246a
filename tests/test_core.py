"""Ordered scans, percentiles, nearest joins and episodes against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import ordered, temporal
from sightline.operators.nearest import nearest
from sightline.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; some values are missing."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.7, 0, rng.integers(1, 40, 4000))
    pdf = pd.DataFrame({"k": key, "o": rng.permutation(4000), "v": rng.integers(0, 9, 4000)})
    pdf["x"] = pdf["v"].where(rng.random(4000) < 0.1)
    return pdf.sort_values(["k", "o"]).reset_index(drop=True), spark.createDataFrame(
        pdf.astype(object).where(pdf.notna(), None), "k long, o long, v long, x double"
    )


@pytest.fixture
def many_slices(spark):
    """Keep ranges apart so that keys really spread over slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_slices_split_the_hot_key(skewed, many_slices):
    s = ordered.sliced(skewed[1], ["k"], ["o"])
    assert s.where("k = 0").select(ordered.SLICE).distinct().count() > 1


@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_sum(skewed, many_slices, inclusive):
    pdf, df = skewed
    s = ordered.prefix_sum(ordered.sliced(df, ["k"], ["o"]), ["k"], ["o"], F.col("v"), "s", inclusive)
    want = pdf.groupby("k")["v"].cumsum() - (0 if inclusive else pdf["v"])
    got = s.select("k", "o", "s").toPandas().sort_values(["k", "o"])["s"]
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_carry(skewed, many_slices, inclusive, reverse):
    pdf, df = skewed
    s = ordered.carry(ordered.sliced(df, ["k"], ["o"]), ["k"], ["o"], F.col("x"), "c", inclusive, reverse)
    g = pdf.groupby("k")["x"]
    want = g.bfill() if reverse else g.ffill()
    if not inclusive:
        want = want.groupby(pdf["k"]).shift(-1 if reverse else 1)
    got = s.select("k", "o", "c").toPandas().sort_values(["k", "o"])["c"]
    np.testing.assert_array_equal(got.to_numpy(float), want.to_numpy(float))


def test_global_row_number(skewed, many_slices):
    pdf, df = skewed
    got = ordered.global_row_number(df, ["o"], "n").select("o", "n").toPandas()
    assert (got["n"] == got["o"] + 1).all()


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_quantiles_match_numpy(spark, limit):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.8, 0, rng.integers(1, 5, 3000)), "v": np.round(rng.normal(0, 3, 3000), 2)})
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, fanout=4, task_values=limit).collect()
    assert len(got) == 5
    for r in got:
        v = pdf.loc[pdf["k"] == r.k, "v"]
        for n, p in probs.items():
            assert r[n] == pytest.approx(np.percentile(v, 100 * p), abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).count() == 0


def brute(q, r):
    return np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1))


@pytest.mark.parametrize("bound", [None, 0.15, 0.6])
@pytest.mark.parametrize("leaf", [None, 0.05])
def test_nearest_against_all_pairs(spark, bound, leaf):
    rng = np.random.default_rng(11)
    q = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(0.2, 0.01, (60, 3))])
    r = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(0.2, 0.01, (120, 3))])
    owner = rng.integers(0, 3, len(r))
    dq = spark.createDataFrame(pd.DataFrame(q, columns=["x", "y", "z"]))
    dr = spark.createDataFrame(pd.DataFrame(r, columns=["x", "y", "z"]).assign(owner=owner))
    d = brute(q, r)
    got = {(a.x, a.y, a.z): a for a in nearest(dq, dr, [], leaf=leaf, bound=bound, payload=["owner"]).collect()}
    for p, row in zip(q, d):
        hit = got.get(tuple(p))
        if bound is not None and row.min() >= bound:
            assert hit is None
        else:
            assert hit.dist == pytest.approx(row.min(), abs=1e-12)
            assert hit.owner == owner[row.argmin()]
    if bound is not None:
        per = nearest(dq, dr, [], leaf=leaf, bound=bound, per=["owner"]).collect()
        want = sum((d[:, owner == k].min(1) < bound).sum() for k in range(3))
        assert len(per) == want


def test_episode_gap_boundary(spark):
    frames = [0, 1, 7, 14, 21, 28]
    seen = spark.createDataFrame([(1, f) for f in frames] + [(1, 0)], "o long, f long")
    eps = temporal.episodes(seen, ["o"], "f", 5).orderBy("first_frame").collect()
    assert [(e.first_frame, e.last_frame, e.n_frames_observed) for e in eps] == [(0, 7, 3), (14, 14, 1), (21, 21, 1), (28, 28, 1)]
    e = temporal.emission(temporal.episodes(seen, ["o"], "f", 5), 5, F.lit(30)).orderBy("first_frame").collect()
    assert [(x.emit_frame, x.flushed) for x in e] == [(13, False), (20, False), (27, False), (30, True)]


def test_interval_join_margin(spark):
    pts = spark.createDataFrame([(0, t) for t in range(30)], "k long, t long")
    iv = spark.createDataFrame([(0, 10, 12, "a"), (0, 25, 25, "b")], "k long, lo long, hi long, n string")
    j = temporal.interval_join(pts, iv, ["k"], "t", "lo", "hi", 1).collect()
    assert sorted((r.n, r.t) for r in j) == [("a", t) for t in range(9, 14)] + [("b", t) for t in (24, 25, 26)]


def test_first_arrival_and_flow(spark):
    a = spark.createDataFrame(
        [("in1", 1, 100, 0), ("in2", 1, 150, 1), ("out", 1, 400, 2), ("out", 1, 900, 3), ("in1", 2, 10, 4), ("out", 2, 20, 5)],
        "topic string, stamp_ns long, recv_us long, seq long",
    )
    assert [(r.stamp_ns, r.flow_us) for r in temporal.flow_times(a, "out", ["in1", "in2"]).collect()] == [(1, 250)]
