import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import assignment
from sightline.operators.assignment import assign, best_total, greedy_pairs
from sightline.operators.components import connected_components


def brute_total(w):
    n, m = w.shape
    if n > m:
        return brute_total(w.T)
    return max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


@pytest.mark.parametrize("seed", range(30))
def test_best_total_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, 6, (rng.integers(1, 6), rng.integers(1, 6))) / 4
    picks = best_total(w)
    assert len(picks) == min(w.shape)
    assert len({r for r, _ in picks}) == len({c for _, c in picks}) == len(picks)
    assert sum(w[p] for p in picks) == pytest.approx(brute_total(w))


def test_sum_beats_greedy():
    w = np.array([[0.9, 0.6], [0.8, 0.0]])
    assert best_total(w) == [(0, 1), (1, 0)]
    assert greedy_pairs(w, 0.0) == [(0, 0)]


def test_greedy_ties_are_row_major():
    assert greedy_pairs(np.full((2, 2), 0.5), 0.0) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("limit", [1, 1000])
def test_assign_by_component(spark, limit):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(6):
        w = np.round(rng.random((4, 5)), 3)
        ok = w >= 0.5
        rows += [(g, int(r), int(c), float(w[r, c])) for r in range(4) for c in range(5)]
        want[g] = brute_total(np.where(ok, w, 0.0))
    df = spark.createDataFrame(rows, "g long, r long, c long, w double")
    got = assign(df, ["g"], "r", "c", "w", F.col("w") >= 0.5, group_pairs=limit).groupBy("g").agg(F.sum("w").alias("w")).collect()
    assert {r.g: pytest.approx(r.w) for r in got} == want


def test_most_pairs_first(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.9), (0, 0, 1, 0.3), (0, 1, 0, 0.3)], "g long, r long, c long, w double")
    best = assign(df, ["g"], "r", "c", "w", F.lit(True)).collect()
    most = assign(df, ["g"], "r", "c", "w", F.lit(True), "most_then_best").collect()
    assert {(r.r, r.c) for r in best} == {(0, 0)}
    assert {(r.r, r.c) for r in most} == {(0, 1), (1, 0)}


def test_components_path_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 180)] + [(500, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.component for r in connected_components(df, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[k] == 100 for k in range(100, 180))
    assert got[500] == 500


def test_groups_that_share_a_call_are_solved_alone():
    """Ids repeat from group to group; each group keeps the choice it has by itself."""
    rng = np.random.default_rng(8)
    rows = [
        (f"g{g}", r, c, float(rng.integers(1, 5)) / 4)
        for g in range(40) for r in range(5) for c in range(5) if rng.random() < 0.5
    ]
    pdf = pd.DataFrame(rows, columns=["_g", "_r", "_c", "_w"]).sample(frac=1, random_state=1)
    for method in ("best_total", "most_then_best", "greedy"):
        solve = assignment._solve(method)
        alone = pd.concat([solve(part) for _, part in pdf.groupby("_g")])
        together = solve(pdf)
        keys = ["_g", "_r", "_c"]
        assert together.sort_values(keys).values.tolist() == alone.sort_values(keys).values.tolist()
        assert not together.duplicated(["_g", "_r"]).any() and not together.duplicated(["_g", "_c"]).any()
