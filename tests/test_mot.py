import itertools

import numpy as np
import pytest

from sightline.operators import mot
from sightline.operators.assignment import best_total


def frames(spark, steps):
    """steps: list of (gts, trks, sim matrix) for one sequence."""
    g, k, p = [], [], []
    for t, (gs, ts, sim) in enumerate(steps):
        g += [(0, t, int(a)) for a in gs]
        k += [(0, t, int(b)) for b in ts]
        p += [(0, t, int(a), int(b), float(sim[i][j])) for i, a in enumerate(gs) for j, b in enumerate(ts) if sim[i][j] > 0]
    mk = spark.createDataFrame
    return (
        mk(g, "seq long, t long, gt long"),
        mk(k, "seq long, t long, trk long"),
        mk(p or [(0, -1, 0, 0, 0.0)], "seq long, t long, gt long, trk long, sim double"),
    )


def scores(spark, steps, chunk=3):
    g, k, p = frames(spark, steps)
    m = mot.clear_matches(p, mot.active_steps(g, k), chunk_steps=chunk)
    c = mot.clear_metrics(g, k, m).first().asDict()
    i = mot.identity_metrics(g, k, p).first().asDict()
    h = mot.hota_metrics(g, k, mot.hota_matches(p, mot.alignment(g, k, p))).first().asDict()
    return {**c, **i, **h}


def base_scene():
    """Two truths over ten steps; the second changes id half way, one miss and one extra."""
    steps = []
    for t in range(10):
        gs, ts, sim = [0, 1], [10, 21 if t >= 5 else 20], [[1.0, 0.0], [0.0, 1.0]]
        if t == 9:
            ts, sim = [10, 99], [[1.0, 0.0], [0.0, 0.0]]
        steps.append((gs, ts, sim))
    return steps


def test_base_scene(spark):
    r = scores(spark, base_scene())
    assert (r["TP"], r["FN"], r["FP"], r["IDSW"], r["Frag"]) == (19, 1, 1, 1, 0)
    assert r["MOTA"] == pytest.approx(0.85)
    assert r["IDF1"] == pytest.approx(0.75)
    assert r["DetA"] == pytest.approx(19 / 21)
    assert r["AssA"] == pytest.approx((10 + 5 * 5 / 10 + 4 * 4 / 10) / 19)


def test_switch_back_counts_twice(spark):
    steps = [([0], [k], [[1.0]]) for k in (1, 1, 2, 1)]
    r = scores(spark, steps)
    assert (r["IDSW"], r["Frag"]) == (2, 0)


def test_gaps_break_segments_only_on_active_steps(spark):
    on, off, none = ([0], [1], [[1.0]]), ([0], [9], [[0.0]]), ([0], [], [[]])
    assert scores(spark, [on, off, on, off, on, off, on])["Frag"] == 3
    assert scores(spark, [on, none, on, none, on])["Frag"] == 0


def stepwise(steps):
    """Plain step-by-step run used as reference for the chunked one."""
    kept, out = set(), []
    for t, (gs, ts, sim) in enumerate(steps):
        if not gs or not ts:
            continue
        w = np.array(sim, float)
        w[w < 0.5] = 0
        for i, j in itertools.product(range(len(gs)), range(len(ts))):
            if (gs[i], ts[j]) in kept and w[i, j] > 0:
                w[i, j] += 1000
        picks = [(gs[i], ts[j]) for i, j in best_total(w) if w[i, j] > 0]
        kept = set(picks)
        out += [(t, a, b) for a, b in picks]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chunked_equals_stepwise(spark, seed):
    rng = np.random.default_rng(seed)
    steps = []
    for _ in range(30):
        gs = sorted(rng.choice(5, rng.integers(0, 5), replace=False).tolist())
        ts = sorted(rng.choice(6, rng.integers(0, 6), replace=False).tolist())
        steps.append((gs, ts, np.round(rng.uniform(0.3, 1, (len(gs), len(ts))), 6).tolist()))
    g, k, p = frames(spark, steps)
    got = mot.clear_matches(p, mot.active_steps(g, k), chunk_steps=2).collect()
    assert sorted((r.t, r.gt, r.trk) for r in got) == sorted(stepwise(steps))


def test_tracking_inputs_reasons(spark):
    gts = spark.createDataFrame(
        [(0, 0, 1, True, False), (0, 0, 2, True, True), (0, 0, 3, False, False)],
        "seq long, t long, gt long, present boolean, is_human boolean",
    )
    out = spark.createDataFrame(
        [(0, 0, 0, 10, 5, 0, 0, 1), (0, 0, 1, 11, 5, 0, 0, 2), (0, 0, 2, 12, 5, 0, 0, 3), (0, 0, 3, 13, 0, 0, 0, None),
         (0, 0, 4, 14, 10, 6, 0, None), (0, 0, 5, 15, 10, 5, 0, None)],
        "seq long, t long, pred long, trk long, n_vox long, void long, ignored long, matched_gt long",
    )
    sim = spark.createDataFrame([(0, 0, 1, 0, 0.9), (0, 0, 2, 1, 0.8)], "seq long, t long, gt long, pred long, sim double")
    truths, tracks, pairs, removed = mot.tracking_inputs(gts, out, sim)
    assert [r.gt for r in truths.collect()] == [1]
    assert sorted(r.trk for r in tracks.collect()) == [10, 15]
    assert [(r.gt, r.trk) for r in pairs.collect()] == [(1, 10)]
    assert {r.trk: r.reason for r in removed.collect()} == {
        11: "matched_human_gt", 12: "matched_non_present_gt", 13: "no_voxels_within_range", 14: "mostly_ignore_region"
    }
