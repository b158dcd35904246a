"""Discovery against a plain one-by-one run, by task and by rounds, in one batch and in many."""

import random

import pytest

from sightline.operators import instances
from sightline.operators.instances import STEPS, place_blobs
from sightline.streaming import discovery, runtime

SCHEMA = discovery.INPUT


def plain(rows):
    """{(sequence, colour, frame, blob): (instance, tied)} by sets, one blob after another."""
    out, owned = {}, {}
    for s, c, f, n, b, v in sorted(rows, key=lambda r: (str(r[0]), str(r[1]), r[2], -r[3], r[4])):
        found = owned.setdefault((s, c), [])
        v = {x for x in v or [] if x is not None}
        n_met = [sum(any(x + d in cells for d in STEPS) for x in v) for cells in found]
        rank = sorted((i for i, k in enumerate(n_met) if k), key=lambda i: (-n_met[i], i))
        tied = []
        if rank and n_met[rank[0]] >= 0.15 * len(v):
            at = rank[0]
            tied = sorted(i for i in rank[1:] if n_met[i] >= 0.3 * len(v))
        elif len(v) >= 20:
            at = len(found)
            found.append(set())
        else:
            at = rank[0] if rank else -1
        if at >= 0:
            found[at] |= v
        out[s, c, f, b] = (at, tied)
    return out


def scene(seed, n=60, hot=1 / 3):
    rng = random.Random(seed)
    rows = []
    for b in range(n):
        colour = 7 if rng.random() < hot else rng.randrange(3)
        start = rng.randrange(0, 500)
        size = rng.choice([4, 15, 30, 60])
        v = list(range(start, start + size)) + ([start + (1 << 21) * k for k in range(5)] if b % 3 == 0 else [])
        if b % 7 == 0:  # reaches into another place
            v += list(range((start + 250) % 500, (start + 250) % 500 + 30))
        rows.append((0, colour, b // 4, rng.randrange(1, 4), b, v))
    return rows


def result(df):
    return {(r["sequence"], r["colour"], r["frame"], r["blob"]): (r["instance"], r["merged"]) for r in df.collect()}


def test_rules_by_task_and_by_rounds(spark):
    span = lambda *parts: sorted(v for p in parts for v in p)
    rows = [
        (0, 1, 0, 9, 0, span(range(0, 40))),
        (0, 1, 1, 9, 0, span(range(30, 60))),          # 10 of 30 shared
        (0, 1, 2, 9, 0, span(range(1000, 1030))),      # new
        (0, 1, 3, 9, 0, span(range(5000, 5005))),      # sliver that touches nothing
        (0, 1, 4, 9, 0, [59, *range(700, 707)]),       # sliver joins its closest
        (0, 1, 5, 9, 0, []),
        (0, 1, 6, 9, 0, None),
        (0, 1, 7, 9, 0, span(range(20, 60), range(1000, 1030))),
        (0, None, 0, 9, 0, span(range(0, 40))),        # a null colour is a colour of its own
        (0, None, 1, 9, 0, [None, *range(0, 40), *range(0, 40)]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert [want[0, 1, f, 0] for f in range(8)] == [(0, []), (0, []), (1, []), (-1, []), (0, []), (-1, []), (-1, []), (0, [1])]
    for limit in (0, instances.PATCH_CELLS):
        out, owned = place_blobs(df, patch_cells=limit)
        assert result(out) == want
        assert {(r["cell"], r["instance"]) for r in owned.where("colour = 1 AND instance = 1").collect()} == {(v, 1) for v in range(1000, 1030)}


def test_random_scene_with_a_hot_colour(spark):
    rows = scene(3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert any(t for _, t in want.values()) and len({(k[1], v[0]) for k, v in want.items()}) > 6
    for limit in (0, 200, instances.PATCH_CELLS):
        assert result(place_blobs(df, patch_cells=limit)[0]) == want


def test_empty_table(spark):
    out, owned = place_blobs(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and owned.count() == 0


@pytest.mark.parametrize("mixed", [False, True])
def test_files_and_their_order_make_no_difference(spark, tmp_path, mixed):
    rows = scene(5, 40)
    if mixed:  # late frames, and frames that lie in several files
        random.Random(1).shuffle(rows)
    for k in range(3):
        part = spark.createDataFrame(rows[k * 14:(k + 1) * 14], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runtime.folder_stream(spark, str(tmp_path / "in"), part.schema, max_files=1)
    assert result(discovery.discover(stream)) == plain(rows)
