import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import vptree


def brute(rows, is_query, k=5):
    """(query, rank) to (id, score) over all valid rows of the same length."""
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            valid[i] = min(valid.get(i, list(v)), list(v))
    out = {}
    for q, a in valid.items():
        if is_query(q):
            near = []
            for i, b in valid.items():
                if i != q and len(b) == len(a):
                    a_, b_ = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                    near.append((-float((a_ * b_).sum() / (np.sqrt((b_ * b_).sum()) * np.sqrt((a_ * a_).sum()))), i))
            # Equal up to rounding is a tie.
            near.sort(key=lambda x: (round(x[0], 12), x[1]))
            out |= {(q, n + 1): (i, -s, {j: -s_ for s_, j in near}) for n, (s, i) in enumerate(near[:k])}
    return out


def same(got, want):
    assert {(r["query_id"], r["rank"]) for r in got} == set(want)
    for r in got:
        _, s, scores = want[r["query_id"], r["rank"]]
        # Scores equal up to rounding may change places.
        assert math.isclose(r["score"], s, abs_tol=1e-12) and math.isclose(scores[r["vec_id"]], s, abs_tol=1e-12), r
    assert len({(r["query_id"], r["vec_id"]) for r in got}) == len(got)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, shard string")


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    same(vptree.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=300).collect(), want)
    # A relaxed search still finds nine of ten.
    relaxed = vptree.nearest(df, F.col("vec_id") % 50 == 0, factor=1.1, shard_rows=300).collect()
    hits = sum(want[r["query_id"], k][0] == r["vec_id"] for r in relaxed for k in range(1, 6) if (r["query_id"], k) in want)
    assert hits / len(want) >= 0.9


@pytest.mark.parametrize("shard_rows", [3, 4096])
def test_odd_vectors(spark, shard_rows):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, [0.0, 0.0])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 2.0]), (10, []), (None, [1.0, 1.0])]
    rows += [(11, [1.0, 1.0]), (11, [1.0, 1.0]), (150, [1e-30, 1e-30]), (12, [3e37, 3e37]), (200, [5.0])]
    df = frame(spark, rows)
    same(vptree.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).collect(), brute(rows, lambda i: i % 50 == 0))
    assert vptree.nearest(frame(spark, []), F.lit(True)).count() == 0


def test_copies_tie_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(400)] + [(500, [0.5, 1.0, 0.3])]
    got = vptree.nearest(frame(spark, rows), F.col("vec_id").isin(7, 500), shard_rows=64).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4] * 2


def test_nothing_nearer_is_skipped_at_factor_one():
    rng = np.random.default_rng(0)
    data = vptree.unit(rng.normal(size=(700, 6)) + rng.integers(0, 3, (700, 1)) * 4)
    tree = vptree.build_tree(data, leaf=8)
    asked = vptree.unit(rng.normal(size=(20, 6)))
    hits = vptree.search_tree(data, np.arange(700), tree, asked, np.full(20, -1), 5, 1.0)
    for q, rows in zip(asked, hits, strict=True):
        best = np.argsort(-(data @ q))[:5]
        assert set(best) <= set(rows.tolist())
