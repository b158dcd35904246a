"""One-to-one assignment of rows to columns inside groups.

Pairs that cannot be chosen are dropped first, and a pair without a rival is
chosen outright. The best assignment of a group is the union of the best
assignments of the connected components of its bipartite graph, and the solver
only ever sees one component: small groups (a frame has at most a few hundred
masks and truths) are parted inside the solver call, larger ones by joins
before it. Either way a component is solved alone from the same numbers, so
the size of its group makes no difference, ties included, nor do the groups that
share its call. The solver itself is
a small numpy routine run by grouped maps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.components import connected_components
from sightline.session import durable


GROUP_PAIRS = 100_000
#: Pairs of small groups that one call solves, on average.
CALL_PAIRS = 2_000


# ------------------------------------------------------------------- solvers

def best_total(weight: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of maximum total weight covering the shorter side.

    Shortest augmenting paths with dual prices.
    """
    w = np.asarray(weight, float)
    if w.size == 0:
        return []
    flip = w.shape[0] > w.shape[1]
    cost = -(w.T if flip else w)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        via = np.full(m, -1)
        closed = np.zeros(m, bool)
        row, last, walked = start, -1, 0.0
        while True:
            step = walked + cost[row] - row_price[row] - col_price
            better = ~closed & (step < reach)
            reach[better] = step[better]
            via[better] = last
            col = int(np.argmin(np.where(closed, np.inf, reach)))
            walked = reach[col]
            closed[col] = True
            last = col
            if owner[col] < 0:
                break
            row = int(owner[col])
        row_price[start] += walked
        for c in np.flatnonzero(closed):
            if c != col:
                row_price[owner[c]] += walked - reach[c]
                col_price[c] -= walked - reach[c]
        while col >= 0:
            prev = int(via[col])
            owner[col] = start if prev < 0 else owner[prev]
            col = prev
    pairs = [(int(r), int(c)) for c, r in enumerate(owner) if r >= 0]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def greedy_pairs(weight: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """Best pair first; ties in row-major order; stops at values not above ``floor``."""
    w = np.asarray(weight, float)
    rows, cols, out = set(), set(), []
    for k in np.argsort(-w, axis=None, kind="stable"):
        r, c = divmod(int(k), w.shape[1])
        if w[r, c] <= floor:
            break
        if r not in rows and c not in cols:
            rows.add(r)
            cols.add(c)
            out.append((r, c))
    return out


def parts(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each pair (row, col) a number of its connected component."""
    _, r = np.unique(rows, return_inverse=True)
    _, c = np.unique(cols, return_inverse=True)
    of_row = np.arange(r.max() + 1)
    while True:
        of_col = np.full(c.max() + 1, len(of_row))
        np.minimum.at(of_col, c, of_row[r])
        least = of_row.copy()
        np.minimum.at(least, r, of_col[c])
        # A row takes the number of the row its number stands for.
        least = least[least]
        if (least == of_row).all():
            return of_row[r]
        of_row = least


def _solve_part(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, method: str) -> list[int]:
    """The chosen ones of the pairs of one component."""
    r, ri = np.unique(rows, return_inverse=True)
    c, ci = np.unique(cols, return_inverse=True)
    w = np.zeros((len(r), len(c)))
    at = np.full(w.shape, -1)
    w[ri, ci] = weights
    at[ri, ci] = np.arange(len(weights))
    ok = at >= 0
    if method == "greedy":
        picks = greedy_pairs(np.where(ok, w, -np.inf), -np.inf)
    elif method == "most_then_best":
        picks = best_total(ok + w / (2.0 * min(w.shape)))
    else:
        picks = best_total(w)
    return [int(at[i, j]) for i, j in picks if ok[i, j]]


def _solve(method: str):
    """Solver of all components of some groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pd.factorize(pdf["_g"])[0]
        r, c, w = (pdf[x].to_numpy() for x in ("_r", "_c", "_w"))
        # Ids count within their group.
        label = parts(*(pd.MultiIndex.from_arrays([group, x]).factorize()[0] for x in (r, c)))
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.diff(label[order], prepend=-1))
        chosen = []
        for part in np.split(order, starts[1:]):
            chosen += part[_solve_part(r[part], c[part], w[part], method)].tolist()
        return pdf[["_g", "_r", "_c", "_w"]].iloc[chosen]

    return run


# ------------------------------------------------------------------ operator

def assign(
    pairs: DataFrame,
    keys: Sequence[str],
    row: str,
    col: str,
    weight: str,
    candidate: Column,
    method: str = "best_total",
    group_pairs: int = GROUP_PAIRS,
) -> DataFrame:
    """Chosen (keys, row, col, weight).

    ``candidate``  pairs that may be chosen; all others count as weight 0
    ``method``     ``best_total``: largest weight sum; ``most_then_best``: most
                   pairs, then largest sum; ``greedy``: best first

    ``row`` and ``col`` are long ids, ``weight`` is positive for candidates.
    """
    keys = list(keys)
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    cand = durable(
        pairs.where(candidate).select(
            *keys,
            group.alias("_g"),
            F.col(row).cast("long").alias("_r"),
            F.col(col).cast("long").alias("_c"),
            F.col(weight).cast("double").alias("_w"),
        ),
        "assign-candidates",
    )
    # A pair whose row and column have no other candidate is chosen outright.
    row_deg = cand.groupBy("_g", "_r").agg(F.count(F.lit(1)).alias("_rd"))
    col_deg = cand.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_cd"))
    deg = cand.join(row_deg, ["_g", "_r"]).join(col_deg, ["_g", "_c"])
    lone = deg.where("_rd = 1 AND _cd = 1").select("_g", "_r", "_c", "_w")
    rest = durable(deg.where("_rd > 1 OR _cd > 1").select("_g", "_r", "_c", "_w"), "assign-rest")
    largest, total = rest.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    chosen = lone
    if largest is not None:
        if largest <= group_pairs:
            part = rest.withColumn("component", F.col("_g"))
        else:
            vr = F.concat_ws("|", F.lit("r"), F.col("_r"), F.col("_g"))
            vc = F.concat_ws("|", F.lit("c"), F.col("_c"), F.col("_g"))
            comp = connected_components(rest.select(vr.alias("a"), vc.alias("b")), "a", "b")
            part = rest.withColumn("v", vr).join(comp, "v").drop("v")
        # Groups are solved many at a call; their number is asked for, as few bytes would be put in few tasks.
        calls = -(-total // CALL_PAIRS)
        tasks = min(calls, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        call = F.pmod(F.xxhash64("component"), F.lit(calls))
        solved = part.withColumn("call", call).repartition(tasks, "call").groupBy("call").applyInPandas(_solve(method), "_g string, _r long, _c long, _w double")
        chosen = lone.union(solved)
    names = cand.select("_g", *keys).distinct() if keys else cand.select("_g").distinct()
    chosen = durable(chosen, "assigned")
    return chosen.join(names, "_g").select(
        *keys, F.col("_r").alias(row), F.col("_c").alias(col), F.col("_w").alias(weight)
    )
