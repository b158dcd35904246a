"""Instances found from blobs taken one after another, solved for all blobs at once.

A blob joins the instance it touches most, ties others to it, or founds a new
one; what it touches is what earlier blobs left behind, so every decision
depends on earlier ones. The decisions of the one-by-one run are the only ones
that agree with themselves: given all owners, recomputing every blob from the
blobs before it changes nothing. So owners are guessed (one per patch of
touching blobs) and recomputed by joins until nothing changes. The first blob of
a patch is right after one round, the next after two, and so on; in practice
most guesses hold and few rounds are needed. Patches that no longer change
leave the rounds. Patches of few cells take no rounds: one task places their
blobs in turn.

Only cells are joined: for a cell and an owner the first blob that put the owner
there is kept, so a cell seen by a thousand blobs of one instance is one row.
No task sees a sequence, a colour or a large patch whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.components import connected_components
from sightline.operators.ordered import global_row_number
from sightline.session import durable, durable_path

# Fixed values
ASSIGN_SHARE = 0.15
MERGE_SHARE = 0.30
MIN_NEW_VOXELS = 20
UNLABELLED = -1
STEPS = (0, 1, -1, 1 << 21, -(1 << 21), 1 << 42, -(1 << 42))

PATCH_CELLS = 50_000
REPEATS = 40
PLACED = "at long, owner long, tied array<long>"
KEYS = ("sequence", "colour")
ORDER = ("frame", "n_px", "blob")


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    """All keys equal, null with null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _grown(cells: DataFrame, *rest: str) -> DataFrame:
    """Every cell with its six neighbours."""
    around = F.array(*[F.col("cell") + F.lit(s).cast("long") for s in STEPS])
    return cells.select(*rest, F.explode(around).alias("cell"))


def _numbered(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blobs with their place in the order (``at``) and group (``_g``), and the groups."""
    v = F.array_distinct(F.filter("voxels", lambda x: x.isNotNull()))
    b = blobs.select(*KEYS, *ORDER, F.coalesce(v, F.array().cast("array<long>")).alias("voxels"))
    b = b.withColumns({"size": F.size("voxels"), "_neg": -F.col("n_px"), "_h": F.xxhash64("voxels")})
    b = global_row_number(b, [*KEYS, "frame", "_neg", "blob", "_h"], "at").drop("_neg", "_h")
    b = durable(b, "instances-numbered")
    groups = durable(b.groupBy(*KEYS).agg(F.min("at").alias("_g")), "instances-groups")
    b = b.alias("b").join(groups.alias("g"), _same("b", "g", KEYS)).select("b.*", "_g")
    return b, groups


def _patches(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(at, patch): blobs that touch, directly or through others; a lone blob is its own patch."""
    first = durable(cells.groupBy("_g", "cell").agg(F.min("at").alias("_f")), "instances-first")
    own = cells.join(first, ["_g", "cell"]).select("at", "_f")
    ahead = F.array(*[F.col("cell") + F.lit(x).cast("long") for x in STEPS if x > 0])
    beside = first.select("_g", F.col("_f").alias("at"), F.explode(ahead).alias("cell")).join(first, ["_g", "cell"]).select("at", "_f")
    edges = own.union(beside).where("at <> _f").distinct()
    comp = connected_components(durable(edges, "instances-edges"), "at", "_f").withColumnsRenamed({"v": "at", "component": "patch"})
    return rows.select("at").join(comp, "at", "left").select("at", F.coalesce("patch", "at").alias("patch"))


def _met(cells: DataFrame, owned: DataFrame, known: DataFrame | None) -> DataFrame:
    """(at, owner, n): how many cells of a blob lie in or beside cells an owner had before it."""
    reach = _grown(owned, "patch", "owner", "first")
    if known is not None:
        reach = reach.unionByName(known)
    reach = reach.groupBy("patch", "cell", "owner").agg(F.min("first").alias("first"))
    hit = cells.select("patch", "cell", "at").join(reach, ["patch", "cell"]).where("first < at")
    return hit.groupBy("at", "owner").agg(F.count(F.lit(1)).alias("n"))


def _decide(rows: DataFrame, met: DataFrame, min_new: int) -> DataFrame:
    """rows (at, patch, size, guess) with owner and tied owners."""
    strong = F.when(F.col("n") >= F.lit(MERGE_SHARE) * F.col("size"), F.col("owner"))
    best = met.join(rows.select("at", "size"), "at").groupBy("at").agg(
        F.max(F.struct("n", (-F.col("owner")).alias("o"))).alias("_b"), F.collect_list(strong).alias("_s")
    )
    j = rows.join(best, "at", "left")
    closest = -F.col("_b.o")
    shares = F.coalesce(F.col("_b.n") >= F.lit(ASSIGN_SHARE) * F.col("size"), F.lit(False))
    small = F.col("size") < min_new
    owner = F.when(F.col("_b").isNotNull() & (shares | small), closest).when(~small, F.col("at"))
    tied = F.when(shares, F.array_remove(F.col("_s"), closest)).otherwise(F.array().cast("array<long>"))
    moved = ~owner.eqNullSafe(F.col("guess"))
    return j.select("at", "patch", "size", owner.alias("owner"), tied.alias("tied"), moved.alias("moved"))


def _by_rounds(blobs: DataFrame, known: DataFrame | None, min_new: int) -> DataFrame:
    """(at, owner, tied) for patches of any size: owners are recomputed until none changes."""
    spark = blobs.sparkSession
    path = durable_path(spark, "instances-placed")
    rows = blobs.select("at", "patch", "size", F.col("patch").alias("guess"))
    cells = durable(blobs.select("patch", "at", F.explode("voxels").alias("cell")), "instances-cells")
    written = None
    while True:
        held = cells.join(rows.where("guess IS NOT NULL").select("at", F.col("guess").alias("owner")), "at")
        owned = held.groupBy("patch", "cell", "owner").agg(F.min("at").alias("first"))
        got = durable(_decide(rows, _met(cells, owned, known), min_new), "instances-round")
        moving = durable(got.where("moved").select("patch").distinct(), "instances-moving")
        got.join(moving, "patch", "left_anti").select("at", "owner", "tied").write.mode("append").parquet(path)
        rows = got.join(moving, "patch", "left_semi").select("at", "patch", "size", F.col("owner").alias("guess"))
        left = rows.count()
        if not left:
            return spark.read.schema(PLACED).parquet(path)
        if written is None or left < written / 2:
            # Patches that are done leave the table of cells as well.
            cells, written = durable(cells.join(moving, "patch", "left_semi"), "instances-cells"), left


def _one_by_one(min_new: int):
    """Solver of one small patch: (blobs, cells of known owners) to (at, owner, tied)."""

    def run(blobs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        reach: dict[int, set[int]] = defaultdict(set)
        for cell, owner in zip(known["cell"].tolist(), known["owner"].tolist(), strict=True):
            reach[cell].add(owner)
        out = []
        for at, voxels in sorted(zip(blobs["at"].tolist(), blobs["voxels"].tolist(), strict=True), key=lambda r: r[0]):
            met = Counter(o for v in voxels for o in reach.get(int(v), ()))
            most, closest = max(((n, -o) for o, n in met.items()), default=(0, 0))
            shares = bool(met) and most >= ASSIGN_SHARE * len(voxels)
            small = len(voxels) < min_new
            owner = -closest if met and (shares or small) else None if small else at
            tied = [o for o, n in met.items() if shares and o != owner and n >= MERGE_SHARE * len(voxels)]
            out.append((at, owner, tied))
            for c in (np.asarray(voxels, np.int64)[:, None] + np.array(STEPS)).ravel().tolist() if owner is not None else ():
                reach[c].add(owner)
        return pd.DataFrame(out, columns=["at", "owner", "tied"]).astype({"owner": "Int64"})

    return run


def _place(b: DataFrame, known: DataFrame | None, min_new: int, patch_cells: int) -> DataFrame:
    """(at, owner, tied) of every blob; an owner is its founding blob, or a negative number of ``known``."""
    patch = _patches(b.select("_g", "at", F.explode("voxels").alias("cell")), b)
    b = durable(b.join(patch, "at").select("_g", "patch", "at", "size", "voxels"), "instances-patched")
    space = b.select("patch", F.explode("voxels").alias("cell")).distinct().groupBy("patch").agg(F.count(F.lit(1)).alias("_d"))
    weight = b.groupBy("patch").agg(F.sum("size").alias("_w")).join(space, "patch")
    near = b.sparkSession.createDataFrame([], "patch long, cell long, owner long, first long")
    if known is not None:
        mine = b.select("_g", "patch", F.explode("voxels").alias("cell")).distinct()
        near = durable(_grown(known, "_g", "owner", "first").distinct().join(mine, ["_g", "cell"]).select("patch", "cell", "owner", "first"), "instances-known")
        extra = near.groupBy("patch").agg(F.count(F.lit(1)).alias("_e"))
        weight = weight.join(extra, "patch", "left").withColumn("_d", F.col("_d") + F.coalesce("_e", F.lit(0)))
    # What a task holds follows the different cells, its time follows all cells.
    over = (F.col("_d") > patch_cells) | (F.col("_w") > patch_cells * REPEATS)
    large = durable(weight.where(over).select("patch"), "instances-large")
    # The number of tasks is asked for, as few bytes that take long would be put in one.
    tasks = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [x.join(large, "patch", "left_anti").repartition(tasks, "patch").groupBy("patch") for x in (b, near)]
    small = sides[0].cogroup(sides[1])
    placed = small.applyInPandas(_one_by_one(min_new), PLACED)
    if not large.isEmpty():
        big = b.join(large, "patch", "left_semi")
        placed = placed.unionByName(_by_rounds(big, near if known is not None else None, min_new))
    return durable(placed, "instances-placed")


def place_blobs(
    blobs: DataFrame,
    known: DataFrame | None = None,
    counts: DataFrame | None = None,
    min_new: int = MIN_NEW_VOXELS,
    patch_cells: int = PATCH_CELLS,
) -> tuple[DataFrame, DataFrame]:
    """Blobs with their instance, and the cells the instances own.

    blobs: (sequence, colour, frame, blob, n_px, voxels array<long>), placed by
    frame, larger first, then by blob. Result: (sequence, colour, frame, blob,
    n_px, instance, merged), and (sequence, colour, cell, instance, first_frame).

    ``known``   cells owned before these blobs, (sequence, colour, cell, instance)
    ``counts``  instances found before, (sequence, colour, n); numbers go on from there
    ``patch_cells``  patches of up to that many different cells, each in ``REPEATS`` blobs on average, are solved
                 in one task, larger ones by rounds; same answer

    Null or empty voxels give ``UNLABELLED``, as does a blob under ``min_new``
    cells that touches nothing. Null keys are a group of their own. Repeated
    rows are placed in turn. Instances are numbered in the order of their first blobs.
    """
    b, groups = _numbered(blobs)
    b = durable(b, "instances-blobs")
    if known is not None:
        near = known.alias("k").join(groups.alias("g"), _same("k", "g", KEYS))
        # Known owners are negative and had their cells before any blob.
        known = near.select("_g", "cell", (F.col("instance") - F.lit(1 << 40)).alias("owner"), F.lit(0).cast("long").alias("first"))
    placed = _place(b, known, min_new, patch_cells)
    where = b.drop("voxels").join(placed, "at")
    founders = global_row_number(where.where("owner = at").select("_g", "at"), ["at"], "_n")
    start = founders.groupBy("_g").agg(F.min("_n").alias("_first"))
    if counts is None:
        base = groups.select("_g", F.lit(0).cast("long").alias("n"))
    else:
        base = groups.alias("g").join(counts.alias("c"), _same("g", "c", KEYS), "left").select("_g", F.coalesce("n", F.lit(0)).alias("n"))
    number = durable(
        founders.join(start, "_g").join(base, "_g")
        .select(F.col("at").alias("owner"), (F.col("_n") - F.col("_first") + F.col("n")).alias("number")),
        "instances-numbers",
    )
    old = F.col("owner") + F.lit(1 << 40)
    named = where.join(number, "owner", "left").withColumn(
        "instance", F.when(F.col("owner") < 0, old).otherwise(F.coalesce("number", F.lit(UNLABELLED).cast("long")))
    )
    ties = (
        where.select("at", F.explode("tied").alias("owner")).join(number, "owner", "left")
        .groupBy("at").agg(F.sort_array(F.collect_list(F.when(F.col("owner") < 0, old).otherwise(F.col("number")))).alias("merged"))
    )
    out = named.join(ties, "at", "left").withColumn("merged", F.coalesce("merged", F.array().cast("array<long>")))
    out = durable(out.select("at", *KEYS, *ORDER, "instance", "merged"), "instances-named")
    has = out.where(F.col("instance") >= 0).select("at", "frame", "instance")
    cells = b.select("at", *KEYS, F.explode("voxels").alias("cell")).join(has, "at")
    owned = cells.groupBy(*KEYS, "cell", "instance").agg(F.min("frame").alias("first_frame"))
    return out.drop("at"), owned
