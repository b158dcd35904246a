"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source has a target in words: its share of all words by weight, but at
most ``ceiling`` times its own words, the excess shared again by weight. The
mix consists of blocks of ``block`` words. Blocks are given to sources by
highest quotients target / (2 k - 1), then to the shards of a source (runs of
``shard_blocks`` blocks in a seeded order of its documents) by the same rule.
Inside a shard a quota of q over n blocks takes every block q div n times and
the q mod n blocks of a circular run that starts at a seeded block once more,
so documents stay whole except at the ends of a run.

A null text has no words; null sources are one source, after all others.
Documents without words take nothing. Rows that repeat an id are documents of
their own. Everything is a function of ids, sources and texts: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import picked
from sightline.operators.ordered import SLICE, global_row_number, prefix_sum, sliced
from sightline.session import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CEILING = 3
BLOCK = 16
SHARD_BLOCKS = 1 << 16
SEED = 20
#: Quotient bounds tried in one pass over the sources.
GRID = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _one(df: DataFrame, *columns: Column):
    return df.agg(*columns).first()


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, rank, source_size, target) from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("_last", F.col("source").isNull().cast("int"))
    ranked = global_row_number(sources, ["_last", "source"], "rank").drop("_last")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = durable(
        ranked.withColumn("weight", F.element_at(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("most", F.col("source_size") * float(ceiling))
        .withColumn("ratio", F.col("most") / F.col("weight")),
        "mix-sources",
    )
    total, weight = _one(ranked, F.sum("source_size"), F.sum("weight"))
    # The level at which the sources that stay below their ceiling share what is left.
    cut = sliced(ranked, [], ["ratio", "rank"])
    cut = prefix_sum(cut, [], ["ratio", "rank"], F.col("most"), "full", inclusive=False)
    cut = prefix_sum(cut, [], ["ratio", "rank"], F.col("weight"), "passed", inclusive=False)
    cut = cut.withColumn("level", (F.lit(float(total or 0)) - F.col("full")) / (F.lit(float(weight or 0)) - F.col("passed")))
    open_ = cut.where(F.col("level") <= F.col("ratio"))
    level = _one(open_, F.min_by("level", F.struct("ratio", "rank")))[0] or 0.0
    return ranked.select(
        "source", "rank", "source_size", F.least("most", F.col("weight") * level).alias("target")
    )


def _seats(target: Column, bound: Column | float, most: Column) -> Column:
    """How many quotients target / (2 k - 1) reach ``bound``."""
    return F.least(most, F.floor((target / bound + 1) / 2)).cast("long")


def apportion(targets: DataFrame, seats: int, order: str = "rank") -> DataFrame:
    """``targets`` with a column ``quota``: seats by highest quotients, at most ``most`` each.

    Ties go by ``order``. The smallest quotient that still gets a seat is
    enclosed by counting over a grid of bounds; only quotients inside the last
    interval are listed and ranked.
    """
    n, total, high = _one(targets, F.count(F.lit(1)), F.sum("target"), F.max("target"))
    if not n or not seats or not total:
        return targets.withColumn("quota", F.lit(0).cast("long"))
    low, high = total / (2.0 * (3 * seats + n + 1)), high * 1.0001
    for _ in range(4):
        grid = [low * (high / low) ** (i / GRID) for i in range(GRID + 1)]
        counts = _one(targets, *[F.sum(_seats(F.col("target"), q, F.col("most"))) for q in grid])
        at = next(i for i in range(GRID, -1, -1) if counts[i] >= seats or i == 0)
        low, high = grid[at], grid[min(at + 1, GRID)]
        if at == GRID or counts[at] - counts[at + 1] <= n:
            break
    base = targets.withColumn("_sure", _seats(F.col("target"), high, F.col("most"))).withColumn(
        "_may", _seats(F.col("target"), low, F.col("most"))
    )
    left = seats - _one(base, F.sum("_sure"))[0]
    claims = base.where("_may > _sure").select(
        order, "target", F.explode(F.sequence(F.col("_sure") + 1, F.col("_may"))).alias("k")
    )
    claims = claims.withColumn("_q", -F.col("target") / (2 * F.col("k") - 1))
    won = global_row_number(claims, ["_q", order, "k"], "_place").where(F.col("_place") <= left)
    extra = won.groupBy(order).agg(F.count(F.lit(1)).alias("_more"))
    return base.join(extra, order, "left").withColumn(
        "quota", F.col("_sure") + F.coalesce("_more", F.lit(0))
    ).drop("_sure", "_may", "_more")


def _shard_quotas(sources: DataFrame, shard_blocks: int) -> DataFrame:
    """Quotas of shards in closed form: all but the last shard of a source have the same size."""
    k = F.lit(shard_blocks)
    full = F.floor(F.col("blocks") / k).cast("long")
    rows = sources.withColumn("full", full).withColumn("tail", F.col("blocks") - F.col("full") * k)
    share = F.floor(F.col("quota") * F.col("tail") / F.greatest("blocks", F.lit(1))).cast("long")
    # The last shard gets x seats if its x-th quotient is among the first quota quotients.
    claims = F.filter(
        F.sequence(F.greatest(share - 2, F.lit(0)), share + 2),
        lambda x: (x == 0)
        | (F.col("full") * F.floor((k * (2 * x - 1) / F.greatest("tail", F.lit(1)) + 1) / 2) + x <= F.col("quota")),
    )
    last = F.when(F.col("full") == 0, F.col("quota")).when(F.col("tail") == 0, F.lit(0)).otherwise(F.array_max(claims))
    rows = rows.withColumn("last", last.cast("long")).withColumn("_rest", F.col("quota") - F.col("last"))
    wide = F.greatest("full", F.lit(1))
    return rows.withColumn("each", F.floor(F.col("_rest") / wide).cast("long")).withColumn(
        "extra", F.pmod(F.col("_rest"), wide)
    ).drop("_rest")


def _common(a: Column, b: Column, c: Column, d: Column) -> Column:
    """[from, to) that [a, b) and [c, d) share, as a struct; empty where to <= from."""
    return F.struct(F.greatest(a, c).alias("begin"), F.least(b, d).alias("end"))


def _ranges(block: int, shard_blocks: int, seed: int) -> Column:
    """Word ranges of a document the mix takes: structs (begin, end, times), counted inside the document."""
    start, size, total = F.col("start"), F.col("size"), F.col("source_size")
    words = block * shard_blocks

    def of_shard(h: Column) -> Column:
        is_last = h == F.col("full")
        # Documents without words may lie behind the last shard.
        n = F.when(is_last, F.greatest("tail", F.lit(1))).otherwise(F.lit(shard_blocks))
        q = F.when(is_last, F.col("last")).otherwise(F.col("each") + (h < F.col("extra")).cast("long"))
        turn = F.pmod((F.col("rank") * 7919 + h * 104729 + seed) * 2654435761, F.lit(4294967296))
        first = h * shard_blocks + F.pmod(turn, n)
        end = first + F.pmod(q, n)
        stop = h * shard_blocks + n
        times = F.floor(q / n).cast("long")
        a, b = start, start + size
        parts = (
            (_common(a, b, h * words, F.least(stop * block, total)), times),
            (_common(a, b, first * block, F.least(F.least(end, stop) * block, total)), F.lit(1).cast("long")),
            (_common(a, b, h * words, (end - n) * block), F.lit(1).cast("long")),
        )
        return F.array(*[
            F.struct((p["begin"] - start).alias("begin"), (p["end"] - start).alias("end"), t.alias("times"))
            for p, t in parts
        ])

    shards = F.sequence(F.floor(start / words).cast("long"), F.floor((start + size - 1) / words).cast("long"))
    found = F.flatten(F.transform(shards, of_shard))
    kept = F.filter(found, lambda r: (r["end"] > r["begin"]) & (r["times"] > 0))
    return F.when(size > 0, kept).otherwise(F.filter(found, lambda r: F.lit(False)))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, block: int = BLOCK,
    shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, content, size, source_size, target, quota, ranges, taken) of every row.

    ``ranges`` holds the word ranges taken with how often, ``taken`` their sum
    in words; ``content`` is a hash of the text that tells repeated ids apart.
    """
    placed = _placed(df, id_col, text_col, source_col, weights, ceiling, block, shard_blocks, seed)
    return placed.select("doc_id", "content", "size", "source_size", "target", "quota", "ranges", "taken")


def _placed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, block: int = BLOCK,
    shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> DataFrame:
    """The columns of ``mix`` with the source of each row and its start in the run of its source."""
    docs = picked(df, doc_id=id_col, text=text_col, source=source_col)
    slim = durable(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content")),
        "mix-sizes",
    )
    sources = source_targets(slim, weights, ceiling)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn(
        "most", F.col("blocks") * ceiling
    )
    seats = round((_one(sources, F.sum("source_size"))[0] or 0) / block)
    quotas = durable(_shard_quotas(apportion(sources, seats), shard_blocks), "mix-quotas")
    named = slim.join(
        quotas.select(F.col("source").alias("_s"), "rank"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = sliced(named.withColumn("_turn", turn), ["rank"], ["_turn", "doc_id", "size", "content"])
    placed = prefix_sum(placed, ["rank"], ["_turn", "doc_id", "size", "content"], F.col("size"), "start", inclusive=False)
    placed = placed.drop("_turn", SLICE).join(quotas.drop("source"), "rank")
    placed = placed.withColumn("ranges", _ranges(block, shard_blocks, seed))
    taken = F.aggregate(
        "ranges", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["begin"]) * r["times"]
    )
    return placed.withColumn("taken", taken)


#: Id, source and text of a row without nulls; a flag tells a null from any value.
KEYS = ["_id", "_source", "_nulls", "_content"]


def _keys(doc_id: Column, source: Column, content: Column) -> list[Column]:
    nulls = doc_id.isNull().cast("int") * 2 + source.isNull().cast("int")
    return [
        F.coalesce(doc_id, F.lit(0)).alias("_id"), F.coalesce(source, F.lit("")).alias("_source"),
        nulls.alias("_nulls"), content.alias("_content"),
    ]


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_nth``, the place of a row among those with its ``KEYS``."""
    return prefix_sum(sliced(df, KEYS, order), KEYS, order, F.lit(1).cast("long"), "_nth").drop(SLICE)


def mixed_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: a row of ``df`` for every taken range and repetition.

    A range over all words keeps the text as it is; a part of a document is
    its words joined by single spaces.
    """
    taken = _placed(df, id_col, text_col, source_col, **options).select(
        *_keys(F.col("doc_id"), F.col("source"), F.col("content")), "start", F.struct("size", "ranges").alias("_take")
    )
    taken = durable(taken, "mix-takes")
    # The user's columns travel as one, so none of their names can meet an inner one.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_user"),
        *_keys(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.xxhash64(F.col(f"`{text_col}`"))),
    )
    repeated = durable(taken.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "mix-repeated")
    if repeated.isEmpty():
        rows = rows.join(taken, KEYS)
    else:
        # Rows alike in id, source and text are numbered over slices, so one of them may be a third of all.
        many = rows.join(repeated, KEYS, "left_semi").withColumn("_row", F.xxhash64(F.to_json("_user")))
        many = _numbered(many.withColumn("_salt", F.rand(seed=SEED)), ["_row", "_salt"])
        takes = _numbered(taken.join(repeated, KEYS, "left_semi"), ["start"])
        once = rows.join(taken.join(repeated, KEYS, "left_anti"), KEYS)
        names = ["_user", "_take"]
        rows = once.select(*names).unionByName(many.join(takes, [*KEYS, "_nth"]).select(*names))
    rows = rows.withColumn("_r", F.explode("_take.ranges"))
    rows = rows.withColumn("_r", F.explode(F.array_repeat("_r", F.col("_r.times").cast("int"))))
    text = F.col("_user").getField(text_col)
    whole = (F.col("_r.begin") == 0) & (F.col("_r.end") == F.col("_take.size"))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    part = F.array_join(F.slice(words, (F.col("_r.begin") + 1).cast("int"), (F.col("_r.end") - F.col("_r.begin")).cast("int")), " ")
    mixed = F.when(whole, text).otherwise(part)
    return rows.select(*[(mixed if c == text_col else F.col("_user").getField(c)).alias(c) for c in df.columns])
