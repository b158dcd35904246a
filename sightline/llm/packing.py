"""Best-two-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut into whole sequences and one shorter
first piece. How pieces of a length are arranged depends only on how many
there are of each length, so the plan is made on counts per length, of which
there are as many as a sequence has tokens, whatever the corpus size. A bin is
filled greedily with the longest pieces that fit; if a gap is left, its
smallest piece is taken out and replaced by the two unpacked pieces that fill
the widened gap best, if they fill it more tightly. A pattern is repeated for
as long as its lengths last. Pieces then find their place by their rank among
the pieces of their length, which is counted without one task per length.

Nulls count as empty texts, whose only token is the end mark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import by_rows, picked
from sightline.llm.tokens import encoder
from sightline.operators.ordered import SLICE, prefix_sum, sliced
from sightline.session import durable

CAPACITY = 1024
END = 2


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of a document; only the first may be shorter than a sequence."""
    head = length % capacity
    cuts = [*([0] if head else []), *range(head, length + 1, capacity)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def token_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all pieces of every row."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        ids_of = encoder(vocabulary).ids
        mark = np.array([end], "<u4").tobytes()
        for doc_ids, texts in batches:
            rows = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                data = (ids_of(text) if text else b"") + mark
                for n, (a, b) in enumerate(piece_bounds(len(data) // 4, capacity)):
                    row = (doc_id, n, a, b - a, zlib.crc32(data[4 * a : 4 * b]))
                    rows.append((*row, np.frombuffer(data[4 * a : 4 * b], "<u4")) if with_ids else row)
            if rows:
                yield tuple(zip(*rows, strict=True))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return by_rows(picked(df, doc_id=id_col, text=text_col), run, schema + ", ids array<int>" * with_ids)


def plan_patterns(counts: Mapping[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths of a bin) that use up ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    at_most = np.empty(0)

    def refresh() -> None:
        nonlocal at_most
        at_most = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    def take(length: int, by: int = -1) -> None:
        had = left[length] > 0
        left[length] += by
        if had != (left[length] > 0):
            refresh()

    def fill(items: list[int], gap: int) -> int:
        while gap and (pick := int(at_most[gap])):
            items.append(pick)
            take(pick)
            gap -= pick
        return gap

    patterns = []
    refresh()
    while at_most[capacity]:
        items: list[int] = []
        gap = fill(items, capacity)
        while gap:
            least = min(items)
            room = gap + least
            x = np.flatnonzero(left[: room + 1] > 0)
            y = at_most[room - x]
            # A length that is its own partner must be there twice.
            twice = (y == x) & (left[x] < 2)
            lower = np.where(x > 0, at_most[np.maximum(x - 1, 0)], 0)
            y = np.where(twice, lower, y)
            sums = np.where(y > 0, x + y, 0)
            if not len(sums) or sums.max() <= least:
                break
            best = int(sums.argmax())
            items.remove(least)
            take(least, 1)
            for pick in (int(x[best]), int(y[best])):
                items.append(pick)
                take(pick)
            gap = room - int(sums[best])
        need = np.bincount(items, minlength=capacity + 1)
        used = need > 0
        again = int((left[used] // need[used]).min())
        left[used] -= again * need[used]
        refresh()
        patterns.append((again + 1, items))
    return patterns


def place_table(patterns: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """For runs of ranks within a length: the first sequence, pieces a sequence, and where their offsets lie."""
    rows, offsets = [], []
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for times, items in patterns:
        at: dict[int, list[int]] = {}
        place = 0
        for length in sorted(items, reverse=True):
            at.setdefault(length, []).append(place)
            place += length
        for length, places in at.items():
            rows.append((length, used[length], sequence, len(places), len(offsets)))
            offsets += places
            used[length] += times * len(places)
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    names = ("length", "rank", "sequence", "each", "offsets")
    return {n: table[:, i] for i, n in enumerate(names)} | {"place": np.array(offsets, np.int64)}


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """The pieces of every row with ``sequence_id`` and ``offset``, their place in a sequence."""
    # Written first: dealing rows by ranges reads them twice, and texts are to be encoded once.
    pieces = durable(token_pieces(df, id_col, text_col, capacity, end, vocabulary, with_ids), "packing-pieces")
    order = ["doc_id", "piece", "ids_crc32"]
    ranged = sliced(pieces, ["length"], order)
    counts = {r["length"]: r["count"] for r in ranged.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = place_table(plan_patterns(counts, capacity), capacity)
    ranked = prefix_sum(ranged, ["length"], order, F.lit(1).cast("long"), "_rank", inclusive=False).drop(SLICE)
    columns = [c for c in ranked.columns if c != "_rank"]
    types = dict(ranked.dtypes)
    # Ranks of a length follow each other, so one sorted key holds length and rank.
    shift = np.int64(1) << 50
    keys = table["length"] * shift + table["rank"]

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for batch in batches:
            *kept, length, rank = batch
            length, rank = np.array(length, np.int64), np.array(rank, np.int64)
            row = np.searchsorted(keys, length * shift + rank, side="right") - 1
            k = rank - table["rank"][row]
            each = table["each"][row]
            yield (*kept, table["sequence"][row] + k // each, table["place"][table["offsets"][row] + k % each])

    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long"
    return by_rows(ranked.select(*columns, F.col("length").alias("_length"), "_rank"), run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pieces packed with their ids; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids")
    )
