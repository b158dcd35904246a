"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are linked at three or fewer differing bits. Cut into
two segments of 32 bits, such a pair differs in at most one bit of one of
them, so every fingerprint looks up, for both segments, the ball of 33 values
within one bit in a table keyed by (segment, value), and whole distances are
verified. Segment values shared by very many fingerprints get a second key
level: the other half is cut into two parts of 16 bits, and the same argument
holds there, so no group emits all its pairs.

Nulls count as empty texts; a text without words has fingerprint zero and is
linked like any other. Equal fingerprints are one representative each, so
copies never meet each other in a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import by_rows, picked
from sightline.operators.components import connected_components
from sightline.session import durable

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints sharing one segment value, beyond which the second key level is used.
CROWDED = 256


def simhash(text: str, words: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half the shingle hashes."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(parts) - words + 1].tolist()
        spans = zip(starts, ends[words - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans]
    return majority(hashes)


def majority(hashes: Sequence[int]) -> int:
    """The bits set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for ids, texts in batches:
            yield ids, np.array([simhash(t or "", words) for t in texts], np.uint64).view(np.int64)

    return by_rows(picked(df, doc_id=id_col, text=text_col), run, "doc_id long, fp long")


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, bits: int) -> Column:
    """The value itself and every value one bit away."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])


def _segments(fps: DataFrame) -> DataFrame:
    """One row per fingerprint and segment: its value and the other half."""
    return fps.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("segment"), _half(F.col("fp"), s).alias("value"), _half(F.col("fp"), 1 - s).alias("rest"))
            for s in (0, 1)
        ])).alias("x"),
    ).select("fp", "x.*")


def _parts(rows: DataFrame, ball: bool) -> DataFrame:
    """Second key level: both parts of 16 bits of ``rest``, with their balls if asked for."""
    low = F.col("rest").bitwiseAND(F.lit(0xFFFF))
    high = F.shiftright("rest", 16)
    keys = [(p, _ball(v, 16) if ball else F.array(v)) for p, v in ((0, low), (1, high))]

    def named(part: int):
        return lambda bits: F.struct(F.lit(part).alias("part"), bits.alias("bits"))

    listed = F.concat(*[F.transform(values, named(part)) for part, values in keys])
    return rows.select("fp", "segment", "crowd", F.explode(listed).alias("k")).select("fp", "segment", "crowd", "k.*")


def near_pairs(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: every pair of the distinct fingerprints ``fp`` that differ in at most three bits."""
    table = _segments(fps)
    sizes = table.groupBy("segment", "value").count()
    crowds = sizes.where(F.col("count") > crowded).select("segment", F.col("value").alias("crowd"))
    sparse = table.join(crowds.withColumnRenamed("crowd", "value"), ["segment", "value"], "left_anti")
    probes = table.select(F.col("fp").alias("a"), "segment", F.explode(_ball(F.col("value"), 32)).alias("value"))
    found = probes.join(sparse.select(F.col("fp").alias("b"), "segment", "value"), ["segment", "value"])
    # Crowded values: who can reach them is found from their own balls.
    reach = crowds.select("segment", "crowd", F.explode(_ball(F.col("crowd"), 32)).alias("value"))
    left = _parts(table.join(reach, ["segment", "value"]), ball=True).withColumnRenamed("fp", "a")
    right = _parts(
        table.join(crowds.withColumnRenamed("crowd", "value"), ["segment", "value"]).withColumn("crowd", F.col("value")),
        ball=False,
    ).withColumnRenamed("fp", "b")
    dense = left.join(right, ["segment", "crowd", "part", "bits"])
    ok = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    both = found.where(ok).select("a", "b").union(dense.where(ok).select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, crowded: int = CROWDED
) -> DataFrame:
    """(doc_id, fingerprint, component_id, links) of every row.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included (null ids never win over others). ``links`` is the number of other
    distinct fingerprints within reach. Repeated ids keep one row each.
    """
    fps = durable(fingerprints(df, id_col, text_col, words), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = durable(near_pairs(least.select("fp"), crowded), "simhash-pairs")
    parts = connected_components(pairs, "a", "b").withColumnRenamed("v", "fp")
    degree = (
        pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    )
    joined = parts.join(degree, "fp").join(least, "fp")
    group = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = joined.join(group, "component").select("fp", "component_id", "links")
    resolved = durable(
        least.join(linked, "fp", "left").select(
            "fp",
            F.coalesce("component_id", "least").alias("component_id"),
            F.coalesce("links", F.lit(0)).alias("links"),
        ),
        "simhash-groups",
    )
    return fps.join(resolved, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links"
    )


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of near copies: the pairs found here and those of a prefix filter, by shingle similarity (``near_copies``)."""
    from sightline.llm import near_copies  # which builds on this module

    return near_copies.one_per_group(df, id_col, text_col)
