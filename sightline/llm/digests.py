"""Document fingerprints: quartile digests of hashed byte triplets.

Every window of a text contributes its byte triplets, hashed into buckets. The
digest holds, for each bucket, the quartile its count falls in (two bits) and
one byte for the length. Two digests are compared by the sum of quartile
differences plus a bounded length difference; the sum is divided by what two
unrelated digests with the same code frequencies would differ by, so sparse
digests of short texts are not alike by their empty buckets.

Nulls count as empty texts. The digest of an empty text has only zero codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import by_rows, picked

BUCKETS = 512
#: Byte positions of the triplets inside a window.
TRIPLETS = ((0, 5, 14), (0, 11, 23))
WINDOW = 24
BLOCK = 1 << 20
LENGTH_STEPS = 24
#: Share of the whole difference that a length ratio of 8 or more makes.
LENGTH_SHARE = 0.1


def bucket_counts(text: str) -> np.ndarray:
    """Counts of hashed byte triplets; a text shorter than a window is padded with zero bytes."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    if not len(data):
        return counts
    if len(data) < WINDOW:
        data = np.concatenate([data, np.zeros(WINDOW - len(data), np.uint8)])
    for start in range(0, len(data) - WINDOW + 1, BLOCK):
        part = data[start : start + BLOCK + WINDOW - 1].astype(np.uint32)
        n = len(part) - WINDOW + 1
        for salt, (i, j, k) in enumerate(TRIPLETS, 1):
            h = part[i : i + n] | part[j : j + n] << 8 | part[k : k + n] << 16
            h |= np.uint32(salt << 24)
            h *= np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            counts += np.bincount(h >> np.uint32(23), minlength=BUCKETS)
    return counts


def quartile_codes(counts: np.ndarray) -> np.ndarray:
    """0 to 3 for each bucket: how many quartiles of all counts lie below its count."""
    at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    low, mid, high = np.partition(counts, at)[at]
    return (counts > low).astype(np.int8) + (counts > mid) + (counts > high)


def length_code(n_bytes: int) -> int:
    return min(255, int(8 * np.log2(1 + n_bytes)))


def digest(text: str) -> tuple[int, np.ndarray]:
    return length_code(len(text.encode("utf-8", "replace"))), quartile_codes(bucket_counts(text))


def to_hex(length: int, codes: np.ndarray) -> str:
    quads = codes.reshape(-1, 4).astype(np.uint8)
    packed = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
    return f"{length:02x}" + packed.tobytes().hex()


def from_hex(text: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
    return int(text[:2], 16), np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], 1).ravel().astype(np.int8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 for equal digests, 0 for a difference of at least what unrelated digests show."""
    difference = float(np.abs(a[1] - b[1]).sum())
    na, nb = np.bincount(a[1], minlength=4), np.bincount(b[1], minlength=4)
    levels = np.arange(4)
    unrelated = float(na @ np.abs(levels[:, None] - levels) @ nb) / len(a[1])
    apart = min(abs(a[0] - b[0]), LENGTH_STEPS) / LENGTH_STEPS * LENGTH_SHARE
    if unrelated == 0:
        return 1.0 - apart
    return max(0.0, 1.0 - min(1.0, difference / unrelated) - apart)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for ids, texts in batches:
            yield ids, [to_hex(*digest(t or "")) for t in texts]

    return by_rows(picked(df, doc_id=id_col, text=text_col), run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the opening of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    The edited text borrows from the next document in ascending id order (rows
    that share an id are ordered by text, null ids come first, the last row is
    followed by the first). Rows are dealt by slices of the id range; each
    slice also gets a copy of the first row of the next one, so the texts are
    shuffled once and no task holds more than its slices.
    """
    spark = df.sparkSession
    docs = picked(df, doc_id=id_col, text=text_col).withColumn(
        "_at", F.coalesce("doc_id", F.lit(-(2**63)))
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = np.linspace(0, 1, 8 * parts + 1)[1:-1].tolist()
    bounds = sorted(set(docs.select("doc_id").approxQuantile("doc_id", steps, 0.25 / (8 * parts))))
    cuts = np.array(bounds, np.float64)

    @F.pandas_udf("int")
    def slice_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(np.float64), side="right").astype(np.int32))

    docs = docs.withColumn("_slice", slice_of("_at"))
    # One row per slice, as many as there are cuts at most.
    first = docs.groupBy("_slice").agg(F.min("_at").alias("_at"))
    order = Window.partitionBy(F.lit(0)).orderBy("_slice")
    before = first.select(
        "_at",
        F.coalesce(F.lag("_slice").over(order), F.max("_slice").over(Window.partitionBy(F.lit(0)))).alias("_slice"),
    )
    copies = docs.drop("_slice").join(F.broadcast(before), "_at").withColumn("_copy", F.lit(1))
    dealt = (
        docs.withColumn("_copy", F.lit(0))
        .unionByName(copies)
        .repartition(parts, "_slice")
        .sortWithinPartitions("_slice", "_copy", "_at", "text")
        .select("_slice", "_copy", "doc_id", "text")
    )

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        held = None
        for rows in batches:
            out: list[tuple] = []
            for at, copy, doc_id, text in zip(*rows, strict=True):
                text = text or ""
                here = (at, doc_id, text, digest(text))
                if held is not None and held[0] == at:
                    _, held_id, held_text, held_digest = held
                    edited = edited_text(held_text, text)
                    edited_digest = digest(edited)
                    out.append((
                        held_id, len(held_text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                        to_hex(*held_digest), to_hex(*edited_digest),
                        likeness(held_digest, edited_digest), likeness(held_digest, here[3]),
                    ))
                held = None if copy else here
            if out:
                yield tuple(zip(*out, strict=True))

    return by_rows(
        dealt, run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
