"""Groups of near copies by the similarity of their shingle sets.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Links are found in two ways, and each is verified on
the whole sets:

1. Multi-index hashing of SimHash fingerprints (``simhash.near_pairs``): every
   pair within ``distance`` bits. At a similarity of 0.8 fingerprints differ
   in about 15 of 100 bits, so this finds the closest copies only.
2. An exact prefix filter for the others. With the shingles of all texts in
   one order, the rare ones first, two texts of n and m shingles can only be
   similar if the first n - least + 1 of one and m - least + 1 of the other
   meet, ``least`` being 0.8 of the larger number. What a pair can still share
   after the place of such a shingle, the ratio of the sizes, and the bits in
   which two parity sketches differ (at most the shingles not shared) settle
   most pairs in the join, wider sketches nearly all others before any set is
   read. No similar pair is lost.

Shingles that the same texts hold at their front are one key. The texts of a
key are not turned into all its pairs: two rounds compare them with the text
that has the fewest shingles of its own, and only texts which that leaves in
different groups, and which the three bounds leave possible, are compared with
each other. Which shingles count as frequent is taken from a bounded sample;
it decides their order, so the work done, and never which links are found.

Nulls count as empty texts; texts of fewer than five words are one shingle.
Equal texts, up to case and spaces, are one by a 64-bit hash of their words.
Columns of any name and type go through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import simhash
from sightline.llm.common import bounded_sample, by_rows, picked
from sightline.operators.components import connected_components
from sightline.session import durable

WORDS = 5
#: Similarity as a ratio of whole numbers.
SIMILAR = (4, 5)
SEED = 42
STAR_ROUNDS = 2
#: Documents from which the order of frequent shingles is taken, and the number of them that makes one frequent.
SAMPLE = 8_000
FREQUENT = 6
#: Bits of the parity sketch.
SKETCH = 256
#: Rows up to which the table of texts to be read again is sent to every executor; larger ones are shuffled.
SENT_ROWS = 300_000
#: Rows that are Python objects at once.
ROWS = 512
_BITS = [f"b{i}" for i in range(SKETCH // 64)]


def shingle_set(text: str, words: int = WORDS) -> tuple[int, np.ndarray]:
    """A hash of all words, and the sorted distinct hashes of the shingles."""
    parts = text.encode("utf-8", "replace").lower().split()
    joined = b" ".join(parts)
    whole = xxhash.xxh64_intdigest(joined, SEED + 1)
    if len(parts) <= words:
        return whole, np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    spans = zip(starts, ends[words - 1 :].tolist(), strict=True)
    return whole, np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit per hash value mod ``SKETCH``, set if an odd number of shingles falls on it."""
    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of two to four bits a shingle; a smaller one comes from it by adding its halves."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, at the size of the smaller one: at most the shingles not shared."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def places(hashes: np.ndarray, frequent: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles as numbers in the one order of all texts: rare before frequent, then by hash."""
    short = (hashes >> np.uint64(8)).astype(np.int64)
    if len(frequent):
        at = np.searchsorted(frequent, short).clip(max=len(frequent) - 1)
        short += np.where(frequent[at] == short, levels[at], 0).astype(np.int64) << 56
    return np.sort(short)


def prefix_length(size: int) -> int:
    """How many of the first shingles a text must be known by."""
    up, down = SIMILAR
    return size + (-size * up // down) + 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    up, down = SIMILAR
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * down >= (len(a) + len(b) - common) * up


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sampled documents and their level; at most ``SAMPLE`` documents are looked at."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for (texts,) in batches:
            for text in texts:
                yield ((shingle_set(text or "")[1] >> np.uint64(8)).astype(np.int64),)

    some = bounded_sample(rows.select("text", F.xxhash64("doc_id", "_r1").alias("_h")), "_h", SEED, SAMPLE)
    counts = by_rows(some.select("text"), run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).sort("token").toPandas()
    level = np.minimum(1 + np.log2(found["n"].to_numpy(float)), 126).astype(np.int64) if len(found) else np.zeros(0, np.int64)
    return found["token"].to_numpy(np.int64), level


def _hashed(df: DataFrame) -> list[Column]:
    """What is hashed of a row: a null is told from its neighbours by its place, maps count as their JSON."""
    cells = []
    for i, (name, kind) in enumerate(df.dtypes):
        cell = F.col(f"`{name}`")
        cells += [F.lit(i), F.to_json(F.struct(cell.alias("c"))) if "map<" in kind or kind == "variant" else cell]
    return cells


def _marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` as one column beside their id, text and two hashes of all they hold."""
    cells = _hashed(df)
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.lit(1), *cells).alias("_r1"), F.xxhash64(F.lit(2), *cells).alias("_r2"),
    )


def _signatures(rows: DataFrame, frequent: np.ndarray, levels: np.ndarray) -> DataFrame:
    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for ids, texts, r1, r2 in batches:
            keys, prints, sizes, sketches, fronts, own, wide = [], [], [], [], [], [], []
            for text in texts:
                whole, hashes = shingle_set(text or "")
                order = places(hashes, frequent, levels)
                keys.append(_signed(whole))
                prints.append(_signed(simhash.majority(hashes)))
                sizes.append(len(hashes))
                sketches.append(parity_sketch(hashes))
                wide.append(wide_sketch(hashes))
                fronts.append(order[: prefix_length(len(order))])
                own.append(int(np.searchsorted(order, 1 << 56)))
            bits = np.array(sketches, np.int64).reshape(-1, len(_BITS))
            yield ids, r1, r2, keys, prints, sizes, own, fronts, wide, *bits.T

    schema = "doc_id long, _r1 long, _r2 long, key long, fp long, n int, own int, front array<long>, wide binary, "
    return by_rows(rows, run, schema + ", ".join(f"{b} long" for b in _BITS), ROWS)


class _Texts:
    """Texts by their key, whose sets are made when a pair asks for them."""

    def __init__(self, texts: DataFrame, rows: DataFrame):
        self.texts, self.rows = texts, rows

    def sets(self, keys: DataFrame) -> DataFrame:
        def run(batches: Iterator[list]) -> Iterator[tuple]:
            for names, texts in batches:
                yield names, [shingle_set(t or "")[1].astype("<u8").tobytes() for t in texts]

        wanted = durable(self.texts.join(keys, "key", "left_semi").select("key", "best._r1", "best._r2"), "near-wanted")
        few = wanted.count() <= SENT_ROWS
        known = self.rows.join(F.broadcast(wanted) if few else wanted, ["_r1", "_r2"]).select("key", "text")
        return durable(by_rows(known, run, "key long, hashes binary", ROWS).dropDuplicates(["key"]), "near-sets")

    def screened(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their wide sketches leave possible; a sketch is a thirtieth of a set."""
        up, down = SIMILAR

        def run(batches: Iterator[list]) -> Iterator[tuple]:
            for a, b, n, m, of_a, of_b in batches:
                ok = [
                    i for i, (x, y) in enumerate(zip(of_a, of_b, strict=True))
                    if sketch_distance(x, y) * (down + up) <= (n[i] + m[i]) * (down - up)
                ]
                yield [a[i] for i in ok], [b[i] for i in ok]

        left = self.texts.select(F.col("key").alias("a"), F.col("n"), F.col("wide").alias("of_a"))
        right = self.texts.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("wide").alias("of_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "of_a", "of_b")
        return by_rows(both, run, "a long, b long", ROWS)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar."""

        def run(batches: Iterator[list]) -> Iterator[tuple]:
            for a, b, of_a, of_b in batches:
                ok = [
                    i for i, (x, y) in enumerate(zip(of_a, of_b, strict=True))
                    if similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))
                ]
                yield [a[i] for i in ok], [b[i] for i in ok]

        pairs = durable(self.screened(pairs.distinct()), "near-pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("of_a"))
        right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("of_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
        return durable(by_rows(both, run, "a long, b long", ROWS), "near-links")


def possible(a: str, b: str) -> Column:
    """Whether the sizes and sketches of two texts leave them a similarity of 0.8."""
    up, down = SIMILAR
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in _BITS[1:]),
                 F.bit_count(F.col(f"{a}.{_BITS[0]}").bitwiseXOR(F.col(f"{b}.{_BITS[0]}"))))
    # Of n + m shingles at least (down - up) / (down + up) may lie in one text only.
    return (n * down >= m * up) & (m * down >= n * up) & (differ * (down + up) <= (n + m) * (down - up))


def _in_reach(a: str, b: str) -> Column:
    """Whether two texts can be similar if this is the first shingle they share: only what follows counts."""
    up, down = SIMILAR
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.p"), F.col(f"{b}.n") - F.col(f"{b}.p"))
    return rest * (down + up) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * up


def _members(texts: DataFrame) -> DataFrame:
    """(token, key, p, n, own, bits) of every text at the front of which another one's shingle lies.

    ``p`` is the number of shingles before this one. Shingles with the same
    texts at whose front they lie keep their first.
    """
    fronts = texts.select("key", F.posexplode("front").alias("p", "token"))
    shared = fronts.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.bit_xor("key").alias("_x"))
    first = durable(
        shared.where("many > 1").groupBy("many", "_x").agg(F.min("token").alias("token")).select("token"), "near-tokens"
    )
    held = durable(fronts.join(first, "token"), "near-fronts")
    return durable(held.join(texts.select("key", "n", "own", *_BITS), "key"), "near-members")


def _placed(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Members with the component they are in, as ``c``."""
    if parts is None:
        return members.withColumn("c", F.col("key"))
    named = parts.select(F.col("v").alias("key"), F.col("component").alias("_c"))
    return members.join(named, "key", "left").withColumn("c", F.coalesce("_c", "key")).drop("_c")


def _links(members: DataFrame, texts: _Texts, close: DataFrame) -> DataFrame:
    """(v, component) of every text that is linked to another; ``close`` are pairs known otherwise."""
    found: list[DataFrame] = []
    parts = None

    def placed_in_open_keys() -> DataFrame:
        """The members of keys that lie in more than one component."""
        placed = durable(_placed(members, parts), "near-placed")
        apart = placed.groupBy("token").agg(F.min("c").alias("_l"), F.max("c").alias("_g")).where("_l <> _g").select("token")
        return durable(placed.join(apart, "token"), "near-open")

    columns = ["key", "p", "n", "own", "c", *_BITS]
    here = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & possible("x", "y") & _in_reach("x", "y")
    for turn in range(STAR_ROUNDS + 1):
        open_ = placed_in_open_keys()
        if turn < STAR_ROUNDS:
            # The text with the fewest shingles of its own stands in the middle of its near copies.
            rank = F.struct(F.xxhash64(F.lit(turn), "key").cast("double") if turn else F.col("own") / F.col("n"), "key")
            sides = open_.groupBy("token").agg(F.min_by(F.struct(*columns), rank).alias("x")).select("token", "x.*")
            joined = open_.alias("y").join(sides.alias("x"), here)
        else:
            joined = open_.alias("x").join(open_.alias("y"), here & (F.col("x.key") < F.col("y.key")))
        pairs = joined.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        found.append(texts.verified(pairs if turn else pairs.union(close)))
        if turn and found[-1].isEmpty():
            continue
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        parts = durable(connected_components(every, "a", "b"), "near-parts")
    return parts


def _close_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints lie within reach of multi-index hashing, equal ones through one of them."""
    least = durable(texts.groupBy("fp").agg(F.min("key").alias("key")), "near-prints")
    pairs = simhash.near_pairs(least.select("fp"))
    first, second = (least.select(F.col("fp").alias(x), F.col("key").alias(f"_{x}")) for x in ("a", "b"))
    across = pairs.join(first, "a").join(second, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = texts.select("fp", F.col("key").alias("b")).join(least.select("fp", F.col("key").alias("a")), "fp").where("a <> b")
    both = across.union(same.select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _filtered(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches leave possible."""
    slim = texts.select("key", "n", *_BITS)
    joined = pairs.join(slim.alias("x"), F.col("a") == F.col("x.key")).join(slim.alias("y"), F.col("b") == F.col("y.key"))
    return joined.where(possible("x", "y")).select("a", "b")


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` per group of near copies: the smallest id, null ids last, then the smallest hash of the row."""
    rows = _marked(df, id_col, text_col)
    slim = rows.select("doc_id", "text", "_r1", "_r2")
    marks = durable(_signatures(slim, *_frequent(slim)), "near-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_r1", "_r2")
    same = [F.first(c).alias(c) for c in ("fp", "n", "own", "front", "wide", *_BITS)]
    texts = durable(marks.groupBy("key").agg(F.min(order).alias("best"), *same), "near-texts")
    close = durable(_filtered(_close_pairs(texts), texts).distinct(), "near-close")
    parts = _links(_members(texts), _Texts(texts, slim), close).withColumnRenamed("v", "key")
    best = texts.join(parts, "key", "left").groupBy(F.coalesce("component", "key").alias("_c")).agg(F.min("best").alias("best"))
    keep = best.select("best._r1", "best._r2")
    # Rows alike in every column are one.
    kept = rows.join(keep, ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"])
    return kept.select("row.*")
