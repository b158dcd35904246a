"""Alignment of the tokens of two tokenizers by an associative fragment monoid.

Both tokenizers cut the same bytes (a space and the text). Where a token of
either ends at one byte, the bytes are cut into groups; inside a group every
stretch between two token ends of any kind is one link, between the token of A
and the token of B that hold it. A ``Fragment`` describes a byte range by its
open prefix (tokens up to the first common end), what its closed groups add
up to, and its open suffix (tokens after the last common end). Joining the
suffix of one fragment with the prefix of the next closes one more group, and
joining is associative, so the ranges of a very long document are tokenised
and joined by different tasks, eight neighbours at a time, until one is left.

Single spaces between other characters end tokens of both vocabularies, which
is verified when they are loaded; ranges are tokenised between such places.
Documents up to ``LONG`` bytes are made of units between such places: a unit
is a closed fragment and is looked up in a table of units seen before.

Link counts are the number of documents that hold an id pair linked. Blocks of
some thousand documents count their pairs first, so what is shuffled is one
row per block and distinct pair; counts go back to the blocks the same way and
are summed there. No table of all pairs is broadcast or held by one task.

Null and empty texts, and texts whose tokens do not give back their bytes (a
text that holds U+2581), have no tokens: zeros and an empty digest. Repeated
rows, null ids included, count as documents of their own.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import by_rows, picked
from sightline.llm.tokens import SPACES, Encoder, kept
from sightline.session import durable

#: Bytes of a document beyond which its ranges are dealt out, and of such a range.
LONG = 1 << 16
RANGE = 1 << 15
#: Bytes of text whose pairs are counted together.
BLOCK = 8 << 20
FAN_IN = 8
#: Units kept per Python worker; beyond it the table is emptied and filled anew.
KEPT_UNITS = 150_000
PIECES = "piece_bpe_32k.model"
SPACE = "▁"
ALONE = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """Ids and token bytes of both tokenizers; special strings are plain text."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.special = []
        self.a.whole.encode_special_tokens = True
        self.a_bytes = {i: t for t, i in self.a.ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(PIECES))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("a piece goes on across a space or a line end")
        self.b_space = self.b.piece_to_id(SPACE)

    def ids(self, raw: str) -> tuple[Sequence[int], Sequence[int]]:
        """Ids of a stretch that begins with a space, or with a line end after another character."""
        a = array("I")
        a.frombytes(self.a.encode(raw))
        if raw == " ":
            return a, [self.b_space]
        return a, self.b.encode(raw[1:]) if raw[0] == " " else self.b.encode(raw)[1:]

    def ends(self, raw: str) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """A ids, A ends, B ids, B ends; None if the tokens do not give back the bytes."""
        a, b = self.ids(raw)
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        data = raw.encode("utf-8", "replace")
        if b"".join(a_parts) != data or b"".join(b_parts) != data:
            return None
        return list(a), _running(a_parts), list(b), _running(b_parts)


def _running(parts: list[bytes]) -> list[int]:
    total, out = 0, []
    for p in parts:
        total += len(p)
        out.append(total)
    return out


def closed_groups(
    a: Sequence[int], a_ends: Sequence[int], b: Sequence[int], b_ends: Sequence[int]
) -> tuple[bytes, list[int], int]:
    """Text of the groups of a closed stretch, its links as (A id << 32 | B id), and the number of groups."""
    texts, links = [], []
    i = j = from_a = from_b = 0
    while i < len(a):
        links.append(a[i] << 32 | b[j])
        x, y = a_ends[i], b_ends[j]
        i += x <= y
        j += y <= x
        if x == y:
            texts.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
            from_a, from_b = i, j
    return ";".join(texts).encode(), links, len(texts)


# The monoid


@dataclass
class Tokens:
    """Tokens of an open part, with their ends in the document."""

    a: list[int] = field(default_factory=list)
    a_ends: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    b_ends: list[int] = field(default_factory=list)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(self.a + other.a, self.a_ends + other.a_ends, self.b + other.b, self.b_ends + other.b_ends)


@dataclass
class Fragment:
    """A byte range: open prefix, closed groups, open suffix. Without a common end all is prefix."""

    ok: bool = True
    cut: bool = False
    prefix: Tokens = field(default_factory=Tokens)
    text: bytes = b""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    suffix: Tokens = field(default_factory=Tokens)

    def __add__(self, other: Fragment) -> Fragment:
        ok = self.ok and other.ok
        if not self.cut:
            return Fragment(ok, other.cut, self.prefix + other.prefix, *other._closed(), other.suffix)
        if not other.cut:
            return Fragment(ok, True, self.prefix, *self._closed(), self.suffix + other.prefix)
        between = closed(self.suffix + other.prefix)
        parts = [self._closed(), between._closed(), other._closed()]
        return Fragment(ok, True, self.prefix, *_summed(parts), other.suffix)

    def _closed(self) -> tuple:
        return self.text, self.n_a, self.n_b, self.n_groups, self.keys, self.times


def _summed(parts: list[tuple]) -> tuple:
    texts, n_a, n_b, n_groups, keys, times = zip(*parts, strict=True)
    some, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate(times), len(some)).astype(np.int64)
    return b";".join(t for t in texts if t), sum(n_a), sum(n_b), sum(n_groups), some, total


def closed(tokens: Tokens) -> Fragment:
    """What a stretch between two common ends adds up to."""
    text, links, groups = closed_groups(tokens.a, tokens.a_ends, tokens.b, tokens.b_ends)
    keys, times = np.unique(np.array(links, np.int64), return_counts=True)
    return Fragment(True, True, Tokens(), text, len(tokens.a), len(tokens.b), groups, keys, times, Tokens())


def fragment(tokens: Tokens) -> Fragment:
    """The fragment of a range that holds the ends of these tokens."""
    both = sorted(set(tokens.a_ends) & set(tokens.b_ends))
    if not both:
        return Fragment(prefix=tokens)
    first, last = both[0] + 1, both[-1] + 1
    p, q = bisect_left(tokens.a_ends, first), bisect_left(tokens.b_ends, first)
    r, s = bisect_left(tokens.a_ends, last), bisect_left(tokens.b_ends, last)

    def part(i: int | None, j: int | None, k: int | None, m: int | None) -> Tokens:
        return Tokens(tokens.a[i:j], tokens.a_ends[i:j], tokens.b[k:m], tokens.b_ends[k:m])

    inner = closed(part(p, r, q, s))
    return Fragment(True, True, part(0, p, 0, q), *inner._closed(), part(r, None, s, None))


def whole(found: Fragment) -> Fragment:
    """The fragment of a whole document: its beginning counts as a common end."""
    return Fragment(cut=True) + found


# Documents made of units


class Units:
    """Numbers of units; what is known of them lies in growing arrays."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        a, b = tokenizers.a_bytes, tokenizers.b_bytes
        self.a_size, self.b_size = max(a) + 1, len(b)
        self.a_lengths = np.array([len(a.get(i, b"")) for i in range(self.a_size)], np.int64)
        self.b_lengths = np.array([len(x) for x in b], np.int64)
        # Ids as text, first as they stand inside a group's list, then as they end it.
        self.words = [
            b"%d%s" % (i, mark)
            for n, marks in ((self.a_size, (b",", b"|")), (self.b_size, (b",", b";"))) for mark in marks for i in range(n)
        ]
        self.empty()

    def empty(self) -> None:
        self.numbers: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.pairs: dict[int, int] = {}
        self.keys = array("q")
        self.n_a, self.n_b, self.n_groups, self.bad, self.links, self.offsets = (
            array("q"), array("q"), array("q"), array("b"), array("q"), array("q", [0])
        )

    def learn(self, units: list[str]) -> None:
        """Tokenise and align many new units at once; their byte ranges follow each other."""
        t = self.tokenizers
        raws = [u if u[:1] in ("\n", " ") else " " + u for u in units]
        a_ids = [t.a.encode(u) if u[:1] == " " else t.a.encode_chunk(u) for u in units]
        b_ids = t.b.encode([r[1:] if r[0] == " " else r for r in raws], num_threads=1)
        b_ids = [[t.b_space] if r == " " else i if r[0] == " " else i[1:] for r, i in zip(raws, b_ids, strict=True)]
        bad = []
        for at, (raw, x, y) in enumerate(zip(raws, a_ids, b_ids, strict=True)):
            data = raw.encode("utf-8", "replace")
            same = b"".join([t.a_bytes[i] for i in array("I", x)]) == data and b"".join([t.b_bytes[i] for i in y]) == data
            bad.append(not same)
            if not same:
                a_ids[at], b_ids[at] = b"", []
        a = np.frombuffer(b"".join(a_ids), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64)
        n_a, n_b = np.array([len(x) // 4 for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        ends = np.union1d(a_ends, b_ends)
        i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        cuts = ends[(a_ends[i] == ends) & (b_ends[j] == ends)] if len(ends) else ends
        owner = np.repeat(np.arange(len(units)), n_a)
        keys, which = np.unique(a[i] << 32 | b[j], return_inverse=True)
        numbers = np.array([self.pairs.setdefault(k, len(self.pairs)) for k in keys.tolist()], np.int64)
        new = numbers >= len(self.keys)
        self.keys.extend(keys[new].tolist())
        if len(which):
            self.links.frombytes(numbers[which].tobytes())
        size = len(units)
        self.offsets.extend((self.offsets[-1] + np.cumsum(np.bincount(owner[i], minlength=size))).tolist())
        self.n_a.extend(n_a.tolist())
        self.n_b.extend(n_b.tolist())
        self.n_groups.extend(np.bincount(owner[np.searchsorted(a_ends, cuts)], minlength=size).tolist())
        self.bad.extend(bad)
        of_a, of_b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        last_a, last_b = cuts[of_a] == a_ends, cuts[of_b] == b_ends
        codes = np.concatenate([a + last_a * self.a_size, 2 * self.a_size + b + last_b * self.b_size])
        codes = codes[np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")].tolist()
        words = list(map(self.words.__getitem__, codes))
        first = len(self.texts)
        stops = np.cumsum(n_a + n_b).tolist()
        self.texts += [b"".join(words[p:q]) for p, q in zip([0, *stops[:-1]], stops, strict=True)]
        self.numbers.update(zip(units, range(first, first + size), strict=True))


def units_of(text: str) -> list[str]:
    """Units of a text: none has a single space inside; those that begin with a line end have no space before."""
    if text[0].isspace() or SPACES.search(text):
        first, *rest = ALONE.split(text)
        # A unit that begins with white space of its own keeps the space before it.
        return [" " + first if first[:1].isspace() else first, *rest]
    return text.replace("\n", " \n").split(" ")


def _packed(positions: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending positions and their counts, compressed."""
    steps = np.diff(positions, prepend=0).astype("<u4")
    data = steps.tobytes() + times.astype("<u4").tobytes()
    return bytes(pa.compress(len(steps).to_bytes(4, "little") + data, codec="zstd", asbytes=True)) if len(steps) else b""


def _unpacked(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = pa.decompress(blob, 4 + 8 * size, codec="zstd", asbytes=True)
    steps, times = np.frombuffer(data, "<u4", size, 4), np.frombuffer(data, "<u4", size, 4 + 4 * size)
    return np.cumsum(steps, dtype=np.int64), times.astype(np.int64)


#: A block row holds the distinct pairs of a block; its document rows hold positions among them.
_ROWS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, "
    "pairs binary, keys array<long>, documents array<long>"
)


def _block(units: Units, block: int, ids: list, texts: list[str | None]) -> Iterator[tuple]:
    """Document rows of a block, then its block row."""
    parts = [units_of(t) if t else [] for t in texts]
    for at in range(0, len(parts), 256):
        new = set().union(*parts[at : at + 256]).difference(units.numbers)
        if new:
            units.learn(sorted(new))
    numbers = [np.fromiter(map(units.numbers.__getitem__, p), np.int64, len(p)) for p in parts]
    n_a, n_b, n_groups, bad, links, offsets, keys = (
        np.array(x) for x in (units.n_a, units.n_b, units.n_groups, units.bad, units.links, units.offsets, units.keys)
    )
    found, digests, sums = [], [], []
    for mine in numbers:
        if not len(mine) or bad[mine].any():
            digests.append("")
            sums.append((0, 0, 0))
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        digests.append(hashlib.sha256(b"".join([units.texts[u] for u in mine.tolist()])[:-1]).hexdigest())
        sums.append((int(n_a[mine].sum()), int(n_b[mine].sum()), int(n_groups[mine].sum())))
        some, times = np.unique(mine, return_counts=True)
        sizes = offsets[some + 1] - offsets[some]
        at = np.repeat(offsets[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        pairs = links[at]
        there, where = np.unique(pairs, return_inverse=True)
        found.append((there, np.bincount(where, np.repeat(times, sizes)).astype(np.int64)))
    documents = np.bincount(np.concatenate([p for p, _ in found]), minlength=len(keys)) if found else np.zeros(0, np.int64)
    used = np.flatnonzero(documents)
    place = np.cumsum(documents > 0) - 1
    yield (
        [block] * len(ids), ids, *zip(*sums, strict=True), [a + b - g for a, b, g in sums], digests,
        [len(p) for p, _ in found], [_packed(place[p], n) for p, n in found], [None] * len(ids), [None] * len(ids),
    )
    if len(used):
        yield ([block], *[[None]] * 8, [keys[used]], [documents[used]])


def _short(rows: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    def run(batches: Iterator[list]) -> Iterator[tuple]:
        tokenizers = _tokenizers(a_path, b_path)
        units = kept(f"alignment units {a_path} {b_path}", lambda: Units(tokenizers))
        block = TaskContext.get().partitionId() << 24
        for ids, texts in batches:
            start = size = 0
            for at, text in enumerate(texts):
                size += len(text or "")
                if size > BLOCK or at + 1 == len(texts):
                    if len(units.texts) > KEPT_UNITS:
                        units.empty()
                    yield from _block(units, block, ids[start : at + 1], texts[start : at + 1])
                    block, start, size = block + 1, at + 1, 0

    return by_rows(rows, run, _ROWS)


def _tokenizers(a_path: str | None, b_path: str | None) -> Tokenizers:
    return kept(f"alignment {a_path} {b_path}", lambda: Tokenizers(a_path, b_path))


# Very long documents


def segments(text: str, size: int) -> Iterator[tuple[int, int, str]]:
    """(start byte in space and text, number, stretch) between single spaces about ``size`` bytes apart."""
    raw = " " + text
    start = begin = number = 0
    while start < len(raw):
        cut = ALONE.search(raw, start + size)
        end = cut.start() if cut else len(raw)
        stretch = raw[start:end]
        yield begin, number, stretch
        begin += len(stretch.encode("utf-8", "replace"))
        start, number = end, number + 1


def ranged_fragments(tokenizers: Tokenizers, begin: int, stretch: str, size: int) -> list[Fragment]:
    """Fragments of the byte ranges, multiples of ``size``, that a stretch has a part of."""
    found = tokenizers.ends(stretch)
    if found is None:
        return [Fragment(ok=False)]
    a, a_ends, b, b_ends = found
    a_ends, b_ends = [begin + e for e in a_ends], [begin + e for e in b_ends]
    out = []
    for low in range(begin // size * size, a_ends[-1], size):
        i, j = bisect_left(a_ends, low + 1), bisect_left(a_ends, low + size + 1)
        k, m = bisect_left(b_ends, low + 1), bisect_left(b_ends, low + size + 1)
        out.append(fragment(Tokens(a[i:j], a_ends[i:j], b[k:m], b_ends[k:m])))
    return out


_PART = "struct<a: array<int>, a_ends: array<bigint>, b: array<int>, b_ends: array<bigint>>"
_FRAGMENT = (
    f"_row long, number long, ok boolean, cut boolean, prefix {_PART}, text binary, n_a long, n_b long, n_groups long, "
    f"keys array<long>, times array<long>, suffix {_PART}"
)


def _to_row(f: Fragment) -> tuple:
    return (
        f.ok, f.cut, vars(f.prefix), f.text, f.n_a, f.n_b, f.n_groups, f.keys.tolist(), f.times.tolist(), vars(f.suffix)
    )


def _from_row(row: Sequence) -> Fragment:
    ok, cut, prefix, text, n_a, n_b, n_groups, keys, times, suffix = row
    return Fragment(
        ok, cut, Tokens(**prefix), text, n_a, n_b, n_groups, np.array(keys, np.int64), np.array(times, np.int64), Tokens(**suffix)
    )


def _joined(parts: DataFrame, fan_in: int) -> DataFrame:
    """Neighbouring fragments of a document joined, ``fan_in`` at a time; a group never holds more."""
    names, schema = parts.columns, parts.schema

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        total = reduce(Fragment.__add__, [_from_row([r[n] for n in names[2:]]) for r in rows])
        values = [rows[0]["_row"], rows[0]["number"] // fan_in, *_to_row(total)]
        return pa.table({n: pa.array([v], table.schema.field(n).type) for n, v in zip(names, values, strict=True)})

    keyed = parts.withColumn("_group", F.floor(F.col("number") / fan_in))
    return keyed.groupBy("_row", "_group").applyInArrow(run, schema)


def _long(rows: DataFrame, a_path: str | None, b_path: str | None, size: int, fan_in: int) -> DataFrame:
    """Document and block rows of very long documents; each is a block of its own."""
    held = durable(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "alignment-long")

    def cut(batches: Iterator[list]) -> Iterator[tuple]:
        for keys, texts in batches:
            for key, text in zip(keys, texts, strict=True):
                for begin, number, stretch in segments(text, size):
                    yield [key], [begin], [number], [stretch]

    def fragments(batches: Iterator[list]) -> Iterator[tuple]:
        tokenizers = _tokenizers(a_path, b_path)
        for keys, begins, numbers, stretches in batches:
            for key, begin, number, stretch in zip(keys, begins, numbers, stretches, strict=True):
                # The parts of a stretch are joined where they are made; others meet in the rounds below.
                total = reduce(Fragment.__add__, ranged_fragments(tokenizers, begin, stretch, size))
                yield tuple([x] for x in (key, number, *_to_row(total)))

    pieces = by_rows(held.select("_row", "text"), cut, "_row long, begin long, number long, stretch string")
    parts = durable(by_rows(pieces.repartition("_row", "number"), fragments, _FRAGMENT), "alignment-fragments")
    most = parts.agg(F.max("number")).first()[0] or 0
    while most:
        parts, most = durable(_joined(parts, fan_in), "alignment-fragments"), most // fan_in

    def finish(batches: Iterator[list]) -> Iterator[tuple]:
        for doc_ids, keys, _, *columns in batches:
            for doc_id, key, *row in zip(doc_ids, keys, *columns, strict=True):
                f = whole(_from_row(row))
                if not f.ok:
                    f = Fragment()
                digest = hashlib.sha256(f.text).hexdigest() if f.ok and f.n_a else ""
                blob = _packed(np.arange(len(f.keys)), f.times)
                yield tuple([x] for x in (
                    -1 - key, doc_id, f.n_a, f.n_b, f.n_groups, f.n_a + f.n_b - f.n_groups, digest, len(f.keys), blob, None, None
                ))
                if len(f.keys):
                    yield ([-1 - key], *[[None]] * 8, [f.keys], [np.ones(len(f.keys), np.int64)])

    named = held.select("_row", "doc_id").join(parts, "_row")
    return by_rows(named.select("doc_id", "_row", *parts.columns[1:]), finish, _ROWS)


# Operators


def aligned_blocks(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
    long: int = LONG, size: int = RANGE, fan_in: int = FAN_IN,
) -> DataFrame:
    """Document rows and block rows of every text, as a written table."""
    rows = picked(df, doc_id=id_col, text=text_col)
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    return durable(
        _short(rows.where(~is_long), a_path, b_path).union(_long(rows.where(is_long), a_path, b_path, size, fan_in)),
        "alignment-blocks",
    )


def link_counts(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, n_documents, is_best) of every linked id pair; ties for the best of an A id all count."""
    pairs = blocks.where("keys IS NOT NULL").select(F.inline(F.arrays_zip("keys", "documents")).alias("key", "n"))
    counts = pairs.groupBy("key").agg(F.sum("n").alias("n_documents"))
    split = counts.select(
        F.shiftright("key", 32).cast("int").alias("a_id"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"),
        "n_documents", "key",
    )
    # A window of one A id holds at most as many rows as B has ids.
    most = F.max("n_documents").over(Window.partitionBy("a_id"))
    return split.withColumn("is_best", F.col("n_documents") == most)


def align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
    long: int = LONG, size: int = RANGE, fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``df``."""
    blocks = aligned_blocks(df, id_col, text_col, a_path, b_path, long, size, fan_in)
    counts = durable(link_counts(blocks).select("key", "n_documents", "is_best"), "alignment-counts")
    wanted = blocks.where("keys IS NOT NULL").select("block", F.posexplode("keys").alias("position", "key"))
    known = wanted.join(counts, "key").select("block", "position", "n_documents", "is_best")
    documents = blocks.where("keys IS NULL").drop("keys", "documents").withColumn("block", F.col("block") + 0)
    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # Positions of a block are dense, so its rows of the other side are all it has pairs.
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["position"].to_numpy()
        count[at], best[at] = right["n_documents"].to_numpy(), right["is_best"].to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for blob, size in zip(left["pairs"].to_pylist(), left["n_pairs"].to_pylist(), strict=True):
            places, times = _unpacked(blob, size) if size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            n_best.append(int((times * best[places]).sum()))
            count_sum.append(int((times * count[places]).sum()))
        return pa.table({
            **{n: left[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
            "groups_sha256": left["groups_sha256"],
        })

    return documents.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """(doc_id, groups) with start and end byte in space and text, A ids and B ids of every group of every row."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        tokenizers = _tokenizers(a_path, b_path)
        for ids, texts in batches:
            yield ids, [_spans(tokenizers, t) if t else [] for t in texts]

    kind = "array<struct<start: bigint, end: bigint, a_ids: array<int>, b_ids: array<int>>>"
    return by_rows(picked(df, doc_id=id_col, text=text_col), run, f"doc_id long, groups {kind}")


def _spans(tokenizers: Tokenizers, text: str) -> list[dict]:
    out = []
    for begin, _, stretch in segments(text, RANGE):
        found = tokenizers.ends(stretch)
        if found is None:
            return []
        a, a_ends, b, b_ends = found
        i = j = low = 0
        for end in sorted(set(a_ends) & set(b_ends)):
            p, q = bisect_left(a_ends, end + 1), bisect_left(b_ends, end + 1)
            out.append({"start": begin + low, "end": begin + end, "a_ids": a[i:p], "b_ids": list(b[j:q])})
            i, j, low = p, q, end
    return out
