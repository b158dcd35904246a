"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch with smallest period q, at least ``MIN_WORDS`` words and
``MIN_TURNS`` periods long, that no neighbouring word extends. Every factor of
length 1, 2, 4, ... gets a name: equal factors, equal names; a factor is named
by the pair of its halves. Occurrences of a name that follow each other within
twice its length at equal distances are an arithmetic progression, and their
distance is a proposed period. A factor at least as long as the smallest
period of a run comes again in it after exactly that period, and the first
name of twice less than two periods is there three times in a run of four, so
every run is proposed. Proposals are extended word by word to both sides;
of proposals for one stretch the smallest period stays.

Names that occur fewer than three times are not carried to the next length,
so texts without repetitions cost one or two levels. Documents are named
together, some hundred thousand words at a time; a name never joins two of
them. Rows stay in their partition: nothing is shuffled.

Nulls count as empty texts: no run, four nulls, digests of nothing. A null id
counts as empty text where its crc32 is taken. Repeated rows give a row each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import by_rows

MIN_WORDS = 6
MIN_TURNS = 4
#: Words named together; a longer document is named alone.
TOGETHER = 1 << 17


class _Codes(dict):
    """Numbers for words, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _by_name(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their positions, those of a key ascending."""
    shift = max(size - 1, 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + shift > 62:
        order = np.argsort(keys, kind="stable")
        return keys[order], at[order]
    both = np.sort((keys << shift) | at)
    return both >> shift, both & ((1 << shift) - 1)


def progressions(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of three occurrences of a basic factor in arithmetic progression.

    Only the first of neighbouring positions with one distance is given.
    ``longest`` is the length of the longest document.
    """
    size = len(codes)
    name = np.full(size, -1, np.int64)
    keys, at, m = codes, np.arange(size, dtype=np.int64), 1
    starts, gaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at) >= 3:
        key, place = _by_name(keys, at, size)
        same = key[1:] == key[:-1]
        gap = place[1:] - place[:-1]
        thrice = same[1:] & same[:-1]
        found = np.flatnonzero(thrice & (gap[1:] == gap[:-1]) & (2 * gap[1:] > m) & (gap[1:] <= 2 * m))
        starts.append(place[found])
        gaps.append(gap[found])
        if 2 * m >= longest:
            break
        name[at] = -1
        often = np.zeros(len(key), bool)
        often[:-2] |= thrice
        often[1:-1] |= thrice
        often[2:] |= thrice
        number = np.concatenate([[0], np.cumsum(~same)])
        name[place[often]] = number[often]
        at = np.sort(place[often])
        at = at[: np.searchsorted(at, size - m)]
        at = at[name[at + m] >= 0]
        keys = name[at] * (int(number[-1]) + 1) + name[at + m]
        m *= 2
    start, gap = np.concatenate(starts), np.concatenate(gaps)
    order = np.lexsort((start, gap))
    start, gap = start[order], gap[order]
    first = np.ones(len(start), bool)
    first[1:] = (gap[1:] != gap[:-1]) | (start[1:] > start[:-1] + 1)
    return start[first], gap[first]


def _agree(codes: np.ndarray, at: int, gap: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around ``at`` in which every word equals the one ``gap`` further on."""
    right, step = at, 64
    while right + gap < high:
        end = min(right + step, high - gap)
        differ = np.flatnonzero(codes[right:end] != codes[right + gap : end + gap])
        if len(differ):
            right += int(differ[0])
            break
        right, step = end, 2 * step
    left, step = at, 64
    while left > low:
        end = max(left - step, low)
        differ = np.flatnonzero(codes[end:left] != codes[end + gap : left + gap])
        if len(differ):
            left = end + int(differ[-1]) + 1
            break
        left, step = end, 2 * step
    return left, right


def runs(documents: Sequence[Sequence[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start, then period."""
    table = _Codes()
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    codes = np.fromiter((c for d in documents for c in map(table.__getitem__, d)), np.int64, int(bounds[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not len(codes):
        return out
    owner = np.repeat(np.arange(len(documents), dtype=np.int64), np.diff(bounds))
    starts, gaps = progressions(codes + owner * len(table), int(np.diff(bounds).max()))
    best: dict[tuple[int, int], int] = {}
    done, upto = 0, -1
    for start, gap in zip(starts.tolist(), gaps.tolist(), strict=True):
        if gap == done and start < upto:
            continue
        d = int(owner[start])
        left, right = _agree(codes, start, gap, int(bounds[d]), int(bounds[d + 1]))
        done, upto = gap, right
        length = right - left + gap
        if length >= max(MIN_WORDS, MIN_TURNS * gap):
            key = (left, length)
            best[key] = min(gap, best.get(key, gap))
    for (left, length), gap in best.items():
        d = int(owner[left])
        out[d].append((left - int(bounds[d]), length, gap))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: Sequence[bytes], found: Sequence[tuple[int, int, int]]) -> bytes:
    """The words no run repeats, joined by one space."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def repeated_tail(words: list[bytes], key: bytes) -> list[bytes]:
    """One document in ten, chosen by the crc32 of its key, with a part of it repeated to its end."""
    h, n = zlib.crc32(key), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_tails: bool = False) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, its ``runs`` and the ``collapsed`` text.

    ``repeat_tails`` puts a repetition into a tenth of the documents first.
    """
    return _mapped(df, id_col, text_col, repeat_tails, _whole_row, _WHOLE)


def run_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_tails: bool = False) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text, per row of ``df``."""
    return _mapped(df, id_col, text_col, repeat_tails, _report_row, _REPORT)


_WHOLE = "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def _whole_row(doc_id: int | None, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    named = [{"start": s, "length": n, "period": p} for s, n, p in found]
    return doc_id, named, collapsed(words, found).decode("utf-8", "replace")


def _report_row(doc_id: int | None, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest(),
    )


def _mapped(df: DataFrame, id_col: str, text_col: str, repeat_tails: bool, row_of, schema: str) -> DataFrame:
    def rows(ids: list, documents: list[list[bytes]]) -> tuple:
        return tuple(zip(*map(row_of, ids, documents, runs(documents)), strict=True))

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for ids, texts in batches:
            some, held, size = [], [], 0
            for doc_id, text in zip(ids, texts, strict=True):
                # Without an argument bytes are split at just the six white-space characters meant.
                words = (text or b"").split()
                if repeat_tails:
                    words = repeated_tail(words, b"" if doc_id is None else b"%d" % doc_id)
                if size and size + len(words) > TOGETHER:
                    yield rows(some, held)
                    some, held, size = [], [], 0
                some.append(doc_id)
                held.append(words)
                size += len(words)
            if some:
                yield rows(some, held)

    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return by_rows(slim, run, schema)
