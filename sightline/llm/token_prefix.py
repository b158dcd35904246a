"""Exact token counts at every prefix of a text, by prefix dynamic programming.

Inside a piece (the unit the vocabulary never merges across) every prefix has
one last token: the token that ends there and is compatible with the last
token of the prefix before it, two tokens being compatible if their joined
bytes encode to just these two. So the count of a prefix is the count of the
prefix before its last token, plus one. Pieces of a text are chained with
their running totals; ends inside a run of white space, a contraction or a
special string, where a cut changes the pieces, are counted as the cut leaves
them. The table answers budget and truncation questions without encoding again.

Nulls count as empty texts: no tokens, an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import by_rows, picked
from sightline.llm.tokens import (
    OTHER, PATTERN, SPACES, Chunks, Encoder, chunk_text, encoder, is_plain, kept, split_chunks,
)

LIMIT = 512
CONTRACTIONS = ("'re", "'ve", "'ll")
RUNS = re.compile(r"\s+|\S+")
#: Pairs and prefixes kept per Python worker; beyond it a table is emptied and filled anew.
KEPT_PAIRS = 1_000_000
KEPT_PREFIXES = 1_000_000
SHARED_BYTES = 96


class PrefixCounter:
    def __init__(self, tokens: Encoder):
        self.tokens = tokens
        self.ranks = tokens.ranks
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pieces = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.states: dict[bytes, tuple[int, int]] = {}
        self.chunks = Chunks(self._chunk)

    def fits(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens encode to just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            joined = self.bytes_of[left] + self.bytes_of[right]
            known = self.pairs[key] = self.tokens.piece_ids(joined) == [left, right]
        return known

    def piece(self, text: str) -> list[int]:
        """Counts at every code point of a piece.

        What is known of a prefix, its last token and its count, is kept, so
        words that begin alike share their openings. Long pieces share nothing
        and are not kept.
        """
        data = text.encode("utf-8", "replace")
        if len(data) > SHARED_BYTES:
            return self._long_piece(text, data)
        states, get, fits = self.states, self.ranks.get, self.fits
        if len(states) > KEPT_PREFIXES:
            states.clear()
        known = len(data)
        while known and data[:known] not in states:
            known -= 1
        for end in range(known + 1, len(data) + 1):
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                token = get(data[start:end])
                if token is None:
                    continue
                if not start:
                    states[data[:end]] = (token, 1)
                    break
                last, count = states[data[:start]]
                if fits(last, token):
                    states[data[:end]] = (token, count + 1)
                    break
        if len(data) == len(text):
            return [states[data[:e]][1] for e in range(1, len(data) + 1)]
        ends = accumulate(len(c.encode("utf-8", "replace")) for c in text)
        return [states[data[:e]][1] for e in ends]

    def _long_piece(self, text: str, data: bytes) -> list[int]:
        get, fits, longest = self.ranks.get, self.fits, self.longest
        last, count = [-1], [0]
        for end in range(1, len(data) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = get(data[start:end])
                if token is not None and (not start or fits(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        ends = accumulate(len(c.encode("utf-8", "replace")) for c in text)
        return [count[e] for e in ends]

    def _split(self, text: str) -> list[str]:
        """Pieces of a text without white space but for a leading space."""
        if OTHER.search(text):
            spans = self.tokens.whole.pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in spans]
        return self.pieces.findall(text)

    def ordinary(self, text: str) -> list[int]:
        """Counts at every code point of a text whose special strings count as ordinary ones."""
        out: list[int] = []
        total, lead = 0, ""
        runs = RUNS.findall(text)
        for at, run in enumerate(runs):
            if run.isspace():
                counts = self.piece(run)
                out += [total + c for c in counts]
                if at + 1 < len(runs):
                    # The last character goes to what follows if it is a space, or stands alone.
                    lead = " " if run[-1] == " " else ""
                    total += counts[-2] if len(run) > 1 else 0
                    total += 0 if lead else self.piece(run[-1])[-1]
                continue
            if lead:
                out.pop()
            for piece in self._split(lead + run):
                counts = [1, 2, 1] if piece in CONTRACTIONS else self.piece(piece)
                out += [total + c for c in counts]
                total += counts[-1]
            lead = ""
        return out

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and is_plain(chunk):
            return array("I", self.piece(" " + chunk)).tobytes()
        return array("I", self.ordinary(chunk_text(chunk))).tobytes()

    def counts(self, text: str) -> np.ndarray:
        """Token count of every prefix, by code points: element k belongs to the first k + 1."""
        if not text:
            return np.zeros(0, np.int64)
        if self.tokens.has_special(text):
            return self._special(text)
        if SPACES.search(text):
            return np.array(self.ordinary(text), np.int64)
        first, *rest = split_chunks(text)
        parts = [array("I", self.ordinary(first)).tobytes(), *map(self.chunks.__getitem__, rest)]
        flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ends = np.cumsum(sizes)
        totals = np.where(sizes > 0, flat[ends - 1], 0)
        return flat + np.repeat(np.cumsum(totals) - totals, sizes)

    def _special(self, text: str) -> np.ndarray:
        """A special string is one token; a prefix that ends inside it has only ordinary ones."""
        parts, total = [], 0
        stops = re.split("(" + "|".join(map(re.escape, self.tokens.special)) + ")", text)
        for plain, mark in zip(stops[::2], [*stops[1::2], ""], strict=True):
            counts = np.array(self.ordinary(plain + mark[:-1]), np.int64) + total
            parts.append(counts)
            total = int(counts[len(plain) - 1]) if plain else total
            if mark:
                total += 1
                parts.append(np.array([total], np.int64))
        return np.concatenate(parts)


def counter(path: str | None) -> PrefixCounter:
    return kept(f"prefix counter {path}", lambda: PrefixCounter(encoder(path)))


def prefix_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, prefix_tokens): the token count of every prefix, by code points, as an array."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        count = counter(vocabulary).counts
        for ids, texts in batches:
            yield ids, [count(t or "") for t in texts]

    return by_rows(picked(df, doc_id=id_col, text=text_col), run, "doc_id long, prefix_tokens array<int>")


def tokens_in_prefix(table: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points, from the table of a text."""
    at = F.least(chars, F.size(table))
    return F.when(at <= 0, F.lit(0)).otherwise(F.element_at(table, F.greatest(at, F.lit(1))))


def longest_prefix(table: Column, budget: int | Column) -> Column:
    """Code points of the longest prefix within ``budget`` tokens."""
    ok = F.transform(table, lambda n, i: F.when(n <= budget, i + 1))
    return F.coalesce(F.array_max(ok), F.lit(0))


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_within) from the prefix table of every text.

    ``chars_within`` is the length in code points of the longest prefix within
    the limit.
    """

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        count = counter(vocabulary).counts
        for ids, texts in batches:
            rows = []
            for text in texts:
                table = count(text or "")
                n = int(table[-1]) if len(table) else 0
                within = np.flatnonzero(table <= limit)
                rows.append((
                    len((text or "").encode("utf-8", "replace")), n, n > limit, int(within[-1]) + 1 if len(within) else 0,
                ))
            yield ids, *(zip(*rows, strict=True) if rows else ([], [], [], []))

    return by_rows(
        picked(df, doc_id=id_col, text=text_col), run,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long",
    )
