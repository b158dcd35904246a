"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities of the pieces of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
by the forward algorithm; a text is scored by its words, since no piece
reaches across words. Piece probabilities are learned by expectation
maximisation over all segmentations of the words of labelled documents.
Letters outside the vocabulary are pieces of their own with a fixed small
probability.

At most ``TRAIN_ROWS`` labelled documents are used, chosen by a hash of their
ids; every whole text is scored. A null text and one without letters is
``und`` with score 1; so is every text if nothing could be learned, with score 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import bounded_sample, by_rows, picked

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
TRAIN_ROWS = 12_000
ROUNDS = 2
SMOOTHING = 0.1
#: Probability of a letter that the vocabulary does not have.
UNKNOWN = 1e-7
SEED = 9
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
RESCALE = 24
#: Longer words are scored one by one, with rescaling.
SHORT = 32
GROUP = 4096
TOGETHER = 256


def vocabulary_pieces(path: str | None = None) -> list[str]:
    """Pieces made of letters, with or without the mark of a word's start, of a public vocabulary."""
    import sentencepiece

    if not path:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == START or p.removeprefix(START).isalpha())


def words_of(text: str) -> list[str]:
    """Letter runs of a text in lower case."""
    return WORD.findall(text.lower())


class Lattice:
    """All segmentations of a word into pieces."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def edges(self, word: str) -> list[list[tuple[int, int]]]:
        """For every end, the (start, piece) that reach it; piece -1 is an unknown letter."""
        text = START + word
        get, longest = self.index.get, self.longest
        out: list[list[tuple[int, int]]] = [[]]
        for end in range(1, len(text) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                piece = get(text[start:end])
                if piece is not None:
                    here.append((start, piece))
            if not any(start == end - 1 for start, _ in here):
                here.append((end - 1, -1))
            out.append(here)
        return out


def log_likelihood(lattice: Lattice, table: np.ndarray, unknown: np.ndarray, word: str) -> np.ndarray:
    """Log probability of a word under every language: the forward sums over all segmentations.

    ``table`` holds the piece probabilities of all languages.
    """
    edges = lattice.edges(word)
    sums = [np.ones(len(unknown))]
    scale = 0.0
    for end in range(1, len(edges)):
        here = sum(sums[start] * (table[piece] if piece >= 0 else unknown) for start, piece in edges[end])
        sums.append(here)
        if end % RESCALE == 0 and 0 < (top := here.max()) < 1e-60:
            # All sums that are still read shrink alike.
            for at in range(max(0, end - lattice.longest), end + 1):
                sums[at] = sums[at] / top
            scale += np.log(top)
    return np.log(np.maximum(sums[-1], 1e-300)) + scale


def expected_counts(lattice: Lattice, probs: np.ndarray, word: str, weight: float, into: dict[int, float]) -> None:
    """Adds the expected uses of every piece in a word, over all segmentations."""
    edges = lattice.edges(word)
    n = len(edges) - 1
    price = lambda piece: float(probs[piece]) if piece >= 0 else UNKNOWN
    forward = [1.0] + [0.0] * n
    for end in range(1, n + 1):
        forward[end] = sum(forward[start] * price(p) for start, p in edges[end])
    if not forward[n] > 0:
        return
    backward = [0.0] * n + [1.0]
    for end in range(n, 0, -1):
        for start, piece in edges[end]:
            p = price(piece)
            backward[start] += backward[end] * p
            if piece >= 0:
                into[piece] = into.get(piece, 0.0) + weight * forward[start] * p * backward[end] / forward[n]


@dataclass
class LanguageModel:
    langs: list[str]
    prior: list[float]
    probs: np.ndarray  # languages x pieces
    vocabulary: str | None = None


def fit(docs: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS, vocabulary: str | None = None) -> LanguageModel:
    """Model from ``docs`` (doc_id, text, lang) where ``learn`` holds and lang is known."""
    known = bounded_sample(docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()), "doc_id", SEED, train_rows)

    def count(batches: Iterator[list]) -> Iterator[tuple]:
        seen: dict[str, Counter] = {}
        for texts, langs in batches:
            for text, lang in zip(texts, langs, strict=True):
                # Words longer than any are split for learning only.
                seen.setdefault(lang, Counter()).update(w[i : i + 60] for w in words_of(text) for i in range(0, len(w), 60))
        rows = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
        yield tuple(zip(*rows, strict=True)) if rows else ([], [], [])

    words = by_rows(known.select("text", "lang"), count, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).cache()
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    present = {r["lang"] for r in words.select("lang").distinct().collect()}
    langs = sorted(present)
    if not langs:
        return LanguageModel([], [], np.zeros((0, 0)), vocabulary)
    pieces = vocabulary_pieces(vocabulary)
    at = {lang: i for i, lang in enumerate(langs)}
    probs = np.full((len(langs), len(pieces)), 1 / len(pieces))
    for _ in range(ROUNDS):
        now = probs

        def expect(batches: Iterator[list], now: np.ndarray = now) -> Iterator[tuple]:
            lattice = Lattice(pieces)
            sums: dict[str, dict[int, float]] = {}
            for names, batch_words, counts in batches:
                for lang, word, n in zip(names, batch_words, counts, strict=True):
                    expected_counts(lattice, now[at[lang]], word, n, sums.setdefault(lang, {}))
            rows = [(lang, p, v) for lang, uses in sums.items() for p, v in uses.items()]
            yield tuple(zip(*rows, strict=True)) if rows else ([], [], [])

        uses = by_rows(words, expect, "lang string, piece int, uses double")
        fresh = np.full_like(probs, SMOOTHING)
        for r in uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect():  # languages x pieces at most
            fresh[at[r["lang"]], r["piece"]] += r["uses"]
        probs = fresh / fresh.sum(1, keepdims=True)
    words.unpersist()
    total = sum(shares[lang] for lang in langs)
    return LanguageModel(langs, [float(np.log(shares[lang] / total)) for lang in langs], probs, vocabulary)


def batch_log_likelihood(lattice: Lattice, table: np.ndarray, words: list[str]) -> np.ndarray:
    """``log_likelihood`` of words of one length together, without rescaling.

    ``table`` has a row per piece, then one for unknown letters and one of zeros.
    """
    unknown, none = len(table) - 2, len(table) - 1
    n = len(words[0]) + 1
    spans = [(a, b) for b in range(1, n + 1) for a in range(max(0, b - lattice.longest), b)]
    get = lattice.index.get
    found = np.array([[get(w[a:b], none) for a, b in spans] for w in (START + w for w in words)])
    sums = [np.ones((len(words), table.shape[1]))]
    column = 0
    for end in range(1, n + 1):
        total = np.zeros_like(sums[0])
        for start in range(max(0, end - lattice.longest), end):
            piece = found[:, column]
            if start == end - 1:
                piece = np.where(piece == none, unknown, piece)
            total += sums[start] * table[piece]
            column += 1
        sums.append(total)
    return np.log(np.maximum(sums[-1], 1e-300))


class Scorer:
    """Word scores of a model, kept between the texts of a task."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.lattice = Lattice(vocabulary_pieces(model.vocabulary))
        n = len(model.langs)
        self.table = np.concatenate([model.probs.T, np.full((1, n), UNKNOWN), np.zeros((1, n))]) if n else None
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, n))

    def learn(self, words: set[str]) -> None:
        """Scores of new words."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        at = len(self.rows)
        while at + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for length, group in by_length.items():
            for i in range(0, len(group), GROUP):
                part = group[i : i + GROUP]
                if length <= SHORT:
                    found = batch_log_likelihood(self.lattice, self.table, part)
                else:
                    found = np.array([log_likelihood(self.lattice, self.table[:-2], self.table[-2], w) for w in part])
                self.scores[at : at + len(part)] = found
                self.rows.update(zip(part, range(at, at + len(part)), strict=True))
                at += len(part)

    def predict(self, texts: list) -> list[tuple[str, float]]:
        """Language and score of every text."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            parts = [words_of(t or "") for t in texts[i : i + TOGETHER]]
            if self.model.langs:
                if len(self.rows) > KEPT_WORDS:
                    self.rows.clear()
                new = {w for words in parts for w in words if w not in self.rows}
                self.learn(new)
            out += map(self._decide, parts)
        return out

    def _decide(self, words: list[str]) -> tuple[str, float]:
        if not any(map(str.isalpha, words)):
            return UNDETERMINED, 1.0
        if not self.model.langs:
            return UNDETERMINED, 0.0
        found = self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        best = int((found.sum(0) + self.model.prior).argmax())
        # How surely single words are of that language, on average.
        odds = found + self.model.prior
        odds = np.exp(odds - odds.max(1, keepdims=True))
        return self.model.langs[best], float((odds[:, best] / odds.sum(1)).mean())


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and the mean posterior of single words for it."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        scorer = Scorer(model)
        for ids, texts in batches:
            yield ids, *(zip(*scorer.predict(texts), strict=True) if texts else ([], []))

    return by_rows(picked(df, doc_id=id_col, text=text_col), run, "doc_id long, lang_pred string, score double")
