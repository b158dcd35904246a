"""Quality scores from compression with dictionaries of good and bad text.

Two zstandard dictionaries are built, one from windows of documents labelled
good, one from windows of documents labelled bad. A document is compressed
window by window with both; the difference of the compressed sizes, normalised
by the window and by their sum, is calibrated into a probability by a logistic
fit on other labelled rows, which also sees how far a window shrinks at all
(text that repeats itself shrinks with either dictionary) and how short the
text is.

Labels are learned from at most ``TRAIN_ROWS`` rows, chosen by a hash of their
ids; every whole text is scored. Nulls and empty texts have no windows and get
the score of a zero difference. Without labels of both kinds every score is
the share of good labels, or 0.5 without any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import bounded_sample, by_rows, logistic_fit, picked

WINDOW = 1024
DICTIONARY = 112 << 10
LEVEL = 3
#: Labelled rows used for the fit, half of them for the dictionaries.
TRAIN_ROWS = 16_000
#: Dictionary samples of each kind, one window each.
SAMPLES = 8_000
THRESHOLD = 0.3
#: Difference per byte: mean, largest; over the sum of sizes; windows clearly better with the bad dictionary; saturated
#: mean. Compressed share: mean, least. Shortness.
FEATURES = ("mean", "largest", "relative", "worse", "saturated", "size", "least_size", "short")
SEED = 5
PENALTY = 0.1


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]
    window: int = WINDOW
    level: int = LEVEL


def windows(text: str, size: int) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + size] for i in range(0, len(data), size)]


class Scorer:
    """Compressors of a model, made once per task."""

    def __init__(self, model: QualityModel):
        self.model = model
        plain = {"level": model.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.pair = []
        for data in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=model.level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=dictionary, **plain).compress)

    def features(self, text: str) -> tuple[float, ...]:
        """Normalised size differences and sizes of all windows, summed up as ``FEATURES`` says."""
        parts = windows(text, self.model.window)
        if not parts:
            return 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0
        good, bad = ([len(f(p)) for p in parts] for f in self.pair)
        g, b, n = (np.array(x, float) for x in (good, bad, [len(p) for p in parts]))
        per_byte = (g - b) / n
        # A short last window says little; it counts by its length.
        share = n / n.sum()
        size = np.minimum(1, g / n)
        return tuple(map(float, (
            share @ per_byte, (per_byte * np.minimum(1, n / self.model.window * 4)).max(), share @ ((g - b) / (g + b)),
            share @ (per_byte > 0.02), share @ np.tanh(20 * per_byte), share @ size, size.min(), np.exp(-n.sum() / 400),
        )))

    def score(self, text: str) -> float:
        w = self.model.weights
        return float(1 / (1 + np.exp(-np.clip(np.dot(w[:-1], self.features(text)) + w[-1], -30, 30))))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label) where ``learn`` holds."""
    known = bounded_sample(labels.where(learn & F.col("label").isin(0, 1)), "doc_id", SEED, train_rows)
    rows = docs.join(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
    half = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2))

    def sample_windows(batches: Iterator[list]) -> Iterator[tuple]:
        for ids, texts, marks in batches:
            out = []
            for doc_id, text, mark in zip(ids, texts, marks, strict=True):
                parts = windows(text or "", WINDOW)
                at = zlib.crc32(str(doc_id).encode())
                # Bad documents are fewer and give more windows.
                for k in range(min(len(parts), 1 if mark else 4)):
                    out.append((mark, at, parts[(at + k * 7) % len(parts)]))
            yield tuple(zip(*out, strict=True)) if out else ([], [], [])

    drawn = by_rows(rows.where(half == 0).select("doc_id", "text", "label"), sample_windows, "label int, at long, part binary")
    drawn = [(r["label"], r["at"], bytes(r["part"])) for r in drawn.collect()]  # at most 4 windows a training row
    sides = {}
    for mark in (0, 1):
        parts = [p for _, _, p in sorted(d for d in drawn if d[0] == mark)][:SAMPLES]
        if len(parts) < 8:
            counts = dict(rows.groupBy("label").count().collect())
            share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
            return QualityModel(b"", b"", [*[0.0] * len(FEATURES), _logit(share)])
        total = sum(map(len, parts))
        try:
            sides[mark] = zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 8)), parts).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: their text is the dictionary
            sides[mark] = b"".join(parts)[-DICTIONARY:]
    model = QualityModel(sides[1], sides[0], [])

    def measure(batches: Iterator[list]) -> Iterator[tuple]:
        scorer = Scorer(model)
        for texts, marks in batches:
            yield [scorer.features(t or "") for t in texts], marks

    found = by_rows(rows.where(half == 1).select("text", "label"), measure, "x array<double>, label int").collect()
    x, y = np.array([r["x"] for r in found]), np.array([r["label"] for r in found], float)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        model.weights = [-10.0, *[0.0] * (len(FEATURES) - 1), _logit(share)]
        return model
    # Fitted on a common scale, so the penalty treats all alike.
    centre, spread = x.mean(0), x.std(0) + 1e-9
    w = logistic_fit((x - centre) / spread, y, ridge=PENALTY)
    model.weights = [*(w[:-1] / spread), w[-1] - (w[:-1] * centre / spread).sum()]
    return model


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    if not model.good:
        constant = 1 / (1 + np.exp(-model.weights[-1]))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.lit(float(constant)).alias("score"))

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        scorer = Scorer(model)
        for ids, texts in batches:
            yield ids, [scorer.score(t or "") for t in texts]

    return by_rows(picked(df, doc_id=id_col, text=text_col), run, "doc_id long, score double")


def kept_rows(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with a score of at least ``threshold``, in one pass."""
    if not model.good:
        return df if 1 / (1 + np.exp(-model.weights[-1])) >= threshold else df.limit(0)
    at = df.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer.score(t or "") >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(keep_mask(keep))

    return df.mapInArrow(run, df.schema)


def keep_mask(keep: list[bool]):
    import pyarrow as pa

    return pa.array(keep, pa.bool_())
