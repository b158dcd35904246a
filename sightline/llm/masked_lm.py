"""Pseudo-likelihood scores of a masked bidirectional window network.

Every word is predicted from the two words before and the two after it. Words
are hashed into ``BUCKETS`` ids; the most frequent ids are classes of their
own, the others share classes by frequency. A network (position embeddings,
one tanh layer, softmax over classes) gives the class of a word from both
sides, corpus counts give the id within its class. The score of a document is
the sum of the conditional log-probabilities of its words.

Words become ids once, in a table of two bytes a word that all passes read.
Counts cover all documents. Training does, too: in every round each partition
trains a copy of the network on every position of its share of the documents,
masked in its turn, and the copies are averaged by their numbers of examples. What is
gathered from the corpus grows with its partitions; what the driver gets has
the size of the model. Nulls and empty texts have no words and score 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import by_rows, picked
from sightline.session import durable

BUCKETS = 1 << 16
CLASSES = 256
#: Classes of several ids, by frequency.
SHARED = 32
WIDTH = 24
OFFSETS = (-2, -1, 1, 2)
ROUNDS = 2
BATCH = 512
RATE = 0.08
SEED = 6
KEPT_WORDS = 400_000
BLOCK = 512
#: Exponents of single precision further below the largest one than this may vanish.
SPREAD = 80.0


class WordIds(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return value


def word_ids(table: WordIds, text: str) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words))


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, written once: the word ids of the text, two bytes each."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        table = WordIds()
        for doc_ids, texts in batches:
            yield doc_ids, [word_ids(table, t or "").astype("<u2").tobytes() for t in texts]

    return durable(by_rows(picked(df, doc_id=id_col, text=text_col), run, "doc_id long, ids binary"), "masked-words")


def laid_out(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of encoded texts end to end, and the number of words of each text."""
    ids = np.frombuffer(b"".join(packed), "<u2").astype(np.int64)
    return ids, np.fromiter(map(len, packed), np.int64, len(packed)) // 2


def bucket_counts(words: DataFrame) -> np.ndarray:
    """How often each id occurs in all texts."""

    def count(batches: Iterator[list]) -> Iterator[tuple]:
        sums = np.zeros(BUCKETS, np.int64)
        for (packed,) in batches:
            sums += np.bincount(laid_out(packed)[0], minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield some, sums[some]

    found = by_rows(words.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


@dataclass
class MaskedModel:
    classes: np.ndarray  # of each id
    within: np.ndarray  # log-probability of each id in its class
    params: dict[str, np.ndarray]


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-counts, kind="stable")
    own = CLASSES - SHARED
    classes = np.empty(BUCKETS, np.int64)
    classes[order[:own]] = np.arange(own)
    # Shared classes hold about equal numbers of words.
    rest = counts[order[own:]] + 1
    classes[order[own:]] = own + np.minimum(SHARED - 1, np.cumsum(rest) * SHARED // (rest.sum() + 1))
    smoothed = counts + 1.0
    totals = np.bincount(classes, smoothed, CLASSES)
    return classes, np.log(smoothed / totals[classes])


def first_params(counts: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    scale = 0.1
    share = np.bincount(classes, counts + 1.0, CLASSES)
    return {
        "context": rng.normal(0, scale, (len(OFFSETS), CLASSES + 1, WIDTH)).astype(np.float32),
        "inner": np.zeros(WIDTH, np.float32),
        "outer": rng.normal(0, scale, (WIDTH, CLASSES)).astype(np.float32),
        "bias": np.log(share / share.sum()).astype(np.float32),
    }


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes around the given positions; beyond the ends is a class of its own."""
    padded = np.concatenate([np.full(2, CLASSES), ids, np.full(2, CLASSES)])
    return np.stack([padded[at + 2 + o] for o in OFFSETS], 1)


def every_position(ids: np.ndarray, sizes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and classes of all positions of one text or of texts end to end, a block at a time."""
    sizes = np.array([len(ids)]) if sizes is None else sizes
    # Two classes of the end on either side of every text.
    at = np.arange(len(ids)) + 2 * np.repeat(np.arange(len(sizes)), sizes)
    padded = np.full(len(ids) + 2 * len(sizes) + 2, CLASSES)
    padded[at + 2] = ids
    for i in range(0, len(ids), BLOCK):
        here = at[i : i + BLOCK] + 2
        yield np.stack([padded[here + o] for o in OFFSETS], 1), ids[i : i + BLOCK]


def slots(around: np.ndarray) -> np.ndarray:
    """Rows of the position embeddings, all offsets in one table."""
    return around + np.arange(len(OFFSETS)) * (CLASSES + 1)


def hidden(params: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The layer, and a column of ones that carries the bias of the classes."""
    table = params["context"].reshape(-1, WIDTH)
    out = np.ones((len(rows), WIDTH + 1), np.float32)
    total = table.take(rows[:, 0], 0)
    for k in range(1, len(OFFSETS)):
        total += table.take(rows[:, k], 0)
    total += params["inner"]
    np.tanh(total, out=out[:, :WIDTH])
    return out


def scaled_logits(params: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Logits less a number of each row that keeps their exponentials finite and some of them above zero.

    The layer lies between -1 and 1, which bounds all logits; where the bounds are
    too far apart for one number, it is the largest logit of the row.
    """
    outer, bias = params["outer"], params["bias"]
    reach = np.abs(outer).sum(0)
    top = (bias + reach).max()
    if top - (bias - reach).max() < SPREAD:
        return h @ np.vstack([outer, bias - top])
    logits = h @ np.vstack([outer, bias])
    logits -= logits.max(1, keepdims=True)
    return logits


ONES = np.ones(CLASSES, np.float32)


def class_log_probs(params: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    logits = scaled_logits(params, hidden(params, slots(around)))
    picked_ = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    return picked_ - np.log(logits @ ONES)


class Trainer:
    """Adagrad on masked positions."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = {k: v.copy() for k, v in params.items()}
        self.square = {k: np.full_like(v, 0.1) for k, v in params.items()}
        self.examples = 0

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        p, n = self.params, len(target)
        rows = slots(around)
        h = hidden(p, rows)
        error = scaled_logits(p, h)
        np.exp(error, out=error)
        error /= (error @ ONES)[:, None] * np.float32(n)
        error[np.arange(n), target] -= np.float32(1 / n)
        layer = h[:, :WIDTH]
        back = (error @ p["outer"].T) * (1 - layer * layer)
        # Every slot gets the sum of its rows.
        cells = (rows * WIDTH)[:, :, None] + np.arange(WIDTH)
        shares = np.broadcast_to(back[:, None], cells.shape)
        context = np.bincount(cells.ravel(), shares.ravel(), p["context"].size).astype(np.float32)
        outer = h.T @ error
        grads = {"context": context.reshape(p["context"].shape), "inner": back.sum(0), "outer": outer[:WIDTH], "bias": outer[WIDTH]}
        for name, g in grads.items():
            self.square[name] += g * g
            p[name] -= RATE * g / np.sqrt(self.square[name])
        self.examples += n


def flatten(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)]).astype(np.float64)


def restore(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        size = like[k].size
        out[k] = flat[at : at + size].reshape(like[k].shape).astype(np.float32)
        at += size
    return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> MaskedModel:
    return train_words(encoded(df, id_col, text_col), rounds)


def train_words(words: DataFrame, rounds: int = ROUNDS) -> MaskedModel:
    """The model of the texts of ``encoded``."""
    counts = bucket_counts(words)
    classes, within = classes_of(counts)
    params = first_params(counts, classes)
    for turn in range(rounds):
        now = params

        def local(batches: Iterator[list], now: dict = now, turn: int = turn) -> Iterator[tuple]:
            trainer = Trainer(now)
            rng = np.random.default_rng([SEED, turn])
            held_around, held_target, held = [], [], 0
            for (packed,) in batches:
                ids, sizes = laid_out(packed)
                for around, target in every_position(classes[ids], sizes):
                    held_around.append(around)
                    held_target.append(target)
                    held += len(target)
                    if held >= 64 * BATCH:
                        _learn(trainer, held_around, held_target, rng)
                        held_around, held_target, held = [], [], 0
            if held:
                _learn(trainer, held_around, held_target, rng)
            if trainer.examples:
                flat = flatten(trainer.params)
                yield np.arange(len(flat)), flat * trainer.examples, np.full(len(flat), trainer.examples)

        share = words.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(rounds)) == turn).select("ids")
        sums = by_rows(share, local, "at int, total double, n long").groupBy("at").agg(
            (F.sum("total") / F.sum("n")).alias("mean")
        )
        found = sums.collect()  # one row per parameter
        if found:
            flat = np.zeros(len(found))
            for r in found:
                flat[r["at"]] = r["mean"]
            params = restore(flat, params)
    return MaskedModel(classes, within, params)


def _learn(trainer: Trainer, around: list, target: list, rng: np.random.Generator) -> None:
    around, target = np.concatenate(around), np.concatenate(target)
    order = rng.permutation(len(target))
    for i in range(0, len(order), BATCH):
        part = order[i : i + BATCH]
        trainer.step(around[part], target[part])


def log_probabilities(model: MaskedModel, ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Conditional log-probability of every word of one text or of texts end to end, given as ids."""
    blocks = [class_log_probs(model.params, *block) for block in every_position(model.classes[ids], sizes)]
    return np.concatenate([*blocks, np.zeros(0)]) + model.within[ids]


def score(df: DataFrame, model: MaskedModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row."""
    return score_words(encoded(df, id_col, text_col), model)


def score_words(words: DataFrame, model: MaskedModel) -> DataFrame:
    """The scores of the texts of ``encoded``."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        for doc_ids, packed in batches:
            ids, sizes = laid_out(packed)
            of_text = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(of_text, log_probabilities(model, ids, sizes), len(sizes))
            yield doc_ids, sizes, total, total / np.maximum(sizes, 1)

    return by_rows(
        words.select("doc_id", "ids"), run,
        "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double",
    )
