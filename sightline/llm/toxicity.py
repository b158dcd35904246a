"""Toxicity scores from a weighted finite-state pattern grammar.

A clause is read word by word. A lexical transducer turns words into symbols
(insult, threat, target, negation, report, other); three context transducers,
for targets, negation and reported speech, run beside it, and their product is
one machine that writes, for every insult or threat, the context it stands in.
Matched clauses, weighted by their terms and contexts, give the score.

Insult terms and their weights are learned: words and word beginnings that
mark toxic documents are taken greedily, each for the toxic documents that no
earlier term explains, then words that are as telling alone. The weights of
matches are fitted on terms learned from the other half of the rows. At most ``TRAIN_ROWS`` labelled rows are used, chosen by
a hash of their ids; every whole text is scored. Nulls and empty texts have no
clauses and get the score of a text without matches. Without labels of both
kinds no term is known and every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import bounded_sample, by_rows, logistic_fit, picked
from sightline.session import durable

#: Labelled rows used for the fit.
TRAIN_ROWS = 16_000
THRESHOLD = 0.3
SEED = 4
PREFIXES = (4, 5, 6, 7)
#: A term marks toxic documents at least so many times more often than others.
LIFT = 20.0
#: Toxic documents that a term must explain, and that make a word without clean ones a term.
LEAST, OFTEN = 2, 3
KEPT_WORDS = 400_000
#: Words after a negation that it covers.
NEGATED = 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
STOP = 6  # ends a clause
WORDS = {
    THREAT: "kill hurt destroy beat stab shoot strangle töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself he she they him her them du dich dir dein ihr euch sie tu toi vous votre ils elles usted ustedes tú ti él ella ellos",
    NEGATION: "not never no neither nor isn aren wasn don doesn nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni",
    REPORT: "said says say told wrote writes claims claimed quoted quote sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma",
}
FIXED = {w: s for s, words in WORDS.items() for w in words.split()}
LETTERS = re.compile(r"[^\W\d_]+")
ENDS = re.compile(r"[.!?;:\n]")
HITS = re.compile(bytes([0x5B, INSULT, THREAT, INSULT + 8, THREAT + 8, 0x5D]))


def context_machines() -> list[dict[tuple[int, int], tuple[int, int]]]:
    """(state, symbol) to (state, mark) for targets, negation and reported speech; states start at 0."""
    symbols = range(6)
    target = {(s, c): (1 if c == TARGET else s, s) for s in (0, 1) for c in symbols}
    negation = {
        (s, c): (NEGATED if c == NEGATION else max(0, s - 1), int(s > 0)) for s in range(NEGATED + 1) for c in symbols
    }
    report = {(s, c): (1 if c == REPORT else s, s) for s in (0, 1) for c in symbols}
    return [target, negation, report]


def compose(machines: list[dict]) -> tuple[list[list[int]], list[list[int]]]:
    """Product machine as tables [state][symbol] of the next state and the marks, one bit per machine."""
    spaces = [sorted({s for s, _ in m}) for m in machines]
    states = list(product(*spaces))
    at = {s: i for i, s in enumerate(states)}
    step, mark = [], []
    for state in states:
        moves = [[m[s, c] for m, s in zip(machines, state, strict=True)] for c in range(6)]
        step.append([at[tuple(n for n, _ in move)] for move in moves])
        mark.append([sum(o << i for i, (_, o) in enumerate(move)) for move in moves])
    return step, mark


CONTEXTS = 8


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)  # a trailing * marks a word beginning
    weights: list[float] = field(default_factory=list)
    base: float = 0.0


class Grammar:
    def __init__(self, terms: dict[str, float]):
        self.exact = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.begins = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.step, self.mark = compose(context_machines())
        self.codes: dict[str, int] = {}

    def weight(self, word: str) -> float:
        """Weight of a word as an insult, 0 for other words."""
        found = [self.exact.get(word, 0.0)]
        found += [self.begins.get(word[:n], 0.0) for n in PREFIXES if len(word) > n]
        return max(found)

    def symbol(self, word: str) -> int:
        return INSULT if self.weight(word) else FIXED.get(word, OTHER)

    def code(self, chunk: str) -> int:
        """Symbol of a chunk, plus 8 if a clause ends with it; of several words the gravest counts."""
        symbols = [self.symbol(w) for w in LETTERS.findall(chunk)]
        best = min((s for s in symbols if s), default=OTHER)
        return best + 8 * bool(ENDS.search(chunk))

    def clauses(self, text: str) -> Iterator[list[tuple[int, int, float]]]:
        """Matched clauses: (symbol, marks, weight) of their insults and threats."""
        codes = self.codes
        chunks = text.lower().replace("\n", " \n ").split(" ")
        try:
            line = bytes(map(codes.__getitem__, chunks))
        except KeyError:
            if len(codes) > KEPT_WORDS:
                codes.clear()
            for chunk in chunks:
                if chunk not in codes:
                    codes[chunk] = self.code(chunk)
            line = bytes(map(codes.__getitem__, chunks))
        done = 0
        for hit in HITS.finditer(line):
            if hit.start() < done:
                continue
            start = hit.start()
            while start > done and line[start - 1] < 8:
                start -= 1
            state, out = 0, []
            # A target after the insult counts as one before it.
            end = hit.start()
            while end < len(line) - 1 and line[end] < 8:
                end += 1
            done = end + 1
            aimed = any(c & 7 == TARGET for c in line[start:done])
            for at in range(start, done):
                symbol = line[at] & 7
                if symbol in (INSULT, THREAT):
                    weight = max((self.weight(w) for w in LETTERS.findall(chunks[at])), default=0.0)
                    out.append((symbol, self.mark[state][symbol] | int(aimed), weight))
                state = self.step[state][symbol]
            yield out

    def features(self, text: str) -> list[float]:
        """The strongest match and all matches, by weight; matches by context; threats that meet a target."""
        sums = [0.0] * CONTEXTS
        threats, top = 0, 0.0
        for clause in self.clauses(text):
            for symbol, marks, weight in clause:
                if symbol == INSULT:
                    sums[marks] += weight
                    top = max(top, weight)
                elif marks & 1 and not marks & 2:
                    threats += 1
        aimed = sums[1]
        negated = sum(v for m, v in enumerate(sums) if m & 2)
        reported = sum(v for m, v in enumerate(sums) if m & 4 and not m & 2)
        # Contexts share the weight of all matches and differ from it only as far as labels show.
        return [top, float(np.log1p(sum(sums))), *(0.3 * float(np.log1p(v)) for v in (aimed, negated, reported, threats))]


def document_terms(text: str) -> set[str]:
    """Words and word beginnings of a text."""
    words = set(LETTERS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Marks:
    """Occurrences of terms in toxic and clean documents."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int

    def lift(self, term: str) -> float:
        pos, neg = self.counts[term]
        return (pos + 0.5) / (self.toxic + 1) * (self.clean + 1) / (neg + 0.5)

    def select(self, toxic_docs: list[list[str]]) -> dict[str, float]:
        """Terms with their log odds: a greedy cover of the toxic documents, then further words."""
        where: dict[str, set[int]] = {}
        for at, terms in enumerate(toxic_docs):
            for t in terms:
                if self.counts.get(t, (0, 0))[0] >= LEAST and self.lift(t) >= LIFT:
                    where.setdefault(t, set()).add(at)
        chosen = {t for t in where if not t.endswith("*") and self.counts[t][0] >= OFTEN and self.counts[t][1] == 0}
        explained: set[int] = set()
        while where:
            # Rarely in clean documents first; a whole word before its beginnings.
            best = max(where, key=lambda t: (len(where[t]) - self.counts[t][1], not t.endswith("*"), len(t), t))
            if len(where[best]) - self.counts[best][1] < LEAST:
                break
            chosen.add(best)
            explained |= where[best]
            where = {t: rest for t, d in where.items() if (rest := d - explained)}
        return {t: float(np.log(self.lift(t))) for t in sorted(chosen)}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label) where ``learn`` holds."""
    known = bounded_sample(labels.where(learn & F.col("label").isin(0, 1)), "doc_id", SEED, train_rows)
    rows = docs.join(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
    # Copies count once, and stay in one half.
    rows = rows.where(F.length("text") > 0).groupBy(F.xxhash64("text").alias("_h"), "label").agg(F.first("text").alias("text"))
    rows = durable(rows.select("text", "label", F.pmod("_h", F.lit(2)).cast("int").alias("half")), "toxicity-train")
    totals = {(r["label"], r["half"]): r["count"] for r in rows.groupBy("label", "half").count().collect()}
    sizes = [[totals.get((label, half), 0) for half in (0, 1)] for label in (0, 1)]
    if not sum(sizes[0]) or not sum(sizes[1]):
        return ToxicityModel(base=float(bool(sum(sizes[1]))))

    def count(batches: Iterator[list]) -> Iterator[tuple]:
        seen = [Counter() for _ in range(4)]
        for texts, labels_, halves in batches:
            for text, label, half in zip(texts, labels_, halves, strict=True):
                seen[2 * label + half].update(document_terms(text))
        terms = list(set().union(*seen))
        yield terms, *[[c[t] for t in terms] for c in seen]

    names = ["clean0", "clean1", "toxic0", "toxic1"]
    counted = by_rows(rows, count, "term string, clean0 long, clean1 long, toxic0 long, toxic1 long")
    counted = counted.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])

    def telling(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
        rate = (toxic + 0.5) / (n_toxic + 1) * (n_clean + 1) / (clean + 0.5)
        return (toxic >= LEAST) & (rate >= LIFT)

    both = telling(F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1"), sum(sizes[1]), sum(sizes[0]))
    either = [telling(F.col(f"toxic{h}"), F.col(f"clean{h}"), sizes[1][h], sizes[0][h]) for h in (0, 1)]
    # As many terms as the bounded sample can hold.
    found = counted.where(both | either[0] | either[1]).collect()
    candidates = frozenset(r["term"] for r in found)

    def listed(batches: Iterator[list]) -> Iterator[tuple]:
        for texts, halves in batches:
            yield [sorted(document_terms(t) & candidates) for t in texts], halves

    toxic_docs = by_rows(rows.where("label = 1").select("text", "half"), listed, "terms array<string>, half int").collect()

    def terms_of(*halves: int) -> dict[str, float]:
        counts = {r["term"]: (sum(r[f"toxic{h}"] for h in halves), sum(r[f"clean{h}"] for h in halves)) for r in found}
        marks = Marks(counts, sum(sizes[1][h] for h in halves), sum(sizes[0][h] for h in halves))
        return marks.select([r["terms"] for r in toxic_docs if r["half"] in halves])

    by_half = [terms_of(1), terms_of(0)]

    def measure(batches: Iterator[list]) -> Iterator[tuple]:
        grammars = [Grammar(t) for t in by_half]
        for texts, labels_, halves in batches:
            yield [grammars[h].features(t) for t, h in zip(texts, halves, strict=True)], labels_

    table = by_rows(rows, measure, "x array<double>, label int").collect()
    x = np.array([r["x"] for r in table])
    y = np.array([r["label"] for r in table], float)
    return ToxicityModel(terms_of(0, 1), logistic_fit(x, y, ridge=0.5).tolist())


def _probability(model: ToxicityModel, x: list[float]) -> float:
    z = np.dot(model.weights[:-1], x) + model.weights[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _scores(model: ToxicityModel):
    """Function from texts to scores, for one task."""
    if not model.weights:
        return lambda texts: [model.base] * len(texts)
    grammar = Grammar(model.terms)
    none = _probability(model, [0.0] * 6)

    def of(texts: list) -> list[float]:
        out = []
        for text in texts:
            x = grammar.features(text or "")
            out.append(_probability(model, x) if any(x) else none)
        return out

    return of


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        of = _scores(model)
        for ids, texts in batches:
            yield ids, of(texts)

    return by_rows(picked(df, doc_id=id_col, text=text_col), run, "doc_id long, score double")


def kept_rows(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with a score below ``threshold``, in one pass."""
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        of = _scores(model)
        for batch in batches:
            scores = of(batch.column(at).to_pylist())
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return df.mapInArrow(run, df.schema)
