import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import language, masked_lm, quality, toxicity
from sightline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def share_right(spark, name, label, modulus, rest):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], modulus, rest) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    return np.mean([truth[r["doc_id"]] == r["predicted"] for r in rows if r["held_out"] and r["doc_id"] in truth])


def test_toxicity_on_held_out_rows(spark):
    assert share_right(spark, "op4_toxicity_grammar", "toxic", 4, 2) > 0.97


def test_quality_on_held_out_rows(spark):
    assert share_right(spark, "op5_quality_compression", "quality", 5, 0) > 0.97


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_language_unigrams"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"] and truth[r["doc_id"]]]) > 0.98


def labelled(docs_of, spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [rng.choice("table chair river house green walks over under seven".split()) for _ in range(60)]
        if bad:
            words.insert(rng.randrange(60), "blarg")
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, label int")


ODD = [(1, None), (2, ""), (3, "word " * 30000), (3, "word " * 30000), (None, "some text"), (4, "\n\n \t")]


def test_toxic_terms_are_learned_and_clauses_matched(docs_of, spark):
    docs, labels = labelled(docs_of, spark)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert "blarg" in model.terms
    of = toxicity._scores(model)
    assert of(["You are a blarg."])[0] > 0.3 > of(["a green river"])[0]
    grammar = toxicity.Grammar({"blarg": 5.0, "zork*": 4.0})
    assert list(grammar.clauses("fine words. you blarg! done")) == [[(toxicity.INSULT, 1, 5.0)]]
    assert list(grammar.clauses("he said blarg, zorkish")) == [[(toxicity.INSULT, 5, 5.0), (toxicity.INSULT, 5, 4.0)]]
    assert list(grammar.clauses("not a blarg")) == [[(toxicity.INSULT, 2, 5.0)]]
    assert grammar.features("i will kill you")[5] > 0 and grammar.features("i kill time")[5] == 0
    rows = toxicity.score(docs_of(ODD), model).collect()
    assert len(rows) == len(ODD) and all(r["score"] < 0.3 for r in rows)
    assert toxicity.kept_rows(docs_of(ODD), model).count() == len(ODD)


def test_product_machine_runs_its_parts_side_by_side():
    machines = toxicity.context_machines()
    step, mark = toxicity.compose(machines)
    rng = random.Random(0)
    for _ in range(200):
        states, state = [0, 0, 0], 0
        for symbol in [rng.randrange(6) for _ in range(12)]:
            moves = [m[s, symbol] for m, s in zip(machines, states, strict=True)]
            assert mark[state][symbol] == sum(o << i for i, (_, o) in enumerate(moves))
            states, state = [n for n, _ in moves], step[state][symbol]


def test_quality_of_odd_rows_and_without_labels(docs_of, spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice("aspen birch cedar maple willow and the of under".split()) for _ in range(150)]
        rows.append((i, " ".join(words) if i % 2 else " ".join(w + "###" for w in words)))
        labels.append((i, i % 2))
    model = quality.fit(docs_of(rows), spark.createDataFrame(labels, "doc_id long, label int"), F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs_of(rows), model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in labels]) > 0.95
    odd = quality.score(docs_of(ODD), model).collect()
    assert len(odd) == len(ODD) and len({r["score"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    empty = spark.createDataFrame([], "doc_id long, label int")
    for operator in (quality, toxicity):
        blank = operator.fit(docs_of(rows), empty, F.lit(True))
        scores = {r["score"] for r in operator.score(docs_of(ODD), blank).collect()}
        assert len(scores) == 1
        assert operator.score(docs_of([]), blank).count() == 0
        assert operator.kept_rows(docs_of(ODD), blank).count() == len(ODD)


def plain_likelihood(index, probs, word):
    """Sum over all segmentations by recursion."""
    text = language.START + word

    def rest(at):
        if at == len(text):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(text) + 1):
            piece = index.get(text[at:end])
            if piece is not None:
                total += probs[piece] * rest(end)
            elif end == at + 1:
                total += language.UNKNOWN * rest(end)
        return total

    return np.log(rest(0))


def test_forward_sums_all_segmentations():
    pieces = language.vocabulary_pieces()
    probs = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 3)
    scorer = language.Scorer(language.LanguageModel(["a", "b", "c"], [0.0] * 3, probs))
    for word in ("the", "über", "日本", "erhaon", "x"):
        want = [plain_likelihood(scorer.lattice.index, p, word) for p in probs]
        assert np.allclose(language.batch_log_likelihood(scorer.lattice, scorer.table, [word])[0], want)
        assert np.allclose(language.log_likelihood(scorer.lattice, scorer.table[:-2], scorer.table[-2], word), want)
    uses = {}
    language.expected_counts(scorer.lattice, probs[0], "the", 2.0, uses)
    letters = sum(n * len(pieces[p]) for p, n in uses.items())
    assert np.isclose(letters, 2 * len("▁the"))
    assert np.isfinite(scorer.predict(["ab" * 5000])[0][1])


def test_language_of_odd_rows(docs_of):
    rows = [(i, "the house of the river", "en") for i in range(20)] + [(100 + i, "das haus und der fluss", "de") for i in range(20)]
    model = language.fit(docs_of([*rows, (500, None, "xx"), (501, "words", None)]), F.lit(True))
    assert model.langs == ["de", "en"]
    odd = [(1, None), (2, "123 !?"), (3, "the river"), (4, "und das"), (4, "und das"), (None, "²³"), (6, "the " * 20000)]
    got = language.predict(docs_of(odd), model).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "en", "de", "de", "und", "en"]
    none = language.fit(docs_of([]), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs_of(odd), none).collect()} == {"und"}


def pattern_rows(n, seed, words_each=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        start = rng.randrange(12)
        rows.append((i, " ".join(words[(start + k) % 12] for k in range(words_each))))
    return rows


def test_masked_model_learns_from_both_sides(docs_of):
    model = masked_lm.train(docs_of(pattern_rows(300, 1, 4000)).coalesce(1))
    rng = random.Random(5)
    ordered = pattern_rows(4, 9)
    mixed = [(10 + i, " ".join(rng.sample(t.split(), 300))) for i, t in ordered]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.score(docs_of(ordered + mixed), model).collect()}
    assert max(got[10 + i] for i, _ in ordered) + 1 < min(got[i] for i, _ in ordered)
    # The probabilities of a word over all ids sum to one.
    around = masked_lm.contexts(np.array([3, 5, 7]), np.array([1]))
    total = sum(np.exp(masked_lm.class_log_probs(model.params, around, np.array([c]))[0]) for c in range(masked_lm.CLASSES))
    assert np.isclose(total, 1, atol=1e-4)
    assert np.allclose(np.bincount(model.classes, np.exp(model.within), masked_lm.CLASSES), 1)


def test_gradient_of_the_masked_model():
    rng = np.random.default_rng(0)
    params = masked_lm.first_params(np.ones(masked_lm.BUCKETS), np.arange(masked_lm.BUCKETS) % masked_lm.CLASSES)
    params = {k: v.astype(np.float64) for k, v in params.items()}
    around, target = rng.integers(0, masked_lm.CLASSES, (6, 4)), rng.integers(0, masked_lm.CLASSES, 6)
    loss = lambda p: -masked_lm.class_log_probs(p, around, target).mean()
    trainer = masked_lm.Trainer(params)
    trainer.step(around, target)
    for name, at in (("outer", (2, int(target[0]))), ("inner", (1,)), ("bias", (int(target[1]),)), ("context", (1, int(around[0, 1]), 3))):
        step = {k: v.copy() for k, v in params.items()}
        step[name][at] += 1e-5
        slope = (loss(step) - loss(params)) / 1e-5
        moved = trainer.params[name][at] - params[name][at]
        gradient = np.sqrt(trainer.square[name][at] - 0.1) * -np.sign(moved)
        assert abs(slope - gradient) < 1e-4, name


def test_masked_scores_of_odd_rows(docs_of):
    model = masked_lm.train(docs_of(ODD))
    got = masked_lm.score(docs_of(ODD), model).collect()
    assert len(got) == len(ODD)
    assert all(r["log_likelihood"] == 0 for r in got if r["n_words"] == 0)
    assert masked_lm.score(docs_of([]), masked_lm.train(docs_of([]))).count() == 0

