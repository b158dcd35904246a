import numpy as np

from sightline.llm import masked_lm as lm


def test_training_sees_every_position_once():
    """Texts of fewer words than the step between masked positions were mostly left out before."""
    for n in (0, 1, 7, lm.BLOCK, 2 * lm.BLOCK + 5):
        ids = np.arange(n) % lm.CLASSES
        seen = list(lm.every_position(ids))
        assert sum(len(t) for _, t in seen) == n
        if n:
            assert (np.concatenate([t for _, t in seen]) == ids).all()
            assert (np.concatenate([a for a, _ in seen]) == lm.contexts(ids, np.arange(n))).all()


def test_trained_model_scores_all_words(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a c d") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs)).collect()}
    assert len(got) == 62 and [got[i].n_words for i in (0, 1, 60, 61)] == [3, 2, 0, 0]
    assert all(np.isfinite(r.log_likelihood) and r.log_likelihood <= 0 for r in got.values())


def test_texts_end_to_end_are_like_texts_alone():
    """Texts are laid out together; a text must not see its neighbours, nor a long one its blocks."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, lm.BUCKETS, n) for n in (3, 0, 1, lm.BLOCK + 7, 2)]
    counts = np.bincount(np.concatenate(texts), minlength=lm.BUCKETS)
    classes, within = lm.classes_of(counts)
    model = lm.MaskedModel(classes, within, lm.first_params(counts, classes))
    ids, sizes = lm.laid_out([t.astype("<u2").tobytes() for t in texts])
    assert sizes.tolist() == [len(t) for t in texts]
    alone = np.concatenate([lm.log_probabilities(model, t) for t in texts])
    assert np.allclose(lm.log_probabilities(model, ids, sizes), alone, atol=1e-5)


def test_one_number_for_all_rows_or_one_a_row():
    """The softmax is that of the plain formula, with weights that are small and far too large for one shift."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, lm.BUCKETS)
    params = lm.first_params(counts, lm.classes_of(counts)[0])
    around, target = rng.integers(0, lm.CLASSES + 1, (50, 4)), rng.integers(0, lm.CLASSES, 50)
    for scale in (1, 300):
        p = {**params, "context": params["context"] * 20, "outer": params["outer"] * scale}
        layer = np.tanh(p["inner"] + sum(p["context"][k, around[:, k]] for k in range(4)).astype(float))
        logits = layer @ p["outer"] + p["bias"]
        peak = logits.max(1)
        want = logits[np.arange(50), target] - peak - np.log(np.exp(logits - peak[:, None]).sum(1))
        assert np.allclose(lm.class_log_probs(p, around, target), want, rtol=1e-4, atol=1e-3)
