import hashlib

import numpy as np

from sightline.llm import digests


def naive_counts(text):
    data = text.encode()
    data = data + b"\0" * max(0, digests.WINDOW - len(data)) if data else b""
    out = [0] * digests.BUCKETS
    for at in range(len(data) - digests.WINDOW + 1 if data else 0):
        for salt, (i, j, k) in enumerate(digests.TRIPLETS, 1):
            h = data[at + i] | data[at + j] << 8 | data[at + k] << 16 | salt << 24
            h = h * 2654435761 % 2**32
            h ^= h >> 15
            out[(h * 2246822519 % 2**32) >> 23] += 1
    return out


def test_counts_match_a_plain_loop_also_across_blocks(monkeypatch):
    text = "Größe und Länge der Wörter " * 40
    want = naive_counts(text)
    assert digests.bucket_counts(text).tolist() == want
    monkeypatch.setattr(digests, "BLOCK", 64)
    assert digests.bucket_counts(text).tolist() == want
    assert digests.bucket_counts("ab").tolist() == naive_counts("ab")


def test_hex_round_trip_and_bounds():
    a, b, empty = digests.digest("some words " * 30), digests.digest("other things entirely " * 30), digests.digest("")
    back = digests.from_hex(digests.to_hex(*a))
    assert back[0] == a[0] and (back[1] == a[1]).all()
    assert digests.likeness(a, a) == 1.0 and digests.likeness(empty, empty) == 1.0
    assert digests.likeness(a, b) == digests.likeness(b, a)
    assert 0 <= digests.likeness(a, empty) < 0.5


def test_next_document_wraps_and_ties_are_ordered(spark, docs_of):
    rows = [(5, "gamma delta " * 20), (1, "alpha beta " * 30), (3, None), (5, "beta " * 9), (None, "no id"), (9, "")]
    got = {}
    for r in digests.compare_with_next(docs_of(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(((-(2**63) if i is None else i), t or "", i) for i, t in rows)
    assert sum(map(len, got.values())) == len(rows)
    for at, (_, text, doc_id) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        row = next(r for r in got[doc_id] if r["n_chars"] == len(text))
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == digests.to_hex(*digests.digest(text))
        assert row["edited_fingerprint"] == digests.to_hex(*digests.digest(edited))
        assert np.isclose(row["near_next"], digests.likeness(digests.digest(text), digests.digest(following)))


def test_empty_and_single(docs_of):
    assert digests.compare_with_next(docs_of([])).count() == 0
    (row,) = digests.compare_with_next(docs_of([(1, "abcdefgh")])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0


def test_edited_texts_are_nearer_than_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = digests.compare_with_next(docs).collect()
    assert len(rows) == docs.count()
    apart = [(r["near_edited"] >= 0.45) + (r["near_next"] < 0.45) for r in rows]
    assert np.mean(apart) > 1.85
