import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import simhash


def naive(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Component of every fingerprint by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint_is_the_stated_one():
    for text in ("", "One", "one TWO", "Äpfel\tund\nBirnen UND Äpfel", "a b c d " * 50, " x\x0b y  z "):
        assert simhash.simhash(text) == naive(text)


def random_fingerprints():
    rng = random.Random(1)
    out = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        out.add(seed)
        for _ in range(25):
            bits = rng.sample(range(64), rng.randint(1, 5))
            out.add(seed ^ sum(1 << b for b in bits))
    return sorted(out)


@pytest.mark.parametrize("crowded", [1, 256])
def test_pairs_are_all_pairs_within_three_bits(spark, crowded):
    fps = random_fingerprints()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded).collect()
    mask = (1 << 64) - 1
    pairs = {frozenset((r["a"] & mask, r["b"] & mask)) for r in got}
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert len(got) == len(pairs) and pairs == want


def test_components_on_documents_with_odd_rows(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(7, base), (3, base), (12, base + " tail"), (5, None), (9, ""), (20, "  \n"), (4, "quite different words here"), (4, "quite different words here"), (None, base), (None, "lonely text")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    group = groups({naive(t) for _, t in rows})
    for r in got:
        members = [i for i, t in rows if group[naive(t)] == group[int(r["fingerprint"], 16)] and i is not None]
        assert r["component_id"] == (min(members) if members else None)
    kept = simhash.one_per_group(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({r["component_id"] for r in got if r["component_id"] is not None})
    assert kept.columns == docs_of(rows).columns
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    group = groups({naive(t) for t in texts.values()})
    least = {}
    for i, t in texts.items():
        least[group[naive(t)]] = min(i, least.get(group[naive(t)], i))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i]["fingerprint"] == f"{naive(t):016x}" and got[i]["component_id"] == least[group[naive(t)]]
    links = sum(r["links"] for r in got.values())
    assert links == 0 or links >= 2
    assert simhash.near_duplicates(docs).where(F.col("component_id") > F.col("doc_id")).count() == 0
