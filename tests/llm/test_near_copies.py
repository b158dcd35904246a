import random

import numpy as np

from sightline.llm import near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_all_pairs(rows):
    """Rows kept when every pair is compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id or 0, text))
    return groups.values()


def planted():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        text = rng.choices(words, k=300)
        rows.append((1000 * base, " ".join(text)))
        for copy in range(1, 7):
            changed = list(text)
            for at in rng.sample(range(300), copy):  # 1 to 6 of 300 words: similarity 0.81 at least
                changed[at] = f"x{copy}_{at}"
            rows.append((1000 * base + copy, " ".join(changed)))
    return rows


def test_planted_near_copies_leave_one_each(spark, docs_of):
    rows = planted()
    far = sum((simhash.simhash(rows[7 * b][1]) ^ simhash.simhash(rows[7 * b + k][1])).bit_count() > 3 for b in range(12) for k in range(1, 7))
    assert far > 0  # pairs that op2's rule leaves in
    got = sorted(r["doc_id"] for r in simhash.one_per_group(docs_of(rows)).collect())
    assert got == sorted(min(g)[1] for g in kept_by_all_pairs(rows))
    assert got == [1000 * base for base in range(12)]


def test_chains_and_tables_equal_all_pairs(spark, docs_of):
    # Every text is similar to the next, the ends are not; one band value holds many of them.
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)] + [(100 + i, f"word {i}") for i in range(4)]
    rows += [(r["doc_id"] + 10_000, r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(r["doc_id"] for r in simhash.one_per_group(docs_of(rows)).collect())
    assert got == sorted(min(g)[1] for g in kept_by_all_pairs(rows))


def test_similarity_is_reached_at_four_fifths():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.similar(a[:8], np.arange(10, dtype=np.uint64)) and near_copies.similar(a, a)
    assert not near_copies.similar(a[:7], a)


def test_null_and_repeated_ids_keep_one_row_a_group(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(None, "one lonely text"), (None, "another lonely text of its own"), (None, base), (3, base), (3, base + " tail")]
    rows += [(5, "five says this"), (5, "and something else entirely"), (5, "five says this"), (None, "one lonely text")]
    got = [(r["doc_id"], r["text"]) for r in simhash.one_per_group(docs_of(rows)).collect()]
    assert len(got) == len(kept_by_all_pairs(rows)) == 5
    assert {i for i, t in got if "word" in t} == {3}
    assert {(i, t) for i, t in got if "word" not in t} == {
        (5, "five says this"), (5, "and something else entirely"), (None, "one lonely text"), (None, "another lonely text of its own"),
    }


def test_the_filters_lose_no_similar_pair():
    rng = random.Random(8)
    none = np.zeros(0, np.int64)
    seen = 0
    for _ in range(400):
        size = rng.choice([5, 30, 200])
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        b = a.copy()
        for at in rng.sample(range(len(b)), rng.randint(0, max(1, size // 8))):
            b[at] = rng.getrandbits(64)
        b = np.unique(b[rng.randint(0, size // 10) :])
        frequent = np.sort((a[:: rng.randint(1, 4)] >> np.uint64(8)).astype(np.int64)) if rng.random() < 0.5 else none
        levels = np.full(len(frequent), 3, np.int64)
        if not near_copies.similar(a, b):
            continue
        seen += 1
        x, y = (near_copies.places(s, frequent, levels) for s in (a, b))
        front = [set(s[: near_copies.prefix_length(len(s))].tolist()) for s in (x, y)]
        shared = min(front[0] & front[1])
        rest = min(len(x) - x.tolist().index(shared), len(y) - y.tolist().index(shared))
        assert 9 * rest >= 4 * (len(a) + len(b))
        bits = sum(int(p ^ q).bit_count() for p, q in zip(*(near_copies.parity_sketch(s).view(np.uint64).tolist() for s in (a, b)), strict=True))
        assert 9 * bits <= len(a) + len(b)
        apart = near_copies.sketch_distance(near_copies.wide_sketch(a), near_copies.wide_sketch(b))
        assert apart <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
    assert seen > 100


def variants(count):
    """One text in many variants: most near it, some with so many changes that nothing is near them."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, count):
        changed = list(words)
        for at in rng.sample(range(150), rng.randint(1, 9)):
            changed[at] = f"x{i}_{at}"
        rows.append((i, " ".join(changed)))
    return rows


def test_a_large_group_of_variants_equals_all_pairs_and_few_pairs_are_made(spark, docs_of, monkeypatch):
    rows = variants(400)
    pairs = []
    plain = near_copies._Texts.verified

    def counted(self, found):
        pairs.append(found.count())
        return plain(self, found)

    monkeypatch.setattr(near_copies._Texts, "verified", counted)
    got = sorted(r["doc_id"] for r in near_copies.one_per_group(docs_of(rows)).collect())
    assert got == sorted(min(g)[1] for g in kept_by_all_pairs(rows))
    assert sum(pairs) < 20 * len(rows)  # all pairs are 79,800


def test_tables_equal_all_pairs_at_every_size(spark):
    """The rows kept of the larger tables, as counted once by comparing every pair of shingle sets."""
    for sf, kept in (("sf0.01", 922), ("sf0.1", 9248)):
        assert near_copies.one_per_group(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).count() == kept


def test_columns_of_any_name_and_type_go_through(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, 5, {"a": 1}, 7), (2, text, 6, {"a": 2}, 8), (None, None, 9, None, None), (3, "other words here", 4, {}, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _r1 long, row map<string,int>, key int")
    got = sorted(map(tuple, near_copies.one_per_group(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3]], key=str)
    assert near_copies.one_per_group(docs).columns == docs.columns and near_copies.one_per_group(docs.limit(0)).count() == 0
