import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import periodic
from sightline.llm.queries import op12_periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def naive_runs(words):
    """All runs, by comparing every word with the one a period further on."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j + (i == j)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def naive_row(doc_id, text, tails=True):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = naive_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=6), min_size=1, max_size=5))
def test_runs_of_several_documents_are_those_of_each(parts):
    documents = [[c.encode() for unit, times in doc for c in unit * times] for doc in parts]
    assert periodic.runs(documents) == [naive_runs(d) for d in documents]


def test_long_periods_and_long_documents():
    rnd = random.Random(5)
    unit = [b"w%d" % rnd.randrange(50) for _ in range(700)]
    words = [b"x"] * 3 + unit * 5 + [b"end"] + [b"again"] * 100_000
    assert periodic.runs([words]) == [[(3, 3500, 700), (3504, 100_000, 1)]]


def test_report_equals_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(naive_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = op12_periodic_runs(spark, "/root/testdata/sf0.001")
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark, docs_of):
    rows = [(None, "a " * 9), (None, None), (1, ""), (2, " \t\n"), (3, "a b " * 4), (3, "a b " * 4), (4, "ä x " * 6), (5, "z")]
    got = periodic.run_report(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((naive_row(i, t, False) for i, t in rows), key=str)
    assert periodic.run_report(docs_of(rows).limit(0)).count() == 0
    spans = {r["doc_id"]: r for r in periodic.find_runs(docs_of(rows)).collect()}
    assert [tuple(r) for r in spans[3]["runs"]] == [(0, 8, 2)] and spans[3]["collapsed"] == "a b"
