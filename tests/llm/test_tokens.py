import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import packing, token_prefix
from sightline.llm.tokens import Encoder

TOUGH = [
    "", " ", "a", "  a   b ", "it's we'll they're 'll 're 'r", "x  \n y", "<|endoftext|>", "hi!<|endoftext|> there <|endoft",
    "a\n\n\nb \t \t c", "日本語 テキスト 😀😀 ok", "a" * 1500, "naïve café—“quoted” …", "  \n", "don't'll''s", "\r\n\r\nwin",
    "x" * 1200 + "  " + "é" * 300, "12 345 67890", "!!'s ??'re", "\x1c\x85 nbsp\xa0\xa0x", "line\nend\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\t'abcrelsvt<|>é!1.日") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    return TOUGH + odd


def test_ids_are_those_of_the_library(library):
    encoder = Encoder()
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want, text[:50]


def test_every_prefix_has_the_count_of_the_library(library):
    counter = token_prefix.PrefixCounter(Encoder())
    for text in texts():
        counts = counter.counts(text)
        assert len(counts) == len(text)
        for end in range(1, min(len(text), 300) + 1):
            assert counts[end - 1] == len(library.encode(text[:end], add_special_tokens=False).ids), (text[:50], end)


def test_long_pieces_take_memory_in_proportion(library):
    counter = token_prefix.PrefixCounter(Encoder())
    text = "语言模型" * 4000 + " " + "wordswithoutspaces" * 700
    counts = counter.counts(text)
    assert len(counts) == len(text) and counts[-1] == len(library.encode(text, add_special_tokens=False).ids)
    for end in (1, 90, 91, 400, 16000, 16001, 16050, 20000):
        assert counts[end - 1] == len(library.encode(text[:end], add_special_tokens=False).ids)
    assert max(map(len, counter.states), default=0) <= token_prefix.SHARED_BYTES


def test_whole_table_counts_and_budgets(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts_ = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in token_prefix.token_counts(docs).collect():
        text = texts_[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 512)
        within = text[: r["chars_within"]]
        assert len(library.encode(within, add_special_tokens=False).ids) <= 512
        assert r["chars_within"] == len(text) or n > 512


def test_table_answers_without_encoding(spark, docs_of, library):
    table = token_prefix.prefix_counts(docs_of([(1, "some words it'll take"), (2, None)]))
    got = {
        r["doc_id"]: r
        for r in table.select(
            "doc_id", token_prefix.tokens_in_prefix(F.col("prefix_tokens"), F.lit(8)).alias("n"),
            token_prefix.longest_prefix(F.col("prefix_tokens"), 3).alias("chars"),
        ).collect()
    }
    assert got[1]["n"] == len(library.encode("some wor", add_special_tokens=False).ids)
    assert len(library.encode("some words it'll take"[: got[1]["chars"]], add_special_tokens=False).ids) <= 3
    assert (got[2]["n"], got[2]["chars"]) == (0, 0)
    assert token_prefix.token_counts(docs_of([])).count() == 0


def simple_best_two_fit(lengths, capacity):
    """One bin after the other, on single pieces."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        items, gap = [], capacity
        while fit := [x for x in left if x <= gap]:
            items.append(max(fit))
            left.remove(max(fit))
            gap -= items[-1]
        while gap:
            least = min(items)
            room = gap + least
            sums = [a + b for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room]
            if not sums or max(sums) <= least:
                break
            # As in the plan: the smallest first piece of a best pair.
            x = min(min(a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b == max(sums))
            items.remove(least)
            left.append(least)
            for piece in (x, max(sums) - x):
                items.append(piece)
                left.remove(piece)
            gap = room - max(sums)
        bins.append(sorted(items))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_like_single_pieces(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 150))] + [17] * 60
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_patterns(counts, 40)
    assert all(sum(items) <= 40 for _, items in plan)
    used = [n for times, items in plan for n in items * times]
    assert sorted(used) == sorted(lengths)
    assert sum(times for times, _ in plan) == len(simple_best_two_fit(lengths, 40))
    assert sum(times for times, _ in plan) <= -(-sum(lengths) // 40) * 1.34 + 1


def check_packed(rows, texts_, library, capacity=1024):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert by_doc.keys() == texts_.keys()
    for doc_id, text in texts_.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == capacity for r in pieces[1:]) and len(pieces) == -(-len(ids) // capacity)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_packed_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).collect()
    check_packed(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, library)


def test_packing_of_odd_rows(docs_of, library):
    rows = [(1, None), (2, ""), (3, "long " * 5000), (4, "tie"), (5, "tie"), (6, "x " * 1023)]
    check_packed(packing.pack(docs_of(rows)).collect(), dict(rows), library)
    assert packing.pack(docs_of([])).count() == 0
    same = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(same) == 3 and len({(r["sequence_id"], r["offset"]) for r in same}) == 3


def test_sequences_hold_the_ids(docs_of, library):
    df = docs_of([(1, "first text"), (2, "second one"), (3, "word " * 3000)])
    pieces = packing.pack(df, with_ids=True)
    found = packing.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in found) == pieces.selectExpr("sum(length)").first()[0]
    assert all(len(r["ids"]) <= 1024 for r in found)
