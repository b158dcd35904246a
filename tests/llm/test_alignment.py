import bisect
import hashlib
import random
from collections import Counter
from functools import reduce

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sightline.llm import alignment
from sightline.llm.alignment import Fragment, Tokenizers, ranged_fragments, segments, whole
from sightline.llm.queries import op11_fragment_alignment

POOL = (
    "the Haus é 日本 <|endoftext|> </s> a b1 don't ... 🙂 ß 's".split()
    + [" ", "  ", "   ", "\n", "\n\n", "\t", " ", "　", "x" * 50, "\r\n", "\x00", "▁", "\x1c", "\x85"]
)


@pytest.fixture(scope="module")
def naive():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}

    def one(text):
        """(ends of groups as text, links) of a text by comparing every pair of tokens; None without tokens."""
        if not text:
            return None
        data = (" " + text).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        parts = [
            [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]],
        ]
        if any(b"".join(p) != data for p in parts):
            return None
        spans = []
        for p in parts:
            at, out = 0, []
            for x in p:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = []
        for x, s in zip(ids[0], spans[0], strict=True):
            # Tokens of at most 48 bytes, so no other one can overlap.
            low, high = (bisect.bisect(spans[1], (at,)) for at in (s[0] - 48, s[1] + 1))
            links += [(x, y) for y, t in zip(ids[1][low:high], spans[1][low:high], strict=True) if s[0] < t[1] and t[0] < s[1]]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        said = []
        for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
            at = [[bisect.bisect(p, (x,)) for x in (low, high)] for p in spans]
            said.append("|".join(",".join(map(str, i[a:b])) for i, (a, b) in zip(ids, at, strict=True)))
        return len(ids[0]), len(ids[1]), said, links

    return one


def naive_rows(naive, rows):
    found = [naive(t) for _, t in rows]
    counts = Counter(p for f in found if f for p in set(f[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        n_a, n_b, said, links = f or (0, 0, [], [])
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if f else ""
        out.append((i, n_a, n_b, len(said), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def random_text(rnd, parts):
    text = "".join(rnd.choice(POOL) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(0, parts)))
    return text if rnd.random() < 0.1 else text.replace("▁", "")


def test_joining_fragments_is_associative(naive):
    rnd, tokenizers = random.Random(3), Tokenizers()
    for _ in range(300):
        text = random_text(rnd, 20)
        if not text:
            continue
        size = rnd.randint(1, 15)
        parts = [f for begin, _, s in segments(text, size) for f in ranged_fragments(tokenizers, begin, s, size)]
        left = whole(reduce(Fragment.__add__, parts))
        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = naive(text)
        for f in (left, whole(parts[0])):
            assert f.ok == bool(want)
            if want:
                assert (f.n_a, f.n_b, f.text.decode()) == (want[0], want[1], ";".join(want[2]))
                assert dict(zip(f.keys.tolist(), f.times.tolist(), strict=True)) == Counter(a << 32 | b for a, b in want[3])
                assert not f.suffix.a and not f.suffix.b


def test_ranges_leave_open_parts():
    text = "einzuwortlang" * 40
    parts = ranged_fragments(Tokenizers(), 0, " " + text, 16)
    assert len(parts) > 10 and any(f.suffix.a or f.suffix.b for f in parts) and any(len(f.prefix.a) > 1 for f in parts)


def test_query_equals_a_plain_version(spark, naive):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = op11_fragment_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=str) == naive_rows(naive, rows)


def test_odd_rows_and_long_documents(spark, docs_of, naive):
    rnd = random.Random(4)
    rows = [(None, None), (None, "ab"), (1, ""), (2, "same text"), (2, "same text"), (3, "has ▁ mark"), (4, " lead"), (5, "tail ")]
    rows += [(10 + n, random_text(rnd, 40)) for n in range(60)] + [(99, "nospacehere" * 30), (None, "word and " * 60)]
    want = naive_rows(naive, rows)
    for long in (alignment.LONG, 64):
        got = alignment.align(docs_of(rows), long=long, size=32, fan_in=3).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert alignment.align(docs_of(rows).limit(0)).count() == 0
    spans = alignment.groups(docs_of(rows)).collect()
    plain = Counter(len(f[2]) if f else 0 for f in (naive(t) for _, t in rows))
    assert Counter(len(r["groups"]) for r in spans) == plain
