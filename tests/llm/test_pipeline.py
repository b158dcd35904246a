import hashlib
import zlib

import numpy as np
import public_tokenizers
from test_mixing import WORDS, naive_seats, naive_targets
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import mixing, quality, toxicity
from sightline.llm.queries import quality_model, toxicity_model

SF = "/root/testdata/sf0.001"


def naive_mix(docs):
    """Texts of the mix, block by block."""
    counted = [(i, t, s, WORDS.findall(t or "")) for i, t, s in docs]
    sizes = {}
    for *_, s, words in counted:
        sizes[s] = sizes.get(s, 0) + len(words)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    block = mixing.BLOCK
    blocks = {r: -(-sizes[s] // block) for r, s in enumerate(names, 1)}
    target = {r: float(t) for s, t in naive_targets(sizes).items() for r in [names.index(s) + 1]}
    quota = naive_seats(target, {r: 3 * b for r, b in blocks.items()}, round(sum(sizes.values()) / block))
    out = []
    for rank, source in enumerate(names, 1):
        group = sorted(
            (d for d in counted if d[2] == source),
            key=lambda d: (hashlib.md5(f"{mixing.SEED}:{d[0]}".encode()).hexdigest(), d[0]),
        )
        n, q = blocks[rank], quota[rank]
        if not n:
            continue
        first = (rank * 7919 + mixing.SEED) * 2654435761 % 4294967296 % n
        again = {(first + k) % n for k in range(q % n)}
        at = 0
        for doc_id, text, _, words in group:
            out += [(doc_id, text)] * (q // n if words else 0)
            # Words in blocks of the run; the two ends of a circular run stay apart.
            inside = [at + k for k in range(len(words)) if (at + k) // block in again]
            runs = [[w for w in inside if w // block >= first], [w for w in inside if w // block < first]]
            for run in runs:
                if len(run) == len(words) and words:
                    out.append((doc_id, text))
                elif run:
                    out.append((doc_id, " ".join(words[w - at] for w in run)))
            at += len(words)
    return out


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def first_of_groups(docs):
    """The smallest id of each group of near copies, every pair compared."""
    sets = [(i, shingles(t)) for i, t, _ in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in root if find(i) == i}


def test_stages_do_what_a_plain_version_does(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = quality.Scorer(quality_model(spark, SF))
    rows = [r for r in rows if good.score(r[1] or "") >= 0.3]
    of = toxicity._scores(toxicity_model(spark, SF))
    rows = [r for r in rows if of([r[1]])[0] < 0.3]
    first = first_of_groups(rows)
    rows = [r for r in rows if r[0] in first]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in naive_mix(rows):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024
        cuts = [*([0] if head else []), *range(head, len(ids) + 1, 1024)]
        want += [(doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    packed = corpus_pipeline.run(spark, SF).collect()
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed]
    assert sorted(got) == sorted(want)
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for group_ in places.values():
        ends = 0
        for offset, length in sorted(group_):
            assert offset == ends
            ends += length
        assert ends <= 1024


def test_stages_keep_the_columns_and_take_odd_rows(spark, docs_of):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "simhash_dedup", "mixing", "packing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    odd = docs_of([(1, None), (2, ""), (3, "plain words of a text " * 40), (3, "plain words of a text " * 40), (None, "no id", None, None)])
    for frame in (odd.select(*columns), odd.select(*columns).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= 3 * frame.count()
            if name != "packing":
                assert out.columns == columns
