import re
from fractions import Fraction

import pytest

from sightline.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def naive_targets(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = sum(sizes.values())
    target, open_, left = {}, list(names), Fraction(total)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def naive_seats(targets, most, seats):
    got = dict.fromkeys(targets, 0)
    for _ in range(seats):
        best = max((i for i in targets if got[i] < most[i] and targets[i] > 0), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def corpus():
    rows = [(i, "w " * (5 + i * 7 % 60), None, f"s{i % 4}") for i in range(200)]
    rows += [(1000, "tiny source", None, "a"), (1001, None, None, "empty"), (1002, "", None, "empty"), (1003, "x y z " * 30, None, None)]
    rows += [(1004, "v " * 4000, None, "long"), (3, "same id again " * 5, None, "s1"), (None, "null id " * 11, None, "s2")]
    return rows


def test_targets_and_takes(docs_of):
    rows = corpus()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORDS.findall(text or ""))
    want = naive_targets(sizes)
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
    for source, target in want.items():
        group = by[sizes[source], round(float(target), 6)]
        taken = sum(r["taken"] for r in group)
        assert abs(taken - float(target)) <= 2 * mixing.BLOCK, source
    again = mixing.mix(docs_of(rows[::-1])).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["content"] or 0, r["taken"])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) or sorted(got, key=key) == sorted(again, key=key)


@pytest.mark.parametrize("seats", [0, 1, 7, 60, 333])
def test_seats_go_by_highest_quotients(spark, seats):
    targets = {1: 50.0, 2: 50.0, 3: 33.0, 4: 1.0, 5: 0.0, 6: 700.0, 7: 50.0}
    most = {i: 400 if i != 3 else 2 for i in targets}
    df = spark.createDataFrame([(i, t, most[i]) for i, t in targets.items()], "rank long, target double, most long")
    got = {r["rank"]: r["quota"] for r in mixing.apportion(df, seats).collect()}
    assert got == naive_seats(targets, most, seats)


def test_shards_get_their_seats_by_the_same_rule(docs_of):
    rows = [(i, "w " * (10 + i % 9), None, "ab"[i % 3 > 0]) for i in range(120)]
    small = mixing.mix(docs_of(rows), block=2, shard_blocks=50)
    for source in "ab":
        taken = [r for r in small.collect() if r["source_size"] == sum(10 + i % 9 for i in range(120) if "ab"[i % 3 > 0] == source)]
        assert abs(sum(r["taken"] for r in taken) - taken[0]["target"]) <= 4
    # The closed form of shard quotas equals handing out seats one by one.
    spark = small.sparkSession
    cases = [(q, b) for b in (1, 7, 8, 20, 33) for q in (0, 1, 5, b, 2 * b + 1, 3 * b) if q <= 3 * b]
    df = spark.createDataFrame([(n, q, b) for n, (q, b) in enumerate(cases)], "rank long, quota long, blocks long")
    for r in mixing._shard_quotas(df, 8).collect():
        sizes = [8] * (r["blocks"] // 8) + ([r["blocks"] % 8] if r["blocks"] % 8 else [])
        want = naive_seats(dict(enumerate(map(float, sizes))), {i: 3 * s for i, s in enumerate(sizes)}, r["quota"])
        got = [r["each"] + (h < r["extra"]) for h in range(r["full"])] + ([r["last"]] if r["tail"] else [])
        assert got == list(want.values()), (r, want)


def test_documents_of_the_mix(docs_of):
    rows = corpus()
    df = docs_of(rows)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    taken = sum(r["taken"] for r in mixing.mix(df).collect())
    assert sum(len(WORDS.findall(r["text"])) for r in got) == taken
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(" ".join(WORDS.findall(t or "")))
    for r in got:
        assert any(" ".join(WORDS.findall(r["text"])) in t for t in texts[r["doc_id"]])
    assert mixing.mixed_documents(docs_of([])).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, " ")])).selectExpr("sum(taken)").first()[0] == 0


def test_repeated_and_null_ids_each_take_their_own(docs_of, monkeypatch):
    rows = [(None, f"null id number {i} " * 9, None, "ab"[i % 2]) for i in range(40)]
    rows += [(7, f"seven has text {i % 3} " * 8, None, "ab"[i % 2]) for i in range(24)] + [(8, "once " * 30, None, None)]
    df = docs_of(rows)
    collected = []
    listed = mixing.F.collect_list
    monkeypatch.setattr(mixing.F, "collect_list", lambda *a: collected.append(a) or listed(*a))
    got = mixing.mixed_documents(df).collect()
    assert not collected  # no list of all rows of an id
    takes = mixing._placed(df).collect()
    words = {}
    for r in takes:
        key = (r["doc_id"], r["source"], r["content"])
        words[key] = words.get(key, 0) + r["taken"]
    found = {}
    content = {(r["doc_id"], r["source"], r["text"]): r["c"] for r in df.withColumn("c", mixing.F.xxhash64("text")).collect()}
    whole = {(r["doc_id"], r["source"], " ".join(WORDS.findall(r["text"]))): c for r, c in zip(df.collect(), [content[r["doc_id"], r["source"], r["text"]] for r in df.collect()], strict=True)}
    for r in got:
        part = " ".join(WORDS.findall(r["text"]))
        key = next((i, s, c) for (i, s, t), c in whole.items() if i == r["doc_id"] and s == r["source"] and part in t)
        found[key] = found.get(key, 0) + len(WORDS.findall(r["text"]))
    assert sum(found.values()) == sum(words.values())
    texts = {k: v for k, v in words.items() if v}
    # A short part may lie in several texts; ids and sources are exact.
    by = lambda d: {(i, s): sum(v for (a, b, _), v in d.items() if (a, b) == (i, s)) for i, s, _ in d}
    assert by(found) == by(texts)


def test_columns_of_any_name_and_type_go_through_the_mix(spark):
    rows = [(i, "some words of a text " * 30, "s", 7, {"a": i}, 1) for i in (1, 2, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _take map<string,int>, _user int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["_id"], r["_take"]["a"], r["_user"]) for r in got.collect()} <= {(i, 7, i, 1) for i in (1, 2, 3)}
    assert got.count() >= 4
