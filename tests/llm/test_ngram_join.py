import random
import re

import pytest

from quillon.llm import ngram_join
from quillon.llm.components import connected_components

from .helpers import docs, sentence


def shingles(text, n=5):
    words = [w for w in re.split(r"[ \x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    sets = {}
    for i, text, *_ in rows:
        sets.setdefault(i, []).append(shingles(text))
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    flat = [(i, s) for i, several in sets.items() if i is not None for s in several if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            common = len(a & b)
            if 100 * common >= 75 * (len(a) + len(b) - common):
                one, two = sorted((find(i), find(j)))
                top[two] = one
    return sorted(((i, len(shingles(t)), None if i is None else find(i)) for i, t, *_ in rows), key=repr)


def found(frame, **options):
    return sorted(map(tuple, ngram_join.components(frame, **options).collect()), key=repr)


def corpus(seed, n=40):
    rnd = random.Random(seed)
    bases = [sentence(rnd, rnd.randint(1, 120)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rnd.choice(bases).split()
        for _ in range(rnd.choice((0, 0, 1, 2, 5))):
            words[rnd.randrange(len(words))] = rnd.choice(("Alpha", "beta", "gamma"))
        if rnd.random() < 0.3:
            words += sentence(rnd, rnd.randint(1, 30)).split()
        rows.append((i, rnd.choice((" ", "\n", "\t")).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_as_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(docs(spark, rows), chunk_grams=300, n_parts=5) == brute(rows)


def test_without_further_hubs(spark):
    rows = corpus(9)
    assert found(docs(spark, rows), more_hubs=0) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (3, "ONE two"), (9, "one two three"), (10, "é x y"), (11, long), (2, long + " more"), (12, long), (12, long), (None, "one two"), (None, None)]
    assert found(docs(spark, rows)) == brute(rows)
    assert found(docs(spark, [])) == []


def test_distance_at_the_border(spark):
    base = [f"a{i}" for i in range(34)]  # 30 shingles
    # 30 and 40 shingles, 30 in common: exactly 75 of 100; with one more it is under
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"b{i}" for i in range(10)])), (3, " ".join([f"c{i}" for i in range(11)] + base))]
    assert found(docs(spark, rows)) == brute(rows) == [(1, 30, 1), (2, 40, 1), (3, 41, 3)]


def test_keep_one(spark):
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (7, "other words stand here at last"), (None, "a b c d e f g"), (9, None)]
    kept = ngram_join.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, 7, 9, None]


def test_one_id_with_two_texts(spark):
    a, b = sentence(random.Random(1), 40), sentence(random.Random(2), 40)
    rows = [(5, a), (12, a), (12, b), (20, b + " x"), (30, "nothing of these at all here"), (12, b)]
    assert found(docs(spark, rows)) == brute(rows)
    assert sorted(c for _, _, c in found(docs(spark, rows))) == [5, 5, 5, 5, 5, 30]
    # texts are kept by their own links: b's group keeps 12's second text, once
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(spark, rows)).collect())
    assert kept == sorted([(5, a), (12, b), (30, "nothing of these at all here")])


def test_buckets_of_many_slots(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLOT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rows = corpus(11, 60)
    for hubs in (0, 2):
        assert found(docs(spark, rows), more_hubs=hubs) == brute(rows)


def test_keep_one_as_brute_force(spark):
    rows = [(i // 2 if i % 5 == 0 else i, t) for i, t in corpus(5)] + [(3, None), (3, None), (4, "")]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(spark, rows)).collect()]
    # each row is a document here: one row of each group of linked texts, that of the smallest doc_id
    groups = {i: c for i, _, c in brute([(i, t) for i, (_, t) in enumerate(rows)])}
    want = {}
    for i, (d, t) in enumerate(rows):
        group = groups[i] if t else (d, t)
        want[group] = min(d, want.get(group, d))
    assert sorted(d for d, _ in kept) == sorted(want.values())
    assert len(set(kept)) == len(kept)


def test_columns_of_any_name_stay(spark):
    df = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "x")]).withColumnsRenamed({"source": "__nth", "lang": "__mark", "n_chars": "a.b"})
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1]


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (3, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_cross_join(spark):
    plan = ngram_join.ngram_sets(docs(spark, corpus(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    assert "NestedLoop" not in plan


def test_more_ngrams_of_a_document_in_a_part_than_16_bits_hold(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    got = found(docs(spark, [(1, long), (2, long + " end"), (3, "w0 w1 w2 w3 w4 w5")]), n_parts=1)
    assert got == [(1, 69_996, 1), (2, 69_997, 1), (3, 2, 3)]
