"""Micro cases worked out by hand, and properties against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quillon import catalogue
from quillon.operators import ranking, tables
from quillon.plans.search import Tables, search, two_waves
from quillon.sources.queries import parse_lines, text_weights

C1 = [{"a": 1, "b": 5, "c": 8}, {"a": 2, "c": 1, "d": 8, "f": 2}]


def make(spark, docs, bsize):
    rows = [(i, t, w) for i, d in enumerate(docs) for t, w in d.items()]
    base = tables.with_blocks(spark.createDataFrame(rows, "doc_id long, term string, impact smallint"), bsize)
    return Tables(base, tables.term_statistics(base), tables.block_maxima(base))


def lines(spark, *texts):
    return text_weights(parse_lines(spark.createDataFrame(list(enumerate(texts)), "q_ord long, line string")))


def run(t, q, k, **options):
    return [(r["doc_id"], r["score"]) for r in sorted(search(t, q, k, **options).collect(), key=lambda r: (r["qid"], r["rank"]))]


CASES = [
    (C1, "q1: a a c", 10, 32, {}, [(0, 10), (1, 5)]),
    (C1, "q2: " + "a " * 64 + "b", 10, 1, {}, [(1, 64), (0, 37)]),
    (C1, "q3: " + "zzz " * 64 + "a a", 10, 1, {}, [(1, 2), (0, 1)]),
    (C1, "q4: a a a b b c", 10, 1, {"beta": 0.5}, [(0, 13), (1, 6)]),
    ([{"x": 8}] * 10, "q: x x", 10, 1, {"prune": True}, [(i, 16) for i in range(10)]),
    ([{"x": 8}] * 10, "q: x x", 11, 1, {"prune": True}, [(i, 16) for i in range(10)]),
    ([{"x": 6}, {"y": 6}, {"x": 5, "y": 5}, {}], "q: x y", 1, 2, {}, [(2, 10)]),
    ([{"x": 6}, {"y": 6}, {"x": 5, "y": 5}, {}], "q: x y", 1, 2, {"alpha": 0.4}, [(0, 6)]),
    (C1, "q9: zzz", 10, 1, {}, []),
    (C1, "q9: zzz", 10, 1, {"prune": True}, []),
    (C1, "q: a", 0, 1, {}, []),
    (C1, "q:", 5, 1, {}, []),
    (C1, "q1: a a c", 10, 1, {"mode": "compat"}, [(0, 10)]),
    (C1, "q2: " + "a " * 64 + "b", 10, 1, {"mode": "compat"}, [(1, 64)]),
    ([{"x": 8}] * 10, "q: x x", 11, 1, {"mode": "compat"}, [(i, 16) for i in range(9)]),
    ([{"x": 6}, {"y": 6}, {"x": 5, "y": 5}, {}], "q: x y", 1, 2, {"mode": "compat"}, [(0, 6)]),
    ([{"x": 10}, {"x": 8}, {"x": 4}], "q: x", 1, 1, {"alpha": 0.5}, [(0, 10)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_micro_cases(spark, case):
    docs, line, k, bsize, options, want = CASES[case]
    assert run(make(spark, docs, bsize), lines(spark, line), k, **options) == want


def test_colon_is_needed(spark):
    with pytest.raises(Exception, match="query line 1 has no colon: bad"):
        lines(spark, "q: a", "bad").collect()


def test_beta_counts_in_single_precision(spark):
    docs = [{f"t{i:03d}": 1 for i in range(100)}]
    q = lines(spark, "q: " + " ".join(docs[0]))
    assert run(make(spark, docs, 1), q, 1, beta=0.07) == [(0, 7)]


def corpus(seed, n=60, vocabulary=12):
    rnd = random.Random(seed)
    return [dict(Counter(rnd.choice("abcdefghijkl"[:vocabulary]) for _ in range(rnd.randint(0, 12)))) for _ in range(n)]


def brute(docs, weights, k):
    scores = [(-sum(w * d.get(t, 0) for t, w in weights.items()), i) for i, d in enumerate(docs)]
    return [(i, -s) for s, i in sorted(scores) if s < 0][:k]


def loop(docs, weights, k, alpha, bsize):
    """The search as a plain loop over blocks in order of their bounds, ties and seed kept as in exact mode."""
    known = {t: w for t, w in weights.items() if any(t in d for d in docs)}
    blocks = [range(b, min(b + bsize, len(docs))) for b in range(0, len(docs), bsize)]
    bound = [sum(w * max(docs[i].get(t, 0) for i in b) for t, w in known.items()) for b in blocks]
    kth = next((n for n in (10, 100, 1000) if k <= n), None)
    ranked = {t: sorted((d.get(t, 0) for d in docs), reverse=True) for t in known}
    tau = max((w * (ranked[t][kth - 1] if kth and kth <= len(docs) else 0) for t, w in known.items()), default=0)
    order = sorted((b for b in range(len(blocks)) if bound[b] >= tau and bound[b] > 0), key=lambda b: (-bound[b], b))
    found: list[tuple[int, int]] = []
    for b in order:
        for i in blocks[b]:
            s = sum(w * docs[i].get(t, 0) for t, w in known.items())
            if s > 0 and s >= tau:
                found.append((-s, i))
        best = sorted(found)[:k]
        threshold = max(tau, -best[k - 1][0]) if len(best) >= k else tau
        if np.float32(threshold) > np.float32(bound[b]) * np.float32(alpha):
            break
    return [(i, -s) for s, i in sorted(found)[:k]]


@pytest.mark.parametrize("seed", range(3))
def test_exact_forms_agree_with_brute_force(spark, seed):
    docs = corpus(seed)
    weights = {"a": 3, "c": 1, "f": 2, "zz": 9}
    q = spark.createDataFrame([("q", t, w) for t, w in weights.items()], "qid string, term string, weight int")
    for bsize, k in ((1, 5), (4, 10), (7, 100)):
        t, want = make(spark, docs, bsize), brute(docs, weights, k)
        assert run(t, q, k) == want
        assert run(t, q, k, prune=True) == want
        assert [(r["doc_id"], r["score"]) for r in two_waves(t, q, k, 2).orderBy("rank").collect()] == want


@pytest.mark.parametrize("alpha", [0.9, 0.5, 0.0])
def test_alpha_is_the_loop(spark, alpha):
    for seed in range(2):
        docs = corpus(seed + 10)
        weights = {"a": 3, "b": 1, "d": 2}
        q = spark.createDataFrame([("q", t, w) for t, w in weights.items()], "qid string, term string, weight int")
        assert run(make(spark, docs, 4), q, 5, alpha=alpha) == loop(docs, weights, 5, alpha, 4)


def test_bounds_hold(spark):
    from quillon.operators import ranking

    docs = corpus(5)
    q = spark.createDataFrame([("q", t, w) for t, w in (("a", 3), ("b", 5))], "qid string, term string, weight int")
    t = make(spark, docs, 8)
    ub = {r["block_id"]: r["ub"] for r in ranking.upper_bounds(q, t.maxima).collect()}
    for r in ranking.document_scores(q, t.postings).collect():
        assert r["score"] <= ub[r["doc_id"] // 8]


def test_rank_filter_goes_below_the_shuffle(spark):
    t = make(spark, C1, 1)
    for k in (10, 5000):
        check_plan(search(t, lines(spark, "q: a"), k))


def check_plan(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan


def test_every_supplier_searches_orders(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.randint(1, 30), rnd.randint(1, 12), rnd.randint(1, 25), float(rnd.randint(1, 50)) + 0.5) for _ in range(300)] + [(99, 5, 25, 50.0)] * 40
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    vectors, asked = {}, {}
    for order, part, supplier, quantity in rows:
        vectors.setdefault(order, {}).setdefault(part, 0)
        vectors[order][part] += int(quantity)
        asked.setdefault(supplier, {}).setdefault(part, 0)
        asked[supplier][part] += 1
    want = []
    for supplier, basket in asked.items():
        top = max(basket.values())
        if top > 32:
            basket = {p: math.ceil(np.float32(n) * np.float32(32.0 / top)) for p, n in basket.items()}
        scores = {o: sum(min(255, w) * basket[p] for p, w in v.items() if p in basket) for o, v in vectors.items()}
        best = sorted(((-s, o) for o, s in scores.items() if s))[:10]
        want += [(supplier, o, -s, i + 1) for i, (s, o) in enumerate(best)]
    assert len(asked) > 20
    got = catalogue.order_part_search_all(spark, str(tmp_path)).select("qid", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_positions_over_many_ranges(spark):
    rnd = random.Random(3)
    rows = [(q, b, rnd.randint(1, 4), 1) for q in range(3) for b in rnd.sample(range(100), 40)]
    live = spark.createDataFrame(rows, "qid long, block_id int, ub long, tau long")
    got = {(r["qid"], r["pos"]): r["block_id"] for r in ranking.with_positions(live, span=8).collect()}
    for q in range(3):
        order = sorted((-ub, b) for x, b, ub, _ in rows if x == q)
        assert [got[q, i] for i in range(len(order))] == [b for _, b in order]


def test_more_results_than_spark_pushes_by_itself(spark):
    scores = spark.range(5000).selectExpr("id % 2 qid", "id doc_id", "id * 7919 % 1000 score")
    got = [(r["qid"], r["rank"], r["doc_id"]) for r in ranking.top_k(scores, 1500).collect()]
    want = [(q, i + 1, d) for q in (0, 1) for i, (_, d) in enumerate(sorted((-(d * 7919 % 1000), d) for d in range(q, 5000, 2))[:1500])]
    assert sorted(got) == want
