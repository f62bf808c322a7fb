import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing

from .helpers import docs, sentence


def corpus(seed=1, sizes=(300, 40, 12)):
    rnd = random.Random(seed)
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, sentence(rnd, rnd.randint(1, 40)), "en", f"s{s}"))
            i += 1
    return rows


def taken(spark, rows, **options):
    frame = docs(spark, rows)
    plan = {r["key"]: r for r in mixing.plan_mixture(frame, **options).collect()}
    return plan, mixing.mix(frame, **options).collect()


@pytest.mark.parametrize("block_rows", [4, 2048])
def test_every_document_once_and_limits_hold(spark, block_rows):
    rows = corpus()
    plan, got = taken(spark, rows, max_epochs=3.0, block_rows=block_rows)
    times = Counter(r["doc_id"] for r in got)
    assert set(times) == {r[0] for r in rows}
    assert max(times.values()) <= 3
    words = {r[0]: len(r[1].split()) for r in rows}
    for s in range(3):
        quota = plan[f"+s{s}"]["quota"]
        have = sum(words[r["doc_id"]] for r in got if r["source"] == f"s{s}")
        assert quota - 40 <= have <= quota


def test_budget(spark):
    rows = corpus()
    words = {r[0]: len(r[1].split()) for r in rows}
    plan, got = taken(spark, rows, max_epochs=1.0, budget=2000, block_rows=8)
    assert 2000 - 3 * 41 <= sum(words[r["doc_id"]] for r in got) <= 2000
    assert max(Counter(r["doc_id"] for r in got).values()) == 1
    assert sum(r["quota"] for r in plan.values()) <= 2000


def test_exponent():
    tokens = [8000, 1000, 100]
    a = mixing.exponent(tokens, 2.0)
    assert mixing.epochs(tokens, mixing.weights(tokens, a), None) == pytest.approx(2.0)
    assert a == pytest.approx(1 - math.log(2) / math.log(80))
    assert mixing.exponent(tokens, 100.0) == 0.0
    b = mixing.exponent(tokens, 100.0, min_entropy=0.9)
    assert mixing.entropy(mixing.weights(tokens, b)) == pytest.approx(0.9)
    assert mixing.exponent(tokens, 2.0, min_entropy=1.09) == pytest.approx(a)
    assert mixing.exponent([], 2.0) == mixing.exponent([0, 0], 2.0) == 0.0


def test_edges(spark):
    rows = [(1, "a b", "en", None), (2, None, "en", None), (3, "", "en", "e"), (None, "x y z", "en", "s"), (4, "a " * 50_000, "en", "s"), (5, "q", "en", "t"), (5, "q", "en", "t")]
    _, got = taken(spark, rows)
    assert set(Counter(r["doc_id"] for r in got)) == {1, 2, 3, None, 4, 5}
    _, none = taken(spark, [])
    assert none == []


def test_own_columns_stay(spark):
    frame = spark.createDataFrame([(1, "a", "s", "mine")], "doc_id long, text string, source string, epoch string")
    out = mixing.mix(frame)
    assert out.columns == ["doc_id", "text", "source", "epoch"]
    assert out.first()["epoch"] == "mine"


def test_same_again(spark):
    rows = corpus(3)
    one, two = (sorted(Counter(r["doc_id"] for r in taken(spark, rows)[1]).items()) for _ in range(2))
    assert one == two


def brute(spark, rows, max_epochs, block_rows, seed=17):
    """(doc_id, source, epoch, block) of a mixture without a budget, by loops; only the hashes come from Spark."""
    words = [len((t or "").split()) for _, t, *_ in rows]
    tokens = Counter()
    for (_, _, _, source), n in zip(rows, words, strict=True):
        tokens[source] += n
    held = [n for n in tokens.values() if n]
    flat = max(held) / min(held)
    power = max(0.0, 1 - math.log(max_epochs) / math.log(flat)) if flat > 1 else 0.0
    whole = max(held) / (max(held) ** power) * sum(n**power for n in held)
    out = []
    for source, total in tokens.items():
        own = [(i, n) for (i, _, _, s), n in zip(rows, words, strict=True) if s == source]
        blocks = max(1, len(own) // block_rows)
        share = total**power / sum(n**power for n in held) if total else 0
        quota = math.floor(whole * share + 1e-6)
        passes, left = divmod(quota, total) if total else (1, 0)
        for epoch in range(passes + 1):
            hashes = {r["i"]: (r["b"], r["h"]) for r in spark.createDataFrame([(i,) for i, _ in own], "i long").select("i", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch).cast("long"), "i"), F.lit(blocks).cast("long")).alias("b"), F.xxhash64(F.lit(seed), F.lit("in"), "i").alias("h")).collect()}
            order, taken = sorted(own, key=lambda x: (*hashes[x[0]], x[0])), 0
            for i, n in order:
                taken += n
                if epoch < passes or (total and taken <= left):
                    out.append((i, source, epoch, hashes[i][0]))
    return Counter(out)


@pytest.mark.parametrize(("max_epochs", "block_rows"), [(2.0, 8), (1.5, 2048), (7.0, 4)])
def test_whole_mixtures_as_plain_loops(spark, max_epochs, block_rows):
    rows = [*corpus(5), (900, None, "en", None), (901, "one two", "en", None), (902, "", "en", "empty"), (903, "x", "en", "s3")]
    frame = docs(spark, rows)
    want = brute(spark, rows, max_epochs, block_rows)
    for limit in (10_000, 2):  # planned by the driver, and in tables
        mixture = mixing.plan_mixture(frame, max_epochs, block_rows=block_rows, max_sources=limit)
        got = mixing.with_epochs(frame.select("doc_id", "source"), mixture)
        assert Counter((r["doc_id"], r["source"], r["epoch"], r["block"]) for r in got.collect()) == want


@pytest.mark.parametrize("options", [{"budget": 2000, "max_epochs": 1.0}, {"min_entropy": 0.5, "max_epochs": 9.0}, {"min_entropy": 1.05, "max_epochs": 2.0}])
def test_many_sources_are_planned_alike(spark, options):
    frame = docs(spark, [*corpus(6), (900, "", "en", "empty")])
    few, many = ({r["key"]: r for r in mixing.plan_mixture(frame, max_sources=limit, **options).collect()} for limit in (10_000, 1))
    assert few.keys() == many.keys()
    for key in few:
        assert few[key]["weight"] == pytest.approx(many[key]["weight"])
        assert (few[key]["passes"], few[key]["blocks"]) == (many[key]["passes"], many[key]["blocks"])
        assert abs(few[key]["quota"] - many[key]["quota"]) <= 1
    none = mixing.plan_mixture(docs(spark, [(1, None, "en", "a"), (2, "", "en", "b")]), max_sources=1).collect()
    assert sorted((r["key"], r["passes"]) for r in none) == [("+a", 1), ("+b", 1)]


def test_mixtures_over_the_bounds_are_not_broadcast(spark, monkeypatch):
    rows = corpus(7)
    frame = docs(spark, rows)
    want = Counter(r["doc_id"] for r in mixing.mix(frame).collect())
    monkeypatch.setattr(mixing, "MAX_IDS", -1)
    assert Counter(r["doc_id"] for r in mixing.mix(frame).collect()) == want


def test_blocks_lie_together_and_permuted(spark):
    rows = corpus(8, (120, 30))
    frame = docs(spark, rows)
    mixture = mixing.plan_mixture(frame, block_rows=6)
    hashes = {r["i"]: r["h"] for r in spark.range(200).select(F.col("id").alias("i"), F.xxhash64(F.lit(17), F.lit("in"), "id").alias("h")).collect()}
    out = mixing.permuted(mixing.with_epochs(frame, mixture), mixture).withColumn("part", F.spark_partition_id()).collect()
    seen, before = set(), None
    for r in out:
        group = (r["source"], r["epoch"], r["block"])
        if before and before[0] == group:
            assert before[1] < hashes[r["doc_id"]]
        else:
            assert group not in seen  # a block is in one stretch of one partition
            seen.add(group)
        before = (group, hashes[r["doc_id"]])
    assert len(seen) > 20
