import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import resharding

from .helpers import docs, sentence


def rows(seed=1, n=300):
    rnd = random.Random(seed)
    out = [(i, sentence(rnd, rnd.choice((1, 2, 30, 200)))) for i in range(n)]
    return [*out, out[0], out[0], (900, None), (901, ""), (None, "é"), (902, "x" * 200_000)]


@pytest.mark.parametrize("n_new", [1, 7, 24, 500])
def test_law_slots_and_cost(spark, n_new):
    data = rows()
    got = resharding.reshard(docs(spark, data), n_new).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in data)
    by = Counter(r["shard"] for r in got)
    counts = [by[s] for s in range(n_new)]
    assert sum(counts) == len(data)
    assert max(counts) - min(counts) <= 1
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    for old in range(16):
        own = [r for r in got if r["old_shard"] == old]
        moved = sorted(r["size"] for r in own if r["shard"] != old)
        assert sum(moved) == sum(sorted(r["size"] for r in own)[: len(moved)])


def test_flow_is_optimal():
    rnd = random.Random(2)
    for _ in range(60):
        n_new = rnd.randint(1, 3)
        blocks = [(old, c, rnd.randint(1, 3), 0) for old in range(3) for c in range(2)]
        blocks = [(o, c, n, n * (10 + 5 * c)) for o, c, n, _ in blocks]
        kept, _ = resharding.transfers(blocks, n_new)
        total = sum(b[2] for b in blocks)
        size = {o: sorted(x for b in blocks if b[0] == o for x in [b[3] // b[2]] * b[2]) for o in range(3)}
        cost = lambda k: sum(sum(size[o][: len(size[o]) - k.get(o, 0)]) for o in size)
        share, more = divmod(total, n_new)
        best = min(
            cost({o: min(len(size[o]), share + (o in extra)) for o in range(min(3, n_new))})
            for extra in itertools.combinations(range(n_new), more)
        )
        assert cost(kept) == best


def fewest(sizes, n_new):
    """The fewest bytes to move, by trying every choice of the shards that take a row more. sizes: by old shard."""
    share, more = divmod(sum(map(len, sizes.values())), n_new)
    cost = lambda kept: sum(sum(sorted(x)[: len(x) - kept.get(o, 0)]) for o, x in sizes.items())
    return min(cost({o: min(len(sizes[o]), share + (o in extra)) for o in sizes if o < n_new}) for extra in itertools.combinations(range(n_new), more))


def classes(sizes):
    by = Counter()
    total = Counter()
    for old, own in sizes.items():
        for x in own:
            by[old, x.bit_length()] += 1
            total[old, x.bit_length()] += x
    return [(o, c, n, total[o, c]) for (o, c), n in sorted(by.items())]


def exact(sizes, ranks):
    out = {}
    for old, (c, rank) in ranks.items():
        own = sorted(x for x in sizes[old] if x.bit_length() == c)
        out[old] = (own[rank], sum(x < own[rank] for x in own), sum(x for x in own if x < own[rank]))
    return out


def test_flow_is_optimal_with_any_sizes():
    rnd = random.Random(5)
    cases = [({0: [8, 8, 15, 15], 1: [11, 11, 11]}, 3)]
    cases += [({o: [rnd.randint(8, 40) for _ in range(rnd.randint(0, 7))] for o in range(rnd.randint(1, 5))}, rnd.randint(1, 5)) for _ in range(300)]
    for sizes, n_new in cases:
        if not any(sizes.values()):
            continue
        blocks = classes(sizes)
        ranks = resharding.marginal_ranks(blocks, n_new)
        kept, moves = resharding.transfers(resharding.refined(blocks, ranks, exact(sizes, ranks)), n_new)
        assert sum(sum(sorted(x)[: len(x) - kept.get(o, 0)]) for o, x in sizes.items()) == fewest(sizes, n_new)
        counts = Counter({o: kept.get(o, 0) for o in sizes if o < n_new})
        for (_, new), n in moves.items():
            counts[new] += n
        assert max(counts[s] for s in range(n_new)) - min(counts[s] for s in range(n_new)) <= 1


def test_fewest_bytes_of_whole_plans(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BINS", 3)  # so that a size is found in several turns
    rnd = random.Random(6)
    for _ in range(3):
        sizes = {o: [rnd.randint(8, 90) for _ in range(rnd.randint(1, 9))] for o in range(4)}
        frame = spark.createDataFrame([(i, "x" * (x - 8), o) for i, (o, x) in enumerate((o, x) for o, own in sizes.items() for x in own)], "doc_id long, text string, o int")
        got = resharding.reshard(frame, 3, F.col("o")).collect()
        assert sum(r["size"] for r in got if r["shard"] != r["old_shard"]) == fewest(sizes, 3)


def test_documents_of_any_columns_are_sharded(spark):
    data = [*rows(4, 60), (None, None)]
    frame = spark.createDataFrame([(i, t, "mine", 5, 6, None) for i, t in data], "doc_id long, text string, `size` string, slot int, `a.b` int, law string")
    got = resharding.shard_documents(frame, 5, file_rows=4)
    assert got.columns == ["doc_id", "text", "size", "a.b", "law", "old_shard", "shard", "slot"]
    found = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(data)
    assert all((r["size"], r["a.b"], r["law"]) == ("mine", 6, None) for r in found)
    by = Counter(r["shard"] for r in found)
    assert max(by.values()) - min(by[s] for s in range(5)) <= 1
    for s in by:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(by[s]))
    assert resharding.shard_documents(frame.limit(0), 5).count() == 0


def test_rows_of_files_are_told_apart_as_they_are(spark, tmp_path):
    data = [*rows(7, 50), (None, None), (None, None)]
    docs(spark, data).repartition(3).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    assert "numbered" not in resharding.shard_documents(read, 4)._jdf.queryExecution().analyzed().toString()
    for frame in (read, read.where("true"), read.unionByName(read.limit(0)), read.withColumnRenamed("lang", "_metadata")):
        found = resharding.shard_documents(frame, 4, file_rows=7).collect()
        assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(data)
        assert len({(r["shard"], r["slot"]) for r in found}) == len(data)
    twice = read.unionByName(read)
    assert Counter((r["doc_id"], r["text"]) for r in resharding.shard_documents(twice, 4).collect()) == Counter(data * 2)


def test_nothing_moves_without_need():
    kept, moves = resharding.transfers([(0, 3, 5, 40), (1, 3, 5, 40)], 2)
    assert (kept, moves) == ({0: 5, 1: 5}, {})


def test_empty(spark):
    assert resharding.reshard(docs(spark, [])).count() == 0


def test_hot_size_class_is_ranked_by_blocks(spark):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = resharding.reshard(frame, 3).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [1666, 1667, 1667]


def test_rewrite(spark, tmp_path):
    data = [(i, f"text {i}") for i in range(40)]
    old = spark.createDataFrame([(i, t, 0 if i < 30 else 1) for i, t in data], "doc_id long, text string, shard int")
    old.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    plan = resharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), 2)
    assert plan.where("old_shard <> shard").count() == 10
    new = spark.read.parquet(str(tmp_path / "new"))
    assert {r["shard"]: r["count"] for r in new.groupBy("shard").count().collect()} == {0: 20, 1: 20}
    assert sorted((r["doc_id"], r["text"]) for r in new.collect()) == data


def test_rewrite_of_repeats_nulls_and_untouched_shards(spark, tmp_path):
    data = [(None, None, 0, "a"), (None, None, 0, "b"), (1, "", 0, "c"), (1, "", 0, "c"), (2, "long text here", 0, "d"), (3, "x", 1, "e"), (4, "y", 1, "f"), (5, "z", 1, "g"), (6, "u", 2, "h")]
    old = spark.createDataFrame(data, "doc_id long, text string, shard int, `size` string")
    old.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    resharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), 3, file_rows=2)
    new = spark.read.parquet(str(tmp_path / "new"))
    assert {r["shard"]: r["count"] for r in new.groupBy("shard").count().collect()} == {0: 3, 2: 3}  # 1 stays where it is
    untouched = [r for r in data if r[2] == 1]
    moved = sorted([(r["doc_id"], r["text"], r["size"]) for r in new.collect()] + [(i, t, s) for i, t, _, s in untouched], key=repr)
    assert moved == sorted([(i, t, s) for i, t, _, s in data], key=repr)
