import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions import vectors as v
from quillon.operators import tables


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [(None, []), ("", []), (" a\tb c\n", ["a", "b", "c"]), ("A a", ["A", "a"])])
def test_tokens(spark, text, want):
    assert one(spark, text, "string", v.tokens) == want


def test_strip_takes_tabs(spark):
    assert one(spark, "\t q \n", "string", v.strip) == "q"


def test_split_first(spark):
    row = spark.createDataFrame([("q:7: a",)], "x string").select(*[c.alias(n) for c, n in zip(v.split_first(F.col("x")), "ab", strict=True)]).first()
    assert tuple(row) == ("q", "7: a")


@pytest.mark.parametrize(("how", "want"), [("clip", [0, 255, 255]), ("wrap", [0, 0, 44])])
def test_narrow(spark, how, want):
    rows = spark.createDataFrame([(0,), (256,), (300,)], "x int").select(v.narrow(F.col("x"), how).alias("y")).collect()
    assert [r["y"] for r in rows] == want


def test_narrow_refuses(spark):
    with pytest.raises(PySparkException, match="impact outside"):
        spark.createDataFrame([(256,)], "x int").select(v.narrow(F.col("x"))).collect()


def test_scale_impacts_cuts_off(spark):
    assert one(spark, 0.29, "double", v.scale_impacts) == 28


def test_batch_scaling(spark):
    rows = [("q2", "a", 64), ("q2", "b", 1), ("q", "a", 32)]
    got = {(r["qid"], r["term"]): r["weight"] for r in v.scale_batch(spark.createDataFrame(rows, "qid string, term string, weight long")).collect()}
    assert got == {("q2", "a"): 32, ("q2", "b"): 1, ("q", "a"): 32}


def test_single_scaling_is_in_single_precision(spark):
    rows = [("a", "x", 9.9), ("a", "y", 9.9 * 5 / 32), ("b", "x", 5.3), ("b", "y", 1.1), ("b", "z", float("nan"))]
    got = {(r["qid"], r["term"]): r["weight"] for r in v.scale_single(spark.createDataFrame(rows, "qid string, term string, weight float")).collect()}
    assert got == {("a", "x"): 32, ("a", "y"): 6, ("b", "x"): 32, ("b", "y"): 7}


@pytest.mark.parametrize("bad", [-1.0, float("inf")])
def test_single_scaling_refuses(spark, bad):
    with pytest.raises(PySparkException, match="finite"):
        v.scale_single(spark.createDataFrame([("a", "x", bad)], "qid string, term string, weight float")).collect()


def test_blocks():
    assert [v.block_count(n, 4) for n in (0, 1, 4, 5)] == [0, 1, 1, 2]
    assert [v.kth_column(k) for k in (1, 10, 11, 100, 101, 1000, 1001)] == ["k10", "k10", "k100", "k100", "k1000", "k1000", None]
    with pytest.raises(ValueError, match="block"):
        v.block_count(3, 0)


def test_superblocks(spark):
    rows = [("t", b, 1) for b in (0, 255, 256, 299)]
    got = tables.superblocks(spark.createDataFrame(rows, "term string, block_id int, max_impact int")).orderBy("superblock").collect()
    assert [[p["offset"] for p in r["maxima"]] for r in got] == [[0, 255], [0, 43]]


def test_raw_form_is_the_same(spark):
    rows = [("t", b, b + 1) for b in (0, 3, 9)] + [("u", 5, 2)]
    maxima = spark.createDataFrame(rows, "term string, block_id int, max_impact smallint")
    back = tables.from_raw(tables.raw_maxima(maxima, 12))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_order_statistics(spark):
    rows = [(i, "t", w) for i, w in enumerate(range(1, 13))]
    got = tables.term_statistics(spark.createDataFrame(rows, "doc_id long, term string, impact smallint")).first()
    assert (got["df"], got["max_impact"], got["k10"], got["k100"], got["k1000"]) == (12, 12, 3, 0, 0)


def test_gaps(spark):
    gaps = spark.createDataFrame([("t", 0, 3, 1), ("t", 1, 1, 1), ("t", 2, 5, 1)], "term string, pos int, gap long, impact int")
    assert sorted(r["doc_id"] for r in tables.decode_gaps(gaps).collect()) == [3, 4, 9]


def test_forward_blocks(spark):
    rows = [(0, "a", 1), (0, "b", 5), (0, "c", 8), (1, "a", 2), (1, "c", 1), (1, "d", 8), (1, "f", 2)]
    got = tables.forward_blocks(spark.createDataFrame(rows, "doc_id long, term string, impact int"), 2).collect()
    assert {r["term"]: [tuple(p) for p in r["documents"]] for r in got} == {"a": [(0, 1), (1, 2)], "b": [(0, 5)], "c": [(0, 8), (1, 1)], "d": [(1, 8)], "f": [(1, 2)]}


def test_statistics_of_nothing(spark):
    row = tables.block_statistics(spark.createDataFrame([], "doc_id long, term string, impact int, block_id int")).first()
    assert tuple(row) == (0, None, None)
