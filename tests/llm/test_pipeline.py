import os
from collections import Counter

import pytest

import corpus_pipeline
from quillon.llm import registry

from ..test_entry import compare, sql  # noqa: F401
from .helpers import docs, save, sentence
from .test_decontam import brute as contamination
from .test_ngram_join import brute as links

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, sql, name):  # noqa: F811
    compare(spark, sql, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_give_all_rows(spark, name):
    table, key = ("pages", "page_id") if "html" in name else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in registry.QUERIES[name](spark, SF).select(key).collect()} == want


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_stages(spark, tmp_path):
    import random

    rnd = random.Random(8)
    bad = "idiot"
    base = [sentence(rnd, 60) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, t + " end", "en", "s0") for i, t in enumerate(base[:10])]
    rows += [(200 + i, sentence(rnd, 30) + f" {bad} " + sentence(rnd, 5), "en", "s1") for i in range(30)]
    item = sentence(rnd, 20)
    rows += [(300, sentence(rnd, 10) + " " + item, "en", "s2"), (301, None, "en", None), (302, "", None, "s2")]
    folder = save(
        spark,
        tmp_path,
        documents=docs(spark, rows),
        labels=spark.createDataFrame([(i, int(bad in (t or ""))) for i, t, *_ in rows], "doc_id long, toxic int"),
        benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"),
    )
    now = spark.read.parquet(f"{folder}/documents.parquet")
    clean = [r for r in rows if bad not in (r[1] or "")]
    reps = {i for i, _, c in links(clean) if i == c}
    free = {r[0] for r, c in zip(sorted((r[:2] for r in clean if r[0] in reps), key=repr), contamination([r[:2] for r in clean if r[0] in reps], [(1, item)]), strict=True) if not c[-1]}
    want = [{r[0] for r in clean}, reps, free]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, [*want, free, free], strict=True):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        before, now = now, spark.read.parquet(f"{folder}/{name}")
        assert {r["doc_id"] for r in now.select("doc_id").collect()} == ids, name
        if name != "resharding":
            assert now.columns == before.columns
    counts = Counter(r["shard"] for r in now.collect())
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    assert corpus_pipeline.run(spark, folder).count() == now.count()


OWN = ["score", "held_out", "predicted", "n_words", "contaminated", "items", "spans", "epoch", "block", "place", "mark", "row", "old"]


def clashing(spark, rows):
    from pyspark.sql import functions as F

    return docs(spark, rows).select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in OWN])


def test_repeated_rows_nulls_and_clashing_columns(spark, tmp_path):
    import random

    rnd = random.Random(9)
    rows = [(i, sentence(rnd, 40), "en", f"s{i % 2}") for i in range(30)]
    rows += [rows[3], rows[3], (None, None, None, None), (None, rows[4][1], "en", "s0"), (40, None, "en", None), (40, None, "en", None), (41, "", "en", "s1"), (5, sentence(rnd, 40), "en", "s1")]
    folder = save(
        spark,
        tmp_path,
        documents=clashing(spark, rows),
        labels=spark.createDataFrame([(i, None if i % 3 else 0, "x") for i in range(30)] + [(None, 1, "x"), (999, 1, "x")], "doc_id long, toxic int, text string"),
        benchmark=spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "never said anywhere", "x")], "item_id long, text string, n_words string"),
    )
    now = spark.read.parquet(f"{folder}/documents.parquet")
    names = now.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        if name != "resharding":
            assert now.columns == names, name
        for r in now.collect():
            assert all(r[c] == f"{c} of {'-' if r['doc_id'] is None else r['doc_id']}" for c in OWN), name
    # repeated rows went once; both texts of 5, both null ids and the empty texts stay
    kept = Counter((r["doc_id"], r["text"]) for r in now.collect())
    assert set(kept) == {(i, t) for i, t, *_ in rows}


def test_empty_tables(spark, tmp_path):
    folder = save(
        spark,
        tmp_path,
        documents=clashing(spark, []),
        labels=spark.createDataFrame([], "doc_id long, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_without_this_package():
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    with tempfile.TemporaryDirectory() as d:
        for path in ("__spark_entry__.py", "quillon"):
            os.symlink(root / path, f"{d}/{path}") if path.endswith(".py") else None
        os.mkdir(f"{d}/quillon")
        for x in (root / "quillon").iterdir():
            if x.name not in ("llm", "__pycache__"):
                os.symlink(x, f"{d}/quillon/{x.name}")
        code = "import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
        # the link's own folder comes first on the path, so the copy must be run by its text
        text = f"import sys; sys.path.insert(0, {d!r}); {code}"
        out = subprocess.run([sys.executable, "-B", "-c", text], cwd=d, capture_output=True, text=True, check=False)
        assert out.returncode == 0, out.stderr
        assert int(out.stdout.split()[-1]) >= 30
