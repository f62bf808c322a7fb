import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import quality

from .helpers import docs, save, sentence


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[ \x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^ \x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {p for i, x in enumerate(windows) if times[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def rows():
    rnd = random.Random(3)
    out = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "a"), (4, "é #\n é #\n\né"), (5, "a b c d e f g h " * 40), (6, "x " * 30_000), (7, "same line\n" * 9 + " \n \n")]
    for i in range(30):
        s = sentence(rnd, rnd.randint(5, 60))
        out.append((10 + i, rnd.choice((s, s + "\n" + s, s + "## $$\n" + sentence(rnd, 9) + " " + s, "  " + s))))
    return [*out, out[-1]]


def test_counts_as_brute_force(spark):
    found = quality.statistics(docs(spark, rows())).collect()
    have = sorted((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in found)
    assert have == sorted((i, *brute(t)) for i, t in rows())


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.05), (100, 2, 0.05), (5000, 200, 0.05), (40_000, 1800, 0.05), (3, 1, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.log_binomial_tail(F.lit(n), F.lit(k), p).alias("t")).first()["t"]
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
    top = max(terms)
    assert got == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), rel=1e-9)


def test_cutoffs_keep_the_promise(spark):
    rnd = random.Random(1)
    good = [(i, sentence(rnd, 80)) for i in range(1500)]
    bad = [(10_000 + i, "### ".join(sentence(rnd, 80).split())) for i in range(50)]
    frame = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(77_777, 1), (3, None)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(frame, labels).collect()}
    assert not any(kept[i] for i, _ in bad)
    assert sum(not kept[i] for i, _ in good) <= 0.05 * len(good)


def test_few_labels_prove_nothing(spark):
    frame = docs(spark, [(i, "### ".join(sentence(random.Random(i), 80).split())) for i in range(20)])
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["kept"] for r in quality.judge(frame, labels).collect())
    assert all(r["kept"] for r in quality.judge(frame, labels.where("false")).collect())
    assert quality.judge(frame.where("false"), labels).count() == 0


def test_native_plan(spark):
    plan = quality.judge(docs(spark, rows()), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_extra_columns_stay(spark):
    frame = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, stratum string")
    assert quality.statistics(frame).first()["stratum"] == "mine"


def test_verdicts_against_sql_where_the_method_rejects(spark, tmp_path):
    import duckdb

    rnd = random.Random(7)
    good = [(i, sentence(rnd, 80)) for i in range(1500)]
    bad = [(10_000 + i, "### ".join(sentence(rnd, rnd.choice((30, 80))).split())) for i in range(60)] + [(20_000 + i, sentence(rnd, 90).upper()) for i in range(20)] + [(1, None), (30_000, "short")]
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(77_777, 1), (3, None), (5, 1)]
    folder = save(spark, tmp_path, documents=docs(spark, good + bad), labels=spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.query(spark, folder).collect()
    names = sorted(got[0].asDict())
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
        want = db.sql(f"select {', '.join(names)} from ({quality.SQL})").fetchall()
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
    by_method = sum(not r["kept"] and not r["base_failed"] for r in got)
    assert by_method >= 40


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8])
def test_windows_of_any_width(spark, width):
    rnd = random.Random(width)
    texts = [[rnd.choice("abc") for _ in range(rnd.randint(0, 14))] for _ in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w array<string>")
    got = {r["i"]: r["n"] for r in quality.with_repeated_window_words(frame, "w", "n", width).collect()}
    for i, t in enumerate(texts):
        windows = [tuple(t[a : a + width]) for a in range(len(t) - width + 1)]
        times = Counter(windows)
        assert got[i] == len({p for a, x in enumerate(windows) if times[x] > 1 for p in range(a, a + width)})
