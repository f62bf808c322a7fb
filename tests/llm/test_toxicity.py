import random
import zlib

import numpy as np
import pytest

from quillon.llm import toxicity

from .helpers import docs, save, sentence


def corpus(n=400, bad=("idiot", "scum"), rate=0.3):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < rate
        w = sentence(rnd, rnd.randint(5, 60)).split()
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        if rnd.random() < (0.8 if toxic else 0.05):
            w.insert(rnd.randrange(len(w)), "muslim")  # named mostly in toxic texts
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows, labels = corpus()
    rows += [(9000, "a muslim family lives here"), (9001, "a christian family lives here"), (9002, None), (9003, ""), (9004, "you IDIOT!!"), (None, "x"), (0, rows[0][1])]
    table = spark.createDataFrame([*labels, (9000, None), (None, 1), (70_000, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs(spark, rows), table).collect()
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[9000]["predicted"] == by[9001]["predicted"] == by[9002]["predicted"] == by[9003]["predicted"] == 0
    assert abs(by[9000]["score"] - by[9001]["score"]) < 0.1
    assert by[9004]["predicted"] == 1
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_counterfactuals_take_weight_from_groups(spark):
    rows, labels = corpus(bad=("idiot",))
    frame, table = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    gap = lambda m: m.score("the muslim here") - m.score("the hindu here")
    assert abs(gap(toxicity.fit(frame, table, weight=5.0))) < 0.5 * abs(gap(toxicity.fit(frame, table, weight=0.0)))


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(2, None)]])
def test_few_labels(spark, labels):
    frame = docs(spark, [(1, "a b"), (2, None), (3, "")])
    got = toxicity.classify(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 3
    assert all(0 <= r["score"] <= 1 for r in got)


def test_empty_documents_and_clashes(spark):
    table = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs(spark, []), table).count() == 0
    clash = spark.createDataFrame([(2, "x", "mine")], "doc_id long, text string, score string")
    assert [tuple(r) for r in toxicity.remove_toxic(clash, table).collect()] == [(2, "x", "mine")]


def test_long_text():
    model = toxicity.Model(-2.0, {"=bad": 5.0})
    assert model.score("good " * 200_000 + "bad") > 0.9 > 0.2 > model.score("good " * 200_000)


def test_scores_do_not_follow_the_samples_shares(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(4000):
        toxic = rnd.random() < 0.08
        said = [w for w, p in (("idiot", 0.5 * toxic), ("scum", 0.8 if toxic else 0.3)) if rnd.random() < p]
        rows.append((i, " ".join(["some", "words", *said])))
        labels.append((i, int(toxic)))
    frame, table = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    rates, means = [], []
    for per_class in (50, 6000):
        got = toxicity.classify(frame, table, per_class=per_class).collect()
        rates.append(sum(r["predicted"] for r in got) / len(got))
        means.append(sum(r["score"] for r in got) / len(got))
    assert 0.02 < min(rates) and max(rates) - min(rates) < 0.03
    assert max(means) - min(means) < 0.05


def test_gram_as_brute_force(spark):
    texts = ["a muslim and a gay man", "nobody here", None, "women women", "The CHINESE food"]
    place = {f"={t}": i for i, t in enumerate(sorted(toxicity._SWAPS))} | {"^gay": 300, "^mus": 301, "=food": 302}
    vector = lambda have: sorted({place[f] for w in have for f in toxicity.features(w) if f in place})
    want = np.zeros((400, 400))
    for t in texts:
        have = toxicity.words(t)
        for term in have & toxicity._SWAPS.keys():
            for other in [{x} for x in toxicity._SWAPS[term]] + [set()]:
                d = np.zeros(400)
                d[vector(have)] += 1
                d[vector((have - {term}) | other)] -= 1
                want += np.outer(d, d)
    sample = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.array_equal(toxicity._gram(sample, vector, 400), want)


def test_counterfactuals_decide_whole_queries(spark, tmp_path):
    """Where a group is mostly named in toxic texts, neutral mentions are false positives without the penalty."""
    rnd = random.Random(9)
    rows, labels, neutral = [], [], []
    for i in range(1200):
        toxic = rnd.random() < 0.2
        w = sentence(rnd, rnd.randint(5, 30)).split()
        if toxic and rnd.random() < 0.6:
            w.insert(rnd.randrange(len(w)), "scum")
        if rnd.random() < (0.9 if toxic else 0.04):
            w.insert(rnd.randrange(len(w)), "muslim")
            if not toxic:
                neutral.append(i)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    folder = save(spark, tmp_path, documents=docs(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.query(spark, folder).collect()}
    plain = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), weight=0.0).collect()}
    assert sum(plain[i] for i in neutral) > 0.8 * len(neutral) > 0
    assert sum(got[i] for i in neutral) < 0.5 * sum(plain[i] for i in neutral)
    assert all(got[i] for i, t in rows if "scum" in t)


def test_scores_by_hand():
    model = toxicity.Model(-2.0, {"=bad": 1.0, "^bad": 0.5, "=worse": 2.0})
    logit = lambda p: float(np.log(p / (1 - p)))
    assert logit(model.score("bad,worse(bad)-BAD\u00a0x")) == pytest.approx(1.5)
    assert logit(model.score("bad worse")) == logit(model.score("worse/bad"))
