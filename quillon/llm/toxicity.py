"""Toxicity: a linear classifier over words and word beginnings, regularised by counterfactuals.

Features are the words of a text and their beginnings of 3 to 5 letters, present or not. The statistics of features and
the weights are learned from a sample of labelled documents (``per_class`` rows of each label at most, expected; never
rows whose crc32(doc_id as text) mod 4 is 2). The ``n_features`` features that tell most of label 1 are kept. Where a
label is sampled, its counts are scaled up by its share, and the bias is moved to the labels' true odds, so that scores
do not follow the sample's shares.

For each labelled text that names a group (an identity term), the same text is made with the other terms of its set in
that place, and with no group named there; the weights minimise the log loss plus ``weight / 2 * (score - score of the
changed text)^2`` for each of these pairs, in logits. The last kind of pair is needed as terms that no labelled text has
could otherwise take on the weight of the one it names. So naming a group carries little weight of its own, and neutral
mentions hardly raise the score. Where no labelled text names a group there are no pairs, and the classifier is a plain
ridge-regularised one.

Defined results: null, empty and wordless texts get the score of a text without features; without any usable label all
scores are 0; with labels of one kind all scores are their smoothed share; repeated documents get a row each; null
labels are left out and a null doc_id is held out; further columns are kept, and those with the added names replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import built, held_out, materialise, put_aside, ship

#: Sets of terms that name groups; within a set each can stand for another.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "african", "latino", "hispanic", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("american", "mexican", "chinese", "russian", "german", "french", "spanish", "turkish", "polish", "indian"),
    ("blind", "deaf", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
)
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5)
#: Into how many parts the hash range of doc_id is cut for sampling.
HASHES = 1 << 20
_SWAPS = {term: [t for t in group if t != term] for group in IDENTITY for term in group}


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [f"={word}", *[f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k]]


class Model:
    """Weights of features, held by words and by beginnings of each length, so that a text's are found by set intersection."""

    def __init__(self, bias: float | None, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.by_word = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        self.by_beginning = {k: {f[1:]: w for f, w in weights.items() if f[0] == "^" and len(f) == k + 1} for k in BEGINNINGS}

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        have = words(text)
        found = [self.by_word[w] for w in have & self.by_word.keys()]
        for k, known in self.by_beginning.items():
            found += [known[b] for b in {w[:k] for w in have} & known.keys()]
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(sorted(found)), -700, 700))))


def _sample(documents: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Labelled texts, about per_class of each label, and the share taken of each label's rows.

    A share is one of the hash range of doc_id, the same at each run.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    cut = {label: min(HASHES, -(-per_class * HASHES // max(1, counts.get(label, 0)))) for label in (0, 1)}
    part = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(HASHES)) < F.when(F.col("toxic") == 1, cut[1]).otherwise(cut[0]))
    # about 2 * per_class rows at most, whatever the size of the tables
    sample = materialise(documents.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("toxic", "text"), "toxicity")
    return sample, {label: n / HASHES for label, n in cut.items()}


def _select(sample: DataFrame, n_features: int, share: dict[int, float]) -> list[str]:
    """The features with the largest log-likelihood ratio for label 1, from the whole sample, counted as among all labels."""

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({f for w in words(text) for f in features(w)})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield flushed(seen)
        yield flushed(seen)

    def flushed(seen):
        names = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_pydict({"feature": names, "n0": [seen[0][f] for f in names], "n1": [seen[1][f] for f in names]}, schema=pa.schema([("feature", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())]))
        seen[0].clear()
        seen[1].clear()
        return out

    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0) / share[0], total.get(1, 0) / share[1]
    seen = sample.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = seen.select("feature", F.col("n1").alias("rows"), (F.col("n0") / share[0]).alias("a"), (F.col("n1") / share[1]).alias("b"))
    expected0, expected1 = (F.col("a") + F.col("b")) * n0 / (n0 + n1), (F.col("a") + F.col("b")) * n1 / (n0 + n1)
    gain = F.col("b") * F.log(F.col("b") / expected1) + F.when(F.col("a") > 0, F.col("a") * F.log(F.col("a") / expected0)).otherwise(0.0)
    best = counts.where((F.col("rows") >= 3) & (F.col("b") > 2 * expected1 * n0 / (n0 + n1))).select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(n_features)
    return [r["feature"] for r in best.collect()]


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 6000, n_features: int = 512, weight: float = 1.0, ridge: float = 0.3) -> Model:
    """Learns a Model. The driver gets n_features names and, of the sample, which of these each text has."""
    ship(documents.sparkSession)
    sample, share = _sample(documents, labels, per_class)
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total:
        return Model(None, {})
    prior = (total.get(1, 0) / share[1] + 0.5) / (sum(n / share[label] for label, n in total.items()) + 1)
    if len(total) == 1:
        return Model(float(np.log(prior / (1 - prior))), {})
    chosen = list(dict.fromkeys([*_select(sample, n_features, share), *[f"={t}" for t in _SWAPS]]))
    place = {f: i for i, f in enumerate(chosen)}

    def vector(have) -> list[int]:
        return sorted({place[f] for w in have for f in features(w) if f in place})

    def rows(batches):
        for batch in batches:
            found = [vector(words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "has"])

    got = sample.mapInArrow(rows, "toxic int, has array<int>").collect()
    x = np.zeros((len(got), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for k, r in enumerate(got):
        x[k, r["has"]] = 1
    y = np.array([r["toxic"] for r in got], np.float32)
    w = _minimise(x, y, _gram(sample, vector, len(chosen) + 1) * weight, ridge)
    # the sample's odds of label 1 are those among all labels times share[1] / share[0]; only the bias carries them
    return Model(float(w[-1] + np.log(share[0] / share[1])), {f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-6})


def _gram(sample: DataFrame, vector, size: int) -> np.ndarray:
    """The sum of d d' over all pairs of a text and one with a term swapped or left out, d the difference of their features.

    Pairs are summed where they are made: at most size * size / 2 sums reach the driver, however many pairs there are.
    """

    def sums(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                have = words(text)
                named = sorted(have & _SWAPS.keys())
                own = set(vector(have)) if named else set()
                for term in named:
                    for other in (*_SWAPS[term], None):
                        changed = set(vector((have - {term}) | {other} if other else have - {term}))
                        d = [(i, 1) for i in own - changed] + [(i, -1) for i in changed - own]
                        for i, a in d:
                            for j, b in d:
                                if i <= j:
                                    total[i, j] += a * b
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["i", "j", "n"])

    gram = np.zeros((size, size))
    for r in sample.select("text").mapInArrow(sums, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["n"]
    return gram


def _minimise(x: np.ndarray, y: np.ndarray, gram: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps, halved while the loss would rise; the bias has no ridge."""
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: float(np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * (keep * w * w).sum() + 0.5 * w @ gram @ w)
    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (p - y) + keep * w + gram @ w
        curvature = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(keep) + gram
        step = np.linalg.solve(curvature + 1e-8 * np.eye(len(w)), gradient)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, before):
            break
    return w


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score to every document."""
    ship(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    own = [c for c in documents.columns if c != "score"]
    kept = documents.select(*[F.col(f"`{c}`") for c in own])
    place = own.index(text)

    def run(batches):
        machine = built(shipped, lambda m: Model(*m))
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                scores = pa.array([machine.score(t) for t in part.column(place).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*own, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("score", T.DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """documents with held_out, score and predicted; learned from labels."""
    ship(documents.sparkSession)
    scored = score(documents, fit(documents, labels, **options))
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remove_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their own columns."""
    aside, back = put_aside(documents, ("score", "held_out", "predicted"))
    return back(classify(aside, labels, **options).where("predicted = 0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return found.select("doc_id", "held_out", "score", "predicted")
