"""Mixing sources to target weights by temperature.

Source weights are token shares to a power, normalised: 1 keeps the shares, 0 makes all sources equal. The exponent is
bisected to the flattest mixture that meets the target: an entropy of at least ``min_entropy`` is asked for by raising
flatness, a limit of ``max_epochs`` passes over any source bounds it. Without a budget the smallest one is taken that
gives every source at least one whole pass, so that no document is lost; then no source is passed more than
``max_epochs`` times.

A source's quota is its weight times the budget. It is realised as whole permutations (epochs) and a last, partial one.
An epoch's permutation deals documents to blocks by a hash of (seed, epoch, doc_id) and goes through blocks in order;
the partial epoch ends at the quota: blocks before the cut are in, of the block at the cut the documents that still
fit, later blocks are out. Only sums per block and the documents of the blocks at the cuts are ever put in order.
``mix`` gives the rows in that order: those of a source, epoch and block lie together, permuted within it.

Up to ``max_sources`` sources are planned by the driver and broadcast. More stay in tables: a step of the bisection then
needs two sums over them, and the quotas are joined.

Defined results: tokens are white-space words; a null source is a source of its own; sources without tokens are passed
once; documents of equal id come or go together; empty tables give no rows; further columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import discard, materialise, parts_for

SPACES = " \t\n\x0b\x0c\r"
#: A mixture is broadcast if it has no more sources, and no more documents of blocks at cuts, than this.
MAX_SOURCES, MAX_IDS = 10_000, 2_000_000


def n_tokens(text: str = "text"):
    bare = F.trim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{SPACES}]+"))).cast("long")


def weights(tokens: list[int], power: float) -> list[float]:
    top = max(tokens, default=0)
    raised = [(t / top) ** power if t else 0.0 for t in tokens]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def entropy(shares: list[float]) -> float:
    return -sum(w * math.log(w) for w in shares if w > 0)


def epochs(tokens: list[int], shares: list[float], budget: float | None) -> float:
    """The most passes over any source; without a budget, that which passes every source once at least."""
    rates = [w / t for t, w in zip(tokens, shares, strict=True) if t]
    if not rates:
        return 1.0
    return max(rates) * budget if budget is not None else max(rates) / min(rates)


def exponent(tokens: list[int], max_epochs: float, budget: float | None = None, min_entropy: float | None = None) -> float:
    """The exponent for sources of so many tokens; see ``bisected``."""
    return bisected(lambda a: epochs(tokens, weights(tokens, a), budget), lambda a: entropy(weights(tokens, a)), max_epochs, min_entropy)


def bisected(epochs_at, entropy_at, max_epochs: float, min_entropy: float | None) -> float:
    """The exponent from 0 to 1, bisected: the largest that meets min_entropy if one is given, else the smallest that keeps max_epochs.

    Both are monotone: a smaller exponent is flatter, has more entropy and repeats small sources more.
    """
    low, high = 0.0, 1.0
    allowed = lambda a: epochs_at(a) <= max_epochs * (1 + 1e-12)
    if not allowed(0.0):
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if allowed(middle) else (middle, high)
        least = high
    else:
        least = 0.0
    if min_entropy is None:
        return least
    enough = lambda a: entropy_at(a) >= min_entropy
    if not enough(least):
        return least  # the limit on passes goes before the entropy
    low, high = least, 1.0
    if enough(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if enough(middle) else (low, middle)
    return low


def _source():
    # null is a source too: sources are compared by a string that no null has
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))


def _block(seed: int, epoch, blocks):
    return F.pmod(F.xxhash64(F.lit(seed), epoch, F.col("doc_id")), blocks)


def _plan(totals: list, max_epochs: float, budget: int | None, min_entropy: float | None, block_rows: int) -> list[tuple]:
    tokens = [r["tokens"] for r in totals]
    power = exponent(tokens, max_epochs, budget, min_entropy)
    shares = weights(tokens, power)
    whole = budget if budget is not None else max([t / w for t, w in zip(tokens, shares, strict=True) if t], default=0)
    rows = []
    for r, w in zip(totals, shares, strict=True):
        quota = math.floor(whole * w + 1e-6) if r["tokens"] else 0
        passes = quota // r["tokens"] if r["tokens"] else 1
        rows.append((r["key"], w, int(quota), int(passes), int(quota - passes * r["tokens"]), max(1, r["n"] // block_rows)))
    return rows


_PLAN = "key string, weight double, quota long, passes long, left long, blocks long"


def _plan_many(totals: DataFrame, max_epochs: float, budget: int | None, min_entropy: float | None, block_rows: int) -> DataFrame:
    """``_plan`` for sources that stay in a table (key, tokens, n): the driver gets sums over them."""
    some = totals.where("tokens > 0")
    ends = some.agg(F.max("tokens").alias("top"), F.min("tokens").alias("low")).first()
    if ends["top"] is None:
        return totals.select("key", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("left"), F.greatest(F.lit(1), F.floor(F.col("n") / block_rows)).cast("long").alias("blocks"))
    top, low = ends["top"], ends["low"]
    part = F.log(F.col("tokens") / F.lit(float(top)))
    sums: dict[float, tuple[float, float]] = {}

    def at(a: float) -> tuple[float, float]:
        """The sum of the raised shares, and of these times their logarithm."""
        if a not in sums:
            r = some.agg(F.sum(F.exp(F.lit(a) * part)).alias("z"), F.sum(F.exp(F.lit(a) * part) * F.lit(a) * part).alias("l")).first()
            sums[a] = (r["z"], r["l"])
        return sums[a]

    # a source's passes go with tokens to the power - 1: the smallest source has the most, the largest the fewest
    flat = lambda a: (low / top) ** (a - 1)
    epochs_at = (lambda a: flat(a)) if budget is None else (lambda a: flat(a) / top / at(a)[0] * budget)
    power = bisected(epochs_at, lambda a: math.log(at(a)[0]) - at(a)[1] / at(a)[0], max_epochs, min_entropy)
    z = at(power)[0]
    whole = budget if budget is not None else top * z
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(power) * part) / z).otherwise(0.0)
    quota = F.when(F.col("tokens") > 0, F.floor(F.lit(float(whole)) * F.col("weight") + 1e-6)).otherwise(0).cast("long")
    passes = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1).cast("long")
    left = F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(0).cast("long")
    planned = totals.withColumn("weight", weight).withColumn("quota", quota).withColumn("passes", passes).withColumn("left", left)
    return materialise(planned.select("key", "weight", "quota", "passes", "left", F.greatest(F.lit(1), F.floor(F.col("n") / block_rows)).cast("long").alias("blocks")), "plan")


def plan_mixture(documents: DataFrame, max_epochs: float = 2.0, budget: int | None = None, min_entropy: float | None = None, seed: int = 17, block_rows: int = 2048, max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row a source: its weight, quota, whole passes, and the cut of the partial one."""
    spark = documents.sparkSession
    meta = materialise(documents.select("doc_id", _source().alias("key"), n_tokens().alias("tokens")), "tokens")
    sources = materialise(meta.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    totals = sources.orderBy("key").limit(max_sources + 1).collect()
    if few := len(totals) <= max_sources:
        table = spark.createDataFrame(_plan(totals, max_epochs, budget, min_entropy, block_rows), _PLAN)
    else:
        table = _plan_many(sources, max_epochs, budget, min_entropy, block_rows)
    held = F.broadcast if few else (lambda d: d)
    part = meta.join(held(table), "key").withColumn("block", _block(seed, F.col("passes"), F.col("blocks")))
    sums = part.groupBy("key", "block").agg(F.sum("tokens").alias("tokens"))
    running = sums.withColumn("up_to", F.sum("tokens").over(Window.partitionBy("key").orderBy("block")))
    cuts = running.join(held(table.select("key", "left")), "key").where(F.col("up_to") > F.col("left"))
    cuts = materialise(cuts.groupBy("key").agg(F.min(F.struct("block", (F.col("up_to") - F.col("tokens")).alias("before"))).alias("c")).select("key", F.col("c.block").alias("cut"), F.col("c.before").alias("before")), "cuts")
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), F.lit("in"), "doc_id"), "doc_id")
    at = part.select("key", "doc_id", "tokens", "block", "left").join(held(cuts), "key").where(F.col("block") == F.col("cut"))
    fits = at.withColumn("up_to", F.sum("tokens").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("before") + F.col("up_to") <= F.col("left"))
    ids = fits.groupBy("key").agg(F.collect_set("doc_id").alias("last_ids"), F.max(F.col("doc_id").isNull()).alias("last_null"))  # of one block of about block_rows documents
    mixture = materialise(table.join(cuts.drop("before"), "key", "left").join(ids, "key", "left"), "mixture")
    for step in (meta, sources, cuts):
        discard(step)
    return mixture


def with_epochs(documents: DataFrame, mixture: DataFrame, seed: int = 17) -> DataFrame:
    """Every document as often as its source's quota takes it, with epoch and block; texts are not shuffled where the mixture is small."""
    table = mixture.select(*[F.col(c).alias(f"__{c}") for c in ("key", "passes", "blocks", "cut", "last_ids", "last_null")])
    size = mixture.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("last_ids"), F.lit(0))).alias("ids")).first()
    if size["n"] <= MAX_SOURCES and (size["ids"] or 0) <= MAX_IDS:
        table = F.broadcast(table)
    joined = documents.withColumn("__key", _source()).join(table, "__key")
    partial = _block(seed, F.col("__passes"), F.col("__blocks"))
    last = F.coalesce(F.array_contains("__last_ids", F.col("doc_id")), F.col("doc_id").isNull() & F.col("__last_null"), F.lit(False))
    extra = F.when(partial < F.col("__cut"), 1).when((partial == F.col("__cut")) & last, 1).otherwise(0)
    times = F.sequence(F.lit(0).cast("long"), F.col("__passes") + extra - 1)
    out = joined.withColumn("epoch", F.explode(F.when(F.col("__passes") + extra > 0, times))).withColumn("block", _block(seed, F.col("epoch"), F.col("__blocks")))
    return out.drop("__key", "__passes", "__blocks", "__cut", "__last_ids", "__last_null")


def permuted(taken: DataFrame, mixture: DataFrame, seed: int = 17) -> DataFrame:
    """What ``with_epochs`` gives, with the rows of a source, epoch and block together and permuted within it."""
    size = 8 * (mixture.agg(F.sum("quota").alias("n")).first()["n"] or 0)  # a token and what is around it: about eight bytes
    return taken.repartition(parts_for(taken.sparkSession, size), _source(), F.col("epoch"), F.col("block")).sortWithinPartitions("epoch", _source(), "block", F.xxhash64(F.lit(seed), F.lit("in"), "doc_id"), "doc_id")


def mix(documents: DataFrame, seed: int = 17, **options) -> DataFrame:
    """documents, each row as often as the mixture takes it, in the order of its block permutations, with its own columns."""
    mixture = plan_mixture(documents.select("doc_id", "source", "text"), seed=seed, **options)
    own = [c for c in documents.columns]
    hidden = documents.select(*[F.col(f"`{c}`").alias({"epoch": "__own_epoch", "block": "__own_block"}.get(c, c)) for c in own])
    out = permuted(with_epochs(hidden, mixture, seed), mixture, seed)
    return out.select(*[F.col({"epoch": "__own_epoch", "block": "__own_block"}.get(c, f"`{c}`")).alias(c) for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each time a document is taken: its epoch, its block in it and its place in the block."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixture = plan_mixture(docs.select("doc_id", "source", "text"))
    taken = with_epochs(docs.select("doc_id", "source"), mixture)
    place = F.row_number().over(Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(17), F.lit("in"), "doc_id"), "doc_id"))
    return taken.withColumn("place", (place - 1).cast("long")).select("doc_id", "source", "epoch", "block", "place")
