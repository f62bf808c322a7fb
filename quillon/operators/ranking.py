"""Operators of a search: joins, sums, bounds, thresholds and ranks. Queries are (qid, term, weight) rows.

`term` names the column that joins queries with postings and block maxima: a string or a dense id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import kth_column

#: Rows up to which a query table is sent to every executor; a row is under 100 bytes.
BROADCAST_ROWS = 500_000
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most `limit` rows; else left to the join strategies."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def known_terms(queries: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """Query terms that the index has."""
    return terms.join(small(queries), term)


def keep_heaviest(queries: DataFrame, beta: float, term: str = "term") -> DataFrame:
    """The ceil(n * beta) heaviest of a query's n terms, in single precision; ties go to the smaller term."""
    if beta >= 1:
        return queries
    n = F.count("*").over(Window.partitionBy("qid"))
    keep = F.ceil(n.cast("float") * F.lit(beta).cast("float"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), term))
    return queries.withColumn("__keep", keep).withColumn("__place", place).where("__place <= __keep").drop("__keep", "__place")


def document_scores(queries: DataFrame, postings: DataFrame, term: str = "term", lie_by: list[str] | tuple = ()) -> DataFrame:
    """(qid, doc_id, score) with the inner product where it is positive; summed on the map side first.

    lie_by names columns that follow from doc_id and by which the postings lie together: no shuffle is needed then.
    """
    product = F.col("weight").cast("long") * F.col("impact").cast("long")
    summed = postings.join(queries, term).groupBy("qid", *lie_by, "doc_id").agg(F.sum(product).alias("score"))
    return summed.where("score > 0").select("qid", "doc_id", "score")


def upper_bounds(queries: DataFrame, maxima: DataFrame, term: str = "term") -> DataFrame:
    """(qid, block_id, ub): no document of the block can score more."""
    product = F.col("weight").cast("long") * F.col("max_impact").cast("long")
    return maxima.join(queries, term).groupBy("qid", "block_id").agg(F.sum(product).alias("ub"))


def seeds(queries: DataFrame, statistics: DataFrame, k: int, term: str = "term") -> DataFrame:
    """(qid, tau): a score that at least k documents reach by a single term; 0 beyond the kept order statistics."""
    column = kth_column(k)
    if column is None:
        return queries.groupBy("qid").agg(F.lit(0).cast("long").alias("tau"))
    product = F.col("weight").cast("long") * F.col(column).cast("long")
    return statistics.join(queries, term).groupBy("qid").agg(F.max(product).alias("tau"))


def live_blocks(bounds: DataFrame, tau: DataFrame, strict: bool = False) -> DataFrame:
    """Blocks that can hold a result (qid, block_id, ub, tau)."""
    enough = F.col("ub") > F.col("tau") if strict else F.col("ub") >= F.col("tau")
    return bounds.join(tau, "qid").where(enough & (F.col("ub") > 0))


def with_positions(live: DataFrame, span: int = 1 << 16) -> DataFrame:
    """live with pos from 0, by bound descending, then block_id.

    Blocks of one bound and range of ``span`` are put in order by themselves; what lies before them comes from counts,
    so a query's blocks are never in one task as a whole.
    """
    cut = live.withColumn("__range", F.floor(F.col("block_id") / span))
    counts = cut.groupBy("qid", "ub", "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("qid").orderBy(F.desc("ub"), "__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("qid", "ub", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("qid", "ub", "__range").orderBy("block_id"))
    placed = cut.withColumn("__within", within - 1).join(starts, ["qid", "ub", "__range"])
    return placed.withColumn("pos", (F.col("__start") + F.col("__within")).cast("long")).drop("__range", "__start", "__within")


def first_blocks(live: DataFrame, n: int) -> DataFrame:
    """The n blocks of each query with the highest bounds; the rank filter goes below the shuffle."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ub"), "block_id"))
    return live.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def stop_positions(scored: DataFrame, live: DataFrame, k: int, alpha: float) -> DataFrame:
    """(qid, stop_pos): the first position after whose block the search may stop; no row if it never does.

    scored: (qid, pos, score) of every document in a live block. The search goes through blocks by position. After a
    block with bound ub it stops if the threshold is over alpha * ub: the seed, or the k-th best score so far. Bounds
    fall with the position, so each condition stays true once it is, and a document counts for the k from the later of
    its own position and the first with alpha * ub under its score.
    """
    limit = lambda c: F.lit(alpha).cast("float") * F.col(c).cast("float")
    early = live.where(F.col("tau").cast("float") > limit("ub")).groupBy("qid").agg(F.min("pos").alias("by_seed"))
    # scores and bounds in one order: the first position whose limit is under a score is found by a running minimum.
    # Bounds and scores are whole numbers under 256 * 32 * terms of the query, and that many rows of each there are at most
    limits = live.groupBy("qid", limit("ub").alias("at")).agg(F.min("pos").alias("pos")).withColumn("kind", F.lit(0))
    marks = limits.select("qid", "at", "kind", "pos").unionByName(scored.select("qid", F.col("score").cast("float").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pos")).distinct())
    # a score comes after limits that are smaller, and before equal ones
    under = Window.partitionBy("qid").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = marks.withColumn("first", F.min("pos").over(under)).where("kind = 1").select("qid", "at", "first")
    counted = scored.withColumn("at", F.col("score").cast("float")).join(first, ["qid", "at"]).where("first is not null").select("qid", F.greatest("pos", "first").alias("from"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("from"))
    by_score = counted.withColumn("__nth", nth).where(F.col("__nth") <= k).where(F.col("__nth") == k).select("qid", F.col("from").alias("by_score"))
    return early.join(by_score, "qid", "full_outer").select("qid", F.least("by_seed", "by_score").alias("stop_pos"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank from 1): best first, ties by doc_id. The rank filter is pushed below the shuffle.

    Spark pushes such filters up to a limit of the session, which is raised to k where it is lower, and stays so: it is
    read when the result is planned, after this returns. It changes plans of rank filters only, no results.
    """
    conf = scores.sparkSession.conf
    if k > int(conf.get(GROUP_LIMIT)):
        conf.set(GROUP_LIMIT, str(k))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
