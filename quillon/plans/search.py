"""Plans of a search, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import ranking


@dataclass(frozen=True)
class Tables:
    """What a search reads. term names the joining column of all of them; postings and maxima have block_id.

    by_block says that postings lie in buckets of block_id: scores are then summed where they lie, without a shuffle.
    """

    postings: DataFrame
    statistics: DataFrame
    maxima: DataFrame
    term: str = "term"
    by_block: bool = False


def search(tables: Tables, queries: DataFrame, k: int, alpha: float = 1.0, beta: float = 1.0, mode: str = "exact", prune: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank) of the k best documents for every query of (qid, term, weight).

    mode 'exact': the true best for alpha and beta of 1 or more; less is approximate. 'compat': the strict seed, and the
    last live block is not scored. With prune, or where alpha or the mode need block order, blocks that cannot hold a
    result are left out before scoring; else every match is scored, which is the faster plan unless pruning is strong.
    """
    if mode not in ("exact", "compat"):
        raise ValueError(mode)
    if k < 1 or beta <= 0:
        return empty(queries)
    kept = queries.select("qid", tables.term, "weight")
    if beta < 1:  # only known terms count for the cut; all later joins drop unknown ones by themselves
        kept = ranking.keep_heaviest(ranking.known_terms(kept, tables.statistics.select(tables.term), tables.term), beta, tables.term)
    kept = ranking.small(kept)
    compat = mode == "compat"
    if not (prune or compat or alpha < 1):
        return ranking.top_k(ranking.document_scores(kept, tables.postings, tables.term, ["block_id"] if tables.by_block else []), k)
    live, order = live_blocks(tables, kept, k, compat), []
    if alpha < 1 or compat:  # only these go through blocks in order
        live, order = ranking.with_positions(live), ["pos"]
    product = F.col("weight").cast("long") * F.col("impact").cast("long")
    matches = tables.postings.join(kept, tables.term).join(live.select("qid", "block_id", "tau", *order), ["qid", "block_id"])
    scored = matches.groupBy("qid", "doc_id", "tau", *order).agg(F.sum(product).alias("score")).where("score > 0")
    if alpha < 1 or compat:
        stops = ranking.stop_positions(scored, live, k, alpha)
        scored = scored.join(stops, "qid", "left").where(F.col("stop_pos").isNull() | (F.col("pos") <= F.col("stop_pos")))
        if compat:
            last = live.groupBy("qid").agg(F.max("pos").alias("last"))
            scored = scored.join(last, "qid").where("pos < last")
    scored = scored.where("score > tau" if compat else "score >= tau")
    return ranking.top_k(scored.select("qid", "doc_id", "score"), k)


def live_blocks(tables: Tables, kept: DataFrame, k: int, strict: bool = False) -> DataFrame:
    bounds = ranking.upper_bounds(kept, tables.maxima, tables.term)
    return ranking.live_blocks(bounds, ranking.seeds(kept, tables.statistics, k, tables.term), strict)


def empty(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, doc_id long, score long, rank long")


def two_waves(tables: Tables, queries: DataFrame, k: int, first_blocks: int = 8) -> DataFrame:
    """The exact result by two waves: the best blocks of a query give a threshold that leaves out most of the others."""
    kept = ranking.small(queries.select("qid", tables.term, "weight"))
    live = live_blocks(tables, kept, k)
    product = F.col("weight").cast("long") * F.col("impact").cast("long")
    score = lambda blocks: tables.postings.join(kept, tables.term).join(blocks.select("qid", "block_id"), ["qid", "block_id"]).groupBy("qid", "doc_id").agg(F.sum(product).alias("score")).where("score > 0")
    first = ranking.first_blocks(live, first_blocks)
    early = ranking.top_k(score(first), k)
    raised = early.where(F.col("rank") == k).select("qid", F.col("score").alias("tau1"))
    late = live.join(first.select("qid", "block_id"), ["qid", "block_id"], "left_anti").join(raised, "qid", "left").where(F.col("tau1").isNull() | (F.col("ub") >= F.col("tau1")))
    return ranking.top_k(early.select("qid", "doc_id", "score").unionByName(score(late)), k)
