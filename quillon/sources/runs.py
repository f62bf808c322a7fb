"""Results as run lines and as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "quillon"


def run_lines(results: DataFrame, tag: str = TAG) -> DataFrame:
    """(qid, rank, value) with lines `qid Q0 docno rank score tag`; ranks from 1."""
    return results.select("qid", "rank", F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), "docno", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value"))


def write_run(results: DataFrame, path: str, order: DataFrame | None = None, tag: str = TAG) -> None:
    """Writes run lines in order of queries (q_ord of `order`, else qid) and ranks; the parts of the folder follow each other."""
    lines = run_lines(results, tag)
    if order is not None:
        lines = lines.join(order.select("qid", "q_ord"), "qid")
    lines.orderBy("q_ord" if order is not None else "qid", "rank").select("value").write.text(path)


def result_frame(results: DataFrame, frame: DataFrame, qid: str = "qid") -> DataFrame:
    """The query frame's columns with docno, score (single precision) and rank from 0."""
    found = results.select(F.col("qid").alias(qid), "docno", F.col("score").cast("float").alias("score"), (F.col("rank") - 1).cast("int").alias("rank"))
    return frame.join(found, qid)
