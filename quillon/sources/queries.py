"""Queries from text files and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vectors import scale_batch, split_first, strip, tokens
from quillon.sources.storage import numbered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(q_ord, line) of a query file, numbered in file order."""
    return numbered(spark.read.text(path).withColumnRenamed("value", "line"), "q_ord").select("q_ord", "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(q_ord, qid, text) from lines `qid: text`, parted at the first colon; a line without one is an error naming it."""
    qid, text = split_first(F.col("line"))
    wrong = F.raise_error(F.concat(F.lit("query line "), F.col("q_ord").cast("string"), F.lit(" has no colon: "), F.col("line")))
    return lines.select("q_ord", F.when(F.instr("line", ":") > 0, strip(qid)).otherwise(wrong.cast("string")).alias("qid"), text.alias("text"))


def text_weights(queries: DataFrame, pattern: str = r"(?U)\s+") -> DataFrame:
    """(qid, term, weight) of (qid, text): a token weighs as often as it occurs, scaled down as a batch."""
    found = queries.select("qid", F.explode(tokens(F.col("text"), pattern)).alias("term"))
    return scale_batch(found.groupBy("qid", "term").agg(F.count("*").alias("weight")))


def frame_weights(frame: DataFrame, qid: str = "qid", toks: str = "query_toks") -> DataFrame:
    """(qid, term, weight) as given, from a column of token maps."""
    if toks not in frame.columns:
        raise ValueError(f"the frame has no column {toks}")
    return frame.select(F.col(qid).alias("qid"), F.explode(toks).alias("term", "weight"))
