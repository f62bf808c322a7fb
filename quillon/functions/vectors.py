"""Scalar pieces of sparse retrieval: tokens, weights, impacts and block numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query weights are scaled down to this maximum, impacts fill a byte.
TOP_WEIGHT, TOP_IMPACT = 32, 255
#: Order statistics of impacts that an index keeps for each term.
KTH = (10, 100, 1000)


def tokens(text, pattern: str = r"(?U)\s+") -> Column:
    """White-space tokens, case kept, none empty; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda t: t != "")


def strip(text) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_first(text, delimiter: str = ":") -> tuple[Column, Column]:
    """What stands before and after the first delimiter; null after, if there is none."""
    both = F.split(text, delimiter, 2)
    return F.get(both, 0), F.get(both, 1)


def term_counts(texts: DataFrame, key: str, text: str = "text", pattern: str = r"(?U)\s+", name: str = "weight", only: DataFrame | None = None) -> DataFrame:
    """(key, term, count) of the tokens of each text; with `only`, a table of terms, others are dropped before the count."""
    found = texts.select(key, F.explode(tokens(F.col(text), pattern)).alias("term"))
    if only is not None:
        found = found.join(only, "term", "left_semi")
    return found.groupBy(key, "term").agg(F.count("*").alias(name))


def ceil_scaled(weight, scale) -> Column:
    """ceil(weight * scale), both in single precision."""
    return F.ceil(weight.cast("float") * scale.cast("float"))


def scale_batch(queries: DataFrame) -> DataFrame:
    """(qid, term, weight): weights of a query whose largest is over TOP_WEIGHT are scaled down to it. Unknown terms count for the largest."""
    top = F.max("weight").over(Window.partitionBy("qid"))
    scale = F.lit(float(TOP_WEIGHT)) / top
    return queries.withColumn("weight", F.when(top > TOP_WEIGHT, ceil_scaled(F.col("weight"), scale)).otherwise(F.col("weight")).cast("int"))


def scale_single(queries: DataFrame) -> DataFrame:
    """(qid, term, weight): weights are always scaled to TOP_WEIGHT; NaN does not count for the largest and is dropped.

    Negative weights and infinities are refused when the rows are read.
    """
    weight = F.col("weight").cast("float")
    fit = F.when(F.isnan(weight) | ((weight >= 0) & (weight < float("inf"))), weight).otherwise(F.raise_error(F.concat(F.lit("query weights must be finite and not negative: "), weight.cast("string"))).cast("float"))
    usable = queries.withColumn("weight", fit).where(~F.isnan("weight"))
    top = F.max("weight").over(Window.partitionBy("qid"))
    scale = F.lit(float(TOP_WEIGHT)) / top
    return usable.withColumn("weight", F.when(top > 0, ceil_scaled(F.col("weight"), scale)).otherwise(0).cast("int"))


def scale_impacts(value, factor: float = 100.0) -> Column:
    """Float impacts as whole ones: value * factor in double precision, cut off."""
    return (value.cast("double") * F.lit(factor).cast("double")).cast("int")


def narrow(impact, how: str = "error") -> Column:
    """Impacts of a byte: 'error' refuses others, 'clip' takes the nearest, 'wrap' keeps the low byte."""
    impact = impact.cast("long")
    if how == "clip":
        return F.least(F.greatest(impact, F.lit(0)), F.lit(TOP_IMPACT)).cast("smallint")
    if how == "wrap":
        return F.pmod(impact, F.lit(TOP_IMPACT + 1)).cast("smallint")
    if how != "error":
        raise ValueError(how)
    wrong = F.raise_error(F.concat(F.lit("impact outside 0..255: "), impact.cast("string"))).cast("smallint")
    return F.when(impact.between(0, TOP_IMPACT), impact.cast("smallint")).otherwise(wrong)


def block_of(doc_id, size: int) -> Column:
    return F.floor(doc_id / F.lit(size)).cast("int")


def local_of(doc_id, size: int) -> Column:
    return F.pmod(doc_id, F.lit(size)).cast("int")


def global_of(block, local, size: int) -> Column:
    return block * F.lit(size) + local


def block_count(n_docs: int, size: int) -> int:
    if size < 1:
        raise ValueError("a block holds one document at least")
    return -(-n_docs // size)


def kth_column(k: int) -> str | None:
    """The order statistic that seeds the threshold for k results; none beyond the largest."""
    return next((f"k{n}" for n in KTH if k <= n), None)
