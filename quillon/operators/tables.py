"""Tables of an index, derived from postings (doc_id, term, impact) without any order between rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.vectors import KTH, block_of, global_of, local_of

SUPERBLOCK = 256
#: Documents or places of a term that are put in order together.
SPAN = 1 << 20


def merged(postings: DataFrame, term: str = "term") -> DataFrame:
    """One row for each document and term; impacts given twice are summed, so that bounds stay bounds."""
    return postings.groupBy("doc_id", term).agg(F.sum("impact").alias("impact"))


def with_blocks(postings: DataFrame, size: int) -> DataFrame:
    return postings.withColumn("block_id", block_of(F.col("doc_id"), size))


def term_statistics(postings: DataFrame, term: str = "term", kind: str = "smallint") -> DataFrame:
    """term, df, max_impact and the 10th, 100th and 1000th largest impact (0 where there are fewer), as `kind`.

    Impacts fill a byte, so a term has 256 distinct ones at most: they are counted before the shuffle, and a running
    count over them gives the order statistics. No task holds a frequent term's postings.
    """
    counted = postings.groupBy(term, "impact").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(term).orderBy(F.desc("impact")))
    kth = [F.coalesce(F.max(F.when(F.col("so_far") >= k, F.col("impact"))), F.lit(0)).cast(kind).alias(f"k{k}") for k in KTH]
    return counted.withColumn("so_far", so_far).groupBy(term).agg(F.sum("n").alias("df"), F.max("impact").cast(kind).alias("max_impact"), *kth)


def block_maxima(postings: DataFrame, term: str = "term") -> DataFrame:
    """The largest impact of each term in each block where it has one."""
    return postings.where("impact > 0").groupBy(term, "block_id").agg(F.max("impact").cast("smallint").alias("max_impact"))


def superblocks(maxima: DataFrame, term: str = "term") -> DataFrame:
    """The sparse form: for each term and run of 256 blocks, the offsets and maxima of blocks that are not zero."""
    pairs = F.sort_array(F.collect_list(F.struct(F.pmod("block_id", F.lit(SUPERBLOCK)).alias("offset"), "max_impact")))
    return maxima.groupBy(term, block_of(F.col("block_id"), SUPERBLOCK).alias("superblock")).agg(pairs.alias("maxima"))


def raw_maxima(maxima: DataFrame, n_blocks: int, term: str = "term") -> DataFrame:
    """The dense form: for each term and run of 256 blocks with a maximum, an array of all maxima there, zeros included.

    Runs without any are left out, so it has 256 cells for each non-zero one at most, however many blocks there are.
    """
    filled = F.map_from_entries(F.collect_list(F.struct(F.pmod("block_id", F.lit(SUPERBLOCK)).cast("int").alias("offset"), "max_impact")))
    last = F.least(F.lit(SUPERBLOCK), F.lit(n_blocks) - F.col("superblock") * SUPERBLOCK) - 1
    dense = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)).cast("smallint"))
    grouped = maxima.groupBy(term, block_of(F.col("block_id"), SUPERBLOCK).alias("superblock")).agg(filled.alias("m"))
    return grouped.select(term, "superblock", dense.alias("maxima"))


def from_raw(raw: DataFrame, term: str = "term") -> DataFrame:
    """Block maxima from their dense form."""
    rows = raw.select(term, "superblock", F.posexplode("maxima").alias("offset", "max_impact")).where("max_impact > 0")
    return rows.select(term, global_of(F.col("superblock"), F.col("offset"), SUPERBLOCK).alias("block_id"), "max_impact")


def forward_blocks(postings: DataFrame, size: int, term: str = "term") -> DataFrame:
    """The blocked forward view: for each block and term its documents, by place in the block, with impacts."""
    pairs = F.sort_array(F.collect_list(F.struct(local_of(F.col("doc_id"), size).alias("local"), F.col("impact").cast("int").alias("impact"))))
    return with_blocks(postings, size).groupBy("block_id", term).agg(pairs.alias("documents"))


def block_statistics(postings: DataFrame, term: str = "term") -> DataFrame:
    """One row: blocks, mean terms of a block (whole number), mean over blocks of a term's mean documents; null if empty."""
    pairs = postings.groupBy("block_id", term).agg(F.count("*").alias("docs"))
    blocks = pairs.groupBy("block_id").agg(F.count("*").alias("terms"), F.avg("docs").alias("docs"))
    return blocks.agg(F.count("*").alias("n_blocks"), F.floor(F.sum("terms") / F.count("*")).alias("terms_per_block"), F.avg("docs").alias("docs_per_term"))


def _prefixed(rows: DataFrame, part, term: str, **sums) -> DataFrame:
    """rows with __part and, for each of sums (name: aggregate over a part, and over the parts before), what lies before the part.

    Only one row for each term and part is put in order by term, so a frequent term is not gathered in a task.
    """
    cut = rows.withColumn("__part", part)
    before = Window.partitionBy(term).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(term, "__part").agg(*[own.alias(name) for name, (own, _) in sums.items()])
    return cut.join(parts.select(term, "__part", *[F.coalesce(over(F.col(name)).over(before), F.lit(0)).alias(name) for name, (_, over) in sums.items()]), [term, "__part"])


def encode_gaps(postings: DataFrame, term: str = "term", span: int = SPAN) -> DataFrame:
    """(term, pos, gap, impact): the first gap is the first doc_id. Ranges of `span` documents are put in order by themselves."""
    cut = _prefixed(postings.select("doc_id", term, "impact"), F.floor(F.col("doc_id") / span), term, __last=(F.max("doc_id"), F.max), __at=(F.count("*"), F.sum))
    order = Window.partitionBy(term, "__part").orderBy("doc_id")
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(order), F.col("__last"))
    return cut.select(term, (F.col("__at") + F.row_number().over(order) - 1).alias("pos"), gap.alias("gap"), "impact")


def decode_gaps(gaps: DataFrame, term: str = "term", span: int = SPAN) -> DataFrame:
    """(term, doc_id, impact): the running sum of gaps, over ranges of `span` places and within them."""
    cut = _prefixed(gaps.select(term, "pos", "gap", "impact"), F.floor(F.col("pos") / span), term, __sum=(F.sum("gap"), F.sum))
    order = Window.partitionBy(term, "__part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.select(term, (F.col("__sum") + F.sum("gap").over(order)).alias("doc_id"), "impact")


def gap_documents(lists_of: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of lists of (gap, tf) structs, and the documents and impacts of all, one list after another."""
    pairs, sizes = lists_of.flatten(), np.diff(lists_of.offsets.to_numpy())
    if lists_of.null_count:
        sizes = np.where(lists_of.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    docs = np.cumsum(pairs.field("gap").to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.cumsum(sizes) - sizes
    base = np.where(first > 0, docs[np.maximum(first, 1) - 1] if len(docs) else 0, 0)
    return sizes, docs - np.repeat(base, sizes), pairs.field("tf").to_numpy(zero_copy_only=False).astype(np.int64)


def decode_gap_lists(lists: DataFrame, term: str = "term", postings: str = "postings") -> DataFrame:
    """(term, doc_id, impact) from a list of (gap, tf) structs for each term; a list is summed where it lies, without a shuffle."""

    def run(batches):
        for batch in batches:
            sizes, docs, impacts = gap_documents(batch.column(1))
            terms = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([terms, pa.array(docs), pa.array(impacts)], names=[term, "doc_id", "impact"])

    kept = lists.select(term, postings)
    return kept.mapInArrow(run, T.StructType([kept.schema[term], T.StructField("doc_id", T.LongType()), T.StructField("impact", T.LongType())]))


SUMS = ("n", "sum_doc", "max_doc", "sum_impact")


def list_sums(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with n, sum_doc, max_doc and sum_impact instead of its last column, lists of (gap, tf) structs; empty ones go."""
    sizes, docs, impacts = gap_documents(batch.column(batch.num_columns - 1))
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    sums = [f.reduceat(x, first) if len(some) else np.zeros(0, np.int64) for f, x in ((np.add, docs), (np.maximum, docs), (np.add, impacts))]
    kept = [c.take(pa.array(some)) for c in batch.columns[:-1]]
    return pa.RecordBatch.from_arrays([*kept, *(pa.array(x.astype(np.int64)) for x in (sizes[some], *sums))], names=[*batch.schema.names[:-1], *SUMS])


def gap_list_sums(lists: DataFrame, keep: list[str], postings: str = "postings") -> DataFrame:
    """keep, n, sum_doc, max_doc and sum_impact of each list of (gap, tf) structs that is not empty, summed where it lies."""

    def run(batches):
        return map(list_sums, batches)

    kept = lists.select(*keep, postings)
    return kept.mapInArrow(run, T.StructType([*(kept.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in SUMS)]))
