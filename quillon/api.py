"""Indexers, searchers and retrievers over an index."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.vectors import scale_single
from quillon.index import SparseIndex
from quillon.sources.queries import frame_weights, parse_lines, read_lines, text_weights
from quillon.sources.runs import TAG, result_frame, run_lines
from quillon.sources.storage import new_path


def build_from_ciff(spark: SparkSession, ciff_file: str, output: str, bsize: int, compress_range: bool = False) -> SparseIndex:
    return SparseIndex.from_ciff(spark, ciff_file, bsize, compress_range).save(output)


def search_file(spark: SparkSession, index: str, queries: str, k: int, alpha: float = 1.0, beta: float = 1.0, **options) -> DataFrame:
    """(qid, q_ord, docno, score, rank) for all queries of a file, in one job."""
    parsed = parse_lines(read_lines(spark, queries))
    found = SparseIndex.load(spark, index).search(text_weights(parsed.select("qid", "text")), k, alpha, beta, **options)
    return found.join(parsed.select("qid", "q_ord"), "qid")


def search_run(spark: SparkSession, index: str, queries: str, k: int, alpha: float = 1.0, beta: float = 1.0, tag: str = TAG) -> str:
    """The run as one string; for outputs that fit the driver."""
    found = search_file(spark, index, queries, k, alpha, beta)
    lines = run_lines(found, tag).join(found.select("qid", "q_ord").distinct(), "qid").orderBy("q_ord", "rank")
    return "".join(f"{r['value']}\n" for r in lines.collect())


FINISHED = "the index is finished already"


class Searcher:
    """Loads an index once and keeps its tables in memory, on disk where they do not fit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.index = spark, SparseIndex.load(spark, path)
        for table in (self.index.docs, self.index.terms, self.index.postings, self.index.block_max):
            table.persist()

    def search(self, query: Mapping[str, float], k: int, alpha: float = 1.0, beta: float = 1.0) -> tuple[list[str], list[float]]:
        """Names and scores for one query, its weights always scaled to the top weight."""
        rows = self.search_df(self.spark.createDataFrame([(0, t, float(w)) for t, w in query.items()], "qid int, term string, weight float"), k, alpha, beta).orderBy("rank").collect()
        return [r["docno"] for r in rows], [float(r["score"]) for r in rows]

    def search_df(self, queries: DataFrame, k: int, alpha: float = 1.0, beta: float = 1.0, **options) -> DataFrame:
        """Many such queries (qid, term, weight) in one job."""
        return self.index.search(scale_single(queries), k, alpha, beta, **options)

    def close(self) -> None:
        for table in (self.index.docs, self.index.terms, self.index.postings, self.index.block_max):
            table.unpersist()

    def __enter__(self) -> Searcher:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class _Once:
    """A builder that writes its index once."""

    def __init__(self, spark: SparkSession, path: str, bsize: int, compress_range: bool = False):
        self.spark, self.path, self.bsize, self.compress_range, self.done = spark, path, bsize, compress_range, False

    def _finish(self, build) -> SparseIndex:
        if self.done:
            raise RuntimeError(FINISHED)
        found = build().save(self.path)
        self.done = True
        return found


class _Spool:
    """Rows given one by one, numbered, and written to the shared folder whenever ``limit`` are held by the driver."""

    def __init__(self, spark: SparkSession, name: str, schema: str, limit: int = 20_000):
        self.spark, self.schema, self.limit, self.rows, self.n = spark, f"ordinal long, {schema}", limit, [], 0
        self.path = new_path(spark, name)

    def add(self, *row) -> None:
        self.rows.append((self.n, *row))
        self.n += 1
        if len(self.rows) >= self.limit:
            self._flush()

    def _flush(self) -> None:
        self.spark.createDataFrame(self.rows, self.schema).write.mode("append").parquet(self.path)
        self.rows = []

    def frame(self) -> DataFrame:
        """All rows; `ordinal` is the order in which they came."""
        self._flush()
        return self.spark.read.schema(self.schema).parquet(self.path)


class Indexer(_Once):
    """Documents one by one, as small batches go from the driver to the shared folder."""

    def __init__(self, *args, **options):
        super().__init__(*args, **options)
        self.rows = _Spool(self.spark, "indexer", "docno string, toks map<string,int>")

    def add_document(self, doc_id: str, vector: Mapping[str, int]) -> None:
        self.rows.add(doc_id, dict(vector))

    def finish(self) -> SparseIndex:
        if self.done:
            raise RuntimeError(FINISHED)
        frame = self.rows.frame().orderBy("ordinal")
        return self._finish(lambda: SparseIndex.from_vectors(frame, self.bsize, compress_range=self.compress_range))


class InvertedIndexer(_Once):
    """Documents with numbered terms, and the terms' lists, given one by one; both sides must agree."""

    def __init__(self, *args, **options):
        super().__init__(*args, **options)
        self.docs = _Spool(self.spark, "indexer-docs", "docno string, vector array<struct<term:long,impact:long>>")
        self.terms = _Spool(self.spark, "indexer-terms", "term string, postings array<struct<doc_id:long,impact:int>>")

    def add_document(self, doc_id: str, vector: Iterable[tuple[int, int]]) -> None:
        self.docs.add(doc_id, list(vector))

    def add_term(self, term: str, postings: Iterable[tuple[int, int]]) -> None:
        self.terms.add(term, list(postings))

    def finish(self) -> SparseIndex:
        if self.done:
            raise RuntimeError(FINISHED)
        docs, lists = self.docs.frame(), self.terms.frame()
        given = docs.select(F.col("ordinal").alias("doc_id"), F.explode("vector").alias("v")).select("doc_id", F.col("v.term").alias("number"), "v.impact")
        known = given.join(lists.select(F.col("ordinal").alias("number"), "term"), "number", "left")
        unknown = F.raise_error(F.concat(F.lit("a document names a term that is not there: "), F.col("number").cast("string"))).cast("string")
        forward = known.select("doc_id", F.when(F.col("term").isNull(), unknown).otherwise(F.col("term")).alias("term"), "impact")
        return self._finish(lambda: SparseIndex.from_postings(docs.select(F.col("ordinal").alias("doc_id"), "docno"), lists.select("term", "postings"), self.bsize, forward, self.compress_range))


class IndexHandle:
    """An index by its folder: whether it is there, its indexer and its retrievers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._searcher = spark, path, None

    def built(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        about = jvm.org.apache.hadoop.fs.Path(f"{self.path}/about/_SUCCESS")
        return about.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(about)

    def index(self, vectors: DataFrame, bsize: int = 32, compress_range: bool = False, scale_float: float = 100.0, impacts: str = "error") -> IndexHandle:
        """Indexes rows of (docno, toks map); refuses if there is an index."""
        if self.built():
            raise FileExistsError(self.path)
        SparseIndex.from_vectors(vectors, bsize, scale=scale_float, compress_range=compress_range, impacts=impacts).save(self.path)
        return self

    def indexer(self, bsize: int = 32, compress_range: bool = False, scale_float: float = 100.0, impacts: str = "error") -> Callable[[DataFrame], IndexHandle]:
        """The index method with its options set; to be called with the vectors."""
        return partial(self.index, bsize=bsize, compress_range=compress_range, scale_float=scale_float, impacts=impacts)

    def load_into_memory(self) -> Searcher:
        if self._searcher is None:
            self._searcher = Searcher(self.spark, self.path)
        return self._searcher

    def retriever(self, num_results: int = 1000, alpha: float = 1.0, beta: float = 1.0) -> Retriever:
        return Retriever(self, num_results, alpha, beta)

    def transform(self, frame: DataFrame) -> DataFrame:
        return self.retriever().transform(frame)

    def close(self) -> None:
        if self._searcher is not None:
            self._searcher.close()
            self._searcher = None

    def __enter__(self) -> IndexHandle:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Retriever:
    """From a frame with qid and query_toks to the same rows with docno, score and rank from 0, all queries in one job."""

    def __init__(self, handle: IndexHandle, num_results: int = 1000, alpha: float = 1.0, beta: float = 1.0):
        self.handle, self.num_results, self.alpha, self.beta = handle, num_results, alpha, beta

    def transform(self, frame: DataFrame) -> DataFrame:
        weights = frame_weights(frame).withColumn("weight", F.col("weight").cast("float"))
        found = self.handle.load_into_memory().search_df(weights, self.num_results, self.alpha, self.beta)
        return result_frame(found, frame)

    def fuse_rank_cutoff(self, k: int) -> Retriever:
        """A retriever of k results at most; itself if it has no more."""
        return Retriever(self.handle, k, self.alpha, self.beta) if self.num_results > k else self
