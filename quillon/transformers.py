"""Indexing and retrieval as transformers of pandas frames, for pipelines of the `pyterrier` package where it is installed.

Without that package the classes work alike, on a plain base class. Only query frames and results pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from quillon.api import IndexHandle, Indexer

try:
    from pyterrier import Indexer as _IndexerBase
    from pyterrier import Transformer as _Base
except ImportError:

    class _Base:
        def __call__(self, frame):
            return self.transform(frame)

    _IndexerBase = _Base


class FrameRetriever(_Base):
    """Adds docno, score and rank (from 0) to a pandas frame with qid and query_toks; its index is kept in ``spark``."""

    def __init__(self, handle: IndexHandle, num_results: int = 1000, alpha: float = 1.0, beta: float = 1.0):
        super().__init__()
        self.handle, self.num_results, self.alpha, self.beta = handle, num_results, alpha, beta

    def transform(self, frame):
        import pandas as pd

        missing = [c for c in ("qid", "query_toks") if c not in frame.columns]
        if missing:
            raise ValueError(f"the frame has no column {', '.join(missing)}")
        out = [*frame.columns, "docno", "score", "rank"]
        keyed = [(i, {t: float(w) for t, w in toks.items()}) for i, toks in enumerate(frame["query_toks"])]
        asked = self.handle.spark.createDataFrame(keyed, "qid long, query_toks map<string,float>")
        found = self.handle.retriever(self.num_results, self.alpha, self.beta).transform(asked).select("qid", "docno", "score", "rank").orderBy("qid", "rank").collect()
        rows = frame.iloc[[r["qid"] for r in found]].reset_index(drop=True)
        return pd.concat([rows, pd.DataFrame({c: [r[c] for r in found] for c in ("docno", "score", "rank")})], axis=1)[out]

    def fuse_rank_cutoff(self, k: int) -> FrameRetriever | None:
        """A retriever of k results, into which a pipeline's rank cut is merged; None, for no merging, if it has no more."""
        return FrameRetriever(self.handle, k, self.alpha, self.beta) if self.num_results > k else None


class FrameIndex(_IndexerBase):
    """An index by its folder, filled from any iterable of {docno, toks} and asked as a transformer."""

    def __init__(self, handle: IndexHandle, bsize: int = 32, compress_range: bool = False, scale_float: float = 100.0):
        super().__init__()
        self.handle, self.bsize, self.compress_range, self.scale_float = handle, bsize, compress_range, scale_float

    def index(self, documents: Iterable[Mapping] | DataFrame) -> FrameIndex:
        if isinstance(documents, DataFrame):
            self.handle.index(documents, self.bsize, self.compress_range, self.scale_float)
            return self
        if self.handle.built():
            raise FileExistsError(self.handle.path)
        indexer = Indexer(self.handle.spark, self.handle.path, self.bsize, self.compress_range)
        for document in documents:
            toks = document["toks"]
            floats = toks and isinstance(next(iter(toks.values())), float)
            indexer.add_document(document["docno"], {t: int(w * self.scale_float) for t, w in toks.items()} if floats else toks)
        indexer.finish()
        return self

    def retriever(self, num_results: int = 1000, alpha: float = 1.0, beta: float = 1.0) -> FrameRetriever:
        return FrameRetriever(self.handle, num_results, alpha, beta)

    def transform(self, frame):
        return self.retriever().transform(frame)
