"""Sparse top-k retrieval as DataFrame plans."""

from quillon.api import IndexHandle, Indexer, InvertedIndexer, Retriever, Searcher, build_from_ciff, search_file, search_run
from quillon.index import SparseIndex

__all__ = ["IndexHandle", "Indexer", "InvertedIndexer", "Retriever", "Searcher", "SparseIndex", "build_from_ciff", "search_file", "search_run"]
