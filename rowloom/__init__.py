"""Sparse expression analytics on Spark DataFrames."""

from .ingest import Ingested, from_matrix, ingest_mtx_dirs
from .matrix import ExpressionMatrix, open_matrix
from .synth import write_example

__all__ = ["ExpressionMatrix", "Ingested", "from_matrix", "ingest_mtx_dirs", "open_matrix", "write_example"]
