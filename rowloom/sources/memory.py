"""In-memory matrices as entry DataFrames.

Accepted: a dense NumPy array or nested lists; ``Coo(shape, i, j, x)``;
``Csr(shape, p, j, x)``; ``Csc(shape, p, i, x)``; a DataFrame of entries; a
handle on a store; any object with a ``tocoo`` method whose result has ``shape``,
``row``, ``col`` and ``data``, as sparse matrix classes commonly have.
Values may be integers, reals (truncated) or booleans (true is 1).  Zeros are
dropped and repeated coordinates summed when entries are normalised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Coo:
    """Triplets, 0-based."""

    shape: tuple[int, int]
    i: np.ndarray
    j: np.ndarray
    x: np.ndarray


@dataclass
class Csr:
    """Row pointers, column indices, values."""

    shape: tuple[int, int]
    p: np.ndarray
    j: np.ndarray
    x: np.ndarray


@dataclass
class Csc:
    """Column pointers, row indices, values."""

    shape: tuple[int, int]
    p: np.ndarray
    i: np.ndarray
    x: np.ndarray


@dataclass
class Frame:
    """Entries ``(feature_idx, cell_idx, x)`` that Spark already holds."""

    shape: tuple[int, int]
    entries: DataFrame = field(repr=False)


def pointers_to_index(p) -> np.ndarray:
    """Index of each entry from a pointer vector: index k repeats p[k+1] - p[k] times."""
    p = np.asarray(p)
    return np.repeat(np.arange(len(p) - 1), np.diff(p))


def index_to_pointers(i, n: int) -> np.ndarray:
    """Pointer vector of a sorted index vector over ``n`` rows."""
    return np.concatenate([[0], np.cumsum(np.bincount(np.asarray(i, dtype=np.int64), minlength=n))])


def to_entries(spark: SparkSession, matrix) -> tuple[tuple[int, int], DataFrame]:
    """Shape and ``(feature_idx, cell_idx, x)`` of a matrix; anything else raises ``TypeError``."""
    if hasattr(matrix, "entries") and hasattr(matrix, "feature_ids"):  # a handle
        return tuple(matrix.shape), matrix.entries.select("feature_idx", "cell_idx", "x")
    if hasattr(matrix, "tocoo"):
        m = matrix.tocoo()
        matrix = Coo(m.shape, m.row, m.col, m.data)
    if isinstance(matrix, Frame):
        return matrix.shape, matrix.entries.select(*[F.col(c).cast("int").alias(c) for c in ("feature_idx", "cell_idx", "x")])
    if isinstance(matrix, list):
        matrix = np.array(matrix)
    if isinstance(matrix, np.ndarray) and matrix.ndim == 2:
        i, j = np.nonzero(matrix)
        shape, x = matrix.shape, matrix[i, j]
    elif isinstance(matrix, Coo):
        shape, i, j, x = matrix.shape, matrix.i, matrix.j, matrix.x
    elif isinstance(matrix, Csr):
        shape, i, j, x = matrix.shape, pointers_to_index(matrix.p), matrix.j, matrix.x
    elif isinstance(matrix, Csc):
        shape, i, j, x = matrix.shape, matrix.i, pointers_to_index(matrix.p), matrix.x
    else:
        raise TypeError(f"class {type(matrix).__name__} is not a matrix this engine reads")
    cols = {"feature_idx": i, "cell_idx": j, "x": np.trunc(np.asarray(x).astype(float))}
    pdf = pd.DataFrame({k: np.asarray(v).astype(np.int32) for k, v in cols.items()})
    return tuple(map(int, shape)), spark.createDataFrame(pdf, "feature_idx int, cell_idx int, x int")


def ordered(entries: DataFrame, by_row: bool = True) -> DataFrame:
    """Entries in row-major or column-major order, range-partitioned and sorted within partitions."""
    first, second = ("feature_idx", "cell_idx") if by_row else ("cell_idx", "feature_idx")
    return entries.repartitionByRange(first, second).sortWithinPartitions(first, second)
