"""Handle on a stored expression matrix."""

from __future__ import annotations

from functools import cached_property
from numbers import Integral

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import expand_home
from .operators import rows
from .operators.dealing import tasks
from .operators.pairs import PairQC, pair_qc
from .sources import files, store


class ExpressionMatrix:
    """Features x cells; entries stay in Parquet until a row is asked for.

    ``m[i]`` and ``m[i, :]`` give a dense row as a NumPy array, by 1-based index
    or by feature ID; ``row_df`` and ``rows_df`` stay in Spark.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._meta = store.read_meta(spark, self.path)
        self.modality, self.integer_id = self._meta["modality"], self._meta["integer_id"]

    @property
    def shape(self) -> tuple[int, int]:
        """(features, cells), from the metadata."""
        return self._meta["n_features"], self._meta["n_cells"]

    @property
    def nnz(self) -> int:
        return self._meta["nnz"]

    def __len__(self) -> int:
        return self.shape[0]

    @cached_property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(store.ENTRIES).parquet(f"{self.path}/entries")

    @cached_property
    def features(self) -> DataFrame:
        return self.spark.read.schema(store.FEATURES).parquet(f"{self.path}/features")

    @cached_property
    def cells(self) -> DataFrame:
        """Every cell, with or without entries."""
        return self.spark.range(self.shape[1]).select(F.col("id").cast("int").alias("cell_idx"))

    @cached_property
    def feature_ids(self) -> list[str]:
        """Feature IDs in row order."""
        return [r[0] for r in self.features.orderBy("feature_idx").select("feature_id").collect()]

    @property
    def dimnames(self) -> tuple[list[str], None]:
        """Row names; cells have none."""
        return self.feature_ids, None

    def index_of(self, key: int | str) -> int:
        """0-based row of a 1-based index or a feature ID that occurs exactly once."""
        if isinstance(key, str):
            found = [r[0] for r in self.features.where(F.col("feature_id") == key).select("feature_idx").limit(2).collect()]
            if len(found) != 1:
                raise KeyError(f"feature ID {key!r} must occur exactly once, found {len(found)} time(s) or more")
            return found[0]
        if isinstance(key, bool) or not isinstance(key, Integral):
            raise TypeError("a row is given by one integer index or one feature ID")
        if not 1 <= key <= self.shape[0]:
            raise IndexError(f"row {key} does not exist: rows run from 1 to {self.shape[0]}")
        return int(key) - 1

    def row_df(self, key: int | str, dense: bool = False) -> DataFrame:
        """One row as ``(cell_idx, x)``."""
        k = self.index_of(key)
        return rows.dense_row(self.entries, self.cells, k) if dense else rows.sparse_row(self.entries, k)

    def rows_df(self, keys: list[int | str]) -> DataFrame:
        """Sparse entries of many rows in one scan."""
        by_id = [k for k in keys if isinstance(k, str)]
        found: dict[str, list[int]] = {}
        if by_id:
            for r in self.features.where(F.col("feature_id").isin(by_id)).collect():
                found.setdefault(r["feature_id"], []).append(r["feature_idx"])
        wanted = []
        for k in keys:
            if isinstance(k, str):
                if len(found.get(k, [])) != 1:
                    raise KeyError(f"feature ID {k!r} must occur exactly once")
                wanted += found[k]
            else:
                wanted.append(self.index_of(k))
        return self.entries.where(F.col("feature_idx").isin(wanted))

    def row(self, key: int | str) -> np.ndarray:
        """One dense row on the driver."""
        out = np.zeros(self.shape[1], np.int32)
        got = self.row_df(key).toArrow()
        out[got.column("cell_idx").to_numpy()] = got.column("x").to_numpy()
        return out

    def __getitem__(self, key) -> np.ndarray:
        if isinstance(key, tuple):
            if len(key) != 2 or key[1] != slice(None):
                raise TypeError("only whole rows can be read: m[i] or m[i, :]")
            key = key[0]
        return self.row(key)

    def threshold(self, key: int | str, threshold: int) -> DataFrame:
        """1-based cells of a row with a stored count of ``threshold`` or more."""
        return rows.threshold_row(self.entries, self.index_of(key), threshold)

    def positions(self, key: int | str, cells_in_use: DataFrame) -> DataFrame:
        """``pos``: 1-based positions in ``cells_in_use(pos, cell_idx)`` of a row's stored entries."""
        return rows.masked_positions(self.entries, self.index_of(key), cells_in_use)

    def pair_qc(self, cells_in_use: DataFrame, groups: DataFrame, controls: DataFrame, pairs: DataFrame, all_controls: DataFrame | None = None) -> PairQC:
        """Nonzero-cell counts of response-perturbation pairs and of the control guides, in one call.

        Lists are given by 1-based position in ``cells_in_use(pos, cell_idx)``:
        ``groups(group_id, pos)``, and ``controls(nt_id, pos)`` if cells outside a
        pair's group are its control (the complement).  With ``all_controls(nt_pos,
        pos)`` the control cells are the control, and ``controls(nt_id, nt_pos)``
        refers to that list.  ``pairs(feature_idx, group_id)`` are 0-based features.
        """
        return pair_qc(self.entries, self.features, cells_in_use, groups, controls, pairs, all_controls, tasks(self.spark, self.nnz))

    def nnz_per_feature(self) -> DataFrame:
        return rows.nnz_per_feature(self.entries, self.features)

    def row_pointers(self) -> DataFrame:
        return rows.row_pointers(self.nnz_per_feature())

    def __repr__(self) -> str:
        n, m = self.shape
        return f"ExpressionMatrix ({self.modality})\n  {n} features\n  {m} cells\n  store: {self.path}"


def open_matrix(spark: SparkSession, path: str) -> ExpressionMatrix:
    """Open a store; reads its metadata only."""
    if not isinstance(path, str):
        raise TypeError("path must be one string")
    path = expand_home(path)
    if not files.exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no matrix store at {path}")
    return ExpressionMatrix(spark, path)
