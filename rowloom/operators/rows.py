"""Row lookups and pointer arithmetic over entries ``(feature_idx, cell_idx, x)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sparse_row(entries: DataFrame, feature_idx: int, values: bool = True) -> DataFrame:
    """``(cell_idx, x)`` of one feature; the equality reaches the Parquet scan, and without ``values`` x is not read."""
    return entries.where(F.col("feature_idx") == feature_idx).select("cell_idx", *(["x"] if values else []))


def dense_row(entries: DataFrame, cells: DataFrame, feature_idx: int) -> DataFrame:
    """``(cell_idx, x)`` for every cell, zeros filled in."""
    row = sparse_row(entries, feature_idx)
    return cells.select("cell_idx").join(row, "cell_idx", "left").select("cell_idx", F.coalesce("x", F.lit(0)).alias("x"))


def rows_of(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries of many features at once, by semi-join."""
    return entries.join(wanted.select("feature_idx").distinct(), "feature_idx", "left_semi")


def threshold_row(entries: DataFrame, feature_idx: int, threshold: int) -> DataFrame:
    """``cell``: 1-based cells of one feature with a stored count of ``threshold`` or more."""
    return entries.where((F.col("feature_idx") == feature_idx) & (F.col("x") >= threshold)).select((F.col("cell_idx") + 1).alias("cell"))


def assignments(entries: DataFrame, threshold: int) -> DataFrame:
    """``(feature_idx, cell_idx)`` of all stored counts of ``threshold`` or more."""
    return entries.where(F.col("x") >= threshold).select("feature_idx", "cell_idx")


def masked_row(entries: DataFrame, feature_idx: int, cells_in_use: DataFrame) -> DataFrame:
    """``cell_idx`` of the stored entries of one feature among the cells in use; values are not read."""
    return sparse_row(entries, feature_idx, values=False).join(cells_in_use.select("cell_idx"), "cell_idx", "left_semi")


def masked_positions(entries: DataFrame, feature_idx: int, cells_in_use: DataFrame) -> DataFrame:
    """``pos``: where in ``cells_in_use(pos, cell_idx)`` the stored entries of one feature stand; values are not read."""
    return sparse_row(entries, feature_idx, values=False).join(cells_in_use.select("pos", "cell_idx"), "cell_idx").select("pos")


def numbered(cells: DataFrame, start: int = 1, span: int = 16) -> DataFrame:
    """``cells`` with ``pos``, their number in order of ``cell_idx``, from ``start``.

    Cells are numbered within blocks of ``2 ** span`` indices, and blocks by a
    running sum over one row each, so no task sorts all cells.
    """
    block = F.shiftright("cell_idx", span)
    cells = cells.withColumn("__block", block)
    sizes = cells.groupBy("__block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__block", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__block").orderBy("cell_idx"))
    return cells.join(sizes, "__block").withColumn("pos", (F.col("__before") + own + (start - 1)).cast("int")).drop("__block", "__before")


def submatrix(entries: DataFrame, cells: DataFrame, batch: str) -> DataFrame:
    """Entries of the cells of one batch, which are numbered anew from 0; ``cells(cell_idx, batch)``."""
    own = numbered(cells.where(F.col("batch") == batch).select("cell_idx"), start=0)
    return entries.join(own, "cell_idx").select("feature_idx", F.col("pos").alias("cell_idx"), "x")


def nnz_per_feature(entries: DataFrame, features: DataFrame) -> DataFrame:
    """``(feature_idx, nnz)`` of every feature, also of those without entries."""
    counts = entries.groupBy("feature_idx").agg(F.count("*").alias("nnz"))
    return features.select("feature_idx").join(counts, "feature_idx", "left").select("feature_idx", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def row_pointers(nnz: DataFrame) -> DataFrame:
    """``(feature_idx, ptr)``: exclusive running sum of nnz, and the total one past the last feature.

    The window runs over one row per feature, not over entries.
    """
    last = nnz.agg((F.max("feature_idx") + 1).alias("feature_idx"), F.lit(0).cast("long").alias("nnz")).where("feature_idx is not null")
    before = Window.orderBy("feature_idx").rowsBetween(Window.unboundedPreceding, -1)
    return nnz.unionByName(last).select("feature_idx", F.coalesce(F.sum("nnz").over(before), F.lit(0)).cast("long").alias("ptr"))


def pointers_to_index(pointers: DataFrame) -> DataFrame:
    """``(position, feature_idx)``: the feature of each stored entry, from row pointers."""
    after = F.lead("ptr").over(Window.orderBy("feature_idx"))
    spans = pointers.select("feature_idx", "ptr", after.alias("end")).where("end > ptr")
    return spans.select(F.explode(F.sequence(F.col("ptr"), F.col("end") - 1)).alias("position"), "feature_idx")


def segment_starts(entries: DataFrame, starts: list[int]) -> DataFrame:
    """``(start, feature_idx)``: the first feature with entries at or after each start, null if there is none.

    One pass with one partial minimum per start; starts are as few as modalities.
    """
    least = [F.min(F.when(F.col("feature_idx") >= s, F.col("feature_idx"))) for s in starts]
    rows = F.array(*[F.struct(F.lit(s).alias("start"), m.alias("feature_idx")) for s, m in zip(starts, least)])
    return entries.agg(rows.alias("r")).select(F.inline("r"))
