"""Per-cell quality covariates.

One aggregation by cell computes all modalities' measures as conditional
aggregates over longs, so it stays a hash aggregation with partial sums; the
spine of cells is then left-joined on the same key, which the aggregate's
partitioning already serves.  Entries that come in dealt by cell are not
shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_mito
from ..schemas import COVARIATES, MITO_PATTERN


_LOW = (1 << 31) - 1


def _measures(modality: str) -> dict[str, Column]:
    own = F.col("modality") == modality
    return {
        "sum": F.sum(F.when(own, F.col("x").cast("long"))),
        "count": F.count(F.when(own, F.lit(1))),
        "mito": F.sum(F.when(own & F.col("is_mito"), F.col("x").cast("long"))),
        # the largest count, and below it the lowest feature, packed into one long
        "top": F.max(F.when(own, F.shiftleft(F.col("x").cast("long"), 31) + (_LOW - F.col("feature_idx")))),
    }


def covariates(entries: DataFrame, features: DataFrame, cells: DataFrame, modalities: list[str], mito_pattern: str = MITO_PATTERN, batch: bool = True) -> DataFrame:
    """One row per cell: ``cell_idx``, ``{modality}_{covariate}`` columns in order, ``batch``.

    ``entries(modality, feature_idx, cell_idx, x)``; ``features`` with ids and
    names; ``cells(cell_idx, batch)`` lists every cell.  Cells without counts get
    0, 0, 0.0, the modality's first feature and 1.0.
    """
    rows = entries.select("modality", "feature_idx", "cell_idx", "x")
    if "gene" in modalities:
        mito = features.where((F.col("modality") == "gene") & is_mito(F.col("feature_name"), mito_pattern))
        mito = mito.select("modality", "feature_idx", F.lit(True).alias("is_mito"))
        rows = rows.join(mito, ["modality", "feature_idx"], "left").withColumn("is_mito", F.coalesce("is_mito", F.lit(False)))
    else:
        rows = rows.withColumn("is_mito", F.lit(False))
    wanted = {m: COVARIATES[m] for m in modalities}
    aggs = []
    for m, names in wanted.items():
        got = _measures(m)
        need = {"sum", "count"} | ({"mito"} if "p_mito" in names else set()) | ({"top"} if "frac_umis_max_feature" in names else set())
        aggs += [v.alias(f"{m}__{k}") for k, v in got.items() if k in need]
    out = cells.select("cell_idx", "batch").join(rows.groupBy("cell_idx").agg(*aggs), "cell_idx", "left")
    for m, names in wanted.items():
        total = F.nullif(F.col(f"{m}__sum"), F.lit(0))
        out = out.withColumn(f"{m}_n_umis", F.coalesce(F.col(f"{m}__sum"), F.lit(0)).cast("long"))
        out = out.withColumn(f"{m}_n_nonzero", F.coalesce(f"{m}__count", F.lit(0)).cast("long"))
        if "p_mito" in names:
            out = out.withColumn(f"{m}_p_mito", F.coalesce(F.coalesce(F.col(f"{m}__mito"), F.lit(0)).cast("double") / total, F.lit(0.0)))
        if "frac_umis_max_feature" in names:
            ids = features.where(F.col("modality") == m).select(F.col("feature_idx").alias("__f"), F.col("feature_id").alias(f"{m}_feature_w_max_expression"))
            top = F.col(f"{m}__top")
            feature = F.coalesce(_LOW - top.bitwiseAND(F.lit(_LOW)), F.lit(0)).cast("int")
            out = out.withColumn("__f", feature).join(ids, "__f", "left").drop("__f")
            out = out.withColumn(f"{m}_frac_umis_max_feature", F.coalesce(F.shiftright(top, 31).cast("double") / total, F.lit(1.0)))
    return out.select("cell_idx", *[f"{m}_{c}" for m, names in wanted.items() for c in names], *(["batch"] if batch else []))
