"""Schemas and constants of the expression data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Raw feature class -> modality name.
MODALITIES = {"Gene Expression": "gene", "CRISPR Guide Capture": "grna", "Antibody Capture": "protein"}

#: Covariates of each modality, in output order.
COVARIATES = {
    "gene": ["n_umis", "n_nonzero", "p_mito"],
    "grna": ["n_umis", "n_nonzero", "feature_w_max_expression", "frac_umis_max_feature"],
    "protein": ["n_umis", "n_nonzero"],
}

#: Fixed value: names of mitochondrial genes.
MITO_PATTERN = "(?i)^MT-"

BATCHES = T.StructType([
    T.StructField("batch_idx", T.IntegerType()), T.StructField("batch", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("cell_offset", T.LongType()), T.StructField("n_cells", T.LongType()),
])
META = T.StructType([
    T.StructField("format_version", T.IntegerType()), T.StructField("modality", T.StringType()), T.StructField("n_features", T.IntegerType()),
    T.StructField("n_cells", T.LongType()), T.StructField("nnz", T.LongType()), T.StructField("integer_id", T.IntegerType()),
])
