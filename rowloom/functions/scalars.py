"""Scalar functions of the engine, as column expressions or driver helpers."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MITO_PATTERN, MODALITIES


def modality_name(raw: Column) -> Column:
    """Short name of a feature class; an unknown class has its white space replaced by ``_``."""
    known = F.create_map(*[F.lit(v) for pair in MODALITIES.items() for v in pair])
    return F.coalesce(F.element_at(known, raw), F.regexp_replace(raw, r"\s+", "_"))


def is_mito(name: Column, pattern: str = MITO_PATTERN) -> Column:
    """Whether a gene name is mitochondrial."""
    return F.coalesce(name.rlike(pattern), F.lit(False))


def batch_of_cell(cell_idx: Column, n_cells: int, n_batches: int) -> Column:
    """Equal-width, right-closed binning of 0-based cell ordinals into 1-based batches."""
    if n_cells < 2:
        return F.lit(1)
    steps = F.ceil(cell_idx * n_batches / F.lit(n_cells - 1))
    return F.greatest(F.lit(1).cast("long"), steps.cast("long"))


def expand_home(path: str) -> str:
    """A path with a leading ``~`` expanded."""
    return os.path.expanduser(path)
