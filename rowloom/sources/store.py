"""Matrix store: one directory per modality of sorted, range-partitioned Parquet.

``{modality}.mat/entries`` holds ``(feature_idx, cell_idx, x)`` in row-major
order: files have disjoint feature ranges and row groups narrow ones, so a row
lookup is an equality that Parquet statistics answer.  ``features`` and ``meta``
sit beside it.  No path is stored inside, so a store can be moved.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import META
from . import files

FORMAT_VERSION = 1
ENTRIES = "feature_idx int, cell_idx int, x int"
FEATURES = "feature_idx int, feature_id string, feature_name string"


def codec(compression_level: int) -> str:
    """Parquet codec for a compression level: 0 stores plainly, others use zstd."""
    if not 0 <= compression_level <= 9:
        raise ValueError("compression_level must be between 0 and 9")
    return "uncompressed" if compression_level == 0 else "zstd"


def write_matrix(entries: DataFrame, features: DataFrame, path: str, modality: str, n_cells: int, integer_id: int, chunk_size: int = 1000, compression_level: int = 3, partitions: int | None = None) -> None:
    """Write one modality; an existing store at ``path`` is replaced.

    ``chunk_size`` is kept for callers' sake as a hint and only validated:
    Parquet sizes its own pages.
    """
    check_layout(chunk_size, compression_level)
    keys = ("feature_idx", "cell_idx")
    dealt = entries.select(*[F.col(c).cast("int").alias(c) for c in (*keys, "x")])
    dealt = dealt.repartitionByRange(partitions, *keys) if partitions else dealt.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", codec(compression_level)).parquet(f"{path}/entries")
    write_tables(features, path, modality, n_cells, integer_id, compression_level)


def write_matrices(entries: DataFrame, features: dict[str, DataFrame], out: str, n_cells: int, integer_id: int, chunk_size: int = 1000, compression_level: int = 3, partitions: int | None = None) -> dict[str, str]:
    """Write all modalities of ``entries(modality, feature_idx, cell_idx, x)`` in one pass; their paths by modality.

    One range shuffle deals all modalities; the partitioned output is then moved
    into the stores, folder by folder.
    """
    check_layout(chunk_size, compression_level)
    spark = entries.sparkSession
    keys = ("modality", "feature_idx", "cell_idx")
    staged = f"{out}/_staged"
    dealt = entries.select("modality", *[F.col(c).cast("int").alias(c) for c in (*keys[1:], "x")])
    dealt = dealt.repartitionByRange(partitions, *keys) if partitions else dealt.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys)
    dealt.write.mode("overwrite").option("compression", codec(compression_level)).partitionBy("modality").parquet(staged)
    paths = {m: f"{out}/{m}.mat" for m in features}

    def finish(m: str) -> None:
        files.delete(spark, f"{paths[m]}/entries")
        if files.exists(spark, f"{staged}/modality={m}"):
            files.move(spark, f"{staged}/modality={m}", f"{paths[m]}/entries")
        else:  # a modality without a single entry
            spark.createDataFrame([], ENTRIES).write.parquet(f"{paths[m]}/entries")
        write_tables(features[m], paths[m], m, n_cells, integer_id, compression_level)

    with ThreadPoolExecutor(len(paths)) as pool:  # small jobs, side by side
        list(pool.map(finish, paths))
    files.delete(spark, staged)
    return paths


def check_layout(chunk_size: int, compression_level: int) -> None:
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    codec(compression_level)


def write_tables(features: DataFrame, path: str, modality: str, n_cells: int, integer_id: int, compression_level: int) -> None:
    """Features and metadata beside entries that are written already."""
    spark = features.sparkSession
    features.select("feature_idx", "feature_id", "feature_name").coalesce(1).sortWithinPartitions("feature_idx").write.mode("overwrite").option("compression", codec(compression_level)).parquet(f"{path}/features")
    nnz = spark.read.schema(ENTRIES).parquet(f"{path}/entries").count()  # answered from the footers
    n_features = spark.read.schema(FEATURES).parquet(f"{path}/features").count()
    spark.createDataFrame([(FORMAT_VERSION, modality, n_features, n_cells, nnz, integer_id)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """The one row of ``meta``."""
    row = spark.read.schema(META).parquet(f"{path}/meta").first()
    if row is None or row["format_version"] != FORMAT_VERSION:
        raise ValueError(f"{path} is not a matrix store of format {FORMAT_VERSION}")
    return row.asDict()
