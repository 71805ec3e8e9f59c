"""Appending batches to matrix stores, one at a time or from a stream of directories.

An extension: a batch of new cells goes behind those already stored.  Entries
are added as new Parquet files whose rows are sorted like the old ones; a row
lookup then reads one narrow row group per appended batch until ``compact``
rewrites the store.  Which directories are in is recorded beside the stores, so
a directory that arrives twice (a restarted stream replays its last
micro-batch) is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import expand_home
from ..ingest import stored_covariates
from ..matrix import ExpressionMatrix, open_matrix
from ..operators import normalize
from ..operators.dealing import tasks
from ..schemas import BATCHES, META
from ..sources import files, mtx, store


def _batches(spark: SparkSession, out: str) -> DataFrame:
    path = f"{out}/batches"
    return spark.read.schema(BATCHES).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], BATCHES)


def append_batch(spark: SparkSession, directory: str, out: str) -> bool:
    """Add the cells of one Matrix Market directory; False if it is in already.

    The features must be those of the first batch.  The record of batches is
    written last.  A call that failed between a modality's entries and its cell
    count leaves entries that no count covers; the next call says so and
    ``compact`` drops them.
    """
    out = expand_home(out).rstrip("/")
    (found,) = mtx.discover(spark, [expand_home(directory)])
    known = _batches(spark, out)
    path = files.uri(spark, found.matrix)
    rows = known.collect()  # one per batch
    if any(r["path"] == path for r in rows):
        return False
    offset = sum(r["n_cells"] for r in rows)
    k = len(rows) + 1
    features = mtx.read_features(spark, found.features)
    batch = spark.createDataFrame([(k, f"batch_{k}", path, offset, found.header.n_cells)], BATCHES)
    # one scan of the body: its lines are counted along with the sums
    summed = normalize.tidy(normalize.attach(mtx.scan(spark, [found.matrix]), features, batch), keep_zeros=True, n=tasks(spark, found.header.nnz), lines=True).persist()
    try:
        mtx.check_length(found, summed.agg(F.sum("lines")).first()[0] or 0)
        _add(spark, summed.where("x <> 0").drop("lines"), features, found, out, k, offset, directory)
    finally:
        summed.unpersist()
    batch.coalesce(1).write.mode("append").parquet(f"{out}/batches")
    return True


def _add(spark: SparkSession, entries: DataFrame, features: DataFrame, found: mtx.Directory, out: str, k: int, offset: int, directory: str) -> None:
    """Append one batch's entries to the stores, or make these from the first batch."""
    for m in [r[0] for r in features.groupBy("modality").agg(F.min("row_idx").alias("k")).orderBy("k").collect()]:
        at, own_features = f"{out}/{m}.mat", features.where(F.col("modality") == m).select("feature_idx", "feature_id", "feature_name")
        own = entries.where(F.col("modality") == m).select("feature_idx", "cell_idx", "x")
        if k == 1:
            store.write_matrix(own, own_features, at, m, found.header.n_cells, 0, partitions=tasks(spark, found.header.nnz))
            continue
        handle = open_matrix(spark, at)
        if handle.features.exceptAll(own_features).limit(1).count() or handle.shape[0] != own_features.count():
            raise ValueError(f"the features of {directory} differ from those of {at}")
        if handle.shape[1] > offset:
            continue  # a call that failed later had added this modality
        stale = handle.entries.where(F.col("cell_idx") >= offset).limit(1).count()
        if stale:
            raise ValueError(f"{at} holds entries of an unfinished append; run compact first")
        keys = ("feature_idx", "cell_idx")
        n = tasks(spark, found.header.nnz)
        (own.repartitionByRange(n, *keys) if n else own.repartitionByRange(*keys)).sortWithinPartitions(*keys).write.mode("append").option("compression", "zstd").parquet(f"{at}/entries")
        meta = (store.FORMAT_VERSION, m, handle.shape[0], offset + found.header.n_cells, handle.nnz + own.count(), handle.integer_id)
        spark.createDataFrame([meta], META).coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")


def compact(spark: SparkSession, path: str, work: str) -> ExpressionMatrix:
    """Rewrite a store into ``work`` in full row order, without entries beyond its cell count."""
    old = open_matrix(spark, path)
    own = old.entries.where(F.col("cell_idx") < old.shape[1])
    store.write_matrix(own, old.features, work, old.modality, old.shape[1], old.integer_id)
    return open_matrix(spark, work)


def current_covariates(spark: SparkSession, out: str) -> DataFrame:
    """Covariates of all cells appended so far."""
    out = expand_home(out).rstrip("/")
    batches = _batches(spark, out)
    first = batches.orderBy("batch_idx").first()
    if first is None:
        raise ValueError(f"no batch in {out}")
    found = [m for m in ("gene", "grna", "protein") if files.exists(spark, f"{out}/{m}.mat/meta")]
    return stored_covariates({m: open_matrix(spark, f"{out}/{m}.mat") for m in found}, normalize.cells_spine(batches))


def stream_batches(spark: SparkSession, inbox: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every directory named in text files that arrive in ``inbox``, one path a line."""
    lines = spark.readStream.schema("value string").format("text").load(inbox)

    def take(df: DataFrame, _: int) -> None:
        for r in df.where("trim(value) <> ''").distinct().orderBy("value").collect():  # paths, not data
            append_batch(df.sparkSession, r["value"].strip(), out)

    writer = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
