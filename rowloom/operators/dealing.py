"""How many tasks rows are dealt to.

Left to itself, adaptive execution merges partitions until there is about one a
core, so what a task holds grows with the input.  A number given by hand stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of input files for one task.
ROWS, BYTES = 250_000, 3 << 20


def tasks(spark: SparkSession, rows: int) -> int | None:
    """Partitions for so many rows; None where a share of one core each is small enough."""
    n = -(-rows // ROWS)
    return n if n > spark.sparkContext.defaultParallelism else None


def tasks_of_files(table: DataFrame) -> int | None:
    """The same for a table read from files, by their size; no job is run."""
    size = int(str(table._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return tasks(table.sparkSession, size // BYTES * ROWS)


def deal(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys to ``n`` tasks, or to as many as Spark sees fit."""
    return rows.repartition(n, *keys) if n else rows.repartition(*keys)
