"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows handled at once inside a Python worker.
SLICE_ROWS = 256
#: Rows of an Arrow batch to and from Python, if the session leaves Spark's default: texts are long rows.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below ``sf_dir`` through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where the session has none (unit tests on one machine),
    a temporary folder is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="rowloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def new_shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"rowloom-{kind}-{uuid.uuid4().hex}")


def trim() -> None:
    """Give memory that this Python process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Give memory that the driver has freed back to the system: Python's, then its JVM's.

    A long run of jobs leaves what its plans and their compilation took in
    malloc's arenas, and a heap that has grown; the heap is collected, and so
    shrinks, only beyond half of its bound.  A JVM without the command to trim is left as it is.
    """
    trim()
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    now = jvm.java.lang.Runtime.getRuntime()
    if 2 * now.totalMemory() > now.maxMemory():
        jvm.java.lang.System.gc()
    # the server's class is not public, so its method is found by the interface
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = jvm.java.lang.Class.forName(name)
    given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given[1], given[2], given[3] = "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    try:
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        pass


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    give_back(df.sparkSession)
    return out


#: Rows up to which a counted table of short rows is broadcast; beyond, Spark shuffles the join.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df``, broadcast if it is counted (or its ``weight`` summed) and found within ``BROADCAST_ROWS``.

    For tables already materialised, of rows of bounded width.
    """
    n = df.agg(F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", n_rows: int | None = None, least: int = 500, share: int = 1000, slices: int = 32) -> DataFrame:
    """Join on ``key``, of which ``right`` has one row each and ``left`` may have any number.

    A key of more than one ``share``-th of ``left``'s rows (and more than
    ``least``) is hot; there are fewer than ``share`` of them.  Their rows are
    dealt by a hash of the whole row, and their rows in ``right`` repeated for
    each slice, so no task gets a hot key alone.  ``n_rows`` saves the count.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    limit = max(least, (left.count() if n_rows is None else n_rows) // share)
    hot = [r[0] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left = left.withColumn("__part", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(slices))).otherwise(F.lit(0).cast("long")))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_hot, F.lit(slices - 1).cast("long")).otherwise(F.lit(0).cast("long"))))
    return left.join(right.withColumn("__part", parts), [key, "__part"], how).drop("__part")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % n


def unit_hash(*cols: Column) -> Column:
    """Deterministic value in [0, 1) from ``cols``, for bounded sampling."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, and keep Arrow batches small.

    Python workers import the operators by name; they need not share the
    driver's working folder or path.  A batch of Spark's default size holds some
    tens of megabytes of text, on both sides and for each core.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    root = Path(__file__).resolve().parent.parent
    if spark.sparkContext.applicationId in _shipped or not root.is_dir():  # a zip: submitted with the job
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="rowloom-code-")), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)  # read on the driver alone; Spark hands it to the executors
    _shipped.add(spark.sparkContext.applicationId)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back: workers live on, beside those of later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def map_texts(
    df: DataFrame,
    keep: Sequence[Column],
    text: Column,
    out: Sequence[tuple[str, str]],
    make: Callable[[], Callable[[list[str | None]], list[list]]],
) -> DataFrame:
    """Run a Python function over texts in Arrow batches.

    ``keep`` columns pass through unchanged; ``make()`` is called once per task
    and returns a function from a list of texts to one list of values for each
    ``out`` column (name, Spark type).  Memory is bounded by an Arrow batch.
    """
    ship(df.sparkSession)
    src = df.select(*keep, text.cast("string").alias("__text"))
    kept = src.drop("__text")
    fields = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
        + [f"`{n}` {t}" for n, t in out]
    )
    n_keep, names = len(kept.columns), [f.name for f in kept.schema.fields] + [n for n, _ in out]
    arrow = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
    }
    kinds = [arrow[t] for _, t in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                f = f or make()
                got = f(batch.column(n_keep).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(n_keep)]
                    + [pa.array(v, type=k) for v, k in zip(got, kinds, strict=True)],
                    names=names,
                )

    return src.mapInArrow(tidy(run), fields)
