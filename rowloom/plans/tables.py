"""The driver's star schema seen as expression data.

Orders are cells, parts genes, suppliers guide RNAs, nations vectors, and the
pairs of return flag and line status proteins; order priority is the batch.
Counts are quantities summed by (feature, cell).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dealing import deal, tasks_of_files
from ..operators.pairs import CONTROL
from ..operators.rows import numbered

#: Stand-in for the mitochondrial pattern.
MITO = "(?i)^red "
#: Guide counts from which a cell is assigned to the guide.
ASSIGN = 30


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for the lines, see ``dealing``."""
    return tasks_of_files(read(spark, sf_dir, "lineitem"))


def _protein(lineitem: DataFrame) -> DataFrame:
    """``(l_returnflag, l_linestatus, feature_idx)``: six rows."""
    kinds = lineitem.select("l_returnflag", "l_linestatus").distinct()
    rank = F.row_number().over(Window.orderBy("l_returnflag", "l_linestatus")) - 1
    return kinds.withColumn("feature_idx", rank)


#: Raw key of the modalities that have one.
KEYS = {"gene": "l_partkey", "grna": "l_suppkey"}


def entries(spark: SparkSession, sf_dir: str, modality: str, feature: int | None = None) -> DataFrame:
    """``(feature_idx, cell_idx, x)`` of one modality, or of one of its features: then the raw key is filtered in the scan.

    Without a feature, lines are dealt by cell before they are summed, as in ``all_entries``.
    """
    return _summed(_lines(spark, sf_dir, [modality], dealt=feature is None, feature=feature)).drop("modality")


def all_entries(spark: SparkSession, sf_dir: str, modalities: list[str]) -> DataFrame:
    """``(modality, feature_idx, cell_idx, x)``: one scan, dealt by cell before it is summed.

    What aggregates these entries by cell needs no exchange of its own.
    """
    return _summed(_lines(spark, sf_dir, modalities, dealt=True))


def _lines(spark: SparkSession, sf_dir: str, modalities: list[str], dealt: bool = False, feature: int | None = None) -> DataFrame:
    """``(modality, feature_idx, cell_idx, x)`` per line and modality, not summed."""
    li = read(spark, sf_dir, "lineitem")
    if feature is not None:
        li = li.where(F.col(KEYS[modalities[0]]) == F.lit(feature).cast("long"))
    columns = {"gene": F.col("l_partkey").cast("int"), "grna": F.col("l_suppkey").cast("int"), "protein": F.col("feature_idx")}
    if "protein" in modalities:
        li = li.join(F.broadcast(_protein(read(spark, sf_dir, "lineitem"))), ["l_returnflag", "l_linestatus"])
    li = li.select(F.col("l_orderkey").cast("int").alias("cell_idx"), F.col("l_quantity").cast("int").alias("x"), *[columns[m].alias(m) for m in modalities])
    if dealt:
        li = deal(li, tasks(spark, sf_dir), "cell_idx")
    if len(modalities) == 1:
        return li.select(F.lit(modalities[0]).alias("modality"), F.col(modalities[0]).alias("feature_idx"), "cell_idx", "x")
    each = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(m).alias("feature_idx")) for m in modalities])
    return li.select(F.inline(each), "cell_idx", "x")


def _summed(lines: DataFrame) -> DataFrame:
    return lines.groupBy("modality", "feature_idx", "cell_idx").agg(F.sum("x").alias("x"))


def features(spark: SparkSession, sf_dir: str, modality: str) -> DataFrame:
    """``(feature_idx, feature_id, feature_name)``."""
    if modality == "gene":
        part = read(spark, sf_dir, "part")
        return part.select(F.col("p_partkey").cast("int").alias("feature_idx"), F.concat(F.lit("part_"), "p_partkey").alias("feature_id"), F.col("p_name").alias("feature_name"))
    if modality == "grna":
        supp = read(spark, sf_dir, "supplier")
        name = F.concat(F.lit("supp_"), "s_suppkey")
        return supp.select(F.col("s_suppkey").cast("int").alias("feature_idx"), name.alias("feature_id"), name.alias("feature_name"))
    name = F.concat("l_returnflag", F.lit("_"), "l_linestatus")
    return _protein(read(spark, sf_dir, "lineitem")).select(F.col("feature_idx").cast("int").alias("feature_idx"), name.alias("feature_id"), name.alias("feature_name"))


def all_features(spark: SparkSession, sf_dir: str, modalities: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [features(spark, sf_dir, m).withColumn("modality", F.lit(m)) for m in modalities])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell_idx, batch)``: every order."""
    orders = read(spark, sf_dir, "orders")
    names = orders.select("o_orderpriority").distinct()
    ranked = names.withColumn("batch", F.concat(F.lit("batch_"), F.row_number().over(Window.orderBy("o_orderpriority"))))
    return orders.join(F.broadcast(ranked), "o_orderpriority").select(F.col("o_orderkey").cast("int").alias("cell_idx"), "batch")


def cells_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_idx`` of the orders that survive."""
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("int").alias("cell_idx"))


def grna_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grna_id, vector_id, ordinal)``; vectors first appear in nation order."""
    supp = read(spark, sf_dir, "supplier")
    return supp.select(
        F.concat(F.lit("supp_"), "s_suppkey").alias("grna_id"), F.concat(F.lit("vector_"), "s_nationkey").alias("vector_id"),
        (F.col("s_nationkey").cast("long") * 1_000_000_000 + F.col("s_suppkey")).alias("ordinal"),
    )


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s_suppkey, s_nationkey, cell_idx)``: cells in use assigned to each guide."""
    got = entries(spark, sf_dir, "grna").where(F.col("x") >= ASSIGN)
    got = got.join(cells_in_use(spark, sf_dir), "cell_idx", "left_semi")
    supp = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("feature_idx"), "s_nationkey")
    return got.join(supp, "feature_idx").select(F.col("feature_idx").alias("s_suppkey"), "s_nationkey", "cell_idx")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nt_id, cell_idx)``: cells of the non-targeting guides."""
    nt = read(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return assigned(spark, sf_dir).join(F.broadcast(nt), "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("nt_id"), "cell_idx")


def control_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nt = read(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return read(spark, sf_dir, "supplier").join(F.broadcast(nt), "s_nationkey", "left_semi").select(F.col("s_suppkey").cast("int").alias("nt_id"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(group_id, cell_idx)``: cells of each nation's guides, each once."""
    return assigned(spark, sf_dir).select(F.col("s_nationkey").cast("int").alias("group_id"), "cell_idx").distinct()


def members(spark: SparkSession, sf_dir: str, once: bool) -> DataFrame:
    """``(cell_idx, group_id, times)`` of treatment groups and of the control, from one scan of the guides.

    A control cell counts as often as control guides list it, or ``once``.
    """
    nt = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_regionkey") == 0).alias("nt"))
    rows = assigned(spark, sf_dir).join(F.broadcast(nt), "s_nationkey", "left")
    both = F.array_compact(F.array(F.col("s_nationkey").cast("int"), F.when(F.col("nt"), F.lit(CONTROL))))
    times = F.count("*").alias("times")
    got = rows.select("cell_idx", F.explode(both).alias("group_id")).groupBy("cell_idx", "group_id").agg(times)
    return got.withColumn("times", F.when((F.col("group_id") == CONTROL) & F.lit(not once), F.col("times")).otherwise(1))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(feature_idx, group_id)``: the pairs to analyse, every part with every nation."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("feature_idx"))
    return part.crossJoin(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("group_id")))


def positions_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell_idx, pos)``: cells in use and their 1-based positions."""
    return numbered(cells_in_use(spark, sf_dir))
