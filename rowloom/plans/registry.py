"""Registered queries of the expression engine and their SQL twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ingest, synth
from ..functions.scalars import batch_of_cell, is_mito, modality_name
from ..matrix import open_matrix
from ..operators import collapse, normalize, pairs, rows
from ..operators.covariates import covariates
from ..schemas import MODALITIES
from ..sources import files, memory, mtx, store
from ..streaming import append
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Looked-up feature of the single-row queries, 0-based, and its ID.
ROW, ROW_ID = 7, "part_7"

# -- SQL fragments -----------------------------------------------------------
_ENTRIES = """
gene AS (SELECT CAST(l_partkey AS INT) f, CAST(l_orderkey AS INT) c, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) x FROM lineitem GROUP BY 1, 2),
grna AS (SELECT CAST(l_suppkey AS INT) f, CAST(l_orderkey AS INT) c, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) x FROM lineitem GROUP BY 1, 2),
kinds AS (SELECT l_returnflag, l_linestatus, row_number() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS f
          FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)),
protein AS (SELECT CAST(f AS INT) f, CAST(l_orderkey AS INT) c, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) x
            FROM lineitem JOIN kinds USING (l_returnflag, l_linestatus) GROUP BY 1, 2),
batches AS (SELECT o_orderpriority, 'batch_' || row_number() OVER (ORDER BY o_orderpriority) AS batch
            FROM (SELECT DISTINCT o_orderpriority FROM orders)),
cells AS (SELECT CAST(o_orderkey AS INT) AS cell_idx, batch FROM orders JOIN batches USING (o_orderpriority)),
mito AS (SELECT CAST(p_partkey AS INT) f FROM part WHERE lower(p_name) LIKE 'red %')"""
_GENE = """
gene_cov AS (SELECT c, sum(x) n_umis, count(*) n_nonzero, sum(CASE WHEN f IN (SELECT f FROM mito) THEN x ELSE 0 END) m FROM gene GROUP BY c)"""
_GRNA = """
grna_top AS (SELECT c, f, x FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY x DESC, f) k FROM grna) WHERE k = 1),
grna_cov AS (SELECT c, sum(x) n_umis, count(*) n_nonzero FROM grna GROUP BY c)"""
_PROTEIN = "\nprotein_cov AS (SELECT c, sum(x) n_umis, count(*) n_nonzero FROM protein GROUP BY c)"
_GENE_COLS = """CAST(coalesce(g.n_umis, 0) AS BIGINT) AS gene_n_umis, CAST(coalesce(g.n_nonzero, 0) AS BIGINT) AS gene_n_nonzero,
       coalesce(CAST(g.m AS DOUBLE) / nullif(g.n_umis, 0), 0.0) AS gene_p_mito"""
_GRNA_COLS = """CAST(coalesce(r.n_umis, 0) AS BIGINT) AS grna_n_umis, CAST(coalesce(r.n_nonzero, 0) AS BIGINT) AS grna_n_nonzero,
       'supp_' || coalesce(top.f, 0) AS grna_feature_w_max_expression,
       coalesce(CAST(top.x AS DOUBLE) / nullif(r.n_umis, 0), 1.0) AS grna_frac_umis_max_feature"""
_PROTEIN_COLS = "CAST(coalesce(p.n_umis, 0) AS BIGINT) AS protein_n_umis, CAST(coalesce(p.n_nonzero, 0) AS BIGINT) AS protein_n_nonzero"
_JOIN = {
    "gene": "LEFT JOIN gene_cov g ON g.c = cell_idx",
    "grna": "LEFT JOIN grna_cov r ON r.c = cell_idx LEFT JOIN grna_top top ON top.c = cell_idx",
    "protein": "LEFT JOIN protein_cov p ON p.c = cell_idx",
}
_COVS = {"gene": (_GENE, _GENE_COLS), "grna": (_GRNA, _GRNA_COLS), "protein": (_PROTEIN, _PROTEIN_COLS)}
_QC = _ENTRIES + f""",
in_use AS (SELECT CAST(o_orderkey AS INT) c FROM orders WHERE o_orderstatus <> 'P'),
y AS (SELECT f, c FROM gene WHERE c IN (SELECT c FROM in_use)),
assigned AS (SELECT f AS s, s_nationkey AS n, c FROM grna JOIN supplier ON s_suppkey = f WHERE x >= {t.ASSIGN} AND c IN (SELECT c FROM in_use)),
nt AS (SELECT CAST(s_suppkey AS INT) AS nt_id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)),
controls AS (SELECT s AS nt_id, c FROM assigned WHERE s IN (SELECT nt_id FROM nt)),
all_nt AS (SELECT DISTINCT c FROM controls),
treated AS (SELECT DISTINCT CAST(n AS INT) AS group_id, c FROM assigned),
pairs AS (SELECT CAST(p_partkey AS INT) AS feature_idx, CAST(n_nationkey AS INT) AS group_id FROM part, nation),
trt AS (SELECT f, group_id, count(*) n FROM y JOIN treated USING (c) GROUP BY 1, 2),
genes AS (SELECT CAST(p_partkey AS INT) AS feature_idx FROM part)"""


def register(name: str, oracle: str | None = None):
    """Add a query, and its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _cov_oracle(modalities: list[str], batch: bool = True) -> str:
    ctes = ",".join(_COVS[m][0] for m in modalities)
    cols = ",\n       ".join(_COVS[m][1] for m in modalities)
    return f"WITH {_ENTRIES},{ctes}\nSELECT cell_idx, {cols}{', batch' if batch else ''}\nFROM cells {' '.join(_JOIN[m] for m in modalities)}"


def _covariates(spark: SparkSession, sf_dir: str, modalities: list[str]) -> DataFrame:
    return covariates(t.all_entries(spark, sf_dir, modalities), t.all_features(spark, sf_dir, modalities), t.cells(spark, sf_dir), modalities, t.MITO)


# -- covariates --------------------------------------------------------------
@register("cellwise_covariates", _cov_oracle(["gene", "grna", "protein"]))
def cellwise_covariates(spark, sf_dir):
    return _covariates(spark, sf_dir, ["gene", "grna", "protein"])


for _m in ("gene", "grna", "protein"):
    register(f"{_m}_covariates", _cov_oracle([_m]))(lambda spark, sf_dir, m=_m: _covariates(spark, sf_dir, [m]))


@register("batch_summary", f"""WITH {_ENTRIES}
SELECT batch, CAST(count(*) AS BIGINT) AS n_cells, CAST(coalesce(sum(n), 0) AS BIGINT) AS gene_n_umis
FROM cells LEFT JOIN (SELECT c, sum(x) n FROM gene GROUP BY c) ON c = cell_idx GROUP BY batch""")
def batch_summary(spark, sf_dir):
    per_cell = _covariates(spark, sf_dir, ["gene"])
    return per_cell.groupBy("batch").agg(F.count("*").alias("n_cells"), F.sum("gene_n_umis").alias("gene_n_umis"))


# -- features and pointers ---------------------------------------------------
_NNZ = f"WITH {_ENTRIES}, nnz AS (SELECT CAST(p_partkey AS INT) AS feature_idx, CAST(count(f) AS BIGINT) AS nnz FROM part LEFT JOIN gene ON f = p_partkey GROUP BY 1)"
_PTR = f"""{_NNZ}, ptr AS (
SELECT feature_idx, CAST(coalesce(sum(nnz) OVER (ORDER BY feature_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr
FROM (SELECT * FROM nnz UNION ALL SELECT CAST(max(feature_idx) + 1 AS INT), 0 FROM nnz))"""


def _nnz(spark, sf_dir):
    return rows.nnz_per_feature(t.entries(spark, sf_dir, "gene"), t.features(spark, sf_dir, "gene"))


@register("feature_nnz", f"{_NNZ} SELECT * FROM nnz")
def feature_nnz(spark, sf_dir):
    return _nnz(spark, sf_dir)


@register("row_ptr", f"{_PTR} SELECT * FROM ptr")
def row_ptr(spark, sf_dir):
    return rows.row_pointers(_nnz(spark, sf_dir))


@register("ptr_to_index", f"WITH {_ENTRIES} SELECT CAST(row_number() OVER (ORDER BY f, c) - 1 AS BIGINT) AS position, f AS feature_idx FROM gene")
def ptr_to_index(spark, sf_dir):
    return rows.pointers_to_index(rows.row_pointers(_nnz(spark, sf_dir)))


@register("dims", f"""WITH {_ENTRIES} SELECT modality, CAST(n_features AS BIGINT) AS n_features, CAST((SELECT count(*) FROM orders) AS BIGINT) AS n_cells, CAST(nnz AS BIGINT) AS nnz FROM (
SELECT 'gene' AS modality, (SELECT count(*) FROM part) AS n_features, (SELECT count(*) FROM gene) AS nnz UNION ALL
SELECT 'grna', (SELECT count(*) FROM supplier), (SELECT count(*) FROM grna) UNION ALL
SELECT 'protein', (SELECT count(*) FROM kinds), (SELECT count(*) FROM protein))""")
def dims(spark, sf_dir):
    names = ["gene", "grna", "protein"]
    n_features = t.all_features(spark, sf_dir, names).groupBy("modality").agg(F.count("*").alias("n_features"))
    nnz = t.all_entries(spark, sf_dir, names).groupBy("modality").agg(F.count("*").alias("nnz"))
    n_cells = t.read(spark, sf_dir, "orders").count()
    return n_features.join(nnz, "modality").select("modality", "n_features", F.lit(n_cells).cast("long").alias("n_cells"), "nnz")


@register("feature_ids", "SELECT CAST(p_partkey AS INT) AS feature_idx, 'part_' || p_partkey AS feature_id, p_name AS feature_name FROM part")
def feature_ids(spark, sf_dir):
    return t.features(spark, sf_dir, "gene")


@register("mito_features", "SELECT CAST(p_partkey AS INT) AS feature_idx, p_name AS feature_name FROM part WHERE lower(p_name) LIKE 'red %'")
def mito_features(spark, sf_dir):
    return t.features(spark, sf_dir, "gene").where(is_mito(F.col("feature_name"), t.MITO)).select("feature_idx", "feature_name")


def _indexed_features(spark, sf_dir):
    names = ["gene", "grna", "protein"]
    order = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]), F.col("modality"))
    feats = t.all_features(spark, sf_dir, names)
    return feats.withColumn("row_idx", F.row_number().over(Window.orderBy(order, "feature_idx")) - 1)


_STACK = f"""WITH {_ENTRIES}, feats AS (
SELECT 0 AS m, 'gene' AS modality, CAST(p_partkey AS INT) AS feature_idx, 'part_' || p_partkey AS feature_id, p_name AS feature_name FROM part UNION ALL
SELECT 1, 'grna', CAST(s_suppkey AS INT), 'supp_' || s_suppkey, 'supp_' || s_suppkey FROM supplier UNION ALL
SELECT 2, 'protein', CAST(f AS INT), l_returnflag || '_' || l_linestatus, l_returnflag || '_' || l_linestatus FROM kinds),
stacked AS (SELECT *, CAST(row_number() OVER (ORDER BY m, feature_idx) - 1 AS INT) AS row_idx FROM feats)"""


@register("modality_offsets", f"{_STACK} SELECT modality, min(row_idx) AS feature_offset, CAST(count(*) AS BIGINT) AS n_features FROM stacked GROUP BY modality")
def modality_offsets(spark, sf_dir):
    return normalize.modality_offsets(_indexed_features(spark, sf_dir))


@register("stacked_features", f"{_STACK} SELECT row_idx, modality, feature_idx, feature_id, feature_name FROM stacked")
def stacked_features(spark, sf_dir):
    return normalize.stacked_features(_indexed_features(spark, sf_dir))


@register("cell_offsets", """WITH b AS (SELECT o_orderpriority p, count(*) n FROM orders GROUP BY 1)
SELECT 'batch_' || row_number() OVER (ORDER BY p) AS batch, CAST(n AS BIGINT) AS n_cells,
       CAST(coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cell_offset FROM b""")
def cell_offsets(spark, sf_dir):
    per = t.read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n_cells"))
    w = Window.orderBy("o_orderpriority")
    before = F.sum("n_cells").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return per.select(F.concat(F.lit("batch_"), F.row_number().over(w)).alias("batch"), "n_cells", F.coalesce(before, F.lit(0)).cast("long").alias("cell_offset"))


@register("cells_spine", """WITH b AS (SELECT o_orderpriority p, count(*) n FROM orders GROUP BY 1),
o AS (SELECT CAST(row_number() OVER (ORDER BY p) AS INT) AS batch_idx, n, CAST(coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM b)
SELECT CAST(o + k AS INT) AS cell_idx, batch_idx, 'batch_' || batch_idx AS batch FROM (SELECT *, unnest(range(n)) AS k FROM o)""")
def cells_spine(spark, sf_dir):
    offsets = cell_offsets(spark, sf_dir)
    return normalize.cells_spine(offsets.withColumn("batch_idx", F.substring_index("batch", "_", -1).cast("int")))


@register("generate_batch", """SELECT CAST(o_orderkey AS INT) AS cell_idx,
CAST(greatest(1, ceil(o_orderkey * 5 / ((SELECT count(*) FROM orders) - 1))) AS BIGINT) AS batch_idx FROM orders""")
def generate_batch(spark, sf_dir):
    orders = t.read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").cast("int").alias("cell_idx"), batch_of_cell(F.col("o_orderkey"), orders.count(), 5).alias("batch_idx"))


@register("modality_names", """SELECT DISTINCT p_type AS raw, CASE p_type WHEN 'Gene Expression' THEN 'gene' WHEN 'CRISPR Guide Capture' THEN 'grna'
WHEN 'Antibody Capture' THEN 'protein' ELSE regexp_replace(p_type, '\\s+', '_', 'g') END AS modality
FROM (SELECT p_type FROM part UNION ALL VALUES ('Gene Expression'), ('CRISPR Guide Capture'), ('Antibody Capture'))""")
def modality_names(spark, sf_dir):
    known = spark.createDataFrame([("Gene Expression",), ("CRISPR Guide Capture",), ("Antibody Capture",)], "raw string")
    raw = t.read(spark, sf_dir, "part").select(F.col("p_type").alias("raw")).union(known).distinct()
    return raw.withColumn("modality", modality_name(F.col("raw")))


# -- rows --------------------------------------------------------------------
_DENSE = f"WITH {_ENTRIES} SELECT cell_idx, coalesce(x, 0) AS x FROM cells LEFT JOIN (SELECT c, x FROM gene WHERE f = {ROW}) ON c = cell_idx"


@register("row_by_index", _DENSE)
def row_by_index(spark, sf_dir):
    return rows.dense_row(t.entries(spark, sf_dir, "gene", ROW), t.cells(spark, sf_dir), ROW)


@register("row_by_feature_id", _DENSE)
def row_by_feature_id(spark, sf_dir):
    found = [r[0] for r in t.features(spark, sf_dir, "gene").where(F.col("feature_id") == ROW_ID).select("feature_idx").limit(2).collect()]
    if len(found) != 1:
        raise KeyError(ROW_ID)
    return rows.dense_row(t.entries(spark, sf_dir, "gene", found[0]), t.cells(spark, sf_dir), found[0])


@register("row_sparse", f"WITH {_ENTRIES} SELECT c AS cell_idx, x FROM gene WHERE f = {ROW}")
def row_sparse(spark, sf_dir):
    return rows.sparse_row(t.entries(spark, sf_dir, "gene", ROW), ROW)


@register("rows_bulk", f"WITH {_ENTRIES} SELECT f AS feature_idx, c AS cell_idx, x FROM gene WHERE f IN (SELECT f FROM mito)")
def rows_bulk(spark, sf_dir):
    return rows.rows_of(t.entries(spark, sf_dir, "gene"), mito_features(spark, sf_dir))


@register("threshold_row", f"WITH {_ENTRIES} SELECT c + 1 AS cell FROM grna WHERE f = {ROW} AND x >= {t.ASSIGN}")
def threshold_row(spark, sf_dir):
    return rows.threshold_row(t.entries(spark, sf_dir, "grna", ROW), ROW, t.ASSIGN)


@register("grna_assignment", f"WITH {_ENTRIES} SELECT f AS feature_idx, c AS cell_idx FROM grna WHERE x >= {t.ASSIGN}")
def grna_assignment(spark, sf_dir):
    return rows.assignments(t.entries(spark, sf_dir, "grna"), t.ASSIGN)


@register("masked_row", f"WITH {_QC} SELECT c AS cell_idx FROM y WHERE f = {ROW}")
def masked_row(spark, sf_dir):
    return rows.masked_row(t.entries(spark, sf_dir, "gene", ROW), ROW, t.cells_in_use(spark, sf_dir))


@register("masked_positions", f"""WITH {_QC}, numbered AS (SELECT c, CAST(row_number() OVER (ORDER BY c) AS INT) AS pos FROM in_use)
SELECT pos FROM numbered JOIN gene USING (c) WHERE f = {ROW}""")
def masked_positions(spark, sf_dir):
    return rows.masked_positions(t.entries(spark, sf_dir, "gene", ROW), ROW, t.positions_in_use(spark, sf_dir))


@register("batch_submatrix", f"""WITH {_ENTRIES}, own AS (SELECT cell_idx, CAST(row_number() OVER (ORDER BY cell_idx) - 1 AS INT) AS k FROM cells WHERE batch = 'batch_2')
SELECT f AS feature_idx, k AS cell_idx, x FROM gene JOIN own ON cell_idx = c""")
def batch_submatrix(spark, sf_dir):
    return rows.submatrix(t.entries(spark, sf_dir, "gene"), t.cells(spark, sf_dir), "batch_2")


_STARTS = [0, 50, 150, 10_000_000]


@register("segment_starts", f"WITH {_ENTRIES} SELECT start, CAST((SELECT min(f) FROM gene WHERE f >= start) AS INT) AS feature_idx FROM (SELECT unnest({_STARTS}) AS start)")
def segment_starts(spark, sf_dir):
    return rows.segment_starts(t.entries(spark, sf_dir, "gene"), _STARTS)


@register("column_sorted", f"WITH {_ENTRIES} SELECT f AS feature_idx, c AS cell_idx, x FROM gene")
def column_sorted(spark, sf_dir):
    return memory.ordered(t.entries(spark, sf_dir, "gene"), by_row=False)


@register("column_order", f"""WITH {_ENTRIES} SELECT c AS cell_idx, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS out_of_order FROM gene GROUP BY c""")
def column_order(spark, sf_dir):
    """Per cell, how many of its entries do not stand behind the one before them in the ordered table."""
    at = F.monotonically_increasing_id()  # rises along the partitions, which are ranges
    rows_ = memory.ordered(t.entries(spark, sf_dir, "gene"), by_row=False).withColumn("at", at)
    before = Window.partitionBy("cell_idx").orderBy("feature_idx")
    wrong = (F.lag("at").over(before) > F.col("at")).cast("long")
    return rows_.withColumn("wrong", wrong).groupBy("cell_idx").agg(F.count("*").alias("n"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("out_of_order"))


# -- vectors -----------------------------------------------------------------
_VEC = f"""WITH {_ENTRIES},
vecs AS (SELECT s_nationkey, CAST(row_number() OVER (ORDER BY s_nationkey) - 1 AS INT) AS v FROM (SELECT DISTINCT s_nationkey FROM supplier)),
vec_map AS (SELECT CAST(s_suppkey AS INT) AS f, v, 'vector_' || s_nationkey AS id FROM supplier JOIN vecs USING (s_nationkey)),
vec AS (SELECT v, c, CAST(sum(x) AS BIGINT) AS x FROM grna JOIN vec_map USING (f) GROUP BY 1, 2)"""


def _map(spark, sf_dir):
    return collapse.vector_map(t.features(spark, sf_dir, "grna"), t.grna_vectors(spark, sf_dir))


@register("vector_map", f"{_VEC} SELECT f AS feature_idx, 'supp_' || f AS feature_id, v AS vector_idx, id AS vector_id FROM vec_map")
def vector_map(spark, sf_dir):
    return _map(spark, sf_dir)


@register("collapsed_grna", f"{_VEC} SELECT v AS feature_idx, c AS cell_idx, x FROM vec")
def collapsed_grna(spark, sf_dir):
    return collapse.collapse(t.entries(spark, sf_dir, "grna"), _map(spark, sf_dir))


@register("collapsed_nnz", f"{_VEC} SELECT v AS vector_idx, CAST(count(DISTINCT c) AS BIGINT) AS n_cells FROM grna JOIN vec_map USING (f) GROUP BY v")
def collapsed_nnz(spark, sf_dir):
    return collapse.collapsed_nnz(t.entries(spark, sf_dir, "grna"), _map(spark, sf_dir))


@register("collapsed_covariates", f"""{_VEC},
top AS (SELECT c, v, x FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY x DESC, v) k FROM vec) WHERE k = 1),
cov AS (SELECT c, sum(x) n, count(*) k FROM vec GROUP BY c),
ids AS (SELECT DISTINCT v, id FROM vec_map)
SELECT cell_idx, CAST(coalesce(n, 0) AS BIGINT) AS grna_n_umis, CAST(coalesce(k, 0) AS BIGINT) AS grna_n_nonzero, id AS grna_feature_w_max_expression,
       coalesce(CAST(x AS DOUBLE) / nullif(n, 0), 1.0) AS grna_frac_umis_max_feature, batch
FROM cells LEFT JOIN cov ON cov.c = cell_idx LEFT JOIN top ON top.c = cell_idx JOIN ids ON ids.v = coalesce(top.v, 0)""")
def collapsed_covariates(spark, sf_dir):
    mapping = _map(spark, sf_dir)
    e = collapse.collapse(t.entries(spark, sf_dir, "grna"), mapping).withColumn("modality", F.lit("grna"))
    f = collapse.vector_features(mapping).withColumn("modality", F.lit("grna"))
    return covariates(e, f, t.cells(spark, sf_dir), ["grna"])


# -- pair quality control ----------------------------------------------------
def _y(spark, sf_dir):
    return pairs.nonzero(t.entries(spark, sf_dir, "gene"), t.cells_in_use(spark, sf_dir))


def _pair_oracle(total: str, control: str) -> str:
    return f"""WITH {_QC}, tot AS ({total})
SELECT feature_idx, pairs.group_id, CAST(coalesce(trt.n, 0) AS BIGINT) AS n_nonzero_trt, CAST({control} AS BIGINT) AS n_nonzero_cntrl
FROM pairs LEFT JOIN trt ON trt.f = feature_idx AND trt.group_id = pairs.group_id LEFT JOIN tot ON tot.f = feature_idx"""


_SUM = "SELECT f, count(*) n FROM y JOIN controls USING (c) GROUP BY f"
_DISTINCT = "SELECT f, count(*) n FROM y JOIN all_nt USING (c) GROUP BY f"
_ALL = "SELECT f, count(*) n FROM y GROUP BY f"


@register("nt_nonzero_matrix", f"""WITH {_QC}, m AS (SELECT nt_id, f, count(*) n FROM y JOIN controls USING (c) GROUP BY 1, 2)
SELECT nt.nt_id, feature_idx, CAST(coalesce(n, 0) AS BIGINT) AS n_nonzero FROM nt CROSS JOIN genes LEFT JOIN m ON m.nt_id = nt.nt_id AND f = feature_idx""")
def nt_nonzero_matrix(spark, sf_dir):
    return pairs.nonzero_matrix(_y(spark, sf_dir), t.controls(spark, sf_dir), t.features(spark, sf_dir, "gene"), t.control_ids(spark, sf_dir), n=t.tasks(spark, sf_dir))


@register("gene_totals_nt", f"WITH {_QC}, tot AS ({_SUM}) SELECT feature_idx, CAST(coalesce(n, 0) AS BIGINT) AS n_nonzero_tot FROM genes LEFT JOIN tot ON f = feature_idx")
def gene_totals_nt(spark, sf_dir):
    return pairs.totals(_y(spark, sf_dir), t.features(spark, sf_dir, "gene"), t.controls(spark, sf_dir))


@register("gene_totals_complement", f"WITH {_QC}, tot AS ({_ALL}) SELECT feature_idx, CAST(coalesce(n, 0) AS BIGINT) AS n_nonzero_tot FROM genes LEFT JOIN tot ON f = feature_idx")
def gene_totals_complement(spark, sf_dir):
    return pairs.totals(_y(spark, sf_dir), t.features(spark, sf_dir, "gene"))


def _pairs(spark, sf_dir, once):
    return pairs.count_pairs(_y(spark, sf_dir), pairs.lists_of(t.members(spark, sf_dir, once)), t.pairs(spark, sf_dir), complement=False, n=t.tasks(spark, sf_dir))


@register("pair_qc_nt_sum", _pair_oracle(_SUM, "coalesce(tot.n, 0)"))
def pair_qc_nt_sum(spark, sf_dir):
    return _pairs(spark, sf_dir, once=False)


@register("pair_qc_nt", _pair_oracle(_DISTINCT, "coalesce(tot.n, 0)"))
def pair_qc_nt(spark, sf_dir):
    return _pairs(spark, sf_dir, once=True)


@register("pair_qc_complement", _pair_oracle(_ALL, "coalesce(tot.n, 0) - coalesce(trt.n, 0)"))
def pair_qc_complement(spark, sf_dir):
    return pairs.pair_counts(_y(spark, sf_dir), t.groups(spark, sf_dir), t.pairs(spark, sf_dir), n=t.tasks(spark, sf_dir))


def _stored_qc(spark, sf_dir, complement):
    """All counts of pair quality control by one call on a stored matrix, with lists given by position."""
    use = t.positions_in_use(spark, sf_dir)
    treated = t.groups(spark, sf_dir).join(use, "cell_idx").select("group_id", "pos")
    controls = t.controls(spark, sf_dir).join(use, "cell_idx")
    asked = t.pairs(spark, sf_dir)
    m = _stored(spark, sf_dir, "gene")
    if complement:
        return m.pair_qc(use, treated, controls.select("nt_id", "pos"), asked)
    every = rows.numbered(controls.select("cell_idx", F.col("pos").alias("at")).distinct()).select("cell_idx", F.col("pos").alias("nt_pos"), F.col("at").alias("pos"))
    listed = controls.select("nt_id", "cell_idx").join(every, "cell_idx").select("nt_id", "nt_pos")
    return m.pair_qc(use, treated, listed, asked, every.select("nt_pos", "pos"))


@register("stored_pair_qc", _pair_oracle(_SUM, "coalesce(tot.n, 0)"))
def stored_pair_qc(spark, sf_dir):
    return _stored_qc(spark, sf_dir, complement=False).pairs


@register("stored_pair_qc_complement", _pair_oracle(_ALL, "coalesce(tot.n, 0) - coalesce(trt.n, 0)"))
def stored_pair_qc_complement(spark, sf_dir):
    return _stored_qc(spark, sf_dir, complement=True).pairs


@register("stored_nt_matrix", f"""WITH {_QC}, m AS (SELECT nt_id, f, count(*) n FROM y JOIN controls USING (c) GROUP BY 1, 2), tot AS ({_SUM})
SELECT DISTINCT controls.nt_id, feature_idx, CAST(coalesce(m.n, 0) AS BIGINT) AS n_nonzero, CAST(coalesce(tot.n, 0) AS BIGINT) AS n_nonzero_tot
FROM controls CROSS JOIN genes LEFT JOIN m ON m.nt_id = controls.nt_id AND m.f = feature_idx LEFT JOIN tot ON tot.f = feature_idx""")
def stored_nt_matrix(spark, sf_dir):
    return _stored_qc(spark, sf_dir, complement=False).matrix_and_totals


# -- round trips through files -----------------------------------------------
def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; a temporary one only in local mode where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.gettempdir()}/rowloom-{uuid.uuid4().hex}"


def _stored(spark, sf_dir, modality):
    """A handle on one modality, written to a store."""
    path = f"{scratch(spark)}/{modality}.mat"
    store.write_matrix(t.entries(spark, sf_dir, modality), t.features(spark, sf_dir, modality), path, modality, t.read(spark, sf_dir, "orders").count(), 0, partitions=t.tasks(spark, sf_dir))
    return open_matrix(spark, path)


@register("stored_dims", ORACLES["dims"])
def stored_dims(spark, sf_dir):
    """Dimensions as handles report them."""
    got = [_stored(spark, sf_dir, m) for m in ("gene", "grna", "protein")]
    return spark.createDataFrame([(m.modality, *m.shape, m.nnz) for m in got], "modality string, n_features long, n_cells long, nnz long")


@register("stored_feature_ids", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS INT) AS row, 'supp_' || s_suppkey AS feature_id FROM supplier")
def stored_feature_ids(spark, sf_dir):
    """Row names in order, as a handle reports them."""
    return spark.createDataFrame(list(enumerate(_stored(spark, sf_dir, "grna").feature_ids, 1)), "row int, feature_id string")


@register("stored_rows", f"WITH {_ENTRIES} SELECT f AS feature_idx, c AS cell_idx, CAST(x AS INT) AS x FROM gene WHERE f IN ({ROW}, 2, 11)")
def stored_rows(spark, sf_dir):
    """Several rows of a stored matrix in one scan, by ID and by 1-based index."""
    return _stored(spark, sf_dir, "gene").rows_df([ROW_ID, 3, 12])


@register("stored_threshold", f"WITH {_ENTRIES} SELECT c + 1 AS cell FROM grna WHERE f = {ROW} AND x >= {t.ASSIGN}")
def stored_threshold(spark, sf_dir):
    return _stored(spark, sf_dir, "grna").threshold(ROW + 1, t.ASSIGN)


@register("stored_pointers", ORACLES["row_ptr"])
def stored_pointers(spark, sf_dir):
    return _stored(spark, sf_dir, "gene").row_pointers()


@register("store_roundtrip_row", _DENSE.replace("coalesce(x, 0)", "CAST(coalesce(x, 0) AS INT)"))
def store_roundtrip_row(spark, sf_dir):
    path = f"{scratch(spark)}/gene.mat"
    n_cells = t.read(spark, sf_dir, "orders").count()
    store.write_matrix(t.entries(spark, sf_dir, "gene"), t.features(spark, sf_dir, "gene"), path, "gene", n_cells, 0)
    return open_matrix(spark, path).row_df(ROW_ID, dense=True)


@register("matrix_roundtrip", f"WITH {_ENTRIES} SELECT f AS feature_idx, c AS cell_idx, CAST(x AS INT) AS x FROM gene")
def matrix_roundtrip(spark, sf_dir):
    ids = [r[0] for r in t.features(spark, sf_dir, "gene").orderBy("feature_idx").select("feature_id").collect()]
    shape = (len(ids), t.read(spark, sf_dir, "orders").count())
    m = ingest.from_matrix(spark, memory.Frame(shape, t.entries(spark, sf_dir, "gene")), ids, f"{scratch(spark)}/gene.mat")
    return m.entries


def _kinds(spark, sf_dir) -> tuple[np.ndarray, list[str]]:
    """Customers by nation and market segment, as a dense matrix on the driver: two small dimensions."""
    got = t.read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).collect()
    segments = sorted({r[1] for r in got})
    x = np.zeros((max(r[0] for r in got) + 1, len(segments)), np.int32)
    for nation, segment, n in got:
        x[nation, segments.index(segment)] = n
    return x, segments


@register("memory_kinds", """WITH n AS (SELECT c_nationkey AS i, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS j, count(*) AS x FROM customer GROUP BY c_nationkey, c_mktsegment),
k AS (SELECT unnest(['bool', 'coo', 'csc', 'csr', 'dense', 'handle', 'list', 'tocoo']) AS kind)
SELECT kind, CAST(i AS INT) AS feature_idx, CAST(j AS INT) AS cell_idx, CAST(CASE WHEN kind = 'bool' THEN 1 ELSE x END AS INT) AS x FROM n, k""")
def memory_kinds(spark, sf_dir):
    """One matrix in every in-memory form, as entries."""
    x, _ = _kinds(spark, sf_dir)
    i, j = np.nonzero(x)
    coo = memory.Coo(x.shape, i, j, x[i, j])
    by_col = np.lexsort((i, j))
    kinds = {
        "dense": x, "list": x.tolist(), "bool": x > 0, "coo": coo,
        "csr": memory.Csr(x.shape, memory.index_to_pointers(i, x.shape[0]), j, x[i, j].astype(float) + 0.5),
        "csc": memory.Csc(x.shape, memory.index_to_pointers(j[by_col], x.shape[1]), i[by_col], x[i, j][by_col]),
        "tocoo": SimpleNamespace(tocoo=lambda: SimpleNamespace(shape=x.shape, row=i, col=j, data=x[i, j])),
        "handle": ingest.from_matrix(spark, coo, [f"n{k}" for k in range(x.shape[0])], f"{scratch(spark)}/kinds.mat"),
    }
    made = [memory.to_entries(spark, m)[1].withColumn("kind", F.lit(k)) for k, m in kinds.items()]
    return reduce(DataFrame.unionByName, made)


@register("appended_batches", f"WITH {_ENTRIES} SELECT 'grna' AS modality, f AS feature_idx, c AS cell_idx, CAST(x AS INT) AS x FROM grna UNION ALL SELECT 'protein', f, c, CAST(x AS INT) FROM protein UNION ALL SELECT 'gene', f, c, CAST(x AS INT) FROM gene")
def appended_batches(spark, sf_dir):
    """Entries of stores to which three batches were appended one after another."""
    base = scratch(spark)
    for d in _write_mtx(spark, sf_dir, f"{base}/mtx"):
        append.append_batch(spark, d, f"{base}/out")
    parts = [open_matrix(spark, f"{base}/out/{m}.mat").entries.withColumn("modality", F.lit(m)) for m in ("gene", "grna", "protein")]
    return reduce(DataFrame.unionByName, parts)


def _write_mtx(spark: SparkSession, sf_dir: str, out: str) -> list[str]:
    """Driver tables as three Matrix Market directories, each with a third of the cells."""
    names = ["gene", "grna", "protein"]
    known = F.create_map(*[F.lit(x) for raw, name in MODALITIES.items() for x in (name, raw)])
    feats = _indexed_features(spark, sf_dir).withColumn("raw", known[F.col("modality")]).persist()
    n_cells, width = t.read(spark, sf_dir, "orders").count(), 3
    step = -(-n_cells // width)
    entries = t.all_entries(spark, sf_dir, names).join(feats.select("modality", "feature_idx", "row_idx"), ["modality", "feature_idx"]).persist()

    def one(b: int) -> str:
        own = entries.where(F.floor(F.col("cell_idx") / step) == b).select("row_idx", (F.col("cell_idx") - b * step).alias("cell_idx"), "x")
        mtx.write_directory(own, feats, min(step, n_cells - b * step), f"{out}/batch_{b + 1}", gz=b > 0)
        return f"{out}/batch_{b + 1}"

    with ThreadPoolExecutor(width) as pool:  # each body is one task, so write the batches side by side
        dirs = list(pool.map(one, range(width)))
    entries.unpersist()
    feats.unpersist()
    return dirs


@register("mtx_roundtrip_covariates", f"""WITH {_ENTRIES},{_GENE},{_GRNA},{_PROTEIN},
n AS (SELECT count(*) AS n, (count(*) + 2) // 3 AS step FROM orders)
SELECT cell_idx, {_GENE_COLS.replace("CAST(g.m AS DOUBLE)", "CAST(0 AS DOUBLE)")},
       {_GRNA_COLS},
       {_PROTEIN_COLS}, 'batch_' || (cell_idx // (SELECT step FROM n) + 1) AS batch
FROM cells {' '.join(_JOIN.values())}""")
def mtx_roundtrip_covariates(spark, sf_dir):
    base = scratch(spark)
    got = ingest.ingest_mtx_dirs(spark, _write_mtx(spark, sf_dir, f"{base}/mtx"), f"{base}/out", seed=1)
    return got.cellwise_covariates


_EXAMPLE = ([30, 8, 6], 60, 2, ["gene", "grna", "protein"])


def _example_oracle() -> str:
    """What the seeded example holds, read off its dense matrices."""
    out, made = [], synth.make_example(*_EXAMPLE, seed=3).matrices
    written = int(np.sum([m.sum() for m in made.values()]))
    for name, m in made.items():
        i, j = np.nonzero(m)
        x = m[i, j].astype(int)
        out.append(f"('{name}', {len(x)}, {x.sum()}, {(x * (i + 1)).sum()}, {(x * (j + 1)).sum()}, {written})")
    cols = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("nnz", "x", "by_feature", "by_cell", "written"))
    return f"SELECT modality, {cols} FROM (VALUES {', '.join(out)}) AS v(modality, nnz, x, by_feature, by_cell, written)"


@register("example_roundtrip", _example_oracle())
def example_roundtrip(spark, sf_dir):
    """Sums of a seeded example written as Matrix Market directories and read back through the stores."""
    base = scratch(spark)
    made = synth.write_example(*_EXAMPLE, tempfile.mkdtemp(prefix="rowloom-example-"), seed=3)
    dirs = _share(spark, made.directories, f"{base}/mtx")
    got = ingest.ingest_mtx_dirs(spark, dirs, f"{base}/out", seed=3)
    want = int(np.sum([m.sum() for m in made.matrices.values()]))
    sums = [F.count("*").alias("nnz"), F.sum("x").alias("x"), F.sum(F.col("x") * (F.col("feature_idx") + 1)).alias("by_feature"), F.sum(F.col("x") * (F.col("cell_idx") + 1)).alias("by_cell")]
    parts = [m.entries.agg(*sums).withColumn("modality", F.lit(name)) for name, m in got.matrices.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("written", F.lit(want).cast("long"))


def _share(spark: SparkSession, directories: list[str], out: str) -> list[str]:
    """Copy small local directories into the shared folder."""
    moved = []
    for d in directories:
        target = f"{out}/{d.rstrip('/').rsplit('/', 1)[1]}"
        fs, p = files.filesystem(spark, target)
        fs.mkdirs(p.getParent())
        fs.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{d}"), p)
        moved.append(target)
    return moved
