"""Randomised differential tests: ingest and read back against dense NumPy matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom import from_matrix, ingest_mtx_dirs, open_matrix, write_example
from rowloom.operators import rows
from rowloom.sources import mtx
from rowloom.sources.memory import Coo, Csc, Csr, index_to_pointers, pointers_to_index

SEEDS = range(1, 9)


def dense(m):
    out = np.zeros(m.shape, np.int64)
    got = m.entries.toPandas()
    out[got.feature_idx, got.cell_idx] = got.x
    return out


def check_covariates(got, mats, gene_names, batch, ids):
    got = got.orderBy("cell_idx").toPandas()
    n = len(batch)
    assert list(got.cell_idx) == list(range(n))
    assert list(got.batch) == [f"batch_{b}" for b in batch]
    for m, x in mats.items():
        total = x.sum(axis=0)
        assert np.array_equal(got[f"{m}_n_umis"], total)
        assert np.array_equal(got[f"{m}_n_nonzero"], (x > 0).sum(axis=0))
        if m == "gene":
            mito = x[[g.startswith("MT-") for g in gene_names]].sum(axis=0)
            assert np.array_equal(got.gene_p_mito, np.where(total == 0, 0.0, mito / np.maximum(total, 1)))
        if m == "grna":
            top = x.max(axis=0)
            assert list(got.grna_feature_w_max_expression) == [ids[m][k] for k in x.argmax(axis=0)]
            assert np.array_equal(got.grna_frac_umis_max_feature, np.where(top == 0, 1.0, top / np.maximum(total, 1)))


@pytest.mark.parametrize("seed", SEEDS)
def test_directories(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    modalities = ["grna", *[m for m in ("gene", "protein") if rng.random() < 0.7]]
    rng.shuffle(modalities)
    sizes = [int(rng.integers(10, 60)) for _ in modalities]
    n_cells, n_batch = int(rng.integers(10, 120)), int(rng.integers(1, 4))
    made = write_example(sizes, n_cells, n_batch, list(modalities), str(tmp_path / "in put"), seed=seed, gz=bool(seed % 2))
    vectors = None
    mats, ids = dict(made.matrices), dict(made.feature_ids)
    if seed % 2:
        of = np.concatenate([np.arange(5), rng.integers(0, 5, len(ids["grna"]) - 5)])
        rng.shuffle(of)
        names = list(dict.fromkeys(f"v{k}" for k in of))
        vectors = spark.createDataFrame([(g, f"v{k}", n) for n, (g, k) in enumerate(zip(ids["grna"], of))], "grna_id string, vector_id string, ordinal int")
        mats["grna"] = np.array([mats["grna"][[f"v{k}" == v for k in of]].sum(axis=0) for v in names])
        ids["grna"] = names
    got = ingest_mtx_dirs(spark, made.directories, str(tmp_path / "out"), grna_target_data_frame=vectors, seed=seed)
    assert list(got.matrices) == list(modalities)
    for m, x in mats.items():
        handle = open_matrix(spark, str(tmp_path / "out" / f"{m}.mat"))
        assert handle.shape == x.shape and handle.nnz == (x > 0).sum()
        assert handle.feature_ids == ids[m] and handle.dimnames == (ids[m], None)
        assert np.array_equal(dense(handle), x)
        for k in {1, len(x), int(rng.integers(1, len(x) + 1))}:
            assert np.array_equal(handle[k], x[k - 1])
            assert np.array_equal(handle[ids[m][k - 1], :], x[k - 1])
        assert [r.nnz for r in handle.nnz_per_feature().orderBy("feature_idx").collect()] == (x > 0).sum(axis=1).tolist()
        pointers = [r.ptr for r in handle.row_pointers().orderBy("feature_idx").collect()]
        assert pointers == np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]).tolist()
        k, t = int(rng.integers(1, len(x) + 1)), int(rng.integers(1, 9))
        assert sorted(r.cell for r in handle.threshold(k, t).collect()) == (np.flatnonzero(x[k - 1] >= t) + 1).tolist()
    assert len({m.integer_id for m in got.matrices.values()}) == 1
    check_covariates(got.cellwise_covariates, mats, made.gene_names, made.batch, ids)
    check_covariates(spark.read.parquet(str(tmp_path / "out" / "cellwise_covariates")), mats, made.gene_names, made.batch, ids)


@pytest.mark.parametrize("seed", range(3))
def test_in_memory_kinds_agree(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 11, (12, 30)) * (rng.random((12, 30)) > 0.5)
    x[0] = 0
    i, j = np.nonzero(x)
    order = np.lexsort((i, j))
    kinds = {
        "dense": x, "lists": x.tolist(), "real": x + 0.4 * (x > 0), "coo": Coo(x.shape, i, j, x[i, j]),
        "csr": Csr(x.shape, index_to_pointers(i, 12), j, x[i, j]),
        "csc": Csc(x.shape, index_to_pointers(j[order], 30), i[order], x[i[order], j[order]]),
    }
    ids = [f"g{k}" for k in range(12)]
    for name, m in kinds.items():
        got = from_matrix(spark, m, ids, str(tmp_path / name), chunk_size=5)
        assert np.array_equal(dense(got), x), name
        assert got.integer_id == 0 and np.array_equal(got[1], x[0])
    logical = from_matrix(spark, x > 0, ids, str(tmp_path / "logical"))
    assert np.array_equal(dense(logical), x > 0)


def test_pointer_round_trip(spark):
    p = np.array([0, 0, 3, 3, 4, 4])
    assert np.array_equal(index_to_pointers(pointers_to_index(p), 5), p)
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(p)], "feature_idx int, ptr long")
    got = [(r.position, r.feature_idx) for r in rows.pointers_to_index(df).orderBy("position").collect()]
    assert got == [(k, int(f)) for k, f in enumerate(pointers_to_index(p))]


def test_row_lookup_is_pushed_down(spark, tmp_path):
    m = from_matrix(spark, np.ones((5, 5), int), list("abcde"), str(tmp_path / "m"))
    plan = m.row_df(2)._jdf.queryExecution().toString()
    assert "EqualTo(feature_idx,1)" in plan
    masked = rows.masked_row(m.entries, 1, m.cells.where(F.col("cell_idx") > 2))
    assert "ReadSchema: struct<feature_idx:int,cell_idx:int>" in masked._jdf.queryExecution().toString()
    assert sorted(r.cell_idx for r in masked.collect()) == [3, 4]


@pytest.mark.parametrize("gz", [True, False])
def test_spark_writer_round_trip(spark, tmp_path, gz):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (7, 9))
    i, j = np.nonzero(x)
    entries = spark.createDataFrame([(int(a), int(b), int(x[a, b])) for a, b in zip(i, j)], "row_idx int, cell_idx int, x int")
    feats = spark.createDataFrame([(k, f"g{k}", f"n{k}", "Gene Expression" if k < 4 else "Antibody Capture") for k in range(7)], "row_idx int, feature_id string, feature_name string, raw string")
    for _ in range(2):  # the second run replaces the first
        mtx.write_directory(entries, feats, 9, str(tmp_path / "d"), gz=gz)
    (found,) = mtx.discover(spark, [str(tmp_path / "d")])
    assert found.header == mtx.Header(7, 9, len(i)) and found.matrix.endswith(".gz") == gz
    got = ingest_mtx_dirs(spark, [str(tmp_path / "d")], str(tmp_path / "out"))
    assert np.array_equal(dense(got["gene"]), x[:4]) and np.array_equal(dense(got["protein"]), x[4:])
