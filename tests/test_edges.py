"""One test per documented quirk or edge case."""

import gzip
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom import from_matrix, ingest_mtx_dirs, open_matrix, write_example
from rowloom.functions.scalars import batch_of_cell, is_mito, modality_name
from rowloom.operators import rows
from rowloom.sources import mtx
from rowloom.sources.memory import Coo, Frame
from rowloom.synth import batches_of

RAW = {"gene": "Gene Expression", "grna": "CRISPR Guide Capture", "protein": "Antibody Capture"}


def write(path, features, n_cells, triples, head="%%MatrixMarket matrix coordinate integer general\n%comment\n%another\n", gz=False, prefix=""):
    os.makedirs(path, exist_ok=True)
    body = "".join(f"{i} {j} {x}\n" for i, j, x in triples)
    for name, text in ((f"{prefix}matrix.mtx", f"{head}{len(features)} {n_cells} {len(triples)}\n{body}"), (f"{prefix}features.tsv", "".join("\t".join(f) + "\n" for f in features))):
        with (gzip.open if gz else open)(os.path.join(path, name + (".gz" if gz else "")), "wt") as f:
            f.write(text)
    return str(path)


FEATS = [("g1", "MT-a", RAW["gene"]), ("g2", "b", RAW["gene"]), ("r1", "r1", RAW["grna"]), ("r2", "r2", RAW["grna"])]


def covs(got):
    return [r.asDict() for r in got.cellwise_covariates.orderBy("cell_idx").collect()]


def test_empty_cells_ties_and_empty_batches(spark, tmp_path):
    a = write(tmp_path / "x" / "batch", FEATS, 3, [(1, 1, 2), (2, 1, 2), (4, 1, 5), (3, 1, 5)], gz=True, prefix="pre_")
    b = write(tmp_path / "y y" / "batch", FEATS, 2, [])  # same base name, path with a space, no entries at all
    got = covs(ingest_mtx_dirs(spark, [a, b], str(tmp_path / "out")))
    assert got[0] == {"cell_idx": 0, "gene_n_umis": 4, "gene_n_nonzero": 2, "gene_p_mito": 0.5, "grna_n_umis": 10, "grna_n_nonzero": 2,
                      "grna_feature_w_max_expression": "r1", "grna_frac_umis_max_feature": 0.5, "batch": "batch_1"}
    assert got[4] == {"cell_idx": 4, "gene_n_umis": 0, "gene_n_nonzero": 0, "gene_p_mito": 0.0, "grna_n_umis": 0, "grna_n_nonzero": 0,
                      "grna_feature_w_max_expression": "r1", "grna_frac_umis_max_feature": 1.0, "batch": "batch_2"}


def test_duplicates_zeros_and_decimals(spark, tmp_path):
    d = write(tmp_path / "d", FEATS, 2, [(1, 1, 2), (1, 1, 3), (2, 1, 0), (2, 2, "4.9")], head="%%MatrixMarket matrix coordinate real general\n")
    got = ingest_mtx_dirs(spark, [d], str(tmp_path / "out"))
    assert got["gene"][1].tolist() == [5, 0] and got["gene"][2].tolist() == [0, 4] and got["gene"].nnz == 2
    kept = ingest_mtx_dirs(spark, [d], str(tmp_path / "kept"), keep_zeros=True)
    assert kept["gene"].nnz == 3
    with pytest.raises(PySparkException):
        ingest_mtx_dirs(spark, [d], str(tmp_path / "bad"), duplicates="error")


def test_modalities_need_not_be_contiguous(spark, tmp_path):
    feats = [FEATS[0], FEATS[2], FEATS[1], FEATS[3]]
    d = write(tmp_path / "d", feats, 1, [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)])
    got = ingest_mtx_dirs(spark, [d], str(tmp_path / "out"))
    assert [got["gene"][k].tolist() for k in (1, 2)] == [[1], [3]] and got["grna"].feature_ids == ["r1", "r2"]


def test_many_batches_keep_their_order(spark, tmp_path):
    dirs = [write(tmp_path / f"d{k}", FEATS, 1, [(1, 1, k + 1)]) for k in range(11)]
    got = covs(ingest_mtx_dirs(spark, dirs, str(tmp_path / "out")))
    assert [r["batch"] for r in got] == [f"batch_{k}" for k in range(1, 12)]
    assert [r["gene_n_umis"] for r in got] == list(range(1, 12))


@pytest.mark.parametrize("head", ["%%MatrixMarket matrix coordinate pattern general\n", "%%MatrixMarket matrix coordinate integer symmetric\n", "%%MatrixMarket matrix array real general\n"])
def test_unsupported_banners(spark, tmp_path, head):
    with pytest.raises(ValueError, match="unsupported"):
        ingest_mtx_dirs(spark, [write(tmp_path / "d", FEATS, 1, [], head=head)], str(tmp_path / "out"))


def test_bad_directories(spark, tmp_path):
    d = write(tmp_path / "d", FEATS, 1, [(1, 1, 1)])
    with pytest.raises(ValueError):
        ingest_mtx_dirs(spark, [d], "")
    with pytest.raises(FileNotFoundError):
        ingest_mtx_dirs(spark, [str(tmp_path / "none")], str(tmp_path / "o"))
    with pytest.raises(ValueError, match="no directory"):
        ingest_mtx_dirs(spark, [], str(tmp_path / "o"))
    (tmp_path / "d" / "matrix.mtx.bak").write_text("")  # not a matrix file
    assert mtx.discover(spark, [d])[0].header == mtx.Header(4, 1, 1)
    (tmp_path / "d" / "other_matrix.mtx").write_text("")
    with pytest.raises(ValueError, match="exactly one matrix.mtx"):
        mtx.discover(spark, [d])
    with pytest.raises(ValueError, match="exactly one features.tsv"):
        empty = tmp_path / "e"
        empty.mkdir()
        mtx.discover(spark, [str(empty)])
    with pytest.raises(ValueError, match="unknown"):
        ingest_mtx_dirs(spark, [write(tmp_path / "u", [("a", "a", "Peaks")], 1, [])], str(tmp_path / "o"))
    with pytest.raises(ValueError, match="compression"):
        ingest_mtx_dirs(spark, [write(tmp_path / "v", FEATS, 1, [])], str(tmp_path / "o"), compression_level=10)
    with pytest.raises(ValueError, match="features"):
        ingest_mtx_dirs(spark, [write(tmp_path / "w", FEATS, 1, []), write(tmp_path / "z", FEATS[:3], 1, [])], str(tmp_path / "o"))


def test_vector_map_errors(spark, tmp_path):
    d = write(tmp_path / "d", FEATS, 1, [(3, 1, 1)])
    for pairs in ([("r1", "v")], [("r1", "v"), ("r2", "v"), ("r2", "w")]):
        with pytest.raises(PySparkException):
            ingest_mtx_dirs(spark, [d], str(tmp_path / "o"), grna_target_data_frame=spark.createDataFrame(pairs, "grna_id string, vector_id string"))


@pytest.mark.parametrize("duplicates", ["sum", "error", "keep"])
def test_collapse_under_each_duplicate_rule(spark, tmp_path, duplicates):
    d = write(tmp_path / "d", FEATS, 2, [(1, 1, 7), (3, 1, 1), (4, 1, 2), (4, 2, 3)])
    vectors = spark.createDataFrame([("r1", "v"), ("r2", "v")], "grna_id string, vector_id string")
    got = ingest_mtx_dirs(spark, [d], str(tmp_path / "o"), grna_target_data_frame=vectors, duplicates=duplicates)
    assert got["grna"].feature_ids == ["v"] and got["grna"][1].tolist() == [3, 3] and got["gene"][1].tolist() == [7, 0]
    assert got["grna"].nnz == 2 and got["gene"].nnz == 1
    again = ingest_mtx_dirs(spark, [d], str(tmp_path / "o"))  # replaces both stores
    assert again["grna"].shape == (2, 2) and sorted(p.name for p in (tmp_path / "o").iterdir()) == ["cellwise_covariates", "gene.mat", "grna.mat"]


def test_row_keys(spark, tmp_path):
    m = from_matrix(spark, [[1, 0], [0, 2], [3, 3]], ["a", "b", "b"], str(tmp_path / "m"))
    assert m["a"].tolist() == [1, 0] and m[3, :].tolist() == [3, 3] and m[np.int64(2)].tolist() == [0, 2]
    for bad in (0, 4, -1):
        with pytest.raises(IndexError):
            m[bad]
    for bad in (1.5, [1, 2], None, True, slice(None)):
        with pytest.raises(TypeError):
            m[bad]
    with pytest.raises(TypeError):
        m[1, 2]
    for bad in ("b", "zz"):
        with pytest.raises(KeyError):
            m[bad]
    assert m.rows_df(["a", 2]).count() == 2
    with pytest.raises(KeyError):
        m.rows_df(["b"])
    assert "3 features" in repr(m) and "2 cells" in repr(m) and len(m) == 3
    again = from_matrix(spark, [[7]], ["q"], str(tmp_path / "m"))  # replaces the store
    assert again.shape == (1, 1) and open_matrix(spark, str(tmp_path / "m"))[1].tolist() == [7]
    with pytest.raises(FileNotFoundError):
        open_matrix(spark, str(tmp_path / "nowhere"))
    with pytest.raises(TypeError):
        open_matrix(spark, ["x"])


def test_matrix_inputs(spark, tmp_path):
    with pytest.raises(TypeError):
        from_matrix(spark, {"not": "a matrix"}, ["a"], str(tmp_path / "m"))
    with pytest.raises(ValueError):
        from_matrix(spark, [[1]], [], str(tmp_path / "m"))
    with pytest.raises(ValueError):
        from_matrix(spark, [[1]], ["a", "b"], str(tmp_path / "m"))
    with pytest.raises(ValueError):
        from_matrix(spark, [[1]], ["a"], str(tmp_path / "m"), chunk_size=0)
    twice = from_matrix(spark, Coo((1, 2), [0, 0, 0], [0, 0, 1], [1, 2, 0]), ["a"], str(tmp_path / "m"))
    assert twice[1].tolist() == [3, 0] and twice.nnz == 1
    frame = spark.createDataFrame([(0, 1, 4)], "feature_idx int, cell_idx int, x int")
    assert from_matrix(spark, Frame((1, 3), frame), ["a"], str(tmp_path / "f"))[1].tolist() == [0, 4, 0]


def test_names_and_bins(spark):
    df = spark.createDataFrame([("MT-x",), ("mt-x",), ("Mt-x",), ("xMT-",), ("MTx",), (None,)], "n string")
    assert [r[0] for r in df.select(is_mito(F.col("n"))).collect()] == [True, True, True, False, False, False]
    df = spark.createDataFrame([("Gene Expression",), ("Antibody Capture",), ("Some  Other Kind",)], "n string")
    assert [r[0] for r in df.select(modality_name(F.col("n"))).collect()] == ["gene", "protein", "Some_Other_Kind"]
    for n, b in ((1, 3), (2, 2), (17, 4), (100, 7)):
        got = [r[0] for r in spark.range(n).select(batch_of_cell(F.col("id"), n, b)).collect()]
        assert got == batches_of(n, b).tolist()


def test_example_is_checked_and_kept_apart(tmp_path):
    (tmp_path / "mine").write_text("keep")
    write_example([3], 4, 1, ["gene"], str(tmp_path), seed=1)
    assert (tmp_path / "mine").read_text() == "keep"
    for sizes, names in (([3], ["peaks"]), ([3, 3], ["gene", "gene"]), ([3], ["gene", "grna"])):
        with pytest.raises(ValueError):
            write_example(sizes, 4, 1, names, str(tmp_path))


def body(path, text, n=(4, 2), nnz=None, head="%%MatrixMarket matrix coordinate integer general\n"):
    d = write(path, FEATS, n[1], [])
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("%")]
    (path / "matrix.mtx").write_text(f"{head}{n[0]} {n[1]} {len(lines) if nnz is None else nnz}\n{text}")
    return d


def test_white_space_and_comments_in_a_body(spark, tmp_path):
    d = body(tmp_path / "d", "1  1 5\n\t2 1\t3 \n\n% a comment\n 2   2  4\r\n3 1 1e1\n", head="%%MatrixMarket matrix coordinate real general\n% made by hand\n")
    got = ingest_mtx_dirs(spark, [d], str(tmp_path / "out"))
    assert got["gene"][1].tolist() == [5, 0] and got["gene"][2].tolist() == [3, 4] and got["grna"][1].tolist() == [10, 0]


@pytest.mark.parametrize("line", ["1 1 abc", "1 1", "1 1 1 1", "x 1 1", "1.5 1 1", "1 1 ,", "99999999999 1 1", '"1" 1 1'])
def test_lines_that_are_no_entries_raise(spark, tmp_path, line):
    with pytest.raises(PySparkException, match="not an entry"):
        ingest_mtx_dirs(spark, [body(tmp_path / "d", f"2 1 1\n{line}\n")], str(tmp_path / "out"))


@pytest.mark.parametrize("line, why", [("1 3 7", "no cell 3"), ("1 0 7", "no cell 0"), ("5 1 7", "no feature"), ("0 1 7", "no feature")])
def test_indices_beyond_the_header_raise(spark, tmp_path, line, why):
    two = [body(tmp_path / "a", f"{line}\n"), body(tmp_path / "b", "1 1 1\n")]
    with pytest.raises(PySparkException, match=why):
        ingest_mtx_dirs(spark, two, str(tmp_path / "out"))


@pytest.mark.parametrize("nnz", [1, 3, 0])
def test_count_of_entries_must_be_the_header_s(spark, tmp_path, nnz):
    d = body(tmp_path / "d", "1 1 1\n2 2 2\n", nnz=nnz)
    with pytest.raises(ValueError, match="and holds 2"):
        ingest_mtx_dirs(spark, [d], str(tmp_path / "out"))
    assert ingest_mtx_dirs(spark, [d], str(tmp_path / "out"), check_counts=False)["gene"].nnz == 2


def test_a_body_line_equal_to_the_header_stays(spark, tmp_path):
    d = body(tmp_path / "d", "4 2 1\n", nnz=1)
    assert ingest_mtx_dirs(spark, [d], str(tmp_path / "out"))["grna"][2].tolist() == [0, 1]


def test_numbers_of_cells(spark):
    cells = [5, 70_000, 65_536, 65_535, 200_000, 0]
    got = {r.cell_idx: r.pos for r in rows.numbered(spark.createDataFrame([(c,) for c in cells], "cell_idx int")).collect()}
    assert got == {c: k + 1 for k, c in enumerate(sorted(cells))}
    assert rows.numbered(spark.createDataFrame([], "cell_idx int")).count() == 0


def test_foreign_classes_and_handles(spark, tmp_path):
    class Foreign:
        def tocoo(self):
            class Got:
                shape, row, col, data = (2, 3), [0, 1], [2, 0], [4, True]
            return Got

    m = from_matrix(spark, Foreign(), ["a", "b"], str(tmp_path / "m"))
    assert m[1].tolist() == [0, 0, 4] and m[2].tolist() == [1, 0, 0]
    again = from_matrix(spark, m, m.feature_ids, str(tmp_path / "again"))
    assert again.shape == (2, 3) and again["b"].tolist() == [1, 0, 0]
