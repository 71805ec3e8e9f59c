import numpy as np
import pytest

from rowloom import open_matrix, write_example
from rowloom.streaming.append import append_batch, compact, current_covariates, stream_batches


def test_stream_of_directories(spark, tmp_path):
    made = write_example([12, 5], 40, 3, ["gene", "grna"], str(tmp_path / "in"), seed=4)
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "1.txt").write_text(made.directories[0] + "\n")
    stream_batches(spark, str(inbox), out, str(tmp_path / "ckpt")).awaitTermination()
    assert open_matrix(spark, f"{out}/gene.mat").shape == (12, int((made.batch == 1).sum()))
    (inbox / "2.txt").write_text("\n".join(made.directories) + "\n")  # the first arrives again
    stream_batches(spark, str(inbox), out, str(tmp_path / "ckpt")).awaitTermination()
    for m, x in made.matrices.items():
        handle = open_matrix(spark, f"{out}/{m}.mat")
        assert handle.shape == x.shape and handle.nnz == (x > 0).sum()
        assert all(np.array_equal(handle[k + 1], x[k]) for k in range(len(x)))
        packed = compact(spark, f"{out}/{m}.mat", f"{out}/{m}-compact.mat")
        assert packed.shape == x.shape and np.array_equal(packed[1], x[0])
    got = current_covariates(spark, out).orderBy("cell_idx").toPandas()
    assert np.array_equal(got.gene_n_umis, made.matrices["gene"].sum(axis=0))
    assert list(got.batch) == [f"batch_{b}" for b in made.batch]
    assert not append_batch(spark, made.directories[1], out)
    other = write_example([11, 5], 10, 1, ["gene", "grna"], str(tmp_path / "other"), seed=5)
    with pytest.raises(ValueError, match="features"):
        append_batch(spark, other.directories[0], out)
