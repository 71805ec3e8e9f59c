"""What one task holds must not grow with the input, and the grid of guides and features must not be shuffled."""

import gzip

from rowloom import open_matrix
from rowloom.operators import dealing, pairs
from rowloom.plans import registry
from rowloom.sources import mtx
from rowloom.streaming import append

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_the_grid(plan):
    lines = plan.splitlines()
    (at,) = [k for k, x in enumerate(lines) if "Generate posexplode" in x]
    return "\n".join(lines[:at])


def test_grid_of_guides_and_features_is_not_shuffled(spark):
    above = above_the_grid(plan_of(registry.QUERIES["nt_nonzero_matrix"](spark, SF)))
    assert "Exchange" not in above and "Sort" not in above and "Join" not in above


def test_grid_keeps_repeated_features_and_guides_and_drops_foreign_ones(spark):
    y = spark.createDataFrame([(0, 5), (0, 6), (1, 5), (9, 5)], "feature_idx int, cell_idx int")
    controls = spark.createDataFrame([(7, 5), (7, 6), (8, 6), (3, 5), (None, 5)], "nt_id int, cell_idx int")
    features = spark.createDataFrame([(0,), (1,), (1,), (2,)], "feature_idx int")
    ids = spark.createDataFrame([(7,), (8,), (8,), (4,), (None,)], "nt_id int")
    got = sorted(map(tuple, pairs.nonzero_matrix(y, controls, features, ids).collect()), key=str)
    n = {(7, 0): 2, (8, 0): 1, (7, 1): 1}
    assert got == sorted([(i, f, n.get((i, f), 0)) for i in (7, 8, 8, 4, None) for f in (0, 1, 1, 2)], key=str)
    assert pairs.nonzero_matrix(y, controls, features, ids.where("false")).count() == 0


def test_totals_beside_the_grid_need_no_join_on_it(spark):
    above = above_the_grid(plan_of(registry.QUERIES["stored_nt_matrix"](spark, SF)))
    assert "Exchange" not in above and "Sort" not in above and "Join" not in above


def test_long_bodies_are_written_in_ranges_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS", 20)
    x = [(g, c, 1 + (g * 7 + c) % 9) for g in range(12) for c in range(20)]
    entries = spark.createDataFrame(x, "row_idx int, cell_idx int, x int")
    feats = spark.createDataFrame([(k, f"g{k}", f"n{k}", "Gene Expression") for k in range(12)], "row_idx int, feature_id string, feature_name string, raw string")
    for gz in (True, False):
        d = str(tmp_path / f"d{gz}")
        mtx.write_directory(entries, feats, 20, d, gz=gz)
        raw = gzip.open(f"{d}/matrix.mtx.gz", "rt") if gz else open(f"{d}/matrix.mtx")
        lines = raw.read().splitlines()
        assert lines[1] == "12 20 240" and [tuple(map(int, v.split())) for v in lines[2:]] == sorted([(g + 1, c + 1, v) for g, c, v in x], key=lambda t: (t[1], t[0]))
        append.append_batch(spark, d, str(tmp_path / f"out{gz}"))
        assert sorted(map(tuple, open_matrix(spark, str(tmp_path / f"out{gz}" / "gene.mat")).entries.collect())) == x
    members = (tmp_path / "dTrue" / "matrix.mtx.gz").read_bytes().count(b"\x1f\x8b\x08")
    assert members > 5  # written by several tasks
