"""Pair counts against a literal reading of their definitions, with overlapping groups and shuffled pairs."""

import numpy as np
import pytest

from rowloom import from_matrix
from rowloom.operators import pairs


@pytest.mark.parametrize("seed", range(4))
def test_against_definitions(spark, seed):
    rng = np.random.default_rng(seed)
    n_genes, n_cells = 8, 40
    x = rng.integers(0, 3, (n_genes, n_cells))
    x[2] = 0
    in_use = rng.permutation(n_cells)[:25]  # 0-based cells, any order; positions are 1-based
    mask = [[x[g, c] > 0 for c in in_use] for g in range(n_genes)]
    all_nt = (rng.permutation(25)[:12] + 1).tolist()
    nt = {i: (rng.integers(0, 12, 6) + 1).tolist() for i in range(3)}  # positions in all_nt; overlap and repeats
    groups = {k: (rng.permutation(25)[: rng.integers(0, 9)] + 1).tolist() for k in range(4)}
    todo = [(int(g), int(k)) for g in range(n_genes) for k in range(4) if rng.random() < 0.7]
    rng.shuffle(todo)

    entries = spark.createDataFrame([(int(g), int(c)) for g, c in zip(*np.nonzero(x))], "feature_idx int, cell_idx int")
    use = spark.createDataFrame([(k + 1, int(c)) for k, c in enumerate(in_use)], "pos int, cell_idx int")
    nt_table = spark.createDataFrame([(k + 1, int(p)) for k, p in enumerate(all_nt)], "nt_pos int, pos int")
    members = spark.createDataFrame([(i, int(p)) for i, ps in nt.items() for p in ps], "nt_id int, nt_pos int")
    controls = pairs.by_position(pairs.redirect(members, nt_table), use)
    treated = pairs.by_position(spark.createDataFrame([(k, int(p)) for k, ps in groups.items() for p in ps], "group_id int, pos int"), use)
    once = pairs.by_position(nt_table.drop("nt_pos"), use)
    y = pairs.nonzero(entries, use)
    feats = spark.createDataFrame([(g,) for g in range(n_genes)], "feature_idx int")
    ids = spark.createDataFrame([(i,) for i in nt], "nt_id int")

    m = {(i, g): sum(mask[g][all_nt[p - 1] - 1] for p in ps) for i, ps in nt.items() for g in range(n_genes)}
    got = pairs.nonzero_matrix(y, controls, feats, ids).collect()
    assert {(r.nt_id, r.feature_idx): r.n_nonzero for r in got} == m
    by_sum = {g: sum(m[i, g] for i in nt) for g in range(n_genes)}
    by_once = {g: sum(mask[g][p - 1] for p in all_nt) for g in range(n_genes)}
    everything = {g: sum(mask[g]) for g in range(n_genes)}
    assert {r.feature_idx: r.n_nonzero_tot for r in pairs.totals(y, feats, controls).collect()} == by_sum
    assert {r.feature_idx: r.n_nonzero_tot for r in pairs.totals(y, feats).collect()} == everything
    pair_df = spark.createDataFrame([(int(g), int(k)) for g, k in todo], "feature_idx int, group_id int")
    for control, tot in ((controls, by_sum), (once, by_once), (None, None)):
        got = {(r.feature_idx, r.group_id): (r.n_nonzero_trt, r.n_nonzero_cntrl) for r in pairs.pair_counts(y, treated, pair_df, control).collect()}
        for g, k in todo:
            trt = sum(mask[g][p - 1] for p in groups[k])
            assert got[g, k] == (trt, everything[g] - trt if tot is None else tot[g])
        assert len(got) == len(todo)


def test_one_call_on_a_stored_matrix(spark, tmp_path):
    x = np.array([[1, 0, 2, 3], [0, 0, 0, 1], [5, 5, 5, 5]])
    m = from_matrix(spark, x, ["a", "b", "c"], str(tmp_path / "m"))
    use = spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "pos int, cell_idx int")
    groups = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "group_id int, pos int")
    asked = spark.createDataFrame([(2, 0), (0, 0), (0, 1), (1, 1), (0, 1)], "feature_idx int, group_id int")
    all_nt = spark.createDataFrame([(1, 3), (2, 1)], "nt_pos int, pos int")
    controls = spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "nt_id int, nt_pos int")
    got = m.pair_qc(use, groups, controls, asked, all_nt)
    assert {(r.nt_id, r.feature_idx): r.n_nonzero for r in got.matrix.collect()} == {(7, 0): 2, (7, 1): 1, (7, 2): 2, (8, 0): 1, (8, 1): 1, (8, 2): 1}
    assert {r.feature_idx: r.n_nonzero_tot for r in got.totals.collect()} == {0: 3, 1: 2, 2: 3}
    assert sorted(map(tuple, got.pairs.collect())) == [(0, 0, 2, 3), (0, 1, 1, 3), (0, 1, 1, 3), (1, 1, 0, 2), (2, 0, 2, 3)]
    got = m.pair_qc(use, groups, spark.createDataFrame([(7, 1), (7, 2)], "nt_id int, pos int"), asked)
    assert {r.feature_idx: r.n_nonzero_tot for r in got.totals.collect()} == {0: 3, 1: 1, 2: 3}
    assert sorted(map(tuple, got.pairs.collect())) == [(0, 0, 2, 1), (0, 1, 1, 2), (0, 1, 1, 2), (1, 1, 0, 1), (2, 0, 2, 1)]
    assert sorted(r.pos for r in m.positions("a", use).collect()) == [1, 2, 3] and [r.pos for r in m.positions(2, use).collect()] == [1]
