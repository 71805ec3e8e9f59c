"""Every registered query of the engine against its SQL twin on the smallest tables."""

import duckdb
import pytest

from rowloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    got, want = order(got), order(want)
    assert len(got) == len(want)
    for c in cols:
        assert (got[c] == want[c]).all(), c


def test_example_round_trip_keeps_every_count(spark):
    got = registry.QUERIES["example_roundtrip"](spark, SF).collect()
    assert sum(r.x for r in got) == got[0].written


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_covariates_shuffle_the_lines_once(spark):
    plan = registry.QUERIES["cellwise_covariates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "SortAggregate" not in plan and "Python" not in plan
    lines = [x for x in plan.splitlines() if "lineitem.parquet" in x and "l_quantity" in x]
    assert len(lines) == 1


def test_no_query_of_the_engine_runs_python(spark):
    for name in ("pair_qc_nt", "collapsed_covariates", "nt_nonzero_matrix", "row_ptr", "grna_assignment"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan, table):
    return [x for x in plan.splitlines() if "Scan parquet" in x and f"{table}.parquet" in x]


@pytest.mark.parametrize("name, key", [("row_by_index", "l_partkey"), ("row_by_feature_id", "l_partkey"), ("row_sparse", "l_partkey"), ("threshold_row", "l_suppkey"), ("masked_row", "l_partkey"), ("masked_positions", "l_partkey")])
def test_row_lookups_filter_in_the_scan(spark, name, key):
    (line,) = scans(plan_of(registry.QUERIES[name](spark, SF)), "lineitem")
    assert f"EqualTo({key},{registry.ROW})" in line


@pytest.mark.parametrize("name, lines", [("pair_qc_nt", 2), ("pair_qc_nt_sum", 2), ("pair_qc_complement", 2)])
def test_pair_counts_scan_responses_and_guides_once(spark, name, lines):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert len(scans(plan, "lineitem")) == lines and plan.count("Exchange") <= 16


def test_pairs_cover_every_part_and_nation(spark):
    want = spark.read.parquet(f"{SF}/part.parquet").count() * spark.read.parquet(f"{SF}/nation.parquet").count()
    assert registry.QUERIES["pair_qc_nt"](spark, SF).count() == want
