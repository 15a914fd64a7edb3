"""Whole jobs on the smallest tables, and incremental equals batch."""

import uuid

import duckdb
import pytest

import __spark_entry__ as contract
from checks.run import TABLES, norm
from checks.views import Views
from zygospan.plans import background
from zygospan.sources.sinks import shared_dir
from zygospan.sources.variants import parse_variants, sample_names

SF = "/root/testdata/sf0.001"
NAMES = ["a05_recombination_map_load", "b05_common_per_population", "c10_smallest_interval", "d08_exceedance_curve",
         "d31_search_space", "e05_sparse_runs", "j10_trio_roh_report", "j17_score_intervals", "k01_incremental_ingest", "k02_incremental_curve"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert mine == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.count() == 5 and "lstar_screened_mb" in df.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_calls_from_cohort_lines(spark):
    """Only samples of populations in which the site is common are unpacked."""
    lines = [
        "##fileformat", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc",
        "1\t10\t.\tA\tG\t.\t.\tAF_P=0.5;AF_Q=0.01\tGT\t0|0\t0|1\t1|1",
        "1\t20\t.\tA\tG\t.\t.\tAF_P=bad;AF_Q=0.95\tGT\t0|0\t0|1\t1|0",
        "1\t30\t.\tA\tG,T\t.\t.\tAF_P=0.5;AF_Q=0.5\tGT\t0|0\t0|1\t1|0",
        "1\t40\t.\tA\tG\t.\t.\tAF_P=0.5\tGT\t.|.\t1|1\t1|0",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    names = sample_names(df)
    calls = background.calls_from_variants(parse_variants(df), names, {"a": "P", "b": "P", "c": "Q"})
    got = sorted((r.sample, r.pos, r.hom) for r in calls.collect())
    assert got == [("a", 10, True), ("b", 10, False), ("b", 40, True), ("c", 20, False)]
    assert "Exchange hashpartitioning" not in calls._jdf.queryExecution().executedPlan().toString()


def test_stored_null_equals_lazy(spark):
    views = Views(spark, SF)
    path = f"{shared_dir(spark)}/null-{uuid.uuid4().hex}"
    lazy, stored = background.sample_null(views.calls), background.sample_null(views.calls, store=path)
    cols = ["sample", "chrom", "start_pos", "end_pos", "n_markers"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(lazy.segments) == rows(stored.segments)
