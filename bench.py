"""Headline queries at one scale; prints one JSON line.

The derived genotypes, and the layout of their mismatches, are written once, as an ingest would, and timed on their own.
``queries`` holds first, cold runs; ``warm`` repeats the main ones in the same session, and ``duckdb`` runs their SQL
over the same stored tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import aggregates, joins, scans, sequences
from checks.views import CTES, Views, curve_sql, lstar_sql, runs_sql
from zygospan.config import DEFAULTS
from zygospan.operators import enrich as N
from zygospan.operators import maps as M
from zygospan.operators import resample as R
from zygospan.operators import trio as T
from zygospan.operators.runs import call_runs, label_runs
from zygospan.operators.sparse import linked_axis, mismatch_rows, sparse_runs
from zygospan.plans import atlas as PA
from zygospan.plans import background as PB
from zygospan.plans import scoring as PS
from zygospan.plans import trio as PT
from zygospan.sources import sinks


class Stored(Views):
    """Views over genotypes and segments that were written once."""

    def __init__(self, spark, sf_dir, store):
        super().__init__(spark, sf_dir)
        self.store = store

    @property
    def genotypes(self):
        return self.spark.read.parquet(f"{self.store}/genotypes")

    def null(self, gaps=(1,)):
        if tuple(gaps) != (1,):
            return PB.sample_null(self.calls, gaps)
        return PB.Null(self.spark.read.parquet(f"{self.store}/segments"), self.spark.read.parquet(f"{self.store}/burden"))


BY = ["axis", "chrom"]


def store_mismatches(v, table, cpus):
    """The mismatch layout from the stored genotypes: a linked axis, the members and the bucketed rows."""
    linked_axis(v.axis, BY).write.parquet(f"{v.store}/axis")
    axis = v.spark.read.parquet(f"{v.store}/axis")
    members = v.members.select("pop", "sample", "axis")
    members.join(axis.select(*BY).distinct(), "axis").write.parquet(f"{v.store}/members")
    calls = v.genotypes.select("sample", "chrom", "pos", (F.col("a0") == F.col("a1")).alias("hom")).join(members, "sample")
    sinks.write_mismatches(mismatch_rows(calls, axis, ["pop", "sample"], BY), table, ["pop", "sample", *BY], int(cpus), f"{v.store}/mismatches")


def sparse(v, table):
    axis, members = (v.spark.read.parquet(f"{v.store}/{name}") for name in ("axis", "members"))
    return sparse_runs(v.spark.table(table), members, axis, ["pop", "sample"], BY, (1,), min_markers=2)


AGAIN = ("e05_runs", "e05_runs_three_gaps", "e05_sparse_runs", "d08_d09_curve_lstar", "j17_score_intervals")


def duckdb_times(store: str, sf_dir: str, cpus: str) -> dict[str, float]:
    """The SQL of runs and curve in DuckDB, from the tables that the Spark runs read."""
    path = store.removeprefix("file:")
    con = duckdb.connect(config={"threads": int(cpus)})
    con.execute(f"create view supplier as select * from '{sf_dir}/supplier.parquet'")
    con.execute(f"create view genotypes as select * from '{path}/genotypes/*.parquet'")
    con.execute(f"create view segs as select * from read_parquet('{path}/segments/*/*.parquet', hive_partitioning=true)")
    con.execute(f"create view burden as select * from '{path}/burden/*.parquet'")
    con.execute(f"create view panel as {CTES['panel'][0].split(' as ', 1)[1]}")
    con.execute(f"create view calls as {CTES['calls'][0].split(' as ', 1)[1]}")
    grid, expo = (CTES[k][0] for k in ("grid", "expo"))
    jobs = {
        "e05_runs": "with " + runs_sql("runs", "calls", "pop, sample, chrom") + " select * from runs",
        "e05_runs_three_gaps": "with " + runs_sql("runs", "calls", "pop, sample, chrom", "0, 1, 2") + " select * from runs",
        "d08_d09_curve_lstar": f"with {grid}, {expo}, {curve_sql('curve', 'segs', 'expo', 'pop')} {lstar_sql('curve', 'pop')}",
    }
    out = {}
    for name, text in jobs.items():
        t0 = time.time()
        con.execute(f"create table {name} as {text}")
        out[name] = round(time.time() - t0, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    store = f"{sinks.shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    raw, v = Views(spark, sf_dir), Stored(spark, sf_dir, store)
    times: dict[str, float] = {}
    warm: dict[str, float] = {}
    only = set(sys.argv[1:])

    def timed(name, job, always=False):
        if only and name not in only and not always:
            return
        t0 = time.time()
        job()
        times[name] = round(time.time() - t0, 3)
        if name in AGAIN:
            t0 = time.time()
            job()
            warm[name] = round(time.time() - t0, 3)

    run = lambda make: (lambda: make().write.format("noop").mode("overwrite").save())

    def store_null():
        PB.sample_null(v.calls, store=f"{store}/segments").burden.write.parquet(f"{store}/burden")

    timed("ingest_genotypes", lambda: raw.genotypes.write.parquet(f"{store}/genotypes"), True)
    timed("e05_runs", run(lambda: call_runs(v.calls, ["pop", "sample", "chrom"])))
    timed("e05_runs_three_gaps", run(lambda: call_runs(v.calls, ["pop", "sample", "chrom"], gaps=(0, 1, 2))))
    table = f"mismatches_{uuid.uuid4().hex}"
    timed("ingest_mismatches", lambda: store_mismatches(v, table, cpus), not only or "e05_sparse_runs" in only)
    timed("e05_sparse_runs", run(lambda: sparse(v, table)))
    timed("e01_label_runs_events", run(lambda: label_runs(sequences.event_trace(v), ["user_id"], "us", "label", 86_400_000_000)))
    timed("j11_segments_and_burden", store_null, True)
    timed("d08_d09_curve_lstar", run(lambda: PB.background_summary(v.null())))
    timed("d21_bootstrap_100", run(lambda: PB.lstar_bootstrap(v.null(), 100, F.floor(F.col("sample") / 64), R.hash_draw(7))))
    timed("d31_search_space", run(lambda: N.search_space(N.case_loads(*v.null(), (100_000, 300_000, 1_000_000)))))
    timed("j07_haplotype_atlas", run(lambda: PA.hbar_atlas(v.common, v.haplotypes, v.combined_map, 0.0625)))
    timed("j06_legacy_atlas", run(lambda: PA.legacy_atlas(v.site_freq, v.combined_map, [0.0625, 0.0156], [2.0, 10.0])))
    timed("j01_trio_crossovers", run(lambda: PT.run_based_crossovers(v.trio, 20)))
    timed("j03_state_model", run(lambda: PT.hmm_crossovers(v.trio, 1.2)))
    timed("j10_trio_roh_report", run(lambda: PT.roh_report(v.trio, v.hbar_windows(), DEFAULTS.prior)))
    timed("j16_rate_binned", run(lambda: PB.rate_binned(v.null(), M.cumulative_cm(v.rates), v.rates, 0.05)))
    timed("j17_score_intervals", run(lambda: PS.score_roh(joins.intervals(v), v.rates, v.curve())))
    timed("j14_platforms", run(lambda: aggregates.platforms(v, (2, 5))[1].segments))
    timed("d12_phase_agreement", run(lambda: T.agreement_summary(T.phase_agreement(T.shared_calls(*scans.two_call_sets(v), ("sample", "chrom", "pos"))), ["sample"])))
    spark.sql(f"drop table if exists {table}")
    rows = spark.read.parquet(f"{store}/genotypes").count()
    # Each rate is over the rows its own job reads.
    reads = {"e05_runs": rows, "d08_d09_curve_lstar": None, "j17_score_intervals": None}
    segments = spark.read.parquet(f"{store}/segments").count()
    rate = {k: round((n or segments) / warm[k]) for k, n in reads.items() if k in warm}
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "warm": warm, "duckdb": duckdb_times(store, sf_dir.rstrip("/"), cpus), "genotype_rows": rows, "segment_rows": segments,
        "rows_per_sec_warm": rate,
    }))


if __name__ == "__main__":
    main()
