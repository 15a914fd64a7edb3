"""Trio reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.operators import hmm as H
from zygospan.operators import scoring as S
from zygospan.operators import trio as T
from zygospan.operators.runs import call_runs


def run_based_crossovers(trio: DataFrame, min_run: int = 2000) -> DataFrame:
    """Label changes between long runs over all informative sites, each trio in the allele order it is written in."""
    sites = T.enough_sites(T.informative_sites(T.father_first(trio)), 2 * min_run)
    return T.crossovers(T.haplotype_runs(sites), min_run)


def robust_crossovers(trio: DataFrame, min_run: int = 500, paternal: int = 1, maternal: int = 2) -> DataFrame:
    """Crossovers from deterministic sites with the interference flag."""
    runs = T.haplotype_runs(T.informative_sites(trio, deterministic=True))
    return T.interference_filter(T.crossovers(runs, min_run), paternal, maternal)


def hmm_crossovers(trio: DataFrame, rate: float, min_sites: int = 100, s: Settings = DEFAULTS) -> DataFrame:
    """Crossovers of the two-state model; sparse chromosomes are left out."""
    sites = T.informative_sites(trio, deterministic=True)
    sizes = sites.groupBy(*H.KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_sites)
    dense = sites.join(sizes.select(*H.KEYS), H.KEYS, "left_semi")
    return H.state_crossovers(H.transmission_states(dense, rate, s))


def phasing_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    return T.agreement_windows(T.phase_agreement(T.shared_calls(left, right)))


def roh_report(trio: DataFrame, windows: DataFrame, prior: float, s: Settings = DEFAULTS) -> DataFrame:
    """Each long run of the child with covariates, evidence, call and Mendel check."""
    keys = ["trio", "chrom"]
    calls = trio.withColumn("hom", F.col("c0") == F.col("c1"))
    runs = call_runs(calls, keys, gaps=(s.gap_tol,), max_gap=s.max_gap_bp, block=s.scan_block_bp)
    runs = runs.filter(F.col("len_bp") >= s.report_min_bp)
    inside = T.markers_in_runs(calls, runs, keys, s)
    scored = S.classify_runs(S.run_covariates(inside, windows, keys, s), prior, s)
    checks = T.mendel_in_runs(inside, keys, s).select(*keys, "start_pos", "n_markers", "parental_sharing", "deletion_flag")
    return scored.join(checks, [*keys, "start_pos"])
