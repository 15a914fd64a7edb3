"""Per-window atlases: posteriors, haplotype homozygosity and calibration."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import evidence as E
from zygospan.functions import genotype as G
from zygospan.operators import calibrate as K
from zygospan.operators import diversity as D
from zygospan.operators import maps as M
from zygospan.operators import resample as R
from zygospan.operators.runs import focal_runs
from zygospan.operators.scoring import with_scenarios
from zygospan.operators.spread import spread_join


def legacy_atlas(
    sites: DataFrame, recmap: DataFrame, priors: Sequence[float], lengths_mb: Sequence[float],
    targets: Sequence[float] = (0.95, 0.99), s: Settings = DEFAULTS,
) -> DataFrame:
    """Window posteriors under the per-site noise term for every prior and length."""
    windows = D.window_heterozygosity(sites, s)
    rates = M.window_rates(recmap, s)
    atlas = windows.join(rates, ["chrom", "window_start"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    atlas = with_scenarios(atlas, prior=[float(p) for p in priors], length_mb=[float(x) for x in lengths_mb])
    atlas = atlas.withColumn("posterior", E.posterior_legacy_2pq(F.col("length_mb"), F.col("rate"), F.col("mean_2pq"), F.col("prior"), s))
    for t in targets:
        atlas = atlas.withColumn(f"length_to_{round(t * 100)}", E.length_to_posterior(F.col("rate"), F.col("mean_2pq"), F.col("prior"), t, s=s))
    return atlas


def hbar_atlas(
    common: DataFrame, haplotypes: DataFrame, recmap: DataFrame, prior: float, length_mb: float = 10.0,
    anchor: str = "any", s: Settings = DEFAULTS,
) -> DataFrame:
    """Window haplotype homozygosity, local rate, posterior and callable length."""
    rates = M.window_rates(recmap, s)
    cum = M.cumulative_cm(rates, s)
    markers = M.add_cm(common.select("pop", "chrom", "pos"), cum, s=s).withColumn("blk", M.block_id(s=s))
    windows = D.window_hbar(markers, haplotypes, s, anchor).join(rates, ["chrom", "window_start"], "left")
    windows = windows.withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return windows.withColumn("posterior", E.posterior_block(F.lit(length_mb), F.col("rate"), F.col("hbar"), prior, s)).withColumn(
        "min_callable_mb", E.min_callable_length(F.col("rate"), F.col("hbar"), prior, s=s)
    )


def population_hbar(common: DataFrame, haplotypes: DataFrame, recmap: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``pop, chrom, window_start, rate, hbar`` from the given haplotypes, blocks anchored in their own population."""
    rates = M.window_rates(recmap, s)
    markers = M.add_cm(common.select("pop", "chrom", "pos"), M.cumulative_cm(rates, s), s=s).withColumn("blk", M.block_id(s=s))
    windows = D.window_hbar(markers, haplotypes, s, anchor="pop").select("pop", "chrom", "window_start", "hbar")
    return windows.join(rates, ["chrom", "window_start"], "left")


def calibration_trials(
    tests: DataFrame, markers: DataFrame, haplotypes: DataFrame, windows: DataFrame, n_trials: int,
    prior_per_mille: int, tract_bp, draw: R.Draw, min_call_bp: int = 100_000, s: Settings = DEFAULTS,
    scan_bp: int | None = None, least_markers: int = 5,
) -> DataFrame:
    """Scored trials ``pop, chrom, t, l_obs, label, posterior`` with known truth.

    With ``scan_bp``, a trial needs ``least_markers`` markers that near its focal one.
    """
    trials = R.labelled_trials(tests, markers, n_trials, prior_per_mille, tract_bp, draw)
    if scan_bp is not None:
        trials = R.crowded_trials(trials, markers, scan_bp, least_markers)
    match = R.implanted_matches(trials, haplotypes, draw, s=s).withColumn("trial", F.struct("pop", "chrom", "t", "label"))
    seen = focal_runs(match, "trial", "focal", s=s).filter(F.col("len_bp") >= min_call_bp)
    flat = seen.select("trial.*", "focal", (F.col("len_bp") / 1e6).alias("l_obs"))
    flat = flat.withColumn("window_start", G.window_start(F.col("focal"), s.window_bp))
    scored = flat.join(windows.select("pop", "chrom", "window_start", "rate", "hbar"), ["pop", "chrom", "window_start"], "left")
    post = E.posterior_block(F.col("l_obs"), F.coalesce("rate", F.lit(0.0)), F.col("hbar"), s.prior, s)
    return scored.select("pop", "chrom", "t", "l_obs", "label", post.alias("posterior"))


class Calibration(NamedTuple):
    trials: DataFrame
    bins: DataFrame
    summary: DataFrame


def truth_calibration(
    units: DataFrame, common: DataFrame, haplotypes: DataFrame, recmap: DataFrame, n_ref: int, n_test: int, n_trials: int,
    prior_per_mille: int, draw: R.Draw, block: Column, tract_bp=None, scan_bp: int = 8_000_000,
    lengths_mb: Sequence[float] = (0.7, 1.5), target: float = 0.05, min_calls: int = 20, s: Settings = DEFAULTS,
) -> Calibration:
    """Posteriors against planted truth: trials, reliability bins and a line per population.

    ``units(pop, sample)`` are split in two halves: one gives the homozygosity of windows, the other the trials. The
    summary has ``n, ece``, the realised FDR at each length and at the target posterior, and ``lstar_mb``, the shortest length
    with ``min_calls`` calls whose FDR is at most ``target``.
    """
    split = R.reference_test_split(units.select("pop", "sample"), ["pop"], "sample", n_ref, n_test, draw)
    half = lambda part: split.filter(F.col("part") == part).select("pop", "sample")
    windows = population_hbar(common, spread_join(haplotypes, half("ref"), ["pop", "sample"], "left_semi"), recmap, s)
    tests = R.index_units(half("test"), ["pop"], "sample", block).withColumnRenamed("sample", "unit")
    markers = R.index_units(common.select("pop", "chrom", "pos"), ["pop", "chrom"], "pos", F.floor(F.col("pos") / s.scan_block_bp))
    trials = calibration_trials(
        tests, markers, haplotypes.withColumnRenamed("sample", "unit"), windows, n_trials, prior_per_mille,
        tract_bp or R.exponential_tract(), draw, s=s, scan_bp=scan_bp,
    )
    bins = K.reliability(trials)
    summary = K.calibration_error(bins).join(K.false_discovery(trials, lengths_mb, s.target_posterior).drop("n"), "pop")
    return Calibration(trials, bins, summary.join(K.truth_lstar(trials, target=target, min_calls=min_calls), "pop"))
