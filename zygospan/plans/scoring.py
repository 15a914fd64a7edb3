"""Scoring and enrichment jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import evidence as E
from zygospan.operators import enrich as N
from zygospan.operators import scoring as S


def score_roh(
    intervals: DataFrame, rates: DataFrame, curve: DataFrame, prior: float = DEFAULTS.prior,
    penalty: float = 1.0, s: Settings = DEFAULTS,
) -> DataFrame:
    """Batch scoring; population UNKNOWN takes the most conservative curve."""
    lstar = S.curve_lstar(curve, prior, s)
    known = S.resolve_unknown(intervals, lstar)
    return S.with_decisive_length(S.score_intervals(known, rates, curve, prior=prior, penalty=penalty, s=s), lstar, penalty)


def score_cases(
    cases: DataFrame, rates: DataFrame, curve: DataFrame, pop, priors: Sequence[float],
    penalties: Sequence[float] = (1.5, 1.0), cutoff_mb: float = 10.0, s: Settings = DEFAULTS,
) -> DataFrame:
    """Case loci with known widths under every prior and platform penalty."""
    start, end = E.locus_interval(F.col("midpoint"), F.col("roh_mb"))
    loci = cases.filter(F.col("roh_mb").isNotNull()).withColumn("start", start).withColumn("end", end)
    grid = S.with_scenarios(loci, penalty=[float(p) for p in penalties], prior=[float(p) for p in priors])
    return _score_grid(grid.withColumn("id", F.struct("case_id", "penalty", "prior")), rates, curve, pop, cutoff_mb, s)


def _score_grid(grid: DataFrame, rates: DataFrame, curve: DataFrame, pop, cutoff_mb: float, s: Settings) -> DataFrame:
    scored = S.score_intervals(
        grid.withColumn("pop", F.lit(pop)), rates, curve, prior=F.col("prior"), penalty=F.col("penalty"), s=s,
    )
    return scored.withColumn("above_cutoff", F.col("roh_mb") >= cutoff_mb).drop("id")


def score_case_tables(
    cases: DataFrame, rates: DataFrame, curve: DataFrame, pop, priors: DataFrame, platforms: DataFrame,
    cutoff_mb: float = 10.0, s: Settings = DEFAULTS,
) -> DataFrame:
    """``score_cases`` with its assumptions from ``priors(prior, prior_label)`` and ``platforms(penalty, platform)``."""
    start, end = E.locus_interval(F.col("midpoint"), F.col("roh_mb"))
    loci = cases.filter(F.col("roh_mb").isNotNull()).withColumn("start", start).withColumn("end", end)
    grid = S.with_scenario_tables(loci, priors, platforms)
    return _score_grid(grid.withColumn("id", F.struct("case_id", "prior_label", "platform")), rates, curve, pop, cutoff_mb, s)


def locus_enrichment(loci: DataFrame, rates: DataFrame, by: str = "source") -> DataFrame:
    """Hot-locus counts per source and combined, with binomial tests."""
    placed = N.locus_rates(loci, rates)
    return N.enrichment_tests(N.hot_counts(placed, N.baseline(rates), by, "COMBINED"), by)


def stratified_enrichment(mutations: DataFrame, intervals: DataFrame, rates: DataFrame) -> DataFrame:
    """Hot-locus tests per length stratum of a family cohort."""
    joined = N.smallest_interval(mutations, intervals).filter(F.col("roh_mb").isNotNull())
    loci = N.locus_rates(joined.withColumnRenamed("pos", "midpoint"), rates.filter(F.col("rate") > 0))
    strata = N.with_strata(loci.filter(F.col("rate").isNotNull()))
    counts = N.hot_counts(strata, N.baseline(rates), "stratum", "ALL").filter(F.col("stratum") != "ALL")
    return N.enrichment_tests(counts.drop("n_short"), "stratum")
