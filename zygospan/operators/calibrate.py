"""Calibration of posteriors against labelled trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospan.functions import evidence as E


def reliability(trials: DataFrame, by: Sequence[str] = ("pop",), n_bins: int = 10) -> DataFrame:
    """Mean posterior and observed fraction in equal bins; the last bin is closed."""
    bin_ = F.least(F.floor(F.col("posterior") * n_bins), F.lit(n_bins - 1))
    return trials.groupBy(*by, bin_.alias("bin")).agg(
        F.avg("posterior").alias("mean_posterior"), F.avg("label").alias("observed"), F.count(F.lit(1)).alias("n")
    )


def calibration_error(bins: DataFrame, by: Sequence[str] = ("pop",)) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("observed") - F.col("mean_posterior"))) / F.sum("n")
    return bins.groupBy(*by).agg(gap.alias("ece"), F.sum("n").alias("n"))


def false_discovery(trials: DataFrame, lengths_mb: Sequence[float], posterior: float = 0.95, by: Sequence[str] = ("pop",)) -> DataFrame:
    """Realised FDR at each length and at the posterior cutoff; null when nothing is called."""
    at = [(1 - F.avg(F.when(F.col("l_obs") >= l, F.col("label")))).alias(f"fdr_{str(l).replace('.', '_')}mb") for l in lengths_mb]
    post = 1 - F.avg(F.when(F.col("posterior") >= posterior, F.col("label")))
    return trials.groupBy(*by).agg(*at, post.alias("fdr_posterior"), F.count(F.lit(1)).alias("n"))


def truth_lstar(
    trials: DataFrame, by: Sequence[str] = ("pop",), target: float = 0.05, min_calls: int = 20,
    start: float = 0.10, step: float = 0.05, points: int = 159,
) -> DataFrame:
    """First length with enough calls and an FDR at or below the target; inf if none.

    Trials collapse to grid cells before the reverse cumulative count.
    """
    by = list(by)
    k = F.least(F.floor((F.col("l_obs") - start) / step + 1e-9), F.lit(points - 1))
    cells = trials.filter(F.col("l_obs") >= start).groupBy(*by, k.alias("k")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_t")
    )
    # A threshold between two cells calls the same trials as the next cell's own.
    grid = trials.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    above = W.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    full = grid.join(cells, [*by, "k"], "left").select(
        *by, "k", F.sum(F.coalesce("_n", F.lit(0))).over(above).alias("calls"),
        F.sum(F.coalesce("_t", F.lit(0))).over(above).alias("true_calls"),
    )
    ok = (F.col("calls") >= min_calls) & (1 - F.col("true_calls") / F.col("calls") <= target)
    first = F.min(F.when(ok, F.round(start + F.col("k") * step, 2)))
    return full.groupBy(*by).agg(F.coalesce(first, F.lit(E.INF)).alias("lstar_mb"))
