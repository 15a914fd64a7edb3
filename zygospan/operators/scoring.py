"""Scoring of intervals against a calibration curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import codes as C
from zygospan.functions import evidence as E
from zygospan.operators.blocked import attach, growing


def median_rate(rates: DataFrame) -> DataFrame:
    """One row with the median positive rate; 1.0 when there is none."""
    m = F.percentile(F.when(F.col("rate") > 0, F.col("rate")), F.lit(0.5))
    return rates.agg(F.coalesce(m, F.lit(1.0)).alias("r_median"))


def interval_rates(intervals: DataFrame, rates: DataFrame, key: str, s: Settings = DEFAULTS) -> DataFrame:
    """Mean positive rate over the windows each interval touches, unweighted.

    The last base is exclusive. Unknown intervals take the genome median and
    ``known = false``. Intervals meet windows by bin, never by range.
    """
    w = s.window_bp
    lo, hi = F.floor(F.col("start") / w), F.floor((F.col("end") - 1) / w)
    bins = F.explode(F.when(hi >= lo, F.sequence(lo, hi)))
    touched = intervals.select(key, "chrom", bins.alias("_b")).withColumn("window_start", F.col("_b") * w)
    # A row a window of the genome, where plans would rather send all touched windows of all intervals.
    local = (
        touched.join(F.broadcast(rates.filter(F.col("rate") > 0)), ["chrom", "window_start"])
        .groupBy(key).agg(F.avg("rate").alias("_local"))
    )
    # One row an interval again, each case once per scenario; plans estimate them by the files of the cases.
    return attach(intervals.join(growing(local), key, "left"), median_rate(rates)).select(
        *intervals.columns, F.coalesce("_local", "r_median").alias("rate"),
        F.col("_local").isNotNull().alias("known"), "r_median",
    )


def interpolate_curve(df: DataFrame, curve: DataFrame, x_mb: Column, value: str = "log10_bf", s: Settings = DEFAULTS) -> DataFrame:
    """Linear interpolation on the uniform grid, clamped to both ends.

    A population's curve travels as one array of its grid values, so every row meets one
    row of its population whatever its cell. A population without a curve keeps its rows,
    with a null value and ``known_population`` false.
    """
    last = s.grid_points - 1
    at = (x_mb * 1e6 - s.grid_start_bp) / s.grid_step_bp
    at = F.greatest(F.lit(0.0), F.least(at, F.lit(float(last))))
    cells = F.sort_array(F.collect_list(F.struct(F.col("l_bp"), F.col(value).alias("v"))))
    arrays = curve.groupBy("pop").agg(cells.alias("_cells")).withColumn("known_population", F.lit(True))
    k = F.least(F.floor("_at"), F.lit(last - 1)).cast("int")
    v0, v1 = F.get("_cells", k)["v"], F.get("_cells", k + 1)["v"]
    # At most ``grid_points`` values for each population of the curve: a proved bound.
    return (
        df.withColumn("_at", at).join(F.broadcast(arrays), "pop", "left")
        .withColumn(value, v0 + (v1 - v0) * (F.col("_at") - k))
        .withColumn("known_population", F.coalesce("known_population", F.lit(False))).drop("_at", "_cells")
    )


def curve_lstar(curve: DataFrame, prior: Column | float, s: Settings = DEFAULTS) -> DataFrame:
    """Shortest effective length per population whose posterior reaches the target."""
    post = E.posterior_from_bf(F.col("log10_bf"), prior)
    first = F.min(F.when(post >= s.target_posterior, F.col("l_bp")))
    return curve.groupBy("pop").agg(F.coalesce(first / 1e6, F.lit(E.INF)).alias("lstar_eff_mb"))


def conservative_population(lstar: DataFrame) -> DataFrame:
    """The population with the largest decisive length; the first name on ties."""
    return lstar.agg(F.max("lstar_eff_mb").alias("lstar_eff_mb")).join(lstar, "lstar_eff_mb").agg(
        F.min("pop").alias("pop"), F.max("lstar_eff_mb").alias("lstar_eff_mb")
    )


def resolve_unknown(df: DataFrame, lstar: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    best = conservative_population(lstar).select(F.col("pop").alias("_best"))
    return attach(df, best).withColumn(
        "pop", F.when(F.col("pop").cast("string") == unknown, F.col("_best")).otherwise(F.col("pop"))
    ).drop("_best")


def score_intervals(
    intervals: DataFrame, rates: DataFrame, curve: DataFrame, key: str = "id",
    prior: Column | float = DEFAULTS.prior, penalty: Column | float = 1.0, s: Settings = DEFAULTS,
) -> DataFrame:
    """Length, local rate, Bayes factor, posterior and decision of each interval.

    ``intervals(key, chrom, start, end, pop)``; ``prior`` and ``penalty`` may be columns.
    """
    located = interval_rates(intervals, rates, key, s).withColumn("l_mb", (F.col("end") - F.col("start")) / 1e6)
    l_eff = E.effective_length(F.col("l_mb"), F.col("rate"), F.col("r_median"), penalty)
    scored = interpolate_curve(located.withColumn("l_eff_mb", l_eff), curve, F.col("l_eff_mb"), s=s)
    post = E.posterior_from_bf(F.col("log10_bf"), prior)
    return scored.withColumn("posterior", post).withColumn(
        "decision", C.decision(F.col("posterior"), s.target_posterior, s.review_posterior)
    )


def with_decisive_length(scored: DataFrame, lstar: DataFrame, penalty: Column | float = 1.0) -> DataFrame:
    """Physical decisive length at each locus."""
    length = E.locus_decisive_length(F.col("lstar_eff_mb"), F.col("rate"), F.col("r_median"), penalty)
    return scored.join(lstar, "pop", "left").withColumn("lstar_locus_mb", length)


def with_scenarios(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row under every combination of the given fixed value lists."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def with_scenario_tables(df: DataFrame, *axes: DataFrame) -> DataFrame:
    """Every row under every combination of the rows of the given scenario tables, with their columns.

    A scenario table is a list of assumptions (priors, platforms), bounded by what someone wrote down; it travels as one
    array. Repeated scenarios count once; an empty table leaves no row.
    """
    for axis in axes:
        listed = axis.agg(F.sort_array(F.collect_set(F.struct(*axis.columns))).alias("_axis"))
        df = attach(df, listed).withColumn("_axis", F.explode("_axis")).select(*df.columns, "_axis.*")
    return df


def first_run_of_variant(variants: DataFrame, runs: DataFrame, keys: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """The first run that holds each variant, both ends included; null when none does."""
    keys = list(keys)
    bins = F.sequence(F.floor(F.col("start_pos") / s.window_bp), F.floor(F.col("end_pos") / s.window_bp))
    spread = runs.select(*keys, "start_pos", "end_pos", "len_bp", F.explode(bins).alias("_bin"))
    inside = (F.col("start_pos") <= F.col("pos")) & (F.col("pos") <= F.col("end_pos"))
    hit = F.when(inside, F.struct("start_pos", "end_pos", "len_bp"))
    return (
        variants.withColumn("_bin", F.floor(F.col("pos") / s.window_bp))
        .join(spread, [*keys, "_bin"], "left").groupBy(*variants.columns).agg(F.min(hit).alias("_h"))
        .select(*variants.columns, "_h.start_pos", "_h.end_pos", "_h.len_bp")
    )


def run_covariates(in_runs: DataFrame, windows: DataFrame, keys: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """Marker-weighted mean rate and homozygosity of each run; unknown windows are skipped."""
    cov = windows.select("chrom", F.col("window_start").alias("_ws"), "rate", "hbar")
    return (
        in_runs.withColumn("_ws", F.col("pos") - F.pmod("pos", F.lit(s.window_bp)))
        .join(cov, ["chrom", "_ws"], "left").groupBy(*keys, "start_pos", "end_pos", "len_bp")
        .agg(F.avg("rate").alias("rate"), F.avg("hbar").alias("hbar"))
    )


def classify_runs(runs: DataFrame, prior: float, s: Settings = DEFAULTS) -> DataFrame:
    """Corrected decisive length, analytic posterior and call of each run."""
    l_mb = F.col("len_bp") / 1e6
    return runs.withColumn("lstar_mb", E.corrected_lstar(F.col("rate"), F.col("hbar"), prior, s)).withColumn(
        "posterior", E.posterior_block(l_mb, F.col("rate"), F.col("hbar"), prior, s)
    ).withColumn("call", C.roh_call(l_mb, F.col("lstar_mb")))
