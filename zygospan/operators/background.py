"""Background exceedance curves and the decisive lengths read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import evidence as E
from zygospan.operators.blocked import attach, exact_quantiles, prefix_sum, rank_desc
from zygospan.operators.maps import add_cm


def grid_cell(length: Column, s: Settings = DEFAULTS) -> Column:
    """Last grid point not above ``length``; null below the grid."""
    k = F.floor((length - s.grid_start_bp) / s.grid_step_bp)
    return F.when(length >= s.grid_start_bp, F.least(k, F.lit(s.grid_points - 1)))


def grid_length(k: Column, s: Settings = DEFAULTS) -> Column:
    return k * s.grid_step_bp + s.grid_start_bp


def spans(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scanned base pairs per key: last minus first marker of each chromosome."""
    keys = list(keys)
    per = calls.groupBy(*keys, "chrom").agg((F.max("pos") - F.min("pos")).alias("_s"))
    return per.groupBy(*keys).agg(F.sum("_s").alias("span_bp"))


def sample_cells(segments: DataFrame, by: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """``cell_partials`` that also tell the burden: ``by, k, cnt, sum_bp, long_bp``; cell -1 lies below the grid and counts nothing.

    Burden and curve that both start from it share what lies beneath: one pass over the segments, one row a sample and cell.
    """
    cell = grid_cell(F.col("len_bp"), s)
    cells = segments.groupBy(*by, F.coalesce(cell, F.lit(-1).cast("long")).alias("k")).agg(
        F.count(cell).alias("cnt"), F.sum("len_bp").alias("sum_bp"), _long_bp(s).alias("long_bp")
    )
    # Always true, but whoever reads the cells asks for all their columns, so they are computed once.
    return cells.filter((F.col("cnt") >= 0) & (F.col("sum_bp") >= 0) & (F.col("long_bp") >= 0))


def _long_bp(s: Settings) -> Column:
    return F.sum(F.when(F.col("len_bp") >= s.burden_min_bp, F.col("len_bp")).otherwise(0))


def sample_burden(segments: DataFrame, span: DataFrame, keys: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """Autozygous share per sample; samples without any run keep a zero row."""
    return _shares(segments.groupBy(*keys).agg(_long_bp(s).alias("roh_bp")), span, list(keys), s)


def burden_of_cells(cells: DataFrame, span: DataFrame, keys: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """``sample_burden`` from ``sample_cells``."""
    return _shares(cells.groupBy(*keys).agg(F.sum("long_bp").alias("roh_bp")), span, list(keys), s)


def _shares(roh: DataFrame, span: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    share = F.when(F.col("span_bp") > 0, F.col("roh_bp") / F.col("span_bp")).otherwise(F.lit(0.0))
    return (
        span.join(roh, keys, "left").withColumn("roh_bp", F.coalesce("roh_bp", F.lit(0)))
        .withColumn("f_roh", share).withColumn("is_outlier", share > s.outlier_f)
    )


def screened(burden: DataFrame, cutoff: float | None) -> DataFrame:
    return burden if cutoff is None else burden.filter(F.col("f_roh") <= cutoff)


def screen_segments(segments: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    return segments.join(kept.select(*keys), list(keys), "left_semi")


def cell_partials(segments: DataFrame, by: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """Additive partials per grid cell, at most ``grid_points`` rows per group."""
    return (
        segments.withColumn("k", grid_cell(F.col("len_bp"), s)).filter(F.col("k").isNotNull())
        .groupBy(*by, "k").agg(F.count(F.lit(1)).alias("cnt"), F.sum("len_bp").alias("sum_bp"))
    )


def curve_from_partials(partials: DataFrame, exposure: DataFrame, by: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """Exceedance ``sum(max(0, len - l)) / exposure`` on the whole grid.

    ``exposure(by, exposure_bp)``; groups without segments have no curve.
    """
    by = list(by)
    # A group's cells are one short map, so what lies beneath the partials is computed once.
    entry = F.struct(F.col("k").cast("long"), F.struct("cnt", "sum_bp"))
    cells = partials.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_cells"))
    grid = exposure.join(cells, by).withColumn(
        "k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s.grid_points - 1).cast("long")))
    ).withColumn("_cell", F.try_element_at("_cells", F.col("k")))
    filled = grid.select(
        *by, "k", "exposure_bp", F.coalesce("_cell.cnt", F.lit(0)).alias("_c"), F.coalesce("_cell.sum_bp", F.lit(0)).alias("_s")
    )
    above = W.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    l_bp = grid_length(F.col("k"), s)
    return filled.select(
        *by, l_bp.alias("l_bp"),
        (F.sum("_s").over(above) - F.sum("_c").over(above) * l_bp).alias("excess_bp"), "exposure_bp",
    ).withColumn("p_bg", F.when(F.col("exposure_bp") > 0, F.col("excess_bp") / F.col("exposure_bp")))


def exceedance_curve(segments: DataFrame, burden: DataFrame, by: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """Curve of kept segments over the spans of all kept samples."""
    by = list(by)
    exposure = burden.groupBy(*by).agg(F.sum("span_bp").alias("exposure_bp"))
    return curve_from_partials(cell_partials(segments, by, s), exposure, by, s)


def decisive_length(curve: DataFrame, by: Sequence[str], threshold: Column | float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Smallest grid length whose exceedance is at or below the threshold; inf if none."""
    limit = s.threshold if threshold is None else threshold
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    first = F.min(F.when(F.col("p_bg") <= limit, F.col("l_bp")))
    return curve.groupBy(*by).agg(F.coalesce(first / 1e6, F.lit(E.INF)).alias("lstar_mb"))


def complete_lstar(lstar: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Null for groups that have samples but no segment at all."""
    return groups.join(lstar, list(by), "left")


def upper_lengths(segments: DataFrame, totals: DataFrame, by: Sequence[str], probs: Sequence[float], s: Settings = DEFAULTS) -> DataFrame:
    """Nearest-rank percentiles over all runs although only long ones are stored.

    ``totals(by, n_all)`` counts every run; the dropped ones are the shortest.
    """
    by = list(by)
    counts = segments.groupBy(*by, "len_bp").agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sum(counts, by, F.floor(F.col("len_bp") / s.grid_step_bp), [F.col("len_bp")], F.col("_c"), "_hi")
    kept = counts.groupBy(*by).agg(F.sum("_c").alias("_kept"))
    ask = totals.join(kept, by).withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    shifted = F.col("pct") / 100 * F.col("n_all") - (F.col("n_all") - F.col("_kept"))
    ask = ask.withColumn("_rank", F.when(shifted > 0, F.least(F.ceil(shifted), F.col("_kept"))))
    hit = (F.col("_hi") - F.col("_c") < F.col("_rank")) & (F.col("_rank") <= F.col("_hi"))
    return ask.join(cum, by).groupBy(*by, "pct").agg(
        F.coalesce(F.max(F.when(hit, F.col("len_bp"))), F.lit(0)).alias("len_bp")
    )


def screen_ladder(burden: DataFrame, cutoffs: Sequence[float | None]) -> DataFrame:
    """``pop, sample, span_bp, screen``: a sample once per rung of the ladder whose cutoff it passes."""
    rungs = F.filter(
        F.array(*[
            F.struct(
                F.lit("none" if c is None else f"{c:.4f}").alias("screen"),
                F.lit(E.INF if c is None else c).alias("cut"),
            ) for c in cutoffs
        ]),
        lambda r: F.col("f_roh") <= r["cut"],
    )
    return burden.withColumn("_r", F.explode(rungs)).select("pop", "sample", "span_bp", "_r.screen")


def lstar_surface(segments: DataFrame, burden: DataFrame, cutoffs: Sequence[float | None], s: Settings = DEFAULTS) -> DataFrame:
    """L* for every gap tolerance and screen; screens use the gap-1 burden.

    All rungs of the ladder share one pass over the segments.
    """
    kept = screen_ladder(burden, cutoffs)
    by = ["pop", "gap", "screen"]
    sizes = kept.groupBy("pop", "screen").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("span_bp").alias("exposure_bp"))
    # Cells first: a sample has at most one row per grid cell when rungs multiply.
    partials = (
        cell_partials(segments, ["pop", "sample", "gap"], s)
        .join(kept.select("pop", "sample", "screen"), ["pop", "sample"])
        .groupBy(*by, "k").agg(F.sum("cnt").alias("cnt"), F.sum("sum_bp").alias("sum_bp"))
    )
    exposure = sizes.join(partials.select(*by).distinct(), ["pop", "screen"])
    lstar = decisive_length(curve_from_partials(partials, exposure.select(*by, "exposure_bp"), by, s), by, s=s)
    return lstar.join(sizes.select("pop", "screen", "n_kept"), ["pop", "screen"])


def quantile_matched(burden: DataFrame, reference: str, sample_block: Column, by: str = "platform") -> DataFrame:
    """Per platform, drop as many top-burden samples as the reference platform flags.

    Equal burdens fall in sample order; ``sample_block`` is monotone in ``sample``.
    """
    drops = burden.filter(F.col(by) == reference).groupBy("pop").agg(F.count_if("is_outlier").alias("_k"))
    ranked = rank_desc(
        burden, [by, "pop"], "f_roh", F.floor(F.col("f_roh") * 1000), "sample",
        sample_block, "_rank",
    )
    return ranked.join(drops, "pop").filter(F.col("_rank") > F.col("_k")).drop("_rank", "_k")


def platform_table(segments: DataFrame, burden: DataFrame, markers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """L* with and without the per-platform screen, with marker density.

    ``markers(platform, pop, n_markers, span_bp)`` holds the scanned axis per platform.
    """
    by = ["platform", "pop"]
    everyone = decisive_length(exceedance_curve(segments, burden, by, s), by, s=s)
    kept = screened(burden, s.outlier_f)
    inside = screen_segments(segments, kept, [*by, "sample"])
    fewer = decisive_length(exceedance_curve(inside, kept, by, s), by, s=s)
    density = markers.groupBy(*by).agg(F.sum("n_markers").alias("_m"), F.sum("span_bp").alias("_sp"))
    return (
        burden.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers"))
        .join(everyone.withColumnRenamed("lstar_mb", "lstar_all_mb"), by, "left")
        .join(fewer.withColumnRenamed("lstar_mb", "lstar_screened_mb"), by, "left")
        .join(density.select(*by, (F.col("_m") / (F.col("_sp") / 1e6)).alias("density")), by, "left")
    )


def burden_quantiles(burden: DataFrame, by: Sequence[str], probs: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    return exact_quantiles(burden, by, "f_roh", probs, F.floor(F.col("f_roh") * 1000))


def emission_sensitivity(curve: DataFrame, density: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """L* of one screened curve under each emission model; ``density(pop, density)``."""
    models = ("flat", "tol", "strict", "budget")
    l_mb = F.col("l_bp") / 1e6
    limit = {m: s.threshold_factor * E.emission_model(m, F.col("density"), l_mb, s) for m in models}
    first = lambda m: F.min(F.when(F.col("p_bg") <= limit[m], F.col("l_bp")))
    return curve.join(density, "pop").groupBy("pop").agg(
        *[F.coalesce(first(m) / 1e6, F.lit(E.INF)).alias(f"lstar_{m}_mb") for m in models]
    )


def analytic_comparison(curve: DataFrame, hbar: DataFrame, mean_rate: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Measured curve next to the independent-block prediction ``H ** (L r / block)``."""
    blocks = F.col("l_bp") / 1e6 * F.col("mean_rate") / s.block_cm
    return attach(curve.join(hbar, "pop"), mean_rate).withColumn("p_analytic", F.pow("mean_hbar", blocks))


# -- recombination-rate bins ------------------------------------------------


def rate_bins(rates: DataFrame, n_bins: int = 5) -> DataFrame:
    """Quantile bins of positive window rates with footprint; ends are open.

    Bins are closed on the left. Windows are at most a few thousand rows.
    """
    probs = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    known = rates.filter(F.col("rate") > 0)
    edges = known.agg(F.percentile("rate", probs).alias("_e")).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"), "_e"
    ).select(
        "bin",
        F.when(F.col("bin") == 0, F.lit(-E.INF)).otherwise(F.expr("get(_e, bin)")).alias("lo"),
        F.when(F.col("bin") == n_bins - 1, F.lit(E.INF)).otherwise(F.expr("get(_e, bin + 1)")).alias("hi"),
    )
    per = assign_bin(known, edges).groupBy("bin").agg(F.avg("rate").alias("mean_rate"), F.count("rate").alias("_f"))
    return edges.join(per, "bin", "left").select(
        "bin", "lo", "hi", "mean_rate", F.coalesce("_f", F.lit(0)).alias("footprint_windows")
    )


def segment_rate(segments: DataFrame, cum: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Mean cM/Mb of each segment from its two genetic end points."""
    both = add_cm(add_cm(segments, cum, "start_pos", "_c0", s), cum, "end_pos", "_c1", s)
    length = F.col("len_bp") / 1e6
    return both.withColumn("rate", F.when(length > 0, (F.col("_c1") - F.col("_c0")) / length).otherwise(F.lit(0.0))).drop("_c0", "_c1")


def assign_bin(df: DataFrame, bins: DataFrame) -> DataFrame:
    """Bin of ``rate``; the few bins travel as one array, so nothing is multiplied."""
    table = bins.agg(F.array_sort(F.collect_list(F.struct("lo", "bin"))).alias("_bins"))
    hit = F.expr("aggregate(_bins, cast(0 as int), (acc, b) -> if(rate >= b.lo, b.bin, acc))")
    return attach(df, table).withColumn("bin", hit).drop("_bins")


def rate_binned_lstar(binned: DataFrame, bins: DataFrame, n_samples: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """L* per rate bin; exposure is samples times the bin's footprint."""
    exposure = attach(bins, n_samples).select(
        "bin", (F.col("n_samples") * F.col("footprint_windows") * s.window_bp).alias("exposure_bp")
    )
    lstar = decisive_length(curve_from_partials(cell_partials(binned, ["bin"], s), exposure, ["bin"], s), ["bin"], s=s)
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_segments"))
    return bins.join(counts, "bin", "left").join(lstar, "bin", "left").select(
        "bin", "lo", "hi", "mean_rate", "footprint_windows",
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        F.coalesce("lstar_mb", F.lit(E.INF)).alias("lstar_mb"),
    )
