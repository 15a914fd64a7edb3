"""Background nulls and the robustness of the decisive length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import evidence as E
from zygospan.functions import genotype as G
from zygospan.operators import background as B
from zygospan.operators import platform as P
from zygospan.operators import resample as R
from zygospan.operators.blocked import attach, growing
from zygospan.operators.runs import call_runs, keep_segments
from zygospan.operators.spread import spread_join
from zygospan.sources import variants as V
from zygospan.sources.sinks import write_partitions

SAMPLE = ["pop", "sample"]


class Null(NamedTuple):
    segments: DataFrame
    burden: DataFrame


def homozygosity_calls(genotypes: DataFrame, members: DataFrame, common: DataFrame, missing: str = "drop") -> DataFrame:
    """``pop, sample, chrom, pos, hom`` at the markers common in each sample's population.

    ``members(sample, pop)``, ``common(pop, chrom, pos)``.
    """
    mine = spread_join(genotypes, members.select("sample", "pop"), ["sample"])
    mine = mine.join(growing(common.select("pop", "chrom", "pos")), ["pop", "chrom", "pos"], "left_semi")
    hom = G.is_homozygous(F.col("a0"), F.col("a1"), missing)
    return mine.select("pop", "sample", "chrom", "pos", hom.alias("hom")).filter(F.col("hom").isNotNull())


def calls_from_variants(
    variants: DataFrame, names: Sequence[str], members: Mapping[str, str], s: Settings = DEFAULTS, missing: str = "drop"
) -> DataFrame:
    """Homozygosity calls straight from cohort lines; only the table of names is joined.

    Frequencies are judged once per site; a sample's field is only kept where the
    site is common in its population. ``members`` maps sample to population.
    """
    pops = sorted(set(members.values()))
    common = F.array_compact(F.array(*[
        F.when(G.is_common(G.info_value(F.col("info"), f"AF_{p}"), s.maf_min), F.lit(p)) for p in pops
    ]))
    spark = variants.sparkSession
    index = spark.createDataFrame([(i, n, members[n]) for i, n in enumerate(names) if n in members], "i int, sample string, pop string")
    sites = V.snvs(variants).withColumn("_common", common).filter(F.size("_common") > 0)
    rows = sites.select("chrom", "pos", "_common", F.posexplode(F.split("gts", "\t")).alias("i", "_g"))
    # The names fill one header line, no longer than each line of calls that a task holds: a proved bound.
    rows = rows.join(F.broadcast(index), "i").filter(F.array_contains("_common", F.col("pop")))
    gt = F.col("_g")
    hom = G.is_homozygous(F.substring(gt, 1, 1).try_cast("int"), F.substring(gt, 3, 1).try_cast("int"), missing)
    return rows.select("pop", "sample", "chrom", "pos", hom.alias("hom")).filter(F.col("hom").isNotNull())


def sample_null(
    calls: DataFrame, gaps: Sequence[int] = (1,), keys: Sequence[str] = SAMPLE, s: Settings = DEFAULTS,
    store: str | None = None, span: DataFrame | None = None,
) -> Null:
    """Kept segments of every sample and the burden at gap tolerance 1.

    ``span(keys, span_bp)`` replaces the spans of ``calls`` where a shorter table knows them. With ``store``, segments are written there by chromosome and read back, so
    every later curve, screen and bootstrap starts from the stored table.
    """
    keys = list(keys)
    runs = call_runs(calls, [*keys, "chrom"], gaps=gaps, max_gap=s.max_gap_bp, block=s.scan_block_bp)
    return null_of_runs(runs, B.spans(calls, keys) if span is None else span, gaps, keys, s, store)


def null_of_runs(
    runs: DataFrame, span: DataFrame, gaps: Sequence[int] = (1,), keys: Sequence[str] = SAMPLE, s: Settings = DEFAULTS,
    store: str | None = None,
) -> Null:
    """``sample_null`` from all runs ``keys, chrom, gap, start_pos, end_pos, n_markers, len_bp`` of the given gap tolerances."""
    runs = keep_segments(runs, s)
    if store is not None:
        write_partitions(runs, store)
        runs = runs.sparkSession.read.schema(runs.schema).parquet(store)
    base = 1 if 1 in gaps else gaps[0]
    # Masked, not filtered: a filter would sink into the scan, which would then run once more for the burden.
    based = B.sample_cells(runs, [*keys, "gap"], s).withColumn("long_bp", F.when(F.col("gap") == base, F.col("long_bp")).otherwise(0))
    return Null(runs, B.burden_of_cells(based, span, keys, s))


def background_curves(null: Null, by: Sequence[str] = ("pop",), s: Settings = DEFAULTS) -> DataFrame:
    """Screened curve with its Bayes factors."""
    kept, by = B.screened(null.burden, s.outlier_f), list(by)
    # The cells that the burden is made of, screened instead of the segments themselves.
    cells = B.sample_cells(null.segments, list(dict.fromkeys([*SAMPLE, *(c for c in null.segments.columns if c == "gap"), *by])), s)
    inside = B.screen_segments(cells, kept, SAMPLE).groupBy(*by, "k").agg(F.sum("cnt").alias("cnt"), F.sum("sum_bp").alias("sum_bp"))
    # A filter on ``k`` would sink into the scan, which would then run once more for the burden.
    inside = inside.filter(F.col("cnt") > 0)
    exposure = kept.groupBy(*by).agg(F.sum("span_bp").alias("exposure_bp"))
    curve = B.curve_from_partials(inside, exposure, by, s)
    return curve.withColumn("log10_bf", E.log10_bf(F.col("p_bg"), s))


def background_summary(null: Null, s: Settings = DEFAULTS) -> DataFrame:
    """Samples, outliers and L* with and without the screen, per population."""
    everyone = B.decisive_length(B.exceedance_curve(null.segments, null.burden, ["pop"], s), ["pop"], s=s)
    clean = B.decisive_length(background_curves(null, s=s), ["pop"], s=s)
    sizes = null.burden.groupBy("pop").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers"),
        F.sum("span_bp").alias("span_bp"), F.sum("roh_bp").alias("roh_bp"),
    )
    return sizes.join(everyone.withColumnRenamed("lstar_mb", "lstar_all_mb"), "pop", "left").join(
        clean.withColumnRenamed("lstar_mb", "lstar_screened_mb"), "pop", "left"
    )


def chance_null(
    haplotypes: DataFrame, indexed: DataFrame, n_pairs: int, gaps: Sequence[int], draw: R.Draw, s: Settings = DEFAULTS
) -> Null:
    """Runs between homologs of different individuals: pure chance identity.

    ``indexed(pop, sample, idx, n_units)``; a pair plays the role of a sample.
    """
    pairs = R.haplotype_pairs(indexed, ["pop"], "sample", n_pairs, draw)
    match = R.pair_matches(pairs, haplotypes, ["pop"], "sample")
    runs = call_runs(match, ["pop", "pair", "chrom"], gaps=gaps, max_gap=s.max_gap_bp, block=s.scan_block_bp)
    return Null(runs, B.spans(match, ["pop", "pair"]))


class ChanceReport(NamedTuple):
    lstar: DataFrame
    curve: DataFrame
    percentiles: DataFrame


def chance_report(
    null: Null, gaps: Sequence[int], hbar: DataFrame, mean_rate: DataFrame, percents: Sequence[float] = (99.0, 99.9, 99.99), s: Settings = DEFAULTS
) -> ChanceReport:
    """The chance null next to the independent-block prediction; the first gap tolerance is the base.

    ``lstar(pop, gap, lstar_mb, lstar_analytic_mb)``; ``curve(pop, l_bp, p_bg, p_analytic)`` at the base;
    ``percentiles(pop, pct, len_bp, n_runs, max_bp)`` of the base's runs, over all of them although only long ones are
    ranked. ``hbar(pop, mean_hbar)``, ``mean_rate`` one row.
    """
    kept, by = keep_segments(null.segments, s), ["pop", "gap"]
    over = null.burden.withColumn("gap", F.explode(F.array(*map(F.lit, gaps))))
    curve = B.exceedance_curve(kept, over, by, s)
    base = F.col("gap") == gaps[0]
    both = B.analytic_comparison(curve.filter(base), hbar, mean_rate, s)
    predicted = B.decisive_length(both.withColumn("p_bg", F.col("p_analytic")), ["pop"], s=s).withColumnRenamed("lstar_mb", "lstar_analytic_mb")
    all_ = null.segments.filter(base).groupBy("pop").agg(F.count(F.lit(1)).alias("n_all"), F.max("len_bp").alias("max_bp"))
    upper = B.upper_lengths(kept.filter(base), all_.select("pop", "n_all"), ["pop"], percents, s)
    return ChanceReport(
        B.decisive_length(curve, by, s=s).join(predicted, "pop", "left"),
        both.select("pop", "l_bp", "p_bg", "p_analytic"),
        upper.join(all_.withColumnRenamed("n_all", "n_runs"), "pop"),
    )


def array_floor(null: Null, markers: DataFrame, reference: str, sample_block: Column, s: Settings = DEFAULTS) -> DataFrame:
    """What a sparse array does to the screen and to L*: one row per platform and population.

    The columns of ``platform_table`` with ``median_f, p90_f`` of the burden and ``lstar_matched_mb``, L* after dropping
    as many top-burden samples as the reference platform flags. ``null`` is that of ``platform_sensitivity``.
    """
    by = ["platform", "pop"]
    table = B.platform_table(null.segments, null.burden, markers, s)
    kept = B.quantile_matched(null.burden, reference, sample_block)
    inside = B.screen_segments(null.segments, kept, [*by, "sample"])
    matched = B.decisive_length(B.exceedance_curve(inside, kept, by, s), by, s=s).withColumnRenamed("lstar_mb", "lstar_matched_mb")
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    spread = B.burden_quantiles(null.burden, by).groupBy(*by).agg(at(0.5).alias("median_f"), at(0.9).alias("p90_f"))
    return table.join(spread, by).join(matched, by, "left")


def lstar_bootstrap(null: Null, replicates: int, block: Column, draw: R.Draw, s: Settings = DEFAULTS) -> DataFrame:
    """Screened point estimate with its bootstrap interval."""
    kept = B.screened(null.burden, s.outlier_f)
    inside = B.screen_segments(null.segments, kept, SAMPLE)
    point = B.decisive_length(B.exceedance_curve(inside, kept, ["pop"], s), ["pop"], s=s)
    reps = R.bootstrap_lstar(inside, kept, ["pop"], replicates, block, draw, s)
    return point.join(R.bootstrap_interval(reps, ["pop"], s=s), "pop")


def lstar_surface(
    null: Null, cutoffs: Sequence[float | None], replicates: int, block: Column, draw: R.Draw, s: Settings = DEFAULTS
) -> DataFrame:
    """``pop, gap, screen, n_kept, lstar_mb`` with ``ci_lo, ci_hi, n_unconverged`` in every cell of the surface.

    Samples are drawn among those a screen keeps; a draw serves all gap tolerances.
    """
    point = B.lstar_surface(null.segments, null.burden, cutoffs, s)
    kept = B.screen_ladder(null.burden, cutoffs)
    reps = R.bootstrap_lstar(null.segments, kept, ["pop", "screen"], replicates, block, draw, s, cells_by=["pop"], within=["gap"])
    cells = ["pop", "gap", "screen"]
    return point.join(R.bootstrap_interval(reps, cells, s=s).select(*cells, "ci_lo", "ci_hi", "n_unconverged"), cells)


def platform_calls(calls: DataFrame, selections: DataFrame) -> DataFrame:
    """Calls restricted to each platform's markers ``(platform, pop, chrom, pos)``."""
    return calls.join(growing(selections), ["pop", "chrom", "pos"])


def platform_selections(
    markers: DataFrame, steps: Sequence[int] = (2, 5, 10, 20), densities: Sequence[float] = (),
    manifest: DataFrame | None = None, draw: R.Draw | None = None, s: Settings = DEFAULTS,
) -> DataFrame:
    """Markers of the full set, the thinnings, the density proxies and real arrays.

    A real array also gets a proxy: as many top-frequency markers as it shares.
    """
    cols = ["platform", "pop", "chrom", "pos"]
    out = markers.withColumn("platform", F.lit("full")).select(*cols)
    if steps:
        thin = P.every_kth(markers, steps, s=s)
        out = out.unionByName(thin.withColumn("platform", F.concat(F.lit("every_"), "step")).select(*cols))
    for d in densities:
        target = P.density_targets(markers, d)
        top = P.top_frequency(markers, target, s=s).withColumn("platform", F.lit(f"top_{d:g}"))
        out = out.unionByName(top.select(*cols))
        if draw is not None:
            some = R.random_markers(markers, target, ["pop", "chrom"], draw).withColumn("platform", F.lit(f"random_{d:g}"))
            out = out.unionByName(some.select(*cols))
    if manifest is not None:
        hit = markers.join(growing(manifest), ["chrom", "pos"]).withColumn("platform", F.col("array"))
        out = out.unionByName(hit.select(*cols))
        sizes = hit.groupBy("platform", "pop", "chrom").agg(F.count(F.lit(1)).alias("n_target"))
        # One row per array, population and chromosome.
        proxies = markers.join(F.broadcast(sizes.select("platform", "pop", "chrom")), ["pop", "chrom"])
        proxy = P.top_frequency(proxies, sizes, ["platform", "pop", "chrom"], s)
        out = out.unionByName(proxy.withColumn("platform", F.concat("platform", F.lit("_proxy"))).select(*cols))
    return out


def platform_sensitivity(calls: DataFrame, selections: DataFrame, span: DataFrame, s: Settings = DEFAULTS) -> Null:
    """Runs per platform; every platform keeps the full axis as exposure."""
    on = platform_calls(calls, selections)
    runs = call_runs(on, ["platform", *SAMPLE, "chrom"], gaps=(s.gap_tol,), max_gap=s.max_gap_bp, block=s.scan_block_bp)
    return platform_null(runs, selections, span, s)


def platform_null(runs: DataFrame, selections: DataFrame, span: DataFrame, s: Settings = DEFAULTS) -> Null:
    """``platform_sensitivity`` from the runs ``platform, pop, sample, chrom, start_pos, end_pos, len_bp`` of every platform."""
    keys = ["platform", *SAMPLE]
    # Every sample of a platform's populations counts, also one without a call on its markers.
    typed = span.join(selections.select("platform", "pop").distinct(), "pop").select(*keys, *[c for c in span.columns if c not in keys])
    return Null(keep_segments(runs, s), B.sample_burden(keep_segments(runs, s), typed, keys, s))


def rate_binned(
    null: Null, cum: DataFrame, rates: DataFrame, mean_hbar: float, n_bins: int = 5, s: Settings = DEFAULTS,
    replicates: int = 0, block: Column | None = None, draw: R.Draw | None = None,
) -> DataFrame:
    """Decisive length per recombination-rate bin next to the closed form.

    With ``replicates``, samples are drawn anew and each bin gets ``ci_lo, ci_hi, n_unconverged``; replicates that
    never cross are left out of the interval, which is null where all are.
    """
    kept = B.screened(null.burden, s.outlier_f)
    bins = B.rate_bins(rates, n_bins)
    placed = B.assign_bin(B.segment_rate(B.screen_segments(null.segments, kept, SAMPLE), cum, s), bins)
    n = kept.agg(F.count(F.lit(1)).alias("n_samples"))
    out = B.rate_binned_lstar(placed, bins, n, s).withColumn(
        "lstar_closed_mb", E.min_callable_length(F.col("mean_rate"), F.lit(mean_hbar), s.prior, s=s)
    )
    if not replicates:
        return out
    one = ["_all"]
    whole = lambda d: d.withColumn("_all", F.lit(0))
    vectors = R.weight_vectors(whole(kept).select("_all", "sample"), one, "sample", replicates, block, draw)
    cells = B.cell_partials(whole(placed), ["_all", "sample", "bin"], s)
    weighted = R.weighted_cells(vectors, cells, one, "sample", replicates, within=["bin"], s=s)
    # Every replicate draws as many samples, so a bin's exposure is the same in all of them.
    exposure = attach(bins, n).select("bin", F.array_repeat(F.col("n_samples") * F.col("footprint_windows") * s.window_bp, replicates).alias("exposure_bp"))
    reps = R.vector_lstar(weighted, exposure, ["bin"], ["bin"], replicates, s)
    found = R.bootstrap_interval(reps, ["bin"], drop_unconverged=True, s=s)
    # A replicate without any segment in a bin does not converge there either.
    counted = reps.groupBy("bin").agg((F.lit(replicates) - F.count_if(F.col("lstar_mb") != E.INF)).alias("n_unconverged"))
    return out.join(found.select("bin", "ci_lo", "ci_hi"), "bin", "left").join(counted, "bin", "left").withColumn(
        "n_unconverged", F.coalesce("n_unconverged", F.lit(replicates)).cast("long")
    )
