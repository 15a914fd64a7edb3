"""Locus enrichment, binomial tails, case descriptives and search-space cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import genotype as G
from zygospan.operators.blocked import attach, exact_quantiles, prefix_sum
from zygospan.operators.sketches import quantile_sketch, sketch_quantiles

_CHUNK = 4096


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted up by 8 so it is exact to about 1e-13."""
    z = n.cast("double") + 9
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shifted = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series
    for i in range(1, 9):
        shifted = shifted - F.ln(n + i)
    return shifted


def binomial_tail(tests: DataFrame, keys: Sequence[str], k: str = "k", n: str = "n", p: str = "p", out: str = "p_value") -> DataFrame:
    """P(X >= k) for each test row; k = 0 gives 1.

    Terms are laid out in chunks that are redistributed, so a long tail is summed
    by many tasks.
    """
    keys = list(keys)
    chunks = F.explode(F.when(F.col(k) <= F.col(n), F.sequence(F.col(k).cast("long"), F.col(n).cast("long"), F.lit(_CHUNK))))
    parts = tests.filter(F.col(k) > 0).select(*keys, F.col(k).alias("_k"), F.col(n).cast("long").alias("_n"), F.col(p).alias("_p"), chunks.alias("_from"))
    terms = parts.repartition(*keys, "_from").withColumn(
        "_i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + _CHUNK - 1, F.col("_n"))))
    )
    i, total = F.col("_i"), F.col("_n")
    log_c = _log_factorial(total) - _log_factorial(i) - _log_factorial(total - i)
    edge = F.when(F.col("_p") <= 0, F.lit(0.0)).when(F.col("_p") >= 1, (i == total).cast("double"))
    term = edge.otherwise(F.exp(log_c + i * F.ln("_p") + (total - i) * F.log1p(-F.col("_p"))))
    tails = terms.groupBy(*keys).agg(F.sum(term).alias("_tail"))
    value = F.when(F.col(k) <= 0, F.lit(1.0)).otherwise(F.coalesce("_tail", F.lit(0.0)))
    return tests.join(tails, keys, "left").withColumn(out, value).drop("_tail")


def locus_rates(loci: DataFrame, rates: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Rate of the window at each locus midpoint; null when the window is unknown."""
    table = rates.select("chrom", F.col("window_start").alias("_ws"), "rate")
    return loci.withColumn("_ws", G.window_start(F.col("midpoint"), s.window_bp)).join(
        table, ["chrom", "_ws"], "left"
    ).drop("_ws")


def baseline(rates: DataFrame, folds: Sequence[float] = (1.5, 2.0)) -> DataFrame:
    """Median positive rate and the share of windows at or above each fold of it."""
    known = rates.filter(F.col("rate") > 0)
    med = known.agg(F.percentile("rate", F.lit(0.5)).alias("r_median"), F.count(F.lit(1)).alias("n_windows"))
    hot = [(F.count_if(F.col("rate") >= f * F.col("r_median")) / F.max("n_windows")).alias(f"frac_{round(f * 10)}") for f in folds]
    return attach(known, med).agg(F.max("r_median").alias("r_median"), F.max("n_windows").alias("n_windows"), *hot)


def rate_percentile(loci: DataFrame, rates: DataFrame) -> DataFrame:
    """Share of positive window rates at or below each locus rate, in percent.

    One cumulative count per distinct window rate; locus rates are window rates,
    so they meet by equality.
    """
    known = rates.filter(F.col("rate") > 0).groupBy("rate").agg(F.count(F.lit(1)).alias("_c"))
    known = known.withColumn("_g", F.lit(0))
    cum = prefix_sum(known, ["_g"], F.floor("rate"), [F.col("rate")], F.col("_c"), "_le").select("rate", "_le")
    total = known.agg(F.sum("_c").alias("_total"))
    return attach(loci.join(cum, "rate", "left"), total).withColumn(
        "percentile", F.col("_le") / F.col("_total") * 100
    ).drop("_le", "_total")


def hot_counts(loci: DataFrame, base: DataFrame, by: str, total: str, short_mb: float = 5.0) -> DataFrame:
    """Loci per group and overall: all, at 1.5x and 2x the median rate, and short."""
    med = F.col("r_median")
    counts = attach(loci, base).rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rate") >= 1.5 * med).alias("n_15"),
        F.count_if(F.col("rate") >= 2.0 * med).alias("n_20"), F.count_if(F.col("roh_mb") <= short_mb).alias("n_short"),
        F.max("frac_15").alias("frac_15"), F.max("frac_20").alias("frac_20"),
        F.grouping(by).alias("_g"),
    )
    return counts.withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by).cast("string"))).drop("_g")


def enrichment_tests(counts: DataFrame, by: str) -> DataFrame:
    """One-sided binomial p-values of the hot counts."""
    one = binomial_tail(counts, [by], "n_15", "n", "frac_15", "p_15")
    return binomial_tail(one, [by], "n_20", "n", "frac_20", "p_20")


# (label, above, up to) in Mb; a row may belong to several strata.
STRATA = (
    ("ROH <= 3 Mb", float("-inf"), 3.0),
    ("ROH <= 5 Mb", float("-inf"), 5.0),
    ("ROH 5-10 Mb", 5.0, 10.0),
    ("ROH > 10 Mb", 10.0, float("inf")),
)


def with_strata(df: DataFrame, length: str = "roh_mb", strata=STRATA) -> DataFrame:
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in strata])
    hit = F.filter(table, lambda x: (F.col(length) > x["lo"]) & (F.col(length) <= x["hi"]))
    return df.withColumn("_s", F.explode(hit)).withColumn("stratum", F.col("_s.name")).drop("_s")


def smallest_interval(mutations: DataFrame, intervals: DataFrame) -> DataFrame:
    """The shortest linkage interval of each mutation's family and chromosome."""
    best = intervals.groupBy("family", "chrom").agg(F.min("len_mb").alias("roh_mb"), F.count(F.lit(1)).alias("n_intervals"))
    return mutations.join(best, ["family", "chrom"], "left").withColumn("n_intervals", F.coalesce("n_intervals", F.lit(0)))


def match_counts(joined: DataFrame) -> DataFrame:
    return joined.agg(
        F.count_if(F.col("n_intervals") > 0).alias("n_matched"),
        F.count_if(F.col("n_intervals") > 1).alias("n_multi"),
        F.count_if(F.col("n_intervals") == 0).alias("n_missed"),
    )


def case_descriptives(cases: DataFrame, by: Sequence[str] = (), sketch_k: int | None = None) -> DataFrame:
    """Length statistics of the cases with a known length.

    The median is exact, from ranks in blocks; with ``sketch_k`` it comes from a sketch of that size.
    """
    l, n, groups = F.col("roh_mb"), F.count("roh_mb"), list(by) or ["_all"]
    known = cases.filter(l.isNotNull()).withColumn("_all", F.lit(0))
    basic = known.groupBy(*groups).agg(
        n.alias("n"), F.avg(l).alias("mean_mb"), F.stddev_samp(l).alias("sd_mb"), F.min(l).alias("min_mb"), F.max(l).alias("max_mb"),
        *[(F.count_if(l <= t) / n).alias(f"share_le_{int(t)}") for t in (3.0, 5.0, 10.0)],
    )
    if sketch_k is None:
        median = exact_quantiles(known, groups, "roh_mb", (0.5,), F.floor(l))
    else:
        median = sketch_quantiles(quantile_sketch(known, groups, "roh_mb", sketch_k), groups, (0.5,))
    out = basic.join(median.select(*groups, F.col("quantile").alias("median_mb")), groups)
    return out if by else out.drop("_all")


def case_loads(segments: DataFrame, burden: DataFrame, floors_bp: Sequence[int]) -> DataFrame:
    """Runs and base pairs at or above each floor for every sample, zero when none."""
    aggs = [
        a for i, f in enumerate(floors_bp) for a in (
            F.count_if(F.col("len_bp") >= f).alias(f"_n{i}"),
            F.sum(F.when(F.col("len_bp") >= f, F.col("len_bp")).otherwise(0)).alias(f"_b{i}"),
        )
    ]
    per = burden.join(segments.groupBy("pop", "sample").agg(*aggs), ["pop", "sample"], "left")
    rows = F.array(*[
        F.struct(F.lit(f).cast("long").alias("floor_bp"), F.coalesce(F.col(f"_n{i}"), F.lit(0)).alias("n_roh"),
                 F.coalesce(F.col(f"_b{i}"), F.lit(0)).alias("roh_len_bp"))
        for i, f in enumerate(floors_bp)
    ])
    return per.withColumn("_r", F.explode(rows)).select("pop", "sample", "is_outlier", "_r.*")


def search_space(loads: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Load per case by set (screened, all), population or POOLED, and floor."""
    sets = F.explode(F.when(F.col("is_outlier"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("screened"))))
    pops = F.explode(F.array(F.col("pop").cast("string"), F.lit("POOLED")))
    # One row per distinct load first, so the two expansions act on few rows.
    few = loads.groupBy("pop", "is_outlier", "floor_bp", "n_roh", "roh_len_bp").agg(F.count(F.lit(1)).alias("_w"))
    rows = few.withColumn("set", sets).withColumn("pop", pops)
    by = ["set", "pop", "floor_bp"]
    w = F.col("_w")
    basic = rows.groupBy(*by).agg(
        F.sum(w).alias("n_cases"), (F.sum(w * F.col("n_roh")) / F.sum(w)).alias("roh_mean"), F.max("n_roh").alias("roh_max")
    )
    q = exact_quantiles(rows, by, "n_roh", (0.25, 0.5, 0.75), F.floor(F.col("n_roh") / 16), w)
    m = exact_quantiles(rows, by, "roh_len_bp", (0.5, 0.75), F.floor(F.col("roh_len_bp") / s.window_bp), w)
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    counts = q.groupBy(*by).agg(at(0.5).alias("roh_median"), at(0.25).alias("roh_q25"), at(0.75).alias("roh_q75"))
    mb = m.groupBy(*by).agg((at(0.5) / 1e6).alias("mb_median"), (at(0.75) / 1e6).alias("mb_q75"))
    return basic.join(counts, by).join(mb, by).withColumn("genes_median", F.col("mb_median") * s.genes_per_mb).withColumn(
        "genes_q75", F.col("mb_q75") * s.genes_per_mb
    )
