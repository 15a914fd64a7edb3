"""Windowed diversity: per-site heterozygosity and block haplotype homozygosity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import evidence as E
from zygospan.functions import genotype as G
from zygospan.operators.blocked import exact_quantiles, row_numbers
from zygospan.operators.sketches import quantile_sketch, sketch_quantiles

MOST_MARKERS = 31


def window_heterozygosity(sites: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Mean 2pq and site count per ``pop, chrom, window`` from rows ``pop, chrom, pos, af``."""
    return (
        sites.filter(G.is_polymorphic(F.col("af")))
        .groupBy("pop", "chrom", G.window_start(F.col("pos"), s.window_bp).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("n_variants"), F.avg(G.heterozygosity(F.col("af"))).alias("mean_2pq"))
    )


def weighted_diversity(windows: DataFrame, by: Sequence[str] = ("pop",)) -> DataFrame:
    weighted = F.sum(F.col("mean_2pq") * F.col("n_variants")) / F.sum("n_variants")
    return windows.groupBy(*by).agg(weighted.alias("mean_2pq"), F.sum("n_variants").alias("n_variants"))


def calibrated_share(windows: DataFrame, posterior: Column, by: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """Share of windows with a known rate whose posterior reaches the target."""
    known = F.col("rate") > 0
    hit = known & (posterior >= s.target_posterior)
    return windows.groupBy(*by).agg(
        F.count_if(known).alias("n_known"), F.count_if(hit).alias("n_calibrated"),
    ).withColumn("share", F.when(F.col("n_known") > 0, F.col("n_calibrated") / F.col("n_known")))


def calibrated_share_with_total(windows: DataFrame, posterior: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Per-chromosome shares with a TOTAL row."""
    known = F.col("rate") > 0
    return windows.rollup("chrom").agg(
        F.count_if(known).alias("n_known"),
        F.count_if(known & (posterior >= s.target_posterior)).alias("n_calibrated"),
    ).select(
        F.coalesce(F.col("chrom").cast("string"), F.lit("TOTAL")).alias("chrom"), "n_known", "n_calibrated",
        F.when(F.col("n_known") > 0, F.col("n_calibrated") / F.col("n_known")).alias("share"),
    )


def thin_blocks(markers: DataFrame, keys: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """At most ``block_max_markers`` evenly spaced markers per block.

    Keeps marker number ``floor(i * n / k)`` for ``i < k`` and adds its place ``slot``.
    """
    keys, k = list(keys), s.block_max_markers
    ranked = row_numbers(markers, keys, F.floor(F.col("pos") / s.scan_block_bp), [F.col("pos")], "_rn")
    sizes = markers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = F.col("_rn") - 1
    i = F.floor((at * k + F.col("_n") - 1) / F.col("_n"))
    chosen = (i < k) & (F.floor(i * F.col("_n") / k) == at)
    return (
        ranked.join(sizes, keys)
        .withColumn("slot", F.when(F.col("_n") <= k, at).otherwise(F.when(chosen, i)))
        .filter(F.col("slot").isNotNull()).drop("_rn", "_n")
    )


def haplotype_codes(thinned: DataFrame, haplotypes: DataFrame, keys: Sequence[str], unit: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """One integer per haplotype and block: two bits for each kept marker.

    Additive, so it combines before the shuffle. A marker without a row or with a null
    allele leaves its bits 0; alleles 0 and 1 set 1 and 2, all others 3. A long holds
    the bits of at most ``MOST_MARKERS`` markers.
    """
    if s.block_max_markers > MOST_MARKERS:
        raise ValueError(f"a code holds at most {MOST_MARKERS} markers a block, not {s.block_max_markers}")
    digit = F.when(F.col("allele").isNotNull(), F.least(F.col("allele") + 1, F.lit(3))).cast("long")
    digit = F.call_function("shiftleft", F.coalesce(digit, F.lit(0).cast("long")), (F.col("slot") * 2).cast("int"))
    on = [c for c in ("pop", "chrom", "pos") if c in thinned.columns and c in haplotypes.columns]
    return (
        haplotypes.join(thinned, on).groupBy(*keys, *unit)
        .agg(F.sum(digit).alias("code"))
    )


def unbiased_homozygosity(codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chance that two different haplotypes of a block are identical."""
    keys = list(keys)
    classes = codes.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c")
    return (
        classes.groupBy(*keys).agg(
            n.alias("n_hap"), F.count(F.lit(1)).alias("n_distinct"),
            F.sum(F.col("_c") * (F.col("_c") - 1)).alias("_same"),
        )
        .withColumn("hom", F.when(F.col("n_hap") >= 2, F.col("_same") / (F.col("n_hap") * (F.col("n_hap") - 1))))
        .drop("_same")
    )


def window_hbar(
    markers: DataFrame, haplotypes: DataFrame, s: Settings = DEFAULTS, anchor: str = "any"
) -> DataFrame:
    """Mean block homozygosity per window, by population.

    ``markers(pop, chrom, pos, blk)`` lists the common markers of each population
    and ``haplotypes(pop, chrom, pos, <unit>, allele)`` their alleles. A block counts
    once, in the window of its first marker: first in any population
    (``anchor='any'``) or first of its own population (``anchor='pop'``).
    """
    keys = ["pop", "chrom", "blk"]
    unit = [c for c in haplotypes.columns if c in ("sample", "hap")]
    thinned = thin_blocks(markers, keys, s)
    blocks = unbiased_homozygosity(haplotype_codes(thinned, haplotypes, keys, unit, s), keys)
    over = ["chrom", "blk"] if anchor == "any" else keys
    first = markers.groupBy(*over).agg(F.min("pos").alias("_first"))
    return (
        blocks.filter(F.col("hom").isNotNull()).join(first, over)
        .groupBy("pop", "chrom", G.window_start(F.col("_first"), s.window_bp).alias("window_start"))
        .agg(F.avg("hom").alias("hbar"), F.count(F.lit(1)).alias("n_blocks"),
             F.avg("n_distinct").alias("mean_distinct"), F.avg("n_hap").alias("mean_n"))
    )


def noise_side_by_side(hbar: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both noise terms on the block-homozygosity windows; a missing 2pq reads as 0."""
    old = legacy.select("pop", "chrom", "window_start", F.col("mean_2pq").alias("_q"))
    return hbar.join(old, ["pop", "chrom", "window_start"], "left").withColumn(
        "p_legacy", 1 - F.coalesce("_q", F.lit(0.0))
    ).drop("_q")


def population_summary(windows: DataFrame, prior: float, s: Settings = DEFAULTS, sketch_k: int | None = None) -> DataFrame:
    """Mean block homozygosity and median callable length per population.

    The median is exact, from ranks in blocks; with ``sketch_k`` it comes from a sketch of that size.
    """
    length = E.min_callable_length(F.col("rate"), F.col("hbar"), prior, s=s)
    callable_ = windows.withColumn("_l", F.when(F.col("rate") > 0, length))
    if sketch_k is None:
        median = exact_quantiles(callable_, ["pop"], "_l", (0.5,), F.floor("_l"))
    else:
        median = sketch_quantiles(quantile_sketch(callable_, ["pop"], "_l", sketch_k), ["pop"], (0.5,))
    mean = windows.groupBy("pop").agg(F.avg("hbar").alias("mean_hbar"))
    return mean.join(median.select("pop", F.col("quantile").alias("median_callable_mb")), "pop", "left")


def representative_windows(windows: DataFrame, by: Sequence[str] = ("chrom",)) -> DataFrame:
    """The lowest, the middle (index n // 2) and the highest positive rate."""
    w = W.partitionBy(*by)
    pos = windows.filter(F.col("rate") > 0)
    pos = pos.withColumn("_i", F.row_number().over(w.orderBy("rate", "window_start")) - 1)
    pos = pos.withColumn("_n", F.count(F.lit(1)).over(w))
    which = (
        F.when(F.col("_i") == 0, "low").when(F.col("_i") == F.floor(F.col("_n") / 2), "median")
        .when(F.col("_i") == F.col("_n") - 1, "high")
    )
    return pos.withColumn("which", which).filter(F.col("which").isNotNull()).drop("_i", "_n")
