"""Recombination maps, windowed rates and genetic distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import evidence as E
from zygospan.functions import genotype as G


def window_rates(recmap: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Rate of every window: its own centre, else the left, else the right one, else 0.

    Each map row offers its rate to the three windows it can serve, so the lookup
    is one grouped minimum rather than three joins.
    """
    w = s.window_bp
    own = F.col("center") - w // 2
    offers = recmap.select("chrom", "rate", F.explode(F.array(
        F.struct(own.alias("ws"), F.lit(0).alias("prio")),
        F.struct((own + w).alias("ws"), F.lit(1).alias("prio")),
        F.struct((own - w).alias("ws"), F.lit(2).alias("prio")),
    )).alias("o")).select("chrom", "rate", "o.ws", "o.prio")
    best = offers.groupBy("chrom", "ws").agg(F.min_by("rate", "prio").alias("rate"))
    axis = recmap.groupBy("chrom").agg(F.max("center").alias("m")).select(
        "chrom", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / w) + 2)).alias("i")
    ).select("chrom", (F.col("i") * w).alias("ws"))
    return axis.join(best, ["chrom", "ws"], "left").select(
        "chrom", F.col("ws").alias("window_start"), F.coalesce("rate", F.lit(0.0)).alias("rate")
    )


def cumulative_cm(rates: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Genetic position at each window start, added up by blocks of 16 windows, of 16 such blocks and so on.

    Whole blocks come first, the widest foremost, so rounding grows with the depth of the blocks and not with the
    number of windows; a segment's rate is the difference of two positions and may tie with the edge of a rate bin.
    """
    fan, depth = 16, 4
    row = W.partitionBy("chrom").orderBy("window_start")
    i = F.col("_i")
    whole = lambda level: F.when(F.pmod(i, F.lit(fan**level)) == fan**level - 1, F.col(f"_b{level}"))
    inside = lambda level: W.partitionBy("chrom", F.floor(i / fan**level)).orderBy("_i")
    out = rates.withColumn("_i", F.row_number().over(row) - 1).withColumn("_b0", F.col("rate") * (s.window_bp / 1e6))
    for level in range(1, depth + 1):
        out = out.withColumn(f"_b{level}", F.sum(whole(level - 1)).over(inside(level).rowsBetween(W.unboundedPreceding, 0)))
    top = W.partitionBy("chrom").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("cm_start", F.coalesce(F.sum(whole(depth)).over(top), F.lit(0.0)))
    for level in reversed(range(depth)):
        before = F.collect_list(whole(level)).over(inside(level + 1).rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn("_a", before).withColumn("cm_start", F.aggregate("_a", F.col("cm_start"), lambda at, x: at + x))
    return out.select(*rates.columns, "cm_start")


def add_cm(df: DataFrame, cum: DataFrame, pos: str = "pos", out: str = "cm", s: Settings = DEFAULTS) -> DataFrame:
    """Genetic position of ``pos``; the last value holds past the end of the map.

    A chromosome that the map lacks keeps its rows, all at position 0 as on an empty map.
    """
    end = cum.groupBy("chrom").agg(F.max(F.col("cm_start") + F.col("rate") * (s.window_bp / 1e6)).alias("_end"))
    table = cum.select("chrom", F.col("window_start").alias("_ws"), F.col("rate").alias("_r"), "cm_start")
    inside = F.col("cm_start") + F.col("_r") * (F.col(pos) - F.col("_ws")) / 1e6
    return (
        df.withColumn("_ws", G.window_start(F.col(pos), s.window_bp))
        .join(table, ["chrom", "_ws"], "left").join(end, "chrom", "left")
        .withColumn(out, F.coalesce(inside, F.col("_end"), F.lit(0.0)))
        .drop("_ws", "_r", "cm_start", "_end")
    )


def block_id(cm: str = "cm", s: Settings = DEFAULTS):
    return F.floor(F.col(cm) / s.block_cm)


def rate_summary(rates: DataFrame, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Distribution of positive window rates; the genome has a few thousand windows."""
    q = F.percentile("rate", F.array(*[F.lit(p) for p in probs]))
    return rates.filter(F.col("rate") > 0).agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("rate").alias("r_min"), F.max("rate").alias("r_max"),
        F.percentile("rate", F.lit(0.5)).alias("r_median"),
        *[F.get(q, F.lit(i)).alias(f"p{round(p * 100)}") for i, p in enumerate(probs)],
    )


def equal_evidence_lengths(rates: DataFrame, reference_mb: float = 10.0, probs=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Length that carries the evidence of ``reference_mb`` at the median-rate locus."""
    base = rates.filter(F.col("rate") > 0).agg(
        F.percentile("rate", F.lit(0.5)).alias("r_median"),
        F.percentile("rate", F.array(*[F.lit(p) for p in probs])).alias("q"),
    )
    pairs = F.arrays_zip(F.array(*[F.lit(round(p * 100)) for p in probs]).alias("percentile"), F.col("q").alias("rate"))
    return base.select("r_median", F.explode(pairs).alias("z")).select(
        F.col("z").getField("percentile").alias("percentile"), F.col("z").getField("rate").alias("rate"),
        (F.col("r_median") * reference_mb / F.col("z").getField("rate")).alias("length_mb"),
    )


def chromosome_means(recmap: DataFrame) -> DataFrame:
    """Mean map rate per chromosome, straight from the map rows."""
    return recmap.groupBy("chrom").agg(F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("n"))


def arm_summary(recmap: DataFrame, centromeres: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Genetic length per chromosome arm; an arm without windows keeps a null row.

    ``centromeres(chrom, cen_start, cen_end)``; centres inside belong to no arm.
    """
    arm = F.when(F.col("center") < F.col("cen_start"), "p").when(F.col("center") > F.col("cen_end"), "q")
    mapped = (
        recmap.join(centromeres, "chrom").withColumn("arm", arm).filter(F.col("arm").isNotNull())
        .groupBy("chrom", "arm").agg(
            F.count(F.lit(1)).alias("n_win"), F.min("center").alias("_lo"), F.max("center").alias("_hi"),
            F.sum("pat").alias("cm_pat"), F.sum("mat").alias("cm_mat"),
        )
    )
    axis = centromeres.select("chrom", F.explode(F.array(F.lit("p"), F.lit("q"))).alias("arm"))
    avg = (F.col("cm_pat") + F.col("cm_mat")) / 2
    return axis.join(mapped, ["chrom", "arm"], "left").select(
        "chrom", "arm", F.coalesce("n_win", F.lit(0)).alias("n_win"),
        ((F.col("_hi") - F.col("_lo") + s.window_bp) / 1e6).alias("span_mb"),
        "cm_pat", "cm_mat", avg.alias("cm_avg"), (avg / F.col("n_win")).alias("mean_rate"),
        E.haldane(avg / 100).alias("theta"),
    )


def arm_totals(arms: DataFrame) -> DataFrame:
    """Genome totals per arm and overall, with the female-to-male ratio."""
    return arms.groupingSets([["arm"], []], "arm").agg(
        F.sum("cm_pat").alias("cm_pat"), F.sum("cm_mat").alias("cm_mat"),
        F.sum("cm_avg").alias("cm_avg"), (F.sum("cm_mat") / F.sum("cm_pat")).alias("ratio_mf"),
    ).withColumn("arm", F.coalesce("arm", F.lit("ALL")))
