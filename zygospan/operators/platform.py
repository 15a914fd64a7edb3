"""Marker panels: thinning, top-frequency selection and real array manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.operators.blocked import growing, rank_desc, row_numbers


def marker_axis(markers: DataFrame, by: Sequence[str] = ("pop", "chrom")) -> DataFrame:
    """Marker count and span of each axis."""
    return markers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_markers"), (F.max("pos") - F.min("pos")).alias("span_bp")
    )


def every_kth(markers: DataFrame, steps: Sequence[int], by: Sequence[str] = ("pop", "chrom"), s: Settings = DEFAULTS) -> DataFrame:
    """Markers 0, k, 2k, ... of each axis, for several steps in one pass."""
    ranked = row_numbers(markers, by, F.floor(F.col("pos") / s.scan_block_bp), [F.col("pos")], "_rn")
    fits = F.filter(F.array(*[F.lit(k) for k in steps]), lambda k: F.pmod(F.col("_rn") - 1, k) == 0)
    return ranked.withColumn("step", F.explode(fits)).drop("_rn")


def density_targets(markers: DataFrame, per_mb: float, by: Sequence[str] = ("pop", "chrom")) -> DataFrame:
    """Markers to keep for a target density, never more than there are."""
    want = F.floor(F.lit(per_mb) * F.col("span_bp") / 1e6)
    return marker_axis(markers, by).select(*by, F.least(want, F.col("n_markers")).alias("n_target"))


def top_frequency(markers: DataFrame, targets: DataFrame, by: Sequence[str] = ("pop", "chrom"), s: Settings = DEFAULTS) -> DataFrame:
    """The ``n_target`` markers of highest minor allele frequency; ties by position."""
    by = list(by)
    ranked = rank_desc(
        markers, by, "maf", F.floor(F.col("maf") * 1000), "pos", F.floor(F.col("pos") / s.scan_block_bp), "_r"
    )
    return ranked.join(F.broadcast(targets), by).filter(F.col("_r") <= F.col("n_target")).drop("_r", "n_target")


def on_manifest(markers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Markers probed by the array, by exact position."""
    return markers.join(growing(manifest.select("chrom", "pos")), ["chrom", "pos"], "left_semi")


def marker_layers(selections: DataFrame, platforms: Sequence[str], group: str, groups: int) -> DataFrame:
    """``chrom, pos, layers``: which platforms hold a marker in which group, one row a marker.

    ``selections(platform, group, chrom, pos)`` with groups 0, 1, ...; bit ``group * len(platforms) + i`` of ``layers`` is
    set where the group's markers on ``platforms[i]`` hold the position. Platforms not named are left out.
    """
    if len(platforms) * groups > 63:
        raise ValueError(f"{len(platforms)} platforms of {groups} groups do not fit the bits of a number")
    code = F.array_position(F.array(*map(F.lit, platforms)), F.col("platform"))
    bit = F.expr("shiftleft(1L, cast(_at as int))")
    rows = selections.filter(code > 0).select("chrom", "pos", (F.col(group) * len(platforms) + code - 1).alias("_at"))
    return rows.groupBy("chrom", "pos").agg(F.bit_or(bit).alias("layers"))


def manifest_overlap(markers: DataFrame, manifest: DataFrame, pop) -> DataFrame:
    """Probes of each array and how many are common markers of ``pop``."""
    mine = markers.filter(F.col("pop") == pop).select("chrom", "pos").withColumn("_hit", F.lit(1))
    axis = mine.select("chrom").distinct()
    return (
        manifest.join(axis, "chrom", "left_semi").join(growing(mine), ["chrom", "pos"], "left")
        .groupBy("array").agg(F.count(F.lit(1)).alias("n_probes"), F.count("_hit").alias("n_hits"))
        .withColumn("share", F.col("n_hits") / F.col("n_probes"))
    )
