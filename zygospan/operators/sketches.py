"""Quantile sketches that are stored, merged over partitions, days and batches, and asked later.

The default everywhere is ``blocked.exact_quantiles``; a sketch is the choice where values keep arriving or one pass
must do. It holds a few thousand values whatever it has seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 800


def rank_error(k: int = K) -> float:
    """Share of all values by which a quantile's rank may be off, at 99 % confidence (the sketch's published bound)."""
    return 2.296 / k**0.9723


def quantile_sketch(df: DataFrame, by: Sequence[str], value: str, k: int = K) -> DataFrame:
    """``by, sketch, n``: one sketch per group of the non-null values, built per partition and merged."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """One sketch per group from several of the same groups, or of finer ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Rows ``by, prob, quantile`` like those of ``exact_quantiles``, each a value that was seen."""
    asked = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probs]))
    return sketches.select(*by, asked.alias("_q")).select(*by, "_q.prob", "_q.quantile")
