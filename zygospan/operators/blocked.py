"""Ordered scans that never put one whole key into one task.

A plain window over ``partitionBy(key)`` reads every row of a key in one task.
The helpers here scan fixed blocks of a key independently and carry only one
total per block across them, so a key that holds a third of the table still
spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_sum(
    df: DataFrame,
    by: Sequence[str],
    block: Column,
    order: Sequence[Column],
    value: Column | int,
    out: str,
    descending_blocks: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running total of ``value`` per ``by`` in ``order``.

    ``block`` must be monotone in ``order``; it and ``by`` must not be null. The rows
    are shuffled once, by key and block, for the scan, the totals and the join.
    """
    by = list(by)
    value = F.lit(value) if isinstance(value, int) else value
    rows = df.withColumn("_blk", block).withColumn("_val", value)
    rows = rows.repartition(*by, "_blk")
    local = W.partitionBy(*by, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    scanned = rows.withColumn("_loc", F.sum("_val").over(local))
    blk_order = F.col("_blk").desc() if descending_blocks else F.col("_blk").asc()
    totals = rows.groupBy(*by, "_blk").agg(F.sum("_val").alias("_tot"))
    before = W.partitionBy(*by).orderBy(blk_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_blk", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"),
    )
    total = F.col("_loc") + F.col("_off")
    if exclusive:
        total = total - F.col("_val")
    return (
        scanned.join(growing(offsets), [*by, "_blk"])
        .withColumn(out, total)
        .drop("_blk", "_val", "_loc", "_off")
    )


def growing(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so that it is shuffled and never sent whole through the driver.

    Plans estimate it by the compressed files beneath, before rows are multiplied, and would broadcast a hundred times that.
    """
    return side.hint("merge")


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which has exactly one row."""
    return df.crossJoin(one_row)


def row_numbers(df, by, block, order, out="rn", descending_blocks=False) -> DataFrame:
    return prefix_sum(df, by, block, order, F.lit(1).cast("long"), out, descending_blocks)


def rank_desc(
    df: DataFrame, by: Sequence[str], value: str, value_block: Column, tie: str,
    tie_block: Column, out: str = "rank",
) -> DataFrame:
    """Rank by ``value`` descending, then ``tie`` ascending, safe under heavy ties.

    Rows above a value are counted from one row per distinct value; only rows
    that share a value are numbered among themselves, in blocks of ``tie``.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cnt"))
    above = prefix_sum(
        counts, by, value_block, [F.col(value).desc()], F.col("_cnt"), "_above",
        descending_blocks=True, exclusive=True,
    ).drop("_cnt")
    among = row_numbers(df, [*by, value], tie_block, [F.col(tie).asc()], "_among")
    return (
        among.join(growing(above), [*by, value])
        .withColumn(out, F.col("_above") + F.col("_among"))
        .drop("_above", "_among")
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], value_block: Column,
    weight: Column | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles as rows ``(by, prob, quantile)``.

    Works on one row per distinct value, ranked in blocks, so no group of values
    is ever held by one task.
    """
    by, groups = ["_all", *by], list(by)
    weight = F.lit(1).cast("long") if weight is None else weight
    counts = (
        df.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
        .groupBy(*by, value).agg(F.sum(weight).alias("_cnt"))
    )
    cum = prefix_sum(counts, by, value_block, [F.col(value).asc()], F.col("_cnt"), "_hi")
    totals = (
        counts.groupBy(*by).agg(F.sum("_cnt").alias("_n"))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_h", F.col("prob") * (F.col("_n") - 1))
    )
    lo_rank, hi_rank = F.floor("_h") + 1, F.ceil("_h") + 1
    first, last = F.col("_hi") - F.col("_cnt") + 1, F.col("_hi")
    joined = cum.join(totals, by)
    hit_lo = (first <= lo_rank) & (lo_rank <= last)
    hit_hi = (first <= hi_rank) & (hi_rank <= last)
    v = F.col(value).cast("double")
    return (
        joined.filter(hit_lo | hit_hi)
        .groupBy(*by, "prob")
        .agg(
            F.max(F.when(hit_lo, v)).alias("_a"),
            F.max(F.when(hit_hi, v)).alias("_b"),
            F.max("_h").alias("_h"),
        )
        .select(
            *groups, "prob",
            F.when(F.col("_a") == F.col("_b"), F.col("_a"))
            .otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias("quantile"),
        )
    )
