"""As-of joins and interpolation on grids of any spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbours(points: DataFrame, knots: DataFrame, by: Sequence[str], x: str, at: str, value: str, block: Column) -> DataFrame:
    """``points`` with ``before`` and ``after``, structs ``x, v`` of the last knot at or below and the first one above.

    ``knots(by, at, value)`` and points lie in one ordered union. It is scanned block by block; ``block`` is an
    expression of a column ``_x`` and monotone in it. A block hands on its last and first knot only, so a key that
    holds most rows spreads over its blocks. Of knots at one place the one with the largest value counts; a null place has
    no neighbours.
    """
    by = list(by)
    own = F.struct(*points.columns)
    knots = knots.filter(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(value).alias("_v"))
    none = F.lit(None)
    rows = points.select(*by, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_kind"), none.cast("struct<x:double,v:double>").alias("_k"), own.alias("_p"))
    knot = F.struct(F.col(at).cast("double").alias("x"), F.col("_v").cast("double").alias("v"))
    grid = knots.select(*by, F.col(at).cast("double").alias("_x"), F.lit(0).alias("_kind"), knot.alias("_k"), none.cast(rows.schema["_p"].dataType).alias("_p"))
    rows = grid.unionByName(rows).withColumn("_blk", F.coalesce(block.cast("long"), F.lit(-(2**62)))).repartition(*by, "_blk")
    # Knots come before points at the same place, so a point on a knot has it as its lower neighbour.
    inside = W.partitionBy(*by, "_blk").orderBy("_x", "_kind")
    back, on = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(1, W.unboundedFollowing)
    scanned = rows.withColumns({"_low": F.last("_k", ignorenulls=True).over(back), "_high": F.first("_k", ignorenulls=True).over(on)})
    ends = rows.groupBy(*by, "_blk").agg(F.max("_k").alias("_last"), F.min("_k").alias("_first"))
    order = W.partitionBy(*by).orderBy("_blk")
    carried = ends.select(
        *by, "_blk", F.last("_last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_from"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_to"),
    )
    known = F.col("_x").isNotNull()
    return scanned.filter("_kind = 1").join(carried, [*by, "_blk"]).select(
        "_p.*", F.when(known, F.coalesce("_low", "_from")).alias("before"), F.when(known, F.coalesce("_high", "_to")).alias("after")
    )


def interpolate(points: DataFrame, knots: DataFrame, by: Sequence[str], x: str, at: str, value: str, block: Column) -> DataFrame:
    """``points`` with ``value``, linear between neighbouring knots and constant beyond the first and the last one."""
    both = neighbours(points, knots, by, x, at, value, block)
    a, b, place = F.col("before"), F.col("after"), F.col(x).cast("double")
    line = a["v"] + (b["v"] - a["v"]) * ((place - a["x"]) / (b["x"] - a["x"]))
    return both.withColumn(value, F.when(a.isNull(), b["v"]).when(b.isNull() | (place == a["x"]), a["v"]).otherwise(line)).drop("before", "after")
