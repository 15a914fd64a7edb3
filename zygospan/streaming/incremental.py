"""Incremental ingest and an incremental background curve."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zygospan.config import DEFAULTS, Settings
from zygospan.operators import background as B


def ingest_available(
    spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame],
    target: str, checkpoint: str, partition_by: Sequence[str] = ("chrom",), files_per_batch: int = 100,
) -> None:
    """Process the files that arrived since the last call exactly once, then stop.

    The checkpoint remembers finished files, so a lost executor or a restart
    repeats no rows in ``target``.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (
        transform(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).partitionBy(*partition_by)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _replace_batch(part: DataFrame, batch_id: int, target: str) -> None:
    """A batch overwrites its own partition, so a replay leaves the same rows."""
    part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)


def _run(spark: SparkSession, source: str, schema: StructType, fold: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int) -> None:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_partials_available(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    by: Sequence[str] = ("pop",), files_per_batch: int = 100, s: Settings = DEFAULTS,
) -> None:
    """Fold newly arrived segment files into grid partials, one set per batch.

    A batch overwrites its own ``batch_id`` partition, so a replayed batch leaves
    the same partials. Only grid-sized rows are stored.
    """
    _run(spark, source, schema, lambda batch, n: _replace_batch(B.cell_partials(batch, by, s), n, target), checkpoint, files_per_batch)


def merged_partials(spark: SparkSession, target: str, by: Sequence[str] = ("pop",)) -> DataFrame:
    """Partials of all batches; sums commute, so arrival order does not matter."""
    return spark.read.parquet(target).groupBy(*by, "k").agg(
        F.sum("cnt").alias("cnt"), F.sum("sum_bp").alias("sum_bp")
    )


def fold_extents(calls: DataFrame, batch_id: int, target: str, keys: Sequence[str] = ("pop", "sample")) -> None:
    """Write the first and last marker of every sample and chromosome in a batch of calls: one row each."""
    part = calls.groupBy(*keys, "chrom").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    _replace_batch(part, batch_id, target)


def merge_extents_available(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    keys: Sequence[str] = ("pop", "sample"), files_per_batch: int = 100,
) -> None:
    """Fold newly arrived calls into extents, the second state of an incremental curve, beside the grid partials.

    Minimum and maximum merge in any order and however a chromosome is cut over files and batches; each file is
    folded exactly once, and a replayed batch replaces its own rows.
    """
    _run(spark, source, schema, lambda batch, n: fold_extents(batch, n, target, keys), checkpoint, files_per_batch)


def merged_spans(spark: SparkSession, target: str, keys: Sequence[str] = ("pop", "sample")) -> DataFrame:
    """``keys, span_bp`` over all batches, as ``background.spans`` gives it for all calls at once."""
    whole = spark.read.parquet(target).groupBy(*keys, "chrom").agg((F.max("last_pos") - F.min("first_pos")).alias("_s"))
    return whole.groupBy(*keys).agg(F.sum("_s").alias("span_bp"))


def incremental_curve(
    spark: SparkSession, partials: str, extents: str, by: Sequence[str] = ("pop",),
    keys: Sequence[str] = ("pop", "sample"), s: Settings = DEFAULTS,
) -> DataFrame:
    """The exceedance curve of all that arrived, from the two stored states alone."""
    exposure = merged_spans(spark, extents, keys).groupBy(*by).agg(F.sum("span_bp").alias("exposure_bp"))
    return B.curve_from_partials(merged_partials(spark, partials, by), exposure, by, s)
