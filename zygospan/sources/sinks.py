"""Tabular and checkpoint outputs."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, path: str | None = None) -> str:
    """The folder all executors share: the given one or that of ``spark.checkpoint.dir``.

    Only a session in local mode, whose executors are threads of one process, gets a folder of its own.
    """
    path = path or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("give a folder that all executors share, or start the session with spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def wide_by(df: DataFrame, index: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    """One column per listed value; listing them avoids a pass to find them."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.max(value))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("chrom",)) -> None:
    """Replace only the partitions present in ``df``; others stay as they are."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(path)
    )


def write_clustered(df: DataFrame, table: str, keys: Sequence[str], buckets: int, block_bp: int, path: str) -> None:
    """Bucket calls by key and position block so later run scans need no first shuffle.

    Pass ``block_col='blk'`` to ``runs.call_runs`` when reading the table back.
    """
    cols = [*keys, "blk"]
    (
        df.withColumn("blk", F.floor(F.col("pos") / block_bp)).repartition(buckets, *cols)
        .write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *cols).sortBy(*cols, "pos").saveAsTable(table)
    )


def write_mismatches(rows: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str) -> None:
    """Bucket the rows of ``sparse.mismatch_rows`` by key and marker block, so ``sparse.sparse_runs`` scans them in place."""
    cols = [*keys, "blk"]
    (
        rows.repartition(buckets, *cols).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *cols).sortBy(*cols, "idx").saveAsTable(table)
    )


def missing_partitions(done: DataFrame, wanted: DataFrame, by: Sequence[str] = ("chrom",)) -> DataFrame:
    """Partitions still to compute, for a resumable run."""
    return wanted.join(done.select(*by).distinct(), list(by), "left_anti")


def finished_partitions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The commit log of ``resume_partitions``: partitions whose data are complete."""
    try:
        return spark.read.schema(schema).parquet(f"{path.rstrip('/')}-log").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def resume_partitions(
    source: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, by: Sequence[str] = ("chrom",), aggregate_only: bool = False,
) -> DataFrame:
    """Compute what ``path`` lacks, partition by partition, and return all finished partitions.

    A partition's data are written first and its line in the log after them. A job that is cut in between computes that
    partition again and replaces it; finished ones are neither read nor touched. A partition without any result is
    finished too. ``aggregate_only`` computes nothing. Only the partitions' names reach the driver.
    """
    spark, by = source.sparkSession, list(by)
    wanted = source.select(*by).distinct()
    todo = [] if aggregate_only else missing_partitions(finished_partitions(spark, path, wanted.schema), wanted, by).orderBy(*by).collect()
    for part in todo:
        mine = reduce(and_, (F.col(c).eqNullSafe(F.lit(part[c])) for c in by))
        write_partitions(compute(source.filter(mine)), path, by)
        spark.createDataFrame([part], wanted.schema).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}-log")
    done = finished_partitions(spark, path, wanted.schema)
    shape = compute(source.limit(0))
    try:
        kept = spark.read.schema(shape.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return shape
    # The log holds one row per partition of a folder tree.
    return kept.join(done, by, "left_semi").select(*shape.columns)
