"""Cohort ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zygospan.sources import sinks, variants


def ingest(spark: SparkSession, path: str | list[str], out: str) -> None:
    """Variant text to long genotypes in Parquet by chromosome, once per file set.

    Compressed text is read by one task per file, so every later job starts from
    the Parquet copy.
    """
    table, names = variants.read_variants(spark, path)
    sinks.write_partitions(variants.genotypes_long(variants.snvs(table), names), out)


def subset(genotypes: DataFrame, prefix: str, maf_min: float, out: str, relaxed: bool = False) -> None:
    """Samples with a name prefix at the sites common among them."""
    mine = genotypes["sample"].startswith(prefix)
    sinks.write_partitions(variants.cohort_subset(genotypes, mine, maf_min, relaxed), out)
