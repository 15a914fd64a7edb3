"""Metadata, map, curve and interval tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospan import schemas
from zygospan.operators.blocked import prefix_sum


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.PANEL)


def select_panel(panel: DataFrame, populations: Sequence[str], level: str = "superpop") -> DataFrame:
    """Samples of the listed populations as ``sample, pop``."""
    return panel.filter(F.col(level).isin(*populations)).select("sample", F.col(level).alias("pop"))


def subpopulations(panel: DataFrame, superpop: str) -> DataFrame:
    return panel.filter(F.col("superpop") == superpop).select("sample", "pop")


def parse_pedigree(lines: DataFrame) -> DataFrame:
    """``id father mother`` text; "0" marks a founder, a header row is dropped."""
    f = F.split(F.trim("value"), r"\s+")
    part = lambda i: F.get(f, F.lit(i))
    parent = lambda i: F.when(part(i) != "0", part(i))
    return lines.filter((F.size(f) >= 3) & ~F.lower(part(0)).isin("id", "sampleid", "sample")).select(
        part(0).alias("sample"), parent(1).alias("father"), parent(2).alias("mother")
    )


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    return parse_pedigree(spark.read.text(path))


def children(pedigree: DataFrame) -> DataFrame:
    return pedigree.filter(F.col("father").isNotNull() & F.col("mother").isNotNull())


def children_population(pedigree: DataFrame, panel: DataFrame, populations: Sequence) -> DataFrame:
    """Each child takes its father's population, else its mother's.

    A father of an unlisted population removes the child: the mother is only
    consulted when the father is not in the panel at all.
    """
    of = lambda role: panel.select(F.col("sample").alias(role), F.col("pop").alias(f"_{role}_pop"))
    return (
        children(pedigree)
        .join(of("father"), "father", "left").join(of("mother"), "mother", "left")
        .withColumn("pop", F.coalesce("_father_pop", "_mother_pop"))
        .filter(F.col("pop").isin(*populations))
        .select("sample", "pop", "father", "mother")
    )


def parse_recmap(raw: DataFrame) -> DataFrame:
    """Window-centre rates; comment, header and malformed rows drop out."""
    return (
        raw.select("chrom", F.col("pos").try_cast("long").alias("center"),
                   F.col("rate").try_cast("double").alias("rate"))
        .filter(~F.col("chrom").startswith("#") & ~F.col("chrom").startswith("Chr"))
        .dropna(subset=["center", "rate"])
    )


def read_recmap(spark: SparkSession, path: str) -> DataFrame:
    return parse_recmap(spark.read.csv(path, sep="\t", schema=schemas.RECMAP_TEXT))


def combine_sexes(pat: DataFrame, mat: DataFrame) -> DataFrame:
    """Paternal axis with both sexes; a missing maternal rate takes the paternal one."""
    joined = pat.select("chrom", "center", F.col("rate").alias("pat")).join(
        mat.select("chrom", "center", F.col("rate").alias("mat")), ["chrom", "center"], "left"
    )
    mat_filled = F.coalesce("mat", "pat")
    return joined.select(
        "chrom", "center", "pat", mat_filled.alias("mat"), ((F.col("pat") + mat_filled) / 2).alias("rate")
    )


def parse_window_stats(raw: DataFrame) -> DataFrame:
    num = lambda c, t="double": F.col(c).try_cast(t)
    return raw.select(
        "chrom", num("window_start", "long").alias("window_start"), F.col("population").alias("pop"),
        num("Hbar").alias("hbar"), num("n_blocks", "long").alias("n_blocks"),
        num("mean_distinct_hap").alias("mean_distinct"), num("mean_n_hap").alias("mean_n"),
        num("cMperMb").alias("rate"),
    ).filter(F.col("window_start").isNotNull())


def read_window_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_window_stats(
        spark.read.csv(path, sep="\t", header=True, schema=schemas.WINDOW_STATS_TEXT)
    )


def replicate_population(stats: DataFrame, source: str, targets: Sequence[str]) -> DataFrame:
    """Give every subpopulation a copy of its superpopulation's windows."""
    return stats.filter(F.col("pop") == source).withColumn(
        "pop", F.explode(F.array(*[F.lit(t) for t in targets]))
    )


def dedupe_rates(stats: DataFrame, positive: bool = False) -> DataFrame:
    """One rate per window: rates do not depend on the population."""
    rates = stats.filter(F.col("rate") > 0) if positive else stats.filter(F.col("rate").isNotNull())
    return rates.groupBy("chrom", "window_start").agg(F.max("rate").alias("rate"))


def curve_long(wide: DataFrame, populations: Sequence[str], suffix: str, length: str = "L_Mb", value: str = "log10_bf") -> DataFrame:
    """Wide curve columns ``<POP><suffix>`` to rows; all-null populations drop out."""
    cols = [p for p in populations if f"{p}{suffix}" in wide.columns]
    named = wide.select(
        F.round(F.col(length).cast("double") * 1e6).cast("long").alias("l_bp"),
        *[F.col(f"{p}{suffix}").try_cast("double").alias(p) for p in cols],
    )
    long = named.unpivot("l_bp", cols, "pop", value)
    usable = F.nanvl(F.col(value), F.lit(None)).isNotNull()
    alive = long.filter(usable).select("pop").distinct()
    return long.join(alive, "pop", "left_semi").select("pop", "l_bp", value)


def parse_intervals(lines: DataFrame) -> DataFrame:
    """BED-like rows: commas stripped, any whitespace, malformed rows dropped."""
    f = F.split(F.trim(F.replace(F.col("value"), F.lit(","), F.lit(""))), r"\s+")
    part = lambda i: F.get(f, F.lit(i))
    whole = lambda c: F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))
    return (
        lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
        .filter(whole(part(1)) & whole(part(2)))
        .select(part(0).alias("chrom"), part(1).cast("long").alias("start"), part(2).cast("long").alias("end"))
    )


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return parse_intervals(spark.read.text(path))


def parse_region(text: Column) -> tuple[Column, Column, Column]:
    """``chr:a-b`` into chromosome, start and end."""
    pick = lambda i: F.regexp_extract(text, r"^([^:]+):([0-9]+)-([0-9]+)$", i)
    return pick(1), pick(2).try_cast("long"), pick(3).try_cast("long")


def parse_mutation(text: Column) -> tuple[Column, Column]:
    """``chr7:1,234,567...`` into chromosome token and position."""
    pattern = r"^chr([0-9XY]+):([0-9,]+)"
    digits = F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), digits.try_cast("long")


def parse_manifest(raw: DataFrame, array: str | Column) -> DataFrame:
    """Distinct autosomal probe positions of one array."""
    name = F.lit(array) if isinstance(array, str) else array
    c = F.col("chrom").try_cast("int")
    return (
        raw.select(name.alias("array"), c.alias("chrom"), F.col("pos").try_cast("long").alias("pos"))
        .filter(F.col("chrom").between(1, 22) & F.col("pos").isNotNull()).distinct()
    )


def read_manifest(spark: SparkSession, path: str, array: str) -> DataFrame:
    return parse_manifest(spark.read.csv(path, sep="\t", schema=schemas.MANIFEST_TEXT), array)


def forward_fill(df: DataFrame, by: Sequence[str], order: str, value: str, block: Column) -> DataFrame:
    """Carry the last non-blank ``value`` down ``order`` within ``by``."""
    filled = F.trim(F.col(value))
    given = filled.isNotNull() & (filled != "")
    rows = prefix_sum(df, by, block, [F.col(order)], given.cast("long"), "_gid")
    heads = rows.filter(given).select(*by, "_gid", filled.alias("_head"))
    return (
        rows.join(heads, [*by, "_gid"], "left").withColumn(value, F.col("_head")).drop("_gid", "_head")
    )


def supplement_intervals(raw: DataFrame, block: int = 100_000) -> DataFrame:
    """Linkage intervals ``family, chrom, len_mb`` of a table that prints a family once."""
    filled = forward_fill(raw, ["file"], "row_no", "family", F.floor(F.col("row_no") / block))
    return filled.select(
        "family", F.col("chrom").try_cast("double").cast("int").alias("chrom"),
        F.col("len_mb").try_cast("double").alias("len_mb"),
    ).dropna(subset=["chrom", "len_mb"])


def supplement_mutations(raw: DataFrame, block: int = 100_000) -> DataFrame:
    """Autosomal mutations ``family, chrom, pos, gene`` of the same layout."""
    filled = forward_fill(raw, ["file"], "row_no", "family", F.floor(F.col("row_no") / block))
    chrom, pos = parse_mutation(F.trim("mutation"))
    return filled.select(
        "family", chrom.try_cast("int").alias("chrom"), pos.alias("pos"),
        F.trim(F.substring_index("protein", ":", 1)).alias("gene"),
    ).dropna(subset=["chrom", "pos"])


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """Case loci from tab-separated text with a header; blank lines and lines without a locus are dropped."""
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.LOCI).dropna(subset=["chrom", "midpoint"])


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """``prior, prior_label`` from tab-separated text with a header; only probabilities strictly between 0 and 1 count."""
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.PRIORS).filter((F.col("prior") > 0) & (F.col("prior") < 1))


def read_platforms(spark: SparkSession, path: str) -> DataFrame:
    """``penalty, platform`` from tab-separated text with a header; a penalty is positive."""
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.PLATFORMS).filter(F.col("penalty") > 0)


def loci_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.LOCI)
