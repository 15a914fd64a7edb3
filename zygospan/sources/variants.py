"""Variant call text to typed tables, and subsets of a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zygospan.functions import genotype as G

FIXED = 9


def sample_names(lines: DataFrame) -> list[str]:
    """Sample names of the ``#CHROM`` header lines, which must be alike in all files."""
    headers = lines.filter(F.col("value").startswith("#CHROM")).select(F.rtrim("value").alias("value")).distinct().take(2)
    if not headers:
        raise ValueError("no #CHROM header line")
    if len(headers) > 1:
        raise ValueError("the files' #CHROM header lines differ: read them by with_file_samples")
    return headers[0]["value"].split("\t")[FIXED:]


def name_table(spark: SparkSession, names: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """``i, sample`` of the wanted columns: a table rather than literals, as a cohort may have any number of samples."""
    wanted = None if keep is None else set(keep)
    return spark.createDataFrame([(i, n) for i, n in enumerate(names) if wanted is None or n in wanted], "i int, sample string")


def parse_variants(lines: DataFrame) -> DataFrame:
    """Typed site columns; the genotype fields stay one unsplit string.

    ``line`` orders the records of a file as they stand in it, if ``lines`` has the
    columns that ``read_lines`` adds; else in the order in which rows are read.
    """
    order = [F.col(c) for c in ("file", "block") if c in lines.columns]
    part = lambda i: F.get("_f", F.lit(i))
    return (
        lines.filter(~F.col("value").startswith("#"))
        .withColumn("_f", F.split("value", "\t", FIXED + 1))
        .select(
            part(0).alias("chrom"), part(1).try_cast("long").alias("pos"),
            part(2).alias("id"), part(3).alias("ref"), part(4).alias("alt"),
            part(7).alias("info"), part(8).alias("format"), part(9).alias("gts"),
            F.struct(*order, F.monotonically_increasing_id().alias("row")).alias("line"),
        )
        .filter(F.col("pos").isNotNull())
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their file and the start of the block they were read from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_variants(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """Variants and sample names. Gzip files are one task each: ingest once to Parquet."""
    lines = read_lines(spark, path)
    return parse_variants(lines), sample_names(lines)


def file_samples(lines: DataFrame) -> DataFrame:
    """``file, names``: the sample names of each file's own #CHROM line, in the order of its columns."""
    names = F.slice(F.split(F.rtrim("value"), "\t"), F.lit(FIXED + 1), F.lit(2**31 - 1))
    heads = lines.filter(F.col("value").startswith("#CHROM")).select("file", names.alias("names")).groupBy("file").agg(
        F.min("names").alias("names"), F.max("names").alias("_other")
    )
    differ = F.raise_error(F.concat(F.lit("two #CHROM lines that differ in "), "file"))
    return heads.select("file", F.when(F.col("names") == F.col("_other"), F.col("names")).otherwise(differ).alias("names"))


def with_file_samples(lines: DataFrame, most_bytes: int = 64 << 20, salts: int = 32) -> DataFrame:
    """Parsed variants with ``names``, the samples of their own file; files may list other samples in other orders.

    The header lines together are broadcast while they hold at most ``most_bytes``, which is measured; beyond that each
    is laid out under a few salts, so that the lines of a large file meet it in many tasks. A file without a header is
    an error.
    """
    heads = file_samples(lines)
    size = heads.agg(F.sum(F.length(F.array_join("names", "\t")))).first()[0] or 0
    rows = parse_variants(lines).withColumn("file", F.col("line.file"))
    if size <= most_bytes:
        both = rows.join(F.broadcast(heads), "file", "left")
    else:
        salted = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = rows.withColumn("_salt", F.pmod(F.xxhash64("chrom", "pos"), F.lit(salts)).cast("int")).join(salted, ["file", "_salt"], "left").drop("_salt")
    unknown = F.raise_error(F.concat(F.lit("no #CHROM header line in "), "file"))
    return both.withColumn("names", F.coalesce("names", unknown))


def genotypes_by_name(variants: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per site and sample, as ``genotypes_long`` gives it, from variants with their own ``names``."""
    cells = F.explode(F.arrays_zip(F.col("names").alias("sample"), F.split("gts", "\t").alias("g")))
    rows = variants.select("chrom", "pos", "ref", "alt", cells.alias("_c")).select("chrom", "pos", "ref", "alt", "_c.sample", F.substring_index("_c.g", ":", 1).alias("gt"))
    if keep is not None:
        rows = rows.filter(F.col("sample").isin(list(keep)))
    return rows.withColumns({"a0": F.substring("gt", 1, 1).try_cast("int"), "a1": F.substring("gt", 3, 1).try_cast("int")})


def snvs(variants: DataFrame, drop_star: bool = False) -> DataFrame:
    return variants.filter(G.is_biallelic_snv(F.col("ref"), F.col("alt"), drop_star))


def genotypes_long(
    variants: DataFrame, names: Sequence[str], keep: Sequence[str] | None = None
) -> DataFrame:
    """One row per site and sample in ``keep``."""
    rows = variants.select("chrom", "pos", "ref", "alt", F.posexplode(F.split("gts", "\t")).alias("i", "_g"))
    # The names fill one header line, no longer than each line of calls that a task holds: a proved bound.
    rows = rows.join(F.broadcast(name_table(variants.sparkSession, names, keep)), "i")
    gt = F.substring_index("_g", ":", 1)
    return rows.select(
        "chrom", "pos", "ref", "alt", "sample", gt.alias("gt"),
        F.substring(gt, 1, 1).try_cast("int").alias("a0"),
        F.substring(gt, 3, 1).try_cast("int").alias("a1"),
    )


def population_af(variants: DataFrame, populations: Sequence[str]) -> DataFrame:
    """Site rows per population with the allele frequency found in INFO."""
    pairs = F.array(*[
        F.struct(F.lit(p).alias("pop"), G.info_value(F.col("info"), f"AF_{p}").alias("af"))
        for p in populations
    ])
    return (
        variants.withColumn("_p", F.explode(pairs))
        .select("*", "_p.pop", "_p.af").drop("_p").filter(F.col("af").isNotNull())
    )


def common_by_population(variants: DataFrame, populations: Sequence[str], maf_min: float) -> DataFrame:
    """A site appears once for each population in which it is common."""
    return population_af(variants, populations).filter(G.is_common(F.col("af"), maf_min))


def trio_from_text(variants: DataFrame, names: Sequence[str], father: str, mother: str, child: str) -> DataFrame:
    """Three samples of the cohort at biallelic, phased and complete sites."""
    cells = F.split("gts", "\t")
    gt = {r: F.get(cells, F.lit(list(names).index(s))) for r, s in
          (("f", father), ("m", mother), ("c", child))}
    wide = snvs(variants).select(
        "chrom", "pos", "id", "ref", "alt",
        gt["f"].alias("gt_f"), gt["m"].alias("gt_m"), gt["c"].alias("gt_c"),
    )
    return trio_alleles(wide.filter(G.is_complete_phased(*map(F.col, ("gt_f", "gt_m", "gt_c")))))


def trio_alleles(wide: DataFrame) -> DataFrame:
    """Parse ``gt_f, gt_m, gt_c`` into ``f0 f1 m0 m1 c0 c1``."""
    cols = [G.allele(F.col(f"gt_{r}"), k).alias(f"{r}{k}") for r in "fmc" for k in (0, 1)]
    return wide.select("*", *cols).drop("gt_f", "gt_m", "gt_c").filter(
        F.col("f0").isNotNull() & F.col("m0").isNotNull() & F.col("c0").isNotNull()
    )


def call_set(variants: DataFrame, names: Sequence[str], sample: str, chrom: str) -> DataFrame:
    """Phased, non-missing SNV calls of one sample on one chromosome."""
    gt = F.substring_index(F.get(F.split("gts", "\t"), F.lit(list(names).index(sample))), ":", 1)
    calls = snvs(variants.filter(F.col("chrom") == chrom)).withColumn("gt", gt)
    return calls.filter(G.is_complete_phased(F.col("gt"))).select(
        "chrom", "pos", "ref", "alt", G.allele(F.col("gt"), 0).alias("a0"),
        G.allele(F.col("gt"), 1).alias("a1"), *(["line"] if "line" in variants.columns else []),
    )


def subset_counts(gt: Column, haploid: bool = True) -> tuple[Column, Column]:
    """(alternate, called) allele counts of one call; missing counts nothing."""
    diploid = gt.rlike(r"^[01][/|][01]$")
    ac = F.when(diploid, F.substring(gt, 1, 1).try_cast("int") + F.substring(gt, 3, 1).try_cast("int"))
    an = F.when(diploid, F.lit(2))
    if haploid:
        ac = ac.when(gt.rlike(r"^[01]$"), gt.try_cast("int"))
        an = an.when(gt.rlike(r"^[01]$"), F.lit(1))
    return ac.otherwise(F.lit(0)), an.otherwise(F.lit(0))


def allele_frequency(genotypes: DataFrame, by: Sequence[str] = ("chrom", "pos"), haploid: bool = True) -> DataFrame:
    """AF of each site from the given samples' calls; sites without calls drop out."""
    ac, an = subset_counts(F.col("gt"), haploid)
    return (
        genotypes.groupBy(*by).agg(F.sum(ac).alias("ac"), F.sum(an).alias("an"))
        .filter(F.col("an") > 0).withColumn("af", F.col("ac") / F.col("an"))
    )


def cohort_subset(
    genotypes: DataFrame, samples: Column, maf_min: float, relaxed: bool = False
) -> DataFrame:
    """Calls of the chosen samples at SNVs common among them.

    ``relaxed`` also drops ``*`` alleles, ignores haploid calls and unphases.
    """
    mine = genotypes.filter(samples)
    mine = mine.filter(G.is_biallelic_snv(F.col("ref"), F.col("alt"), drop_star=relaxed))
    keys = ["chrom", "pos", "ref", "alt"]
    af = allele_frequency(mine, keys, haploid=not relaxed)
    af = af.filter(G.is_common(F.col("af"), maf_min))
    out = mine.join(af.select(*keys, "ac", "an", "af"), keys)
    return out.withColumn("gt", F.replace(F.col("gt"), F.lit("|"), F.lit("/"))) if relaxed else out
