"""Column builders over variant and genotype fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_start(pos: Column, width: int) -> Column:
    """Start of the fixed window that holds ``pos``."""
    return pos - F.pmod(pos, F.lit(width))


def is_biallelic_snv(ref: Column, alt: Column, drop_star: bool = False) -> Column:
    keep = (F.length(ref) == 1) & (F.length(alt) == 1) & (alt != ",")
    return keep & (alt != "*") if drop_star else keep


def allele(gt: Column, which: int) -> Column:
    """Numbered allele of a phased call; null when unphased or not numeric."""
    parts = F.split(gt, r"\|", 2)
    a0 = F.get(parts, F.lit(0)).try_cast("int")
    a1 = F.get(parts, F.lit(1)).try_cast("int")
    return F.when(a0.isNotNull() & a1.isNotNull(), (a0, a1)[which])


def is_complete_phased(*gts: Column) -> Column:
    """Every call is phased and none is missing."""
    return reduce(
        lambda x, y: x & y, [g.contains("|") & ~g.contains(".") for g in gts]
    )


def info_value(info: Column, key: str) -> Column:
    """A numeric INFO entry, null when absent or malformed."""
    hit = F.filter(F.split(info, ";"), lambda kv: kv.startswith(f"{key}="))
    return F.substring_index(F.get(hit, F.lit(0)), "=", -1).try_cast("double")


def maf(af: Column) -> Column:
    return F.least(af, 1 - af)


def is_common(af: Column, minimum: float) -> Column:
    return maf(af) >= minimum


def is_polymorphic(af: Column) -> Column:
    return (af > 0) & (af < 1)


def heterozygosity(af: Column) -> Column:
    return 2 * af * (1 - af)


def is_homozygous(a0: Column, a1: Column, missing: str = "drop") -> Column:
    """Both alleles equal. ``missing='hom'`` counts a missing call as homozygous."""
    same = a0 == a1
    if missing == "hom":
        return F.coalesce(same, F.lit(True))
    if missing == "drop":
        return same
    raise ValueError("missing must be 'hom' or 'drop'")


def transmitted(child: Column, p0: Column, p1: Column) -> Column:
    """Parental haplotype (0/1) that the child's allele matches, else null."""
    return F.when(child == p0, F.lit(0)).when(child == p1, F.lit(1))
