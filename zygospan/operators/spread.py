"""Joins of whole-genome rows with narrow tables of samples, homologs or roles, without one task a genome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings
from zygospan.operators.blocked import growing

#: Tasks that the rows of one unit are dealt over; a genome has about ten times as many position blocks.
PARTS = 64


def spread_join(
    rows: DataFrame, units: DataFrame, on: Sequence[str], how: str = "inner", parts: int = PARTS, s: Settings = DEFAULTS,
    few: bool = False,
) -> DataFrame:
    """``rows.join(units, on, how)`` for ``rows(on, chrom, pos)``, each unit's rows dealt over ``parts`` keys.

    A key is the unit and a hash of chromosome and position block, so rows that are read together stay together. The
    narrow side is repeated ``parts`` times, the wide side is not; ``how`` is inner, left or left_semi. Rows whose
    position is null share the first part. With ``few`` the units are of a given number: they are broadcast as they are.
    """
    on = list(on)
    if few:
        return rows.join(F.broadcast(units), on, how)
    block = F.floor(F.col("pos") / s.scan_block_bp)
    part = F.coalesce(F.pmod(F.hash("chrom", block), F.lit(parts)), F.lit(0))
    dealt = units.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Plans estimate the units before they are repeated, and would send the whole cohort ``parts`` times through the driver.
    return rows.withColumn("_part", part).join(growing(dealt), [*on, "_part"], how).drop("_part")
