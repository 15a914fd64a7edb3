"""Joins whose key would be a whole genome, and scenario tables."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from zygospan.operators import resample as R
from zygospan.operators import scoring as S
from zygospan.operators import trio as T
from zygospan.operators.spread import spread_join
from zygospan.plans import background as PB
from zygospan.sources import sinks, tables


@pytest.fixture(scope="module")
def genotypes(spark):
    rows = spark.range(4000).select(
        F.when(F.pmod("id", F.lit(3)) > 0, F.lit(1)).otherwise(F.pmod("id", F.lit(11))).cast("long").alias("sample"), (F.pmod("id", F.lit(2)) + 21).cast("int").alias("chrom"),
        (F.col("id") * 90_000).alias("pos"), F.pmod("id", F.lit(2)).cast("int").alias("a0"), F.pmod(F.floor(F.col("id") / 3), F.lit(2)).cast("int").alias("a1"),
    )
    return rows.unionByName(spark.createDataFrame([(1, None, None, 0, 0), (None, 21, 5, 0, 0)], "sample long, chrom int, pos long, a0 int, a1 int"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_equals_the_plain_join(spark, genotypes, how):
    units = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c"), (99, "d")], "sample long, pop string")
    got, want = spread_join(genotypes, units, ["sample"], how), genotypes.join(units, ["sample"], how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert spread_join(genotypes.limit(0), units, ["sample"], how).count() == 0


def test_no_exchange_on_a_genome_alone(spark, genotypes):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = spark.createDataFrame([(i, i % 2) for i in range(11)], "sample long, pop long")
        common = genotypes.select("chrom", "pos").distinct().withColumn("pop", F.lit(0).cast("long"))
        trios = spark.createDataFrame([(2, 2, 0, 1)], "trio long, child long, father long, mother long")
        pairs = spark.createDataFrame([(0, 0, 0, 1, 1, 0)], "pop long, pair long, unit_a long, hap_a int, unit_b long, hap_b int")
        haps = genotypes.select("sample", "chrom", "pos", F.lit(0).cast("long").alias("pop"), F.lit(0).alias("hap"), F.col("a0").alias("allele"))
        for df in (PB.homozygosity_calls(genotypes, members, common), T.align_trios(genotypes, trios), R.pair_matches(pairs, haps, ["pop"], "sample")):
            text = df._jdf.queryExecution().executedPlan().toString()
            keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
            assert keys and all("_part" in k or "pos" in k or "chrom" in k for k in keys), keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_one_genome_is_dealt_over_many_parts(genotypes):
    block = F.floor(F.col("pos") / 5_000_000)
    parts = genotypes.filter("sample = 1").groupBy(F.pmod(F.hash("chrom", block), F.lit(64))).count().collect()
    total = sum(r["count"] for r in parts)
    assert len(parts) > 30 and max(r["count"] for r in parts) < total / 8


def test_scenario_tables(spark):
    path = f"{sinks.shared_dir(spark)}/{uuid.uuid4().hex}"
    sinks.write_tsv(spark.createDataFrame([(0.0625, "cousins"), (0.005, "screen"), (1.5, "no probability"), (None, "none")], "prior double, prior_label string"), f"{path}/priors")
    sinks.write_tsv(spark.createDataFrame([(1.5, "array"), (1.0, "dense"), (1.0, "dense"), (-1.0, "bad")], "penalty double, platform string"), f"{path}/platforms")
    sinks.write_tsv(spark.createDataFrame([("s", "c1", "G", "chr1", 5_000_000, 2.5, "outbred", "38", None), ("s", "c2", None, None, None, None, None, None, None)],
                                          "source string, case_id string, gene string, chrom string, midpoint long, roh_mb double, case_class string, build string, note string"), f"{path}/loci")
    priors, platforms, loci = tables.read_priors(spark, f"{path}/priors"), tables.read_platforms(spark, f"{path}/platforms"), tables.read_loci(spark, f"{path}/loci")
    rows = S.with_scenario_tables(loci, priors, platforms).collect()
    assert [r.case_id for r in rows] == ["c1"] * 4
    assert {(r.prior, r.prior_label, r.penalty, r.platform) for r in rows} == {
        (p, pl, q, ql) for p, pl in ((0.0625, "cousins"), (0.005, "screen")) for q, ql in ((1.5, "array"), (1.0, "dense"))
    }
    assert S.with_scenario_tables(loci, priors.limit(0)).count() == 0
