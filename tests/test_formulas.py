"""Published values and edge cases of the evidence formulas."""

import math

import pytest
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS
from zygospan.functions import codes as C
from zygospan.functions import evidence as E
from zygospan.operators import background as B
from zygospan.operators import calibrate as K
from zygospan.operators import scoring as S
from zygospan.operators.blocked import exact_quantiles, rank_desc, row_numbers


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_constants():
    assert DEFAULTS.emission == pytest.approx(0.367695, abs=1e-6)
    assert DEFAULTS.threshold == pytest.approx(1.290159e-3, abs=1e-9)
    assert E.threshold_p(0.0625, 0.95) == pytest.approx(DEFAULTS.threshold, rel=1e-12)


def test_length_to_posterior_inverts_the_posterior(spark):
    r, q = F.lit(1.3), F.lit(0.2)
    length = one(spark, E.length_to_posterior(r, q, 0.0625, 0.95))
    assert one(spark, E.posterior_legacy_2pq(length, r, q, 0.0625)) == pytest.approx(0.95, abs=1e-9)
    assert one(spark, E.length_to_posterior(F.lit(0.0), q, 0.0625)) is None
    assert one(spark, E.length_to_posterior(F.lit(0.001), q, 0.0625)) is None
    assert one(spark, E.length_to_posterior(r, F.lit(1.0), 0.0625)) == 0.1


def test_callable_length_edges(spark):
    assert one(spark, E.min_callable_length(F.lit(0.0), F.lit(0.02), 0.0625)) == math.inf
    assert one(spark, E.min_callable_length(F.lit(1.0), F.lit(1.0), 0.0625)) == math.inf
    # One block at least, however rare the haplotypes.
    assert one(spark, E.min_callable_length(F.lit(1.0), F.lit(0.0), 0.5)) == pytest.approx(0.5)


def test_block_posterior_without_covariate_is_the_prior(spark):
    assert one(spark, E.posterior_block(2.0, F.lit(0.0), F.lit(0.02), 0.0625)) == 0.0625
    assert one(spark, E.posterior_block(2.0, F.lit(1.0), F.lit(None).cast("double"), 0.0625)) == 0.0625


def test_bayes_factor_cap_and_prior_clamp(spark):
    assert one(spark, E.log10_bf(F.lit(0.0))) == pytest.approx(11.57, abs=0.005)
    assert one(spark, E.choose_prior(0.0625, F.lit(0.9))) == 0.5
    assert one(spark, E.choose_prior(0.0625, F.lit(0.0))) == 1e-4
    assert one(spark, E.choose_prior(0.0625, F.lit(None).cast("double"))) == 0.0625


def test_haldane_of_a_long_arm(spark):
    assert one(spark, E.haldane(F.lit(1.3))) == pytest.approx(0.5 * (1 - math.exp(-2.6)))
    assert one(spark, E.switch_probability(F.lit(0.0), 1.0)) == 1e-15


def test_codes(spark):
    assert one(spark, C.trace_code(F.lit(2), F.lit(2))) == "."
    assert one(spark, C.trace_code(F.lit(4), F.lit(16))) == "1"
    assert one(spark, C.trace_code(F.lit(5), F.lit(15))) == "x"
    assert one(spark, C.agreement_code(F.lit(0), F.lit(0))) == "."
    assert one(spark, C.agreement_code(F.lit(1), F.lit(19))) == "D"
    assert one(spark, C.agreement_code(F.lit(4), F.lit(1))) == "a"


def test_curve_and_decisive_length(spark):
    segs = spark.createDataFrame([("A", 1, 700_000), ("A", 1, 150_000), ("A", 2, 20_000_000)], "pop string, sample int, len_bp long")
    burden = spark.createDataFrame([("A", 1, 10_000_000), ("A", 2, 10_000_000), ("B", 3, 10_000_000)], "pop string, sample int, span_bp long")
    curve = B.exceedance_curve(segs, burden, ["pop"])
    rows = {r.l_bp: r.excess_bp for r in curve.collect()}
    lengths = [700_000, 150_000, 20_000_000]
    assert rows == {l: sum(max(0, x - l) for x in lengths) for l in range(100_000, 12_000_001, 50_000)}
    got = B.complete_lstar(B.decisive_length(curve, ["pop"]), burden.select("pop").distinct(), ["pop"])
    assert {r.pop: r.lstar_mb for r in got.collect()} == {"A": math.inf, "B": None}


def test_burden_keeps_samples_without_runs_and_is_strict(spark):
    segs = spark.createDataFrame([("A", 1, 1_560_000), ("A", 2, 1_560_001)], "pop string, sample int, len_bp long")
    span = spark.createDataFrame([("A", i, 100_000_000 if i < 4 else 0) for i in (1, 2, 3, 4)], "pop string, sample int, span_bp long")
    got = {r.sample: (r.f_roh, r.is_outlier) for r in B.sample_burden(segs, span, ["pop", "sample"]).collect()}
    assert got[1] == (0.0156, False) and got[2][1] and got[3] == (0.0, False) and got[4] == (0.0, False)


def test_interpolation_is_clamped(spark):
    curve = spark.range(239).select(F.lit("A").alias("pop"), (F.col("id") * 50_000 + 100_000).alias("l_bp"), F.col("id").cast("double").alias("log10_bf"))
    x = spark.createDataFrame([("A", 0.01), ("A", 0.125), ("A", 12.0), ("A", 40.0)], "pop string, x double")
    got = sorted(r.log10_bf for r in S.interpolate_curve(x, curve, F.col("x")).collect())
    assert got == pytest.approx([0.0, 0.5, 238.0, 238.0])


def test_interval_rate_uses_the_base_before_the_end(spark):
    rates = spark.createDataFrame([("1", 0, 1.0), ("1", 1_000_000, 3.0), ("1", 2_000_000, 0.0)], "chrom string, window_start long, rate double")
    iv = spark.createDataFrame([(1, "1", 0, 1_000_000), (2, "1", 0, 1_000_001), (3, "2", 0, 10), (4, "1", 2_000_000, 2_500_000)], "id int, chrom string, start long, end long")
    got = {r.id: (r.rate, r.known) for r in S.interval_rates(iv, rates, "id").collect()}
    assert got == {1: (1.0, True), 2: (2.0, True), 3: (2.0, False), 4: (2.0, False)}


def test_ranks_and_quantiles_across_blocks(spark):
    rows = [("a", i, i % 3 / 10) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    rn = row_numbers(df, ["g"], F.floor(F.col("id") / 7), [F.col("id")])
    assert all(r.rn == r.id + 1 for r in rn.collect())
    rk = rank_desc(df, ["g"], "v", F.floor(F.col("v") * 20), "id", F.floor(F.col("id") / 9))
    order = sorted(range(100), key=lambda i: (-(i % 3 / 10), i))
    assert [r.id for r in sorted(rk.collect(), key=lambda r: r["rank"])] == order
    q = exact_quantiles(df, ["g"], "id", [0.0, 0.25, 0.9, 1.0], F.floor(F.col("id") / 7)).collect()
    assert {r.prob: r.quantile for r in q} == pytest.approx({0.0: 0.0, 0.25: 24.75, 0.9: 89.1, 1.0: 99.0})


def test_reliability_last_bin_is_closed(spark):
    t = spark.createDataFrame([("A", 1.0, 1), ("A", 0.95, 1), ("A", 0.1, 0)], "pop string, posterior double, label int")
    bins = {r.bin: r.n for r in K.reliability(t).collect()}
    assert bins == {9: 2, 1: 1}
