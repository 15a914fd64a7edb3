"""Vector bootstrap, incremental exposure, stored sketches, as-of joins, resumable jobs and columns per file."""

import bisect
import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS
from zygospan.operators import asof, diversity, enrich
from zygospan.operators import background as B
from zygospan.operators import resample as R
from zygospan.operators import sketches as Q
from zygospan.operators.blocked import exact_quantiles
from zygospan.operators.runs import call_runs, keep_segments
from zygospan.plans import background as PB
from zygospan.sources import sinks, variants
from zygospan.streaming import incremental as I

DRAW = R.hash_draw(5)


def block():
    return F.floor(F.col("sample") / 8)


@pytest.fixture(scope="module")
def null(spark):
    rng = random.Random(3)
    samples = [(p, 100 * p + i, rng.randint(20, 60) * 10**6, rng.random() * 0.03) for p in (1, 2) for i in range(30)]
    segs = [(p, s, gap, rng.randint(50_000, 14_000_000)) for p, s, _, _ in samples[:-3] for gap in (0, 1) for _ in range(rng.randint(0, 30))]
    burden = spark.createDataFrame(samples, "pop long, sample long, span_bp long, f_roh double").withColumn("is_outlier", F.col("f_roh") > 0.0156)
    return PB.Null(spark.createDataFrame(segs, "pop long, sample long, gap int, len_bp long"), burden)


def lstar(cells, exposure):
    """Plain L* of weighted lengths."""
    for k in range(DEFAULTS.grid_points):
        l = DEFAULTS.grid_start_bp + k * DEFAULTS.grid_step_bp
        if sum(w * max(0, n - l) for w, n in cells) / exposure <= DEFAULTS.threshold:
            return l / 1e6
    return math.inf


def test_vectors_hold_the_draws_of_the_exploded_weights(spark, null):
    units = null.burden.select("pop", "sample")
    want = {(r.pop, r.sample, r.b): r.w for r in R.bootstrap_weights(units, ["pop"], "sample", 13, block(), DRAW).collect()}
    for hits in (1 << 21, 40):
        rows = R.weight_vectors(units, ["pop"], "sample", 13, block(), DRAW, hits_per_block=hits).collect()
        got = {(r.pop, r.sample, b + 1): w for r in rows for b, w in enumerate(r.w) if w}
        assert got == want and len({(r.pop, r.sample) for r in rows}) == len(rows)


def test_replicates_equal_plain_resampling(spark, null):
    segs = null.segments.filter("gap = 1")
    weights = collections.defaultdict(dict)
    for r in R.bootstrap_weights(null.burden.select("pop", "sample"), ["pop"], "sample", 9, block(), DRAW).collect():
        weights[r.pop, r.b][r.sample] = r.w
    spans = {(r.pop, r.sample): r.span_bp for r in null.burden.collect()}
    lengths = [(r.pop, r.sample, r.len_bp) for r in segs.collect()]
    want = {}
    for (pop, b), w in weights.items():
        cells = [(w.get(s, 0), n) for p, s, n in lengths if p == pop]
        want[pop, b] = lstar(cells, sum(k * spans[pop, s] for s, k in w.items()))
    got = {(r.pop, r.b): r.lstar_mb for r in R.bootstrap_lstar(segs, null.burden, ["pop"], 9, block(), DRAW).collect()}
    assert got == want


def test_no_replicate_is_a_row_before_the_end(spark, null):
    """Nothing is exploded on the way: not samples, cells or grid by replicates."""
    kept = null.burden.withColumn("screen", F.lit("none"))
    plan = R.bootstrap_lstar(null.segments, kept, ["pop", "screen"], 50, block(), DRAW, cells_by=["pop"], within=["gap"])
    assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_surface_and_bins_without_anything(spark, null):
    none = PB.Null(null.segments.filter("false"), null.burden.filter("false"))
    assert PB.lstar_surface(none, [None], 5, block(), DRAW).count() == 0
    assert R.bootstrap_lstar(none.segments, null.burden, ["pop"], 5, block(), DRAW).count() == 0


def test_surface_intervals_lie_around_their_replicates(spark, null):
    rows = PB.lstar_surface(null, [None, 0.0156], 40, block(), DRAW).collect()
    assert {(r.pop, r.gap, r.screen) for r in rows} == {(p, g, s) for p in (1, 2) for g in (0, 1) for s in ("none", "0.0156")}
    assert all(r.ci_lo <= r.ci_hi and 0 <= r.n_unconverged <= 40 for r in rows)


def test_a_replayed_batch_changes_no_exposure(spark, tmp_path):
    rng = random.Random(4)
    calls = spark.createDataFrame([(rng.randint(1, 2), s, c, rng.randint(1, 10**8), True) for s in range(20) for c in (1, 2) for _ in range(15)], "pop int, sample int, chrom int, pos long, hom boolean")
    calls = calls.withColumn("pop", F.pmod("sample", F.lit(2)))
    want = {(r.pop, r["sample"]): r.span_bp for r in B.spans(calls, ["pop", "sample"]).collect()}
    target = str(tmp_path / "extents")
    for n, part in enumerate((calls.filter("pos % 3 = 0"), calls.filter("pos % 3 = 1"), calls.filter("pos % 3 = 2"))):
        I.fold_extents(part, n, target)
    for again in (1, 1, 0):
        I.fold_extents(calls.filter(F.col("pos") % 3 == again), again, target)
        assert {(r.pop, r["sample"]): r.span_bp for r in I.merged_spans(spark, target).collect()} == want


def test_sketches_keep_their_bound_however_they_are_merged(spark):
    rng = random.Random(6)
    data = [(rng.choice("ab"), rng.choice([rng.gauss(0, 1), 3.0, rng.random() ** 9])) for _ in range(40_000)] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("part", F.pmod(F.xxhash64("g", "v"), F.lit(7)))
    fine = Q.quantile_sketch(df, ["g", "part"], "v", 200)
    probs = [i / 20 for i in range(21)]
    for sketch in (Q.merge_sketches(fine, ["g"], 200), Q.quantile_sketch(df, ["g"], "v", 200)):
        assert {r.g: r.n for r in sketch.collect()} == {g: sum(1 for a, v in data if a == g and v is not None) for g in "ab"}
        for r in Q.sketch_quantiles(sketch, ["g"], probs).collect():
            values = sorted(v for g, v in data if g == r.g and v is not None)
            low, high = bisect.bisect_left(values, r.quantile), bisect.bisect_right(values, r.quantile)
            off = max(0.0, low / len(values) - r.prob, r.prob - high / len(values))
            assert off <= 2 * Q.rank_error(200)
    assert Q.rank_error(800) < 0.004


def test_medians_need_no_percentile_over_rows(spark):
    cases = spark.createDataFrame([(c, x) for c in "xy" for x in [0.5, 2.0, 2.0, 7.5, None, 30.0]], "k string, roh_mb double")
    for by in (["k"], []):
        exact, rough = (enrich.case_descriptives(cases, by, k) for k in (None, 200))
        assert "percentile(" not in exact._jdf.queryExecution().optimizedPlan().toString()
        assert all(r.median_mb == 2.0 and r.mean_mb == 8.4 for r in exact.collect()) and exact.count() == max(1, 2 * len(by))
        assert all(r.median_mb in (2.0, 7.5) for r in rough.collect())
    windows = spark.createDataFrame([(1, 1.0, h) for h in (0.1, 0.2, 1.0, 1.0, 1.0)] + [(2, 0.0, 0.5)], "pop int, rate double, hbar double")
    got = {r.pop: r.median_callable_mb for r in diversity.population_summary(windows, 0.0625).collect()}
    assert got[1] == math.inf and got[2] is None


def test_quantiles_between_equal_infinities_stay_infinite(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (math.inf,)], "v double")
    assert [r.quantile for r in exact_quantiles(df, [], "v", (0.75,), F.floor("v")).collect()] == [math.inf]


@pytest.mark.parametrize("width", [7, 1000, 1])
def test_interpolation_on_any_grid(spark, width):
    rng = random.Random(8)
    knots = {k: sorted({rng.randint(0, 300) for _ in range(n)}) for k, n in (("a", 25), ("b", 1), ("c", 60))}
    value = {(k, x): rng.random() for k, xs in knots.items() for x in xs}
    points = [(k, rng.choice([rng.uniform(-50, 350), float(rng.randint(0, 300))])) for k in "abcd" for _ in range(80)] + [("a", None)]
    df = spark.createDataFrame(points, "k string, x double").withColumn("v0", F.lit(1))
    grid = spark.createDataFrame([(k, x, v) for (k, x), v in value.items()], "k string, at long, v double")
    got = asof.interpolate(df, grid, ["k"], "x", "at", "v", F.floor(F.col("_x") / width))
    assert got.columns == ["k", "x", "v0", "v"] and got.count() == len(points)
    for r in got.collect():
        xs = knots.get(r.k)
        want = None if r.x is None or not xs else float(np.interp(r.x, xs, [value[r.k, x] for x in xs]))
        assert r.v == want or abs(r.v - want) < 1e-12


def test_a_cut_job_goes_on_where_it_stopped(spark, tmp_path):
    rng = random.Random(9)
    calls = spark.createDataFrame([(1, s, c, 40_000 * i, rng.random() < 0.8) for s in range(6) for c in (20, 21, 22) for i in range(60)], "pop int, sample int, chrom int, pos long, hom boolean")
    calls = calls.unionByName(calls.limit(1).withColumns({"chrom": F.lit(23), "hom": F.lit(False)}))  # without any result
    runs = lambda d: keep_segments(call_runs(d, ["pop", "sample", "chrom"]))
    key = lambda df: sorted(map(tuple, df.select("sample", "chrom", "gap", "start_pos", "end_pos").collect()))
    path, seen = str(tmp_path / "segments"), []

    def cut(d):
        if len(seen) == 2:
            raise InterruptedError
        seen.append(1)
        return runs(d)

    assert sinks.resume_partitions(calls, runs, path, aggregate_only=True).count() == 0
    with pytest.raises(InterruptedError):
        sinks.resume_partitions(calls, cut, path)
    files = lambda: {p: p.stat().st_mtime_ns for c in (20, 21) for p in (tmp_path / "segments" / f"chrom={c}").glob("*.parquet")}
    before = files()
    half = sinks.resume_partitions(calls, runs, path, aggregate_only=True)
    assert {r.chrom for r in half.select("chrom").distinct().collect()} == {20, 21}
    # Data without a line in the log, as a cut between the two writes leaves them, do not count and are replaced.
    sinks.write_partitions(runs(calls.filter("chrom = 22 and sample = 0")), path)
    assert {r.chrom for r in sinks.resume_partitions(calls, runs, path, aggregate_only=True).select("chrom").distinct().collect()} == {20, 21}
    whole = sinks.resume_partitions(calls, runs, path)
    assert key(whole) == key(runs(calls)) and files() == before
    assert sinks.finished_partitions(spark, path, calls.select("chrom").schema).count() == 4
    started = []
    sinks.resume_partitions(calls, lambda d: started.append(1) or runs(d), path)
    assert len(started) == 1  # only to learn the shape


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_each_file_names_its_own_columns(spark, tmp_path, most_bytes):
    head, site = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t", "{}\t{}\t.\tA\tG\t.\tPASS\t.\tGT\t"
    (tmp_path / "one.vcf").write_text("##x\n" + head + "s1\ts2\ts3\n" + site.format(1, 10) + "0|1\t1|1\t0|0:9\n")
    (tmp_path / "two.vcf").write_text(head + "s3\ts1\n" + site.format(2, 20) + "1|0\t0|0\n" + site.format(2, 30) + "1|1\t.\n")
    rows = variants.with_file_samples(variants.read_lines(spark, str(tmp_path)), most_bytes=most_bytes)
    got = {(r.pos, r["sample"]): r.gt for r in variants.genotypes_by_name(rows).collect()}
    assert got == {(10, "s1"): "0|1", (10, "s2"): "1|1", (10, "s3"): "0|0", (20, "s3"): "1|0", (20, "s1"): "0|0", (30, "s3"): "1|1", (30, "s1"): "."}
    assert {r["sample"] for r in variants.genotypes_by_name(rows, ["s2"]).collect()} == {"s2"}
    (tmp_path / "bad.vcf").write_text(site.format(3, 30) + "1|1\n")
    with pytest.raises(Exception, match="no #CHROM header line"):
        variants.genotypes_by_name(variants.with_file_samples(variants.read_lines(spark, str(tmp_path)), most_bytes=most_bytes)).collect()


def test_trials_need_five_markers_near(spark):
    rng = random.Random(10)
    pos = {(p, c): sorted(rng.sample(range(0, 4_000_000, 100), 120)) for p in (1, 2) for c in (21, 22)}
    markers = spark.createDataFrame([(p, c, x, i, 120) for (p, c), xs in pos.items() for i, x in enumerate(xs)], "pop long, chrom int, pos long, idx long, n_units long")
    trials = spark.createDataFrame([(p, c, t, rng.choice(pos[p, c])) for p in (1, 2) for c in (21, 22) for t in range(60)], "pop long, chrom int, t long, focal long")
    for reach in (0, 50_000, 90_000, 10**9):
        got = {(r.pop, r.chrom, r.t) for r in R.crowded_trials(trials, markers, reach).collect()}
        assert got == {(r.pop, r.chrom, r.t) for r in trials.collect() if sum(abs(x - r.focal) <= reach for x in pos[r.pop, r.chrom]) >= 5}


def test_tracts_are_exponential_within_their_bounds(spark):
    tract = R.exponential_tract()(lambda k: R.hash_draw(3)(F.col("id"), F.lit(k)))
    x = np.array([r.x for r in spark.range(20_000).select((tract / 1e6).alias("x")).collect()])
    assert x.min() == 0.2 and x.max() == 12.0
    for at in (0.5, 1.0, 2.0, 5.0):
        assert abs((x > at).mean() - math.exp(-at / 2)) < 0.015
