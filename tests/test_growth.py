"""Joins and draws that only break on tables far larger than their files."""

import re

import duckdb
from pyspark.sql import functions as F

from checks.joins import arithmetic_draw
from checks.views import Views
from zygospan.operators import background as B
from zygospan.operators import maps as M
from zygospan.operators import platform as P
from zygospan.operators import resample as R
from zygospan.operators import scoring as S
from zygospan.operators import trio as T
from zygospan.operators.runs import site_runs
from zygospan.plans import background as PB


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def markers(spark, n=300):
    pos = F.col("id") * 5000
    return spark.range(n).withColumn("pop", F.explode(F.array(*[F.lit(p).cast("long") for p in range(5)]))).select(
        "pop", F.lit(21).alias("chrom"), pos.alias("pos"), (F.pmod("id", F.lit(45)) / 100).alias("maf"))


def test_draws_of_far_positions(spark):
    """Positions of a table sixty times as large: the product no longer fits 64 bits, its remainder does."""
    far = [0, 21, 1_700_000_000, 8_100_000_000, 2**40]
    rows = spark.createDataFrame([(21, p) for p in far], "chrom int, pos long").select("pos", arithmetic_draw(F.col("chrom"), F.col("pos")).alias("d")).collect()
    m = 2147483647
    assert {r.pos: r.d for r in rows} == {p: (((12345 + 21 * 7919 + p * 112648) * 48271 + 11) % m * 69621 + 7) % m for p in far}


def test_markers_are_never_broadcast(spark):
    """Whatever the estimate says; only tables of a row per array, population and chromosome may be."""
    common = markers(spark)
    calls = common.select("pop", F.lit(1).alias("sample"), "chrom", "pos", F.lit(True).alias("hom"))
    manifest = common.select("chrom", "pos").distinct()
    assert "Broadcast" not in plan(PB.platform_calls(calls, common.withColumn("platform", F.lit("full"))))
    assert "Broadcast" not in plan(P.on_manifest(common, manifest))
    targets = P.density_targets(common, 40.0)
    for df in (R.random_markers(common, targets, ["pop", "chrom"], arithmetic_draw), P.top_frequency(common, targets), P.every_kth(common, (2, 5))):
        assert plan(df).count("SortMergeJoin") >= 1 and plan(df).count("BroadcastExchange") <= 1
    proxies = PB.platform_selections(common, (), manifest=manifest.withColumn("array", F.lit("A1")))
    assert "BuildLeft" not in plan(proxies)


def test_a_curve_reads_its_segments_once(spark):
    segments = spark.createDataFrame([(0, 1, 250_000), (0, 2, 90_000), (1, 3, 700_000)], "pop long, sample long, len_bp long").repartition(3, "sample")
    burden = spark.createDataFrame([(0, 1, 10_000_000), (0, 2, 5_000_000), (1, 3, 8_000_000), (2, 4, 1_000_000)], "pop long, sample long, span_bp long")
    curve = B.exceedance_curve(segments, burden, ["pop"])
    assert plan(curve).count("Scan ExistingRDD") == 2
    got = {(r.pop, r.l_bp): (r.excess_bp, r.exposure_bp) for r in curve.collect()}
    lengths = [100_000 + 50_000 * i for i in range(239)]
    want = {0: ([250_000, 90_000], 15_000_000), 1: ([700_000], 8_000_000)}
    assert got == {(p, x): (sum(max(0, n - x) for n in ns), e) for p, (ns, e) in want.items() for x in lengths}


def test_trials_travel_and_markers_stay(spark):
    """Trials and pairs are few whatever the cohort: they are broadcast, markers and haplotypes are not shuffled for others."""
    tests = spark.createDataFrame([(p, 5 * i + p, i, 4) for p in range(5) for i in range(4)], "pop long, unit long, idx long, n_units long")
    numbered = R.index_units(markers(spark), ["pop", "chrom"], "pos", F.floor(F.col("pos") / 500_000))
    assert "BuildLeft" not in plan(numbered)
    trials = R.labelled_trials(tests, numbered, 6, 500, lambda d: F.lit(400_000), arithmetic_draw)
    assert "BuildLeft" in plan(R.crowded_trials(trials, numbered, 30_000)) and trials.count() == 30
    pairs = spark.createDataFrame([(0, 0, 1, 1, 2, 0)], "pop long, pair long, unit_a long, hap_a int, unit_b long, hap_b int")
    haps = spark.range(2000).select(
        F.lit(0).cast("long").alias("pop"), F.pmod("id", F.lit(50)).alias("sample"), F.pmod("id", F.lit(2)).cast("int").alias("hap"),
        F.lit(21).alias("chrom"), F.floor(F.col("id") / 50).alias("pos"), F.lit(1).alias("allele")).repartition(4)
    assert "LeftSemi" in plan(R.pair_matches(pairs, haps, ["pop"], "sample"))


def test_a_family_is_shuffled_by_site_and_scanned_once(spark):
    """The calls of four samples travel as one row, and the burden asks for the very scan that the segments come from."""
    null = Views(spark, "/root/testdata/sf0.001").null((0, 1, 2))
    assert not [line for line in plan(null.burden).splitlines() if "Filter" in line and "gap" in line]
    scans = [re.sub(r"#\d+L?", "", line) for line in plan(null.segments).splitlines() if "REPARTITION_BY_COL" in line and "_blk" in line]
    assert len(scans) == 1 and "fam" in scans[0] and "sample" not in scans[0]


def test_long_maps_add_up_as_their_sql_does(spark):
    """To the last bit: segments inside a window whose rate is the edge of a bin fall on the side that the rounding picks."""
    rate = lambda c: (F.pmod(F.col("id") * 37 + c * 11, F.lit(40)) + 2) / F.lit(20.0) + F.pmod(F.col("id") * 23 + c * 7, F.lit(50)) / F.lit(40.0)
    windows = [spark.range(5000).select(F.lit(c).alias("chrom"), (F.col("id") * 1_000_000).alias("window_start"), rate(c).alias("rate")) for c in (21, 22)]
    got = M.cumulative_cm(windows[0].unionByName(windows[1])).toPandas()
    want = duckdb.sql("""select chrom, window_start, coalesce(sum(rate) over (partition by chrom order by window_start
        rows between unbounded preceding and 1 preceding), 0.0) as cm_start from got""").df()
    both = got.merge(want, on=["chrom", "window_start"])
    assert len(both) == 10000 and (both.cm_start_x == both.cm_start_y).all()


def test_sparse_sites_need_no_stitching(spark):
    """Blocks as wide as the sites are sparse, and short runs inside a block, leave the scan with few pieces and the same runs."""
    pos = F.col("id") * 400_000 + F.pmod(F.col("id"), F.lit(7)) * 150_000
    hom = lambda n: F.pmod(F.col("id") * F.col("id") + F.col("id"), F.lit(n)) != 0
    sites = spark.range(3000).select(F.lit(1).alias("fam"), F.lit(21).alias("chrom"), pos.alias("pos"), hom(7).alias("h0"), hom(11).alias("h1"), F.lit(900_000_000).alias("width"))
    cols = ["member", "gap", "start_pos", "end_pos", "n_markers", "len_bp"]
    runs = lambda **more: site_runs(sites, ["fam", "chrom"], ["h0", "h1"], gaps=(0, 1, 2), **more)
    want = sorted(tuple(r) for r in runs().filter("len_bp > 1500000").select(*cols).collect())
    got = sorted(tuple(r) for r in runs(block=F.col("width"), over=1_500_000).select(*cols).collect())
    assert got == want and len(got) > 100
    view = Views(spark, "/root/testdata/sf0.001")
    assert {r.fam for r in view.widths.collect()} == {r.fam for r in view.family_markers.collect()}
    assert [r.n for r in view.family_calls.groupBy("fam", "chrom").agg(F.countDistinct(F.floor(F.col("pos") / F.col("width"))).alias("n")).collect()] == [1] * view.family_axes.count()
    key = ["sample", "chrom", "gap", "start_pos", "end_pos", "n_markers"]
    kept = view.runs((0, 1, 2)).filter("len_bp > 5000")
    assert sorted(map(tuple, view.null((0, 1, 2)).segments.select(*key).collect())) == sorted(map(tuple, kept.select(*key).collect()))


def test_a_site_is_not_multiplied_by_its_members(spark):
    """A line item's site is one row throughout, so no hash table holds every site; also where the panel lacks members."""
    for sampled in (F.lit(True), F.pmod("sample", F.lit(5)) != 2):
        view = Views(spark, "/root/testdata/sf0.001")
        view.panel = view.panel.filter(sampled)
        calls = view.family_calls
        assert not [line for line in plan(calls).splitlines() if "Aggregate" in line and re.search(r"keys=\[[^\]]*(pos|idx)", line)]
        seat = [F.max(F.when(F.pmod("sample", F.lit(4)) == i, F.col("a0") == F.col("a1"))).alias(f"h{i}") for i in range(4)]
        want = view.genotypes.groupBy(F.floor(F.col("sample") / 4).alias("fam"), "chrom", "pos").agg(*seat)
        key = ["fam", "chrom", "pos", "h0", "h1", "h2", "h3"]
        got = sorted(map(str, calls.select(*key).distinct().collect()))
        assert got == sorted(map(str, want.select(*key).collect())) and len(got) > 500
        assert calls.count() > len(got)


def test_repeated_sites_count_once(spark):
    """Copies of a site, next to each other or at a block's edge, leave the runs as they are."""
    pos = F.col("id") * 400_000 + F.pmod(F.col("id"), F.lit(7)) * 150_000
    hom = lambda n: F.when(F.pmod("id", F.lit(13)) != 5, F.pmod(F.col("id") * F.col("id") + F.col("id"), F.lit(n)) != 0)
    sites = spark.range(900).select(F.lit(1).alias("fam"), F.lit(21).alias("chrom"), pos.alias("pos"), hom(7).alias("h0"), hom(11).alias("h1"))
    copies = sites.withColumn("c", F.explode(F.sequence(F.lit(0), F.pmod(F.floor(F.col("pos") / 50_000), F.lit(4)).cast("int")))).drop("c")
    cols = ["member", "gap", "start_pos", "end_pos", "n_markers", "len_bp"]
    runs = lambda df, **more: sorted(map(tuple, site_runs(df, ["fam", "chrom"], ["h0", "h1"], gaps=(0, 1, 2), block=2_000_000, **more).select(*cols).collect()))
    want = runs(sites)
    assert runs(copies.repartition(5), repeated=True) == want and runs(sites, repeated=True) == want and copies.count() > 1500


def test_a_screened_curve_stitches_its_runs_once(spark):
    """Burden and curve start from the same cells of a sample; what lies below the grid makes no curve."""
    df = PB.background_curves(Views(spark, "/root/testdata/sf0.001").null())
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") <= 2
    rows = [(0, 1, 1, 250_000), (0, 1, 1, 90_000), (0, 1, 2, 400_000), (0, 2, 1, 1_200_000), (1, 3, 1, 40_000), (2, 4, 1, 99_999), (2, 4, 1, 100_000)]
    runs = spark.createDataFrame(rows, "pop long, sample long, gap int, len_bp long").repartition(3, "len_bp")
    span = spark.createDataFrame([(0, 1, 10_000_000), (0, 2, 50_000_000), (1, 3, 8_000_000), (2, 4, 1_000_000), (2, 5, 1_000_000)], "pop long, sample long, span_bp long")
    null = PB.null_of_runs(runs, span, (1, 2))
    assert {r.sample: r.roh_bp for r in null.burden.collect()} == {1: 0, 2: 1_200_000, 3: 0, 4: 0, 5: 0}
    got = {(r.pop, r.l_bp): (r.excess_bp, r.exposure_bp) for r in PB.background_curves(null).collect()}
    want = {0: ([250_000, 400_000], 10_000_000), 2: ([100_000], 2_000_000)}
    lengths = [100_000 + 50_000 * i for i in range(239)]
    assert got == {(p, x): (sum(max(0, n - x) for n in ns), e) for p, (ns, e) in want.items() for x in lengths}


def test_local_rates_of_intervals_are_shuffled(spark):
    """One row an interval meets its interval again: as many as there are, so never broadcast for the files beneath being small."""
    intervals = spark.range(300).select("id", F.lit(21).alias("chrom"), (F.col("id") * 900_000).alias("start"), (F.col("id") * 900_000 + 2_500_000).alias("end"))
    rates = spark.range(400).select(F.lit(21).alias("chrom"), (F.col("id") * 1_000_000).alias("window_start"), F.pmod("id", F.lit(4)).cast("double").alias("rate"))
    located = S.interval_rates(intervals, rates, "id")
    assert re.search(r"SortMergeJoin \[id#\d+L?\], \[id#\d+L?\], LeftOuter", plan(located))
    assert not re.search(r"BuildLeft", plan(located).split("SortMergeJoin")[1])
    got = {r.id: (r.rate, r.known) for r in located.collect()}
    assert len(got) == 300 and got[0] == (1.5, True) and got[41] == (2.0, True)


def test_a_cohort_is_not_sent_whole_per_part(spark):
    """Units are estimated before they are repeated for each part, so a join with them must never be left to the estimate."""
    rows = spark.range(200).select(F.pmod("id", F.lit(8)).alias("sample"), F.lit(21).alias("chrom"), F.col("id").alias("pos"), F.lit(0).alias("a0"), F.lit(1).alias("a1"))
    trios = spark.createDataFrame([(3, 3, 2, 1), (7, 7, 6, 5)], "trio long, child long, father long, mother long")
    assert "Broadcast" not in plan(T.align_trios(rows, trios))


def test_trios_of_sites_equal_those_of_rows(spark):
    """Also where the panel lacks parents; a site listed by several line items counts once and is dealt by its marker only."""
    for lacks in (None, 1, 2):
        view = Views(spark, "/root/testdata/sf0.001")
        if lacks is not None:
            view.panel = view.panel.filter(F.pmod("sample", F.lit(8)) != lacks)
        want = T.align_trios(view.genotypes, view.trios)
        assert view.trio.schema == want.schema
        got = sorted(map(str, view.trio.collect()))
        assert got == sorted(map(str, want.collect())) and len(got) == 400
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(view.family_alleles))
        assert keys and all(re.match(r"idx#", k) for k in keys), keys


def test_runs_inside_a_block_are_not_shuffled_again(spark):
    """Only pieces at an edge are stitched; both scans read one shuffle of the sites."""
    pos = F.col("id") * 200_000 + F.pmod(F.col("id"), F.lit(7)) * 70_000
    hom = lambda n: F.when(F.pmod("id", F.lit(13)) != 5, F.pmod(F.col("id") * F.col("id") + F.col("id"), F.lit(n)) != 0)
    sites = spark.range(3000).select(F.pmod("id", F.lit(2)).alias("fam"), F.lit(21).alias("chrom"), pos.alias("pos"), hom(7).alias("h0"), hom(11).alias("h1"))
    cols = ["fam", "member", "gap", "start_pos", "end_pos", "n_markers", "len_bp"]
    for block in (2_000_000, 40_000_000):
        for over in (None, 600_000):
            runs = [site_runs(sites, ["fam", "chrom"], ["h0", "h1"], gaps=(0, 1, 2), block=block, over=over, apart=a) for a in (False, True)]
            got = [sorted(map(tuple, r.select(*cols).collect())) for r in runs]
            assert got[0] == got[1] and len(got[0]) > 100
    view = Views(spark, "/root/testdata/sf0.001").runs((0, 1, 2))
    view.collect()
    final = plan(view).split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 3 and "ReusedExchange" in final


def test_platforms_share_one_scan_of_the_sites(spark):
    """A site travels once for all platforms and members, and gives the runs that each platform's own calls would."""
    view = Views(spark, "/root/testdata/sf0.001")
    view.panel = view.panel.filter(F.pmod("sample", F.lit(8)) != 2)
    names = ["full", "every_2", "every_5"]
    sel = PB.platform_selections(view.common, (2, 5)).filter("not (platform = 'every_5' and pop = 3)")
    got, want = view.platform_null(sel, names), PB.platform_sensitivity(view.calls, sel, view.spans)
    key = ["platform", "pop", "sample", "chrom", "start_pos", "end_pos", "n_markers", "len_bp"]
    rows = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    segments = rows(got.segments, key)
    assert segments == rows(want.segments, key) and {r[0] for r in segments} == set(names)
    assert rows(got.burden, want.burden.columns) == rows(want.burden, want.burden.columns)
    scans = [line for line in plan(got.segments).splitlines() if "REPARTITION_BY_COL" in line and "_blk" in line]
    assert len([line for line in scans if "fam" in line]) == 1 and not [line for line in scans if "platform" in line or "sample" in line]
