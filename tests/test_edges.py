"""Rows that are easily lost or misread: absent calls, unknown names, unmapped places, double records."""

import uuid

import pytest
from pyspark.sql import functions as F

from checks.views import Views
from zygospan.config import Settings
from zygospan.operators import diversity as D
from zygospan.operators import maps as M
from zygospan.operators import scoring as S
from zygospan.operators import trio as T
from zygospan.operators.runs import focal_runs
from zygospan.plans import atlas as PA
from zygospan.plans import background as PB
from zygospan.plans import cohort
from zygospan.plans import trio as PT
from zygospan.sources import sinks, variants


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_member_is_typed_at_every_family_marker(spark, sf):
    v = Views(spark, f"/root/testdata/{sf}")
    sizes = v.panel.groupBy(F.floor(F.col("sample") / 4).alias("fam")).agg(F.count("*").alias("n"))
    expected = v.family_markers.join(sizes, "fam").agg(F.sum("n")).head()[0]
    assert v.genotypes.count() == expected > 0
    assert v.genotypes.filter("a0 is null or a1 is null").isEmpty()
    assert v.family_markers.count() <= v.table("lineitem").count()


def test_absent_rows_differ_from_the_first_allele(spark):
    thinned = spark.createDataFrame([("P", 1, 10, 7, 0), ("P", 1, 20, 7, 1)], "pop string, chrom int, pos long, blk long, slot long")
    haps = spark.createDataFrame(
        [("P", 1, 10, "A", 1), ("P", 1, 20, "A", 0), ("P", 1, 10, "B", 1), ("P", 1, 10, "C", 1), ("P", 1, 20, "C", None), ("P", 1, 10, "D", 1), ("P", 1, 20, "D", 0), ("P", 1, 10, "E", 1), ("P", 1, 20, "E", 2)],
        "pop string, chrom int, pos long, sample string, allele int")
    codes = {r.sample: r.code for r in D.haplotype_codes(thinned, haps, ["pop", "chrom", "blk"], ["sample"]).collect()}
    assert codes["A"] == codes["D"] and codes["B"] == codes["C"] and len({codes[s] for s in "ABE"}) == 3


def test_codes_hold_31_markers_and_no_more(spark):
    thinned = spark.createDataFrame([("P", i, i) for i in range(31)], "pop string, pos long, slot long")
    haps = spark.createDataFrame([("P", i, s, int(i == at)) for s, at in (("A", 30), ("B", 29)) for i in range(31)], "pop string, pos long, sample string, allele int")
    codes = [r.code for r in D.haplotype_codes(thinned, haps, ["pop"], ["sample"], Settings(block_max_markers=31)).collect()]
    assert len(set(codes)) == 2 and all(c > 0 for c in codes)
    with pytest.raises(ValueError, match="31"):
        D.haplotype_codes(thinned, haps, ["pop"], ["sample"], Settings(block_max_markers=32))


def test_unknown_population_keeps_its_row(spark):
    curve = spark.createDataFrame([("P", 100_000 + 50_000 * i, float(i)) for i in range(239)], "pop string, l_bp long, log10_bf double")
    rows = spark.createDataFrame([("a", "P", 1.0), ("b", "Q", 1.0), ("c", "P", 99.0)], "id string, pop string, x double")
    got = {r.id: (r.log10_bf, r.known_population) for r in S.interpolate_curve(rows, curve, F.col("x")).collect()}
    assert got["a"] == (pytest.approx(18.0), True) and got["b"] == (None, False) and got["c"] == (pytest.approx(238.0), True)


def test_unmapped_chromosome_keeps_its_rows(spark):
    cum = spark.createDataFrame([(1, 0, 2.0, 0.0), (1, 1_000_000, 1.0, 2.0)], "chrom int, window_start long, rate double, cm_start double")
    rows = spark.createDataFrame([(1, 500_000), (1, 9_000_000), (2, 5)], "chrom int, pos long")
    assert sorted((r.chrom, r.pos, r.cm) for r in M.add_cm(rows, cum).collect()) == [(1, 500_000, 1.0), (1, 9_000_000, 3.0), (2, 5, 0.0)]


def test_the_last_record_of_a_site_counts(spark):
    schema = "chrom int, pos long, ref string, alt string, a0 int, a1 int, line long"
    left = spark.createDataFrame([(1, 5, "A", "G", 1, 0, 1), (1, 5, "A", "G", 0, 1, 2), (1, 6, "A", "G", 0, 1, 4), (1, 6, "A", "G", 1, 0, 3)], schema)
    got = {r.pos: (r._l.a0, r._l.a1) for r in T.shared_calls(left, left.filter("line in (2, 4)")).select("pos", "_l").collect()}
    assert got == {5: (0, 1), 6: (0, 1)}
    with pytest.raises(ValueError, match="line"):
        T.shared_calls(left.drop("line"), left)


def test_samples_without_calls_stay_in_the_platform(spark):
    calls = spark.createDataFrame([("P", s, 1, p * 100_000, True) for s in ("a", "b") for p in range(30) if s == "a" or p % 2], "pop string, sample string, chrom int, pos long, hom boolean")
    picked = spark.createDataFrame([("even", "P", 1, p * 100_000) for p in range(0, 30, 2)], "platform string, pop string, chrom int, pos long")
    from zygospan.operators.background import spans
    null = PB.platform_sensitivity(calls, picked, spans(calls, PB.SAMPLE))
    assert sorted((r.platform, r.sample, r.roh_bp > 0) for r in null.burden.collect()) == [("even", "a", True), ("even", "b", False)]


def test_focal_reach_is_off_and_flags_its_cut(spark):
    rows = [(1, 50_000_000, p * 500_000, True) for p in range(200)] + [(2, 50_000_000, p * 500_000, p % 100 > 90 or p % 100 < 10 or p == 100) for p in range(200)]
    df = spark.createDataFrame(rows, "t int, focal long, pos long, hom boolean")
    free = {r.t: r.len_bp for r in focal_runs(df, "t", "focal").collect()}
    assert free[1] == 99_500_000
    near = {r.t: (r.len_bp, r.cut) for r in focal_runs(df, "t", "focal", reach=8_000_000).collect()}
    assert near[1] == (16_000_000, True) and near[2] == (free[2], False)


def test_allele_order_is_measured_per_trio(spark):
    trio = Views(spark, "/root/testdata/sf0.01").trio
    swapped = trio.withColumns({"c0": F.col("c1"), "c1": F.col("c0")})
    rows = lambda df: sorted(map(tuple, PT.run_based_crossovers(df, 20).select("trio", "parent", "chrom", "prev_pos", "new_pos").collect()))
    assert rows(trio) == rows(swapped) != []


LINES = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{names}", "1\t10\t.\tA\tG\t.\t.\t.\tGT\t0|1\t1|1", "2\t{pos}\t.\tA\tC\t.\t.\t.\tGT\t0|0\t1|0"]


def write(spark, *files):
    path = f"{sinks.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    for i, names in enumerate(files):
        text = "\n".join(LINES).format(names="\t".join(names), pos=20 + i)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{i}")
    return [f"{path}/{i}" for i in range(len(files))]


def test_cohort_ingest_and_subset(spark):
    out = f"{sinks.shared_dir(spark)}/cohort-{uuid.uuid4().hex}"
    cohort.ingest(spark, write(spark, ["HG1", "NA2"], ["HG1", "NA2"]), out)
    got = spark.read.parquet(out)
    assert sorted((r.pos, r.sample, r.a0, r.a1) for r in got.collect()) == [
        (10, "HG1", 0, 1), (10, "HG1", 0, 1), (10, "NA2", 1, 1), (10, "NA2", 1, 1), (20, "HG1", 0, 0), (20, "NA2", 1, 0), (21, "HG1", 0, 0), (21, "NA2", 1, 0)]
    cohort.subset(got, "NA", 0.05, f"{out}-na")
    assert {(r.pos, r.sample) for r in spark.read.parquet(f"{out}-na").collect()} == {(20, "NA2"), (21, "NA2")}


def test_files_with_other_samples_are_refused(spark):
    with pytest.raises(ValueError, match="differ"):
        variants.read_variants(spark, write(spark, ["HG1", "NA2"], ["NA2", "HG1"]))


def test_records_keep_their_place_in_the_file(spark):
    table, names = variants.read_variants(spark, write(spark, ["HG1", "NA2"]))
    assert [r.pos for r in table.orderBy("line").collect()] == [10, 20] and "line" in variants.call_set(table, names, "NA2", "1").columns


def test_building_a_plan_starts_no_job(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    tables = {t: v.table(t) for t in ("part", "supplier", "lineitem")}  # reading a file's schema is a job
    v.table = tables.__getitem__
    spark.sparkContext.setJobGroup("plans", "building only")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("plans"))
        PA.hbar_atlas(v.common, v.haplotypes, v.combined_map, 0.0625)
        PB.background_summary(v.null())
        PT.roh_report(v.trio, v.hbar_windows(), 0.0625)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("plans")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_shared_folder_may_be_given(spark):
    assert sinks.shared_dir(spark, "/some/where/") == "/some/where"
