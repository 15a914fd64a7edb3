"""Sources, sinks, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import POPS, sql

from zygospan.functions import genotype as G

from zygospan.operators import enrich as N
from zygospan.operators import trio as T

from zygospan.sources import sinks, tables, variants
from zygospan.operators.runs import call_runs, keep_segments


def _gt_rows(v):
    """Genotype text ``a|b`` per sample with its site record."""
    return v.genotypes.select("sample", "chrom", "pos", F.concat_ws("|", "a0", "a1").alias("gt")).join(
        v.sites.drop("af_milli", "idx"), ["chrom", "pos"]
    )


def _named(v):
    return _gt_rows(v).withColumn("sample", F.concat(F.lit("S"), F.lpad(F.col("sample").cast("string"), 9, "0")))


def _site_lines(v):
    """Variant lines without genotypes, two lead-in comments included."""
    s = v.sites
    body = s.select(F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), "pos", "id", "ref", "alt", F.lit("."), F.lit("PASS"), "info").alias("value"))
    return body.unionByName(s.filter(F.pmod("idx", F.lit(50)) == 0).select(F.concat(F.lit("##note="), "id").alias("value")))


@check("a01_variant_load", sql("""
select 'chr' || s.chrom as chrom, count(*) as n, count(distinct s.pos) as n_pos, cast(sum(s.pos) as bigint) as sum_pos,
 count(case when s.alt = 'G' then 1 end) as n_g from sites s group by s.chrom""", "sites"))
def _(v):
    return variants.parse_variants(_site_lines(v)).groupBy("chrom").agg(
        F.count("*").alias("n"), F.countDistinct("pos").alias("n_pos"), F.sum("pos").alias("sum_pos"),
        F.count_if(F.col("alt") == "G").alias("n_g"),
    )


@check("a01_genotypes_long", sql("""
select 'S' || lpad(cast(g.sample as varchar), 9, '0') as sample, count(*) as n, cast(sum(g.a0) as bigint) as sum_a0, cast(sum(g.a1) as bigint) as sum_a1,
 cast(sum(g.pos * (g.a0 + 2*g.a1)) as bigint) as checksum
from genotypes g join sites s on s.idx = g.idx where length(s.alt) = 1 group by g.sample""", "genotypes", "sites"))
def _(v):
    """Every family is a cohort file of its own: one line per site with four calls."""
    rows = _gt_rows(v).withColumn("fam", F.floor(F.col("sample") / 4)).withColumn("slot", F.pmod("sample", F.lit(4)))
    cell = lambda k: F.coalesce(F.max(F.when(F.col("slot") == k, F.col("gt"))), F.lit("."))
    wide = rows.groupBy("fam", "chrom", "pos", "ref", "alt").agg(F.concat_ws("\t", *[cell(k) for k in range(4)]).alias("gts"))
    long = variants.genotypes_long(variants.snvs(wide.withColumn("chrom", F.concat_ws(":", "fam", "chrom"))), ["0", "1", "2", "3"])
    sample = F.split("chrom", ":")[0].cast("long") * 4 + F.col("sample").cast("int")
    return long.filter(F.col("a0").isNotNull()).groupBy(F.concat(F.lit("S"), F.lpad(sample.cast("string"), 9, "0")).alias("sample")).agg(
        F.count("*").alias("n"), F.sum("a0").alias("sum_a0"), F.sum("a1").alias("sum_a1"),
        F.sum(F.col("pos") * (F.col("a0") + 2 * F.col("a1"))).alias("checksum"),
    )


@check("a01_columns_per_file", sql("""
select g.sample, count(*) as n, cast(sum(g.a0) as bigint) as sum_a0, cast(sum(g.pos * (g.a0 + 2*g.a1)) as bigint) as checksum
from genotypes g join sites s on s.idx = g.idx where length(s.alt) = 1 group by g.sample""", "genotypes", "sites"))
def _(v):
    """A text file for every family and chromosome; its four columns start at another member in each family."""
    import uuid

    path = f"{sinks.shared_dir(v.spark)}/cohort-{uuid.uuid4().hex}"
    rows = _gt_rows(v).withColumn("fam", F.floor(F.col("sample") / 4)).withColumn("slot", F.pmod(F.col("sample") + F.col("fam"), F.lit(4)))
    cell = lambda k: F.coalesce(F.max(F.when(F.col("slot") == k, F.col("gt"))), F.lit("."))
    wide = rows.groupBy("fam", "chrom", "pos", "ref", "alt", "id").agg(F.concat_ws("\t", *[cell(k) for k in range(4)]).alias("gts"))
    member = lambda k: (F.col("fam") * 4 + F.pmod(F.lit(k) - F.col("fam"), F.lit(4))).cast("string")
    fixed = F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT")
    heads = wide.select("fam", "chrom").distinct().select("fam", "chrom", F.concat_ws("\t", fixed, *[member(k) for k in range(4)]).alias("value"))
    lines = wide.select("fam", "chrom", F.concat_ws("\t", "chrom", "pos", "id", "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "gts").alias("value"))
    heads.unionByName(lines).repartition("fam", "chrom").write.partitionBy("fam", "chrom").text(path)
    long = variants.genotypes_by_name(variants.snvs(variants.with_file_samples(variants.read_lines(v.spark, path))))
    return long.filter(F.col("a0").isNotNull()).groupBy(F.col("sample").cast("long").alias("sample")).agg(
        F.count("*").alias("n"), F.sum("a0").alias("sum_a0"), F.sum(F.col("pos") * (F.col("a0") + 2 * F.col("a1"))).alias("checksum")
    )


@check("a02_trio_extract", sql("""
select t.trio, t.chrom, count(*) as n, cast(sum(t.f0 + 2*t.f1 + 4*t.m0 + 8*t.m1 + 16*t.c0 + 32*t.c1) as bigint) as code, cast(sum(t.pos) as bigint) as sum_pos
from trio t join sites s on s.chrom = t.chrom and s.pos = t.pos
where length(s.alt) = 1 group by t.trio, t.chrom""", "trio", "sites"))
def _(v):
    rows = _gt_rows(v).withColumn("fam", F.floor(F.col("sample") / 4)).withColumn("slot", F.pmod("sample", F.lit(4)))
    cell = lambda k: F.coalesce(F.max(F.when(F.col("slot") == k, F.col("gt"))), F.lit("."))
    wide = rows.groupBy("fam", "chrom", "pos", "ref", "alt", "id").agg(F.concat_ws("\t", *[cell(k) for k in range(4)]).alias("gts"))
    wide = wide.withColumn("chrom", F.concat_ws(":", "fam", "chrom"))
    trio = variants.trio_from_text(wide, ["0", "1", "2", "3"], father="2", mother="1", child="3")
    part = F.split("chrom", ":")
    code = F.col("f0") + 2 * F.col("f1") + 4 * F.col("m0") + 8 * F.col("m1") + 16 * F.col("c0") + 32 * F.col("c1")
    return trio.groupBy((part[0].cast("long") * 4 + 3).alias("trio"), part[1].cast("int").alias("chrom")).agg(
        F.count("*").alias("n"), F.sum(code).alias("code"), F.sum("pos").alias("sum_pos")
    )


@check("a03_panel_select", sql("select cast(sample as varchar) as sample, case pop when 0 then 'EUR' when 3 then 'SAS' end as pop from panel where pop in (0, 3)", "panel"))
def _(v):
    name = F.element_at(F.array(*map(F.lit, POPS)), F.col("pop").cast("int") + 1)
    panel = v.panel.select(F.col("sample").cast("string").alias("sample"), F.concat(F.lit("sub"), F.pmod("sample", F.lit(26))).alias("pop"), name.alias("superpop"))
    return tables.select_panel(panel, ["EUR", "SAS"])


@check("a03_subpopulations", sql("select cast(sample as varchar) as sample, 'sub' || (sample % 26) as pop from panel where pop = 3", "panel"))
def _(v):
    name = F.element_at(F.array(*map(F.lit, POPS)), F.col("pop").cast("int") + 1)
    panel = v.panel.select(F.col("sample").cast("string").alias("sample"), F.concat(F.lit("sub"), F.pmod("sample", F.lit(26))).alias("pop"), name.alias("superpop"))
    return tables.subpopulations(panel, "SAS")


def _pedigree_lines(v):
    return v.panel.select(F.concat_ws("  ", "sample", F.coalesce("father", F.lit(0)), F.coalesce("mother", F.lit(0))).alias("value"))


@check("a04_pedigree_children", sql("select cast(sample as varchar) as sample, cast(father as varchar) as father, cast(mother as varchar) as mother from panel where father > 0 and mother > 0", "panel"))
def _(v):
    return tables.children(tables.parse_pedigree(_pedigree_lines(v)))


@check("a05_recombination_map_load", sql("select cast(chrom as varchar) as chrom, center, pat as rate from recmap", "recmap"))
def _(v):
    good = v.recmap.select(F.col("chrom").cast("string").alias("chrom"), F.col("center").cast("string").alias("pos"), F.lit("-").alias("extra"), F.col("pat").cast("string").alias("rate"))
    bad = v.recmap.select(F.lit("Chr").alias("chrom"), F.lit("pos").alias("pos"), F.lit("-").alias("extra"), F.lit("cM").alias("rate"))
    worse = v.recmap.select(F.col("chrom").cast("string").alias("chrom"), F.lit("na").alias("pos"), F.lit("-").alias("extra"), F.lit("1").alias("rate"))
    return tables.parse_recmap(good.unionByName(bad).unionByName(worse))


def _stats_text(v):
    pop = F.explode(F.array(*map(F.lit, POPS)))
    return v.hbar_windows().withColumn("population", pop).select(
        F.col("chrom").cast("string").alias("chrom"), F.col("window_start").cast("string").alias("window_start"), "population",
        F.col("hbar").cast("string").alias("Hbar"), F.lit("3").alias("n_blocks"), F.lit("2.0").alias("mean_distinct_hap"),
        F.lit("200").alias("mean_n_hap"), F.col("rate").cast("string").alias("cMperMb"),
    )


@check("a06_window_lookup_load", sql("select cast(chrom as varchar) as chrom, window_start, p.pop, hbar, rate from hwin cross join (select unnest(['s1', 's2', 's3']) as pop) p", "hwin"))
def _(v):
    stats = tables.parse_window_stats(_stats_text(v))
    return tables.replicate_population(stats, "SAS", ["s1", "s2", "s3"]).select("chrom", "window_start", "pop", "hbar", "rate")


@check("a07_rates_deduplicated", sql("select cast(chrom as varchar) as chrom, window_start, rate from rates where rate > 0", "rates"))
def _(v):
    return tables.dedupe_rates(tables.parse_window_stats(_stats_text(v)), positive=True)


@check("a08_curve_load", sql("""
select case pop when 0 then 'EUR' when 1 then 'AFR' when 2 then 'EAS' when 3 then 'SAS' else 'AMR' end as pop, l_bp, round(p_bg, 6) as p_bg
from curve where pop <> 4""", "curve"))
def _(v):
    curve = v.curve()
    wide = sinks.wide_by(curve, ["l_bp"], "pop", [0, 1, 2, 3, 4], "p_bg")
    text = wide.select(
        (F.col("l_bp") / 1e6).cast("string").alias("L_Mb"),
        *[F.col(str(i)).cast("string").alias(f"{p}_bg") for i, p in enumerate(POPS[:4])], F.lit("nan").alias("AMR_bg"),
    )
    return tables.curve_long(text, POPS, "_bg", value="p_bg").select("pop", "l_bp", F.round("p_bg", 6).alias("p_bg"))


@check("a09_interval_load", sql("select 'chr' || chrom as chrom, start_pos as \"start\", end_pos as \"end\" from segs", "segs"))
def _(v):
    good = F.concat(F.lit("chr"), "chrom", F.lit("\t"), F.format_number("start_pos", 0), F.lit("   "), F.format_number("end_pos", 0), F.lit(" x"))
    bad = [F.concat(F.lit("# chr1 1 "), "end_pos"), F.concat(F.lit("chrom start "), "end_pos")]
    return tables.parse_intervals(v.null().segments.select(F.explode(F.array(good, *bad)).alias("value")))


@check("a09_region_string", sql("select 'chr' || chrom as chrom, start_pos as \"start\", end_pos as \"end\" from segs", "segs"))
def _(v):
    text = F.format_string("chr%d:%d-%d", "chrom", "start_pos", "end_pos")
    c, a, b = tables.parse_region(F.col("t"))
    return v.null().segments.select(text.alias("t")).select(c.alias("chrom"), a.alias("start"), b.alias("end"))


@check("a10_manifest_load", sql("select 'A1' as array, chrom, pos from markers", "markers"))
def _(v):
    m = v.markers.select(F.col("chrom").cast("string").alias("chrom"), F.col("pos").cast("string").alias("pos"))
    junk = m.select(F.lit("X").alias("chrom"), "pos").unionByName(m.select("chrom", F.lit("?").alias("pos")))
    return tables.parse_manifest(m.unionByName(m).unionByName(junk), "A1")


def _supplement(v):
    """Orders as cases: the family is printed only on the first row of its block."""
    li = v.table("lineitem")
    return li.select(
        F.pmod("l_orderkey", F.lit(7)).alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"), "l_orderkey",
        "l_linenumber", "l_partkey", "l_quantity",
    ).groupBy("file", "row_no").agg(F.max("l_orderkey").alias("o"), F.max("l_linenumber").alias("ln"), F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q")).withColumn(
        "family", F.when((F.pmod("o", F.lit(4)) == 0) | (F.pmod("row_no", F.lit(11)) == 0), F.concat(F.lit("M"), "o")).otherwise("")
    )


_SUPPLEMENT_SQL = """with raw as (select l_orderkey % 7 as file, l_orderkey*8 + l_linenumber as row_no, max(l_orderkey) as o, max(l_linenumber) as ln,
  max(l_partkey) as p, max(l_quantity) as q from lineitem group by 1, 2),
 f as (select *, last_value(case when o % 4 = 0 or row_no % 11 = 0 then 'M' || o end ignore nulls)
  over (partition by file order by row_no rows between unbounded preceding and current row) as family from raw)"""


@check("a11_supplement_intervals", _SUPPLEMENT_SQL + " select family, cast(1 + p % 22 as int) as chrom, q as len_mb from f")
def _(v):
    raw = _supplement(v).withColumn("chrom", (1 + F.pmod("p", F.lit(22))).cast("string")).withColumn("len_mb", F.col("q").cast("string"))
    return tables.supplement_intervals(raw)


@check("a11_supplement_mutations", _SUPPLEMENT_SQL + " select family, cast(1 + p % 22 as int) as chrom, p*1000 as pos, 'G' || p as gene from f where p % 13 <> 0")
def _(v):
    chrom = F.when(F.pmod("p", F.lit(13)) == 0, "X").otherwise((1 + F.pmod("p", F.lit(22))).cast("string"))
    raw = _supplement(v).withColumn("mutation", F.concat(F.lit("chr"), chrom, F.lit(":"), F.format_number(F.col("p") * 1000, 0), F.lit("A>G")))
    return tables.supplement_mutations(raw.withColumn("protein", F.concat(F.lit("G"), "p", F.lit(": p.R1X"))))


def loci(v):
    """Parts as case loci with a nullable length."""
    k = F.col("idx")
    return v.markers.select(
        F.element_at(F.array(F.lit("cohortA"), F.lit("cohortB"), F.lit("cohortC")), (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("source"),
        k.alias("case_id"), "chrom", F.col("pos").alias("midpoint"),
        F.when(F.pmod(k, F.lit(5)) != 0, (F.pmod(k * 7, F.lit(120)) + 5) / F.lit(10.0)).alias("roh_mb"),
        F.element_at(F.array(F.lit("outbred"), F.lit("founder"), F.lit("consanguineous"), F.lit("isolate")), (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("case_class"),
    )


LOCI_SQL = """loci as (select case idx % 3 when 0 then 'cohortA' when 1 then 'cohortB' else 'cohortC' end as source, idx as case_id, chrom, pos as midpoint,
 case when idx % 5 <> 0 then ((idx*7) % 120 + 5) / 10.0 end as roh_mb,
 case idx % 4 when 0 then 'outbred' when 1 then 'founder' when 2 then 'consanguineous' else 'isolate' end as case_class from markers)"""


@check("a12_case_table", sql(f"with {LOCI_SQL} select source, case_class, count(*) as n, count(roh_mb) as n_known, cast(sum(midpoint) as bigint) as sum_mid from loci group by source, case_class", "markers"))
def _(v):
    return loci(v).groupBy("source", "case_class").agg(F.count("*").alias("n"), F.count("roh_mb").alias("n_known"), F.sum("midpoint").alias("sum_mid"))


@check("a13_second_call_set", sql("""
select g.chrom, g.pos, s.ref, s.alt, g.a0, g.a1 from genotypes g join sites s on s.idx = g.idx
where g.sample = 0 and g.chrom = 22 and length(s.alt) = 1 and s.idx % 9 <> 2""", "genotypes", "sites"))
def _(v):
    gt = F.when(F.pmod("idx", F.lit(9)) == 2, F.concat_ws("/", "a0", "a1")).otherwise(F.concat_ws("|", "a0", "a1"))
    one = v.genotypes.filter(F.col("sample") == 0).withColumn("gts", F.concat(gt, F.lit(":35")))
    table = one.join(v.sites.select("chrom", "pos", "ref", "alt"), ["chrom", "pos"])
    return variants.call_set(table, ["0"], "0", 22)


_SUBSET = """with f as (select g.chrom, g.pos, s.ref, s.alt, cast(sum(g.a0 + g.a1) as bigint) as ac, 2 * count(*) as an from genotypes g join sites s on s.idx = g.idx
 where g.sample % 10 < 4 and length(s.alt) = 1 and s.alt <> '{drop}' group by 1, 2, 3, 4)
 select chrom, pos, ref, alt, ac, an, round(ac / an, 6) as af from f where least(ac / an, 1 - ac / an) >= 0.05"""


@check("a14_cohort_subset", sql(_SUBSET.format(drop="none"), "genotypes", "sites"))
def _(v):
    rows = _gt_rows(v).withColumn("sample", F.concat(F.when(F.pmod("sample", F.lit(10)) < 4, "HG").otherwise("XX"), "sample"))
    out = variants.cohort_subset(rows, F.col("sample").startswith("HG"), 0.05)
    return out.select("chrom", "pos", "ref", "alt", "ac", "an", F.round("af", 6).alias("af")).distinct()


@check("a14_cohort_subset_relaxed", sql(_SUBSET.format(drop="*"), "genotypes", "sites"))
def _(v):
    rows = _gt_rows(v).withColumn("sample", F.concat(F.when(F.pmod("sample", F.lit(10)) < 4, "HG").otherwise("XX"), "sample"))
    out = variants.cohort_subset(rows, F.col("sample").startswith("HG"), 0.05, relaxed=True)
    return out.filter(F.col("gt").contains("/")).select("chrom", "pos", "ref", "alt", "ac", "an", F.round("af", 6).alias("af")).distinct()


@check("a15_wide_curve_sink", sql("""
select l_bp, round(max(case when pop=0 then p_bg end), 6) as "0", round(max(case when pop=1 then p_bg end), 6) as "1", round(max(case when pop=2 then p_bg end), 6) as "2",
 round(max(case when pop=3 then p_bg end), 6) as "3", round(max(case when pop=4 then p_bg end), 6) as "4" from curve group by l_bp""", "curve"))
def _(v):
    wide = sinks.wide_by(v.curve(), ["l_bp"], "pop", [0, 1, 2, 3, 4], "p_bg")
    return wide.select("l_bp", *[F.round(str(i), 6).alias(str(i)) for i in range(5)])


@check("a16_checkpoint_merge", sql("select pop, count(*) as n, cast(sum(len_bp) as bigint) as total_bp from segs group by pop", "segs"))
def _(v):
    """Write segments by chromosome, rewrite one of them, then aggregate the lot."""
    import uuid

    path = f"{sinks.shared_dir(v.spark)}/segments-{uuid.uuid4().hex}"
    segs = v.null().segments
    sinks.write_partitions(segs, path)
    sinks.write_partitions(segs.filter(F.col("chrom") == 22), path)
    return v.spark.read.parquet(path).groupBy("pop").agg(F.count("*").alias("n"), F.sum("len_bp").alias("total_bp"))


@check("a16_resumed_job", sql("select pop, chrom, count(*) as n, cast(sum(len_bp) as bigint) as total_bp from segs group by pop, chrom", "segs"))
def _(v):
    """A job that is cut after its first chromosome, started anew, then only aggregated."""
    import uuid

    path = f"{sinks.shared_dir(v.spark)}/resumed-{uuid.uuid4().hex}"
    runs = lambda calls: keep_segments(call_runs(calls, ["pop", "sample", "chrom"]))
    started = []

    def cut_short(calls):
        started.append(1)
        if len(started) > 1:
            raise InterruptedError("cut")
        return runs(calls)

    try:
        sinks.resume_partitions(v.calls, cut_short, path)
    except InterruptedError:
        sinks.resume_partitions(v.calls, runs, path)
    out = sinks.resume_partitions(v.calls, runs, path, aggregate_only=True)
    return out.groupBy("pop", "chrom").agg(F.count("*").alias("n"), F.sum("len_bp").alias("total_bp"))


# -- filters and predicates ------------------------------------------------------


@check("b01_biallelic_snv", sql("select chrom, pos, alt from sites where length(alt) = 1", "sites"))
def _(v):
    return variants.snvs(v.sites).select("chrom", "pos", "alt")


@check("b01_biallelic_snv_no_star", sql("select chrom, pos, alt from sites where length(alt) = 1 and alt <> '*'", "sites"))
def _(v):
    return variants.snvs(v.sites, drop_star=True).select("chrom", "pos", "alt")


def _messy(v):
    k = F.col("idx") + F.col("sample")
    return v.genotypes.withColumn("gt", F.when(F.pmod(k, F.lit(17)) == 0, ".|.").when(F.pmod(k, F.lit(19)) == 0, F.concat_ws("/", "a0", "a1")).otherwise(F.concat_ws("|", "a0", "a1")))


_MESSY = """messy as (select *, case when (idx + sample) % 17 = 0 then 'missing' when (idx + sample) % 19 = 0 then 'unphased' else 'phased' end as kind from genotypes)"""


@check("b02_genotype_parse", sql(f"with {_MESSY} select sample, count(*) as n, count(case when kind='phased' then 1 end) as n_parsed, cast(sum(case when kind='phased' then a0 + 2*a1 end) as bigint) as code from messy group by sample", "genotypes"))
def _(v):
    gt = F.col("gt")
    rows = _messy(v).select("sample", G.allele(gt, 0).alias("x"), G.allele(gt, 1).alias("y"))
    return rows.groupBy("sample").agg(F.count("*").alias("n"), F.count("x").alias("n_parsed"), F.sum(F.col("x") + 2 * F.col("y")).alias("code"))


@check("b03_complete_phased_trio", sql(f"""with {_MESSY} select trio, count(*) as n from (select m.sample // 4 * 4 + 3 as trio, m.idx from messy m
 where m.kind = 'phased' and m.sample % 4 > 0 group by 1, 2 having count(*) = 3) group by trio""", "genotypes"))
def _(v):
    roles = v.trios.select("trio", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(c).alias("sample")) for r, c in (("c", "child"), ("f", "father"), ("m", "mother"))])).alias("x")).select("trio", "x.r", "x.sample")
    wide = _messy(v).join(roles, "sample").groupBy("trio", "chrom", "pos").agg(*[F.max(F.when(F.col("r") == r, F.col("gt"))).alias(f"gt_{r}") for r in "fmc"])
    ok = wide.filter(G.is_complete_phased(F.col("gt_f"), F.col("gt_m"), F.col("gt_c")))
    return variants.trio_alleles(ok).groupBy("trio").agg(F.count("*").alias("n"))


@check("b04_info_frequency", sql("""
select s.pop, count(*) as n, cast(sum(s.afm) as bigint) as sum_afm from site_freq s where not (s.pop = 4 and s.idx % 29 = 0) group by s.pop""", "site_freq"))
def _(v):
    code = F.array_position(F.array(*map(F.lit, POPS)), F.col("pop")) - 1
    return variants.population_af(v.sites, POPS).groupBy(code.alias("pop")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("af") * 1000).cast("long")).alias("sum_afm"))


@check("b05_common_per_population", sql("select pop, chrom, pos from common where not (pop = 4 and idx % 29 = 0)", "common"))
def _(v):
    code = F.array_position(F.array(*map(F.lit, POPS)), F.col("pop")) - 1
    return variants.common_by_population(v.sites, POPS, 0.05).select(code.alias("pop"), "chrom", "pos")


@check("b06_polymorphic", sql("select pop, count(*) as n from site_freq where afm > 0 and afm < 1000 group by pop", "site_freq"))
def _(v):
    return v.site_freq.filter(G.is_polymorphic(F.col("af"))).groupBy("pop").agg(F.count("*").alias("n"))


@check("b07_heterozygosity", sql("select pop, chrom, pos, round(2*(afm/1000)*(1-afm/1000), 6) as het from site_freq", "site_freq"))
def _(v):
    return v.site_freq.select("pop", "chrom", "pos", F.round(G.heterozygosity(F.col("af")), 6).alias("het"))


@check("b08_subset_frequency", sql(f"""with {_MESSY} select chrom, pos, cast(sum(a0 + a1) as bigint) as ac, 2*count(*) as an from messy where kind <> 'missing' and sample % 3 = 0 group by chrom, pos""", "genotypes"))
def _(v):
    mine = _messy(v).filter(F.pmod("sample", F.lit(3)) == 0)
    return variants.allele_frequency(mine).select("chrom", "pos", "ac", "an")


@check("b09_window_bins", sql("select chrom, pos // 1000000 * 1000000 as w1m, pos // 250000 * 250000 as w250k, count(*) as n from markers group by 1, 2, 3", "markers"))
def _(v):
    return v.markers.groupBy("chrom", G.window_start(F.col("pos"), 1_000_000).alias("w1m"), G.window_start(F.col("pos"), 250_000).alias("w250k")).agg(F.count("*").alias("n"))


@check("b10_homozygous_flag", sql(f"""with {_MESSY} select sample, count(case when kind = 'missing' or a0 = a1 then 1 end) as n_hom_parity, count(case when kind <> 'missing' and a0 = a1 then 1 end) as n_hom,
 count(case when kind <> 'missing' then 1 end) as n_called from messy group by sample""", "genotypes"))
def _(v):
    a, b = (F.substring("gt", i, 1).try_cast("int") for i in (1, 3))
    rows = _messy(v).select("sample", G.is_homozygous(a, b, "hom").alias("p"), G.is_homozygous(a, b).alias("h"))
    return rows.groupBy("sample").agg(F.count_if("p").alias("n_hom_parity"), F.count_if("h").alias("n_hom"), F.count("h").alias("n_called"))


@check("b11_transmission_labels", sql("""
select trio, parent, count(*) as n_informative, count(label) as n_used, count(*) - count(label) as n_inconsistent from labelled group by trio, parent""", "labelled"))
def _(v):
    return T.trace_counts(T.informative_sites(v.trio))


@check("b12_deterministic_sites", sql("select trio, parent, chrom, pos, cast(label as int) as label from labelled where o0 = o1", "labelled"))
def _(v):
    return T.informative_sites(v.trio, deterministic=True).select("trio", "parent", "chrom", "pos", "label")


def two_call_sets(v):
    """Each child's calls, and the same calls rephased in stretches with noise."""
    base = v.genotypes.join(v.trios.select(F.col("trio").alias("sample")), "sample").join(v.sites.select("chrom", "pos", "ref", "alt"), ["chrom", "pos"])
    left = base.select("sample", "chrom", "pos", "ref", "alt", "a0", "a1", F.col("idx").alias("line"))
    flip = (F.pmod(F.col("idx") + F.col("sample"), F.lit(300)) < 60) | (F.pmod(F.col("idx") * 31, F.lit(47)) == 0)
    right = base.filter(F.pmod("idx", F.lit(13)) != 5).select(
        "sample", "chrom", "pos", "ref", F.when(F.pmod("idx", F.lit(53)) == 0, "T").otherwise(F.col("alt")).alias("alt"),
        F.when(flip, F.col("a1")).otherwise(F.col("a0")).alias("a0"), F.when(flip, F.col("a0")).otherwise(F.col("a1")).alias("a1"), F.col("idx").alias("line"),
    )
    return left, right


TWO_SETS = """two as (select g.sample, g.chrom, g.pos, g.a0, g.a1, s.alt, case when g.idx % 53 = 0 then 'T' else s.alt end as alt2,
 case when (g.idx + g.sample) % 300 < 60 or (g.idx*31) % 47 = 0 then g.a1 else g.a0 end as b0 from genotypes g join sites s on s.idx = g.idx
 join panel p on p.sample = g.sample where p.father is not null and g.idx % 13 <> 5),
 agree as (select *, alt = alt2 as same_alleles, alt = alt2 and a0 <> a1 as comparable, case when alt = alt2 and a0 <> a1 then a0 = b0 end as agree from two)"""


@check("b13_phase_agreement", sql(f"with {TWO_SETS} select sample, chrom, pos, same_alleles, comparable, agree from agree", "genotypes", "sites"))
def _(v):
    left, right = two_call_sets(v)
    return T.phase_agreement(T.shared_calls(left, right, ("sample", "chrom", "pos")))


TRACE_SQL = """tw as (select trio, chrom, pos // 250000 * 250000 as window_start,
 count(case when f0 <> f1 and c0 = f0 then 1 end) as pat_hap0, count(case when f0 <> f1 and c0 <> f0 and c0 = f1 then 1 end) as pat_hap1,
 count(case when m0 <> m1 and c1 = m0 then 1 end) as mat_hap0, count(case when m0 <> m1 and c1 <> m0 and c1 = m1 then 1 end) as mat_hap1 from trio group by 1, 2, 3)"""


@check("b14_trace_codes", sql(f"""with {TRACE_SQL} select trio, chrom, window_start,
 case when pat_hap0 > pat_hap1 then '0' when pat_hap1 > pat_hap0 then '1' else '-' end as pat_dominant,
 round(case when pat_hap0 + pat_hap1 > 0 then greatest(pat_hap0, pat_hap1) / (pat_hap0 + pat_hap1) else 0 end, 6) as pat_purity,
 case when mat_hap0 + mat_hap1 < 5 then '.' when greatest(mat_hap0, mat_hap1) / (mat_hap0 + mat_hap1) < 0.8 then 'x' when mat_hap0 > mat_hap1 then '0' else '1' end as mat_code from tw""", "trio"))
def _(v):
    return T.trace_windows(v.trio).select("trio", "chrom", "window_start", "pat_dominant", F.round("pat_purity", 6).alias("pat_purity"), "mat_code")


AGREE_WIN = """aw as (select sample, chrom, pos // 250000 * 250000 as window_start, count(case when agree then 1 end) as n_agree, count(case when not agree then 1 end) as n_disagree
 from agree where comparable group by 1, 2, 3)"""


@check("b15_agreement_codes", sql(f"""with {TWO_SETS}, {AGREE_WIN} select sample, chrom, window_start, case when n_agree + n_disagree < 5 then '.'
 when n_agree / (n_agree + n_disagree) >= 0.95 then 'A' when n_agree / (n_agree + n_disagree) >= 0.8 then 'a' when n_agree / (n_agree + n_disagree) <= 0.05 then 'D'
 when n_agree / (n_agree + n_disagree) <= 0.2 then 'd' else 'x' end as code from aw""", "genotypes", "sites"))
def _(v):
    left, right = two_call_sets(v)
    sites = T.phase_agreement(T.shared_calls(left, right, ("sample", "chrom", "pos")))
    return T.agreement_windows(sites, ("sample", "chrom")).select("sample", "chrom", "window_start", "code")


@check("b16_segment_filters", sql("select pop, count(case when len_bp > 5000 then 1 end) as n_kept, count(case when len_bp >= 1000000 then 1 end) as n_long from runs group by pop", "runs"))
def _(v):
    from zygospan.operators.runs import call_runs

    runs = call_runs(v.calls, ["pop", "sample", "chrom"])
    kept = keep_segments(runs).groupBy("pop").agg(F.count("*").alias("n_kept"))
    return runs.groupBy("pop").agg(F.count_if(F.col("len_bp") >= 1_000_000).alias("n_long")).join(kept, "pop")


@check("b17_case_class_filter", sql(f"with {LOCI_SQL} select case_id, roh_mb from loci where case_class in ('outbred', 'founder') and roh_mb is not null", "markers"))
def _(v):
    return loci(v).filter(F.col("case_class").isin("outbred", "founder") & F.col("roh_mb").isNotNull()).select("case_id", "roh_mb")


@check("b18_length_strata", sql(f"""with {LOCI_SQL}, st as (select * from (values ('ROH <= 3 Mb', -1e9, 3.0), ('ROH <= 5 Mb', -1e9, 5.0), ('ROH 5-10 Mb', 5.0, 10.0), ('ROH > 10 Mb', 10.0, 1e9)) t(stratum, lo, hi))
 select stratum, count(*) as n, round(sum(roh_mb), 6) as total from loci join st on roh_mb > lo and roh_mb <= hi group by stratum""", "markers"))
def _(v):
    return N.with_strata(loci(v)).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.sum("roh_mb"), 6).alias("total"))
