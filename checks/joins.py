"""Joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.registry import check
from checks.scans import LOCI_SQL, loci, two_call_sets
from checks.views import EMISSION, rd, sql
from zygospan.operators import background as B
from zygospan.operators import diversity as D
from zygospan.operators import enrich as N
from zygospan.operators import platform as P
from zygospan.operators import resample as R
from zygospan.operators import asof as A
from zygospan.operators import scoring as S
from zygospan.operators import trio as T
from zygospan.plans import background as PB
from zygospan.sources import tables


@check("c01_sample_panel", sql("select p.pop, count(*) as n, cast(sum(g.a0 + g.a1) as bigint) as alt from genotypes g join panel p on p.sample = g.sample where p.pop in (0, 1, 2) group by p.pop", "genotypes"))
def _(v):
    some = v.panel.filter(F.col("pop").isin(0, 1, 2)).select("sample", "pop")
    return v.genotypes.join(some, "sample").groupBy("pop").agg(F.count("*").alias("n"), F.sum(F.col("a0") + F.col("a1")).alias("alt"))


@check("c02_child_population", sql("""select c.sample, coalesce(f.pop, m.pop) as pop, c.father, c.mother from panel c
 left join (select * from panel where sample % 3 <> 0) f on f.sample = c.father left join (select * from panel where sample % 3 <> 0) m on m.sample = c.mother
 where c.father is not null and coalesce(f.pop, m.pop) in (0, 2, 4)""", "panel"))
def _(v):
    listed = v.panel.filter(F.pmod("sample", F.lit(3)) != 0)
    return tables.children_population(v.panel, listed, [0, 2, 4])


@check("c03_window_rate_fallback", sql("select chrom, window_start, round(rate, 6) as rate from rates", "rates"))
def _(v):
    return v.rates.select("chrom", "window_start", F.round("rate", 6).alias("rate"))


@check("c04_combine_sexes", sql("select chrom, center, pat, mat, round(rate, 6) as rate from cmap", "cmap"))
def _(v):
    pat = v.recmap.select("chrom", "center", F.col("pat").alias("rate"))
    mat = v.recmap.filter(F.col("mat").isNotNull()).select("chrom", "center", F.col("mat").alias("rate"))
    return tables.combine_sexes(pat, mat).select("chrom", "center", "pat", "mat", F.round("rate", 6).alias("rate"))


@check("c05_call_set_intersection", sql("""select g.sample, count(*) as n, cast(sum(g.pos) as bigint) as sum_pos,
 cast(sum(g.idx * case when g.idx % 2 = 0 then g.a1 else g.a0 end) as bigint) as weighted from genotypes g join panel p on p.sample = g.sample
 where p.father is not null and g.idx % 13 <> 5 group by g.sample""", "genotypes"))
def _(v):
    left, right = two_call_sets(v)
    # Each site twice; of even ones the later record has the alleles swapped, of odd ones the earlier.
    swapped = left.withColumns({"a0": F.col("a1"), "a1": F.col("a0"), "line": F.col("line") + F.when(F.pmod("line", F.lit(2)) == 0, 1).otherwise(-1) * 10**9})
    shared = T.shared_calls(left.unionByName(swapped), right, ("sample", "chrom", "pos"))
    ids = v.markers.select("chrom", "pos", "idx")
    return shared.join(ids, ["chrom", "pos"]).groupBy("sample").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos"), F.sum(F.col("idx") * F.col("_l.a0")).cast("long").alias("weighted"),
    )


def manifest(v):
    return v.markers.filter(F.pmod(F.col("idx") * 7, F.lit(10)) < 3).select("chrom", "pos").unionByName(
        v.markers.filter(F.pmod("idx", F.lit(11)) == 0).select("chrom", (F.col("pos") + 1).alias("pos"))
    ).distinct()


MANIFEST_SQL = "manifest as (select chrom, pos from markers where (idx*7) % 10 < 3 union select chrom, pos + 1 from markers where idx % 11 = 0)"


@check("c06_markers_on_manifest", sql(f"with {MANIFEST_SQL} select c.pop, c.chrom, c.pos from common c join manifest m on m.chrom = c.chrom and m.pos = c.pos", "common"))
def _(v):
    return P.on_manifest(v.common, manifest(v)).select("pop", "chrom", "pos")


def intervals(v):
    """Runs as scored intervals."""
    runs = v.null().segments
    return runs.select(F.concat_ws("-", "sample", "chrom", "start_pos").alias("id"), "pop", "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))


INTERVALS_SQL = """iv as (select sample || '-' || chrom || '-' || start_pos as id, pop, chrom, start_pos as s, end_pos as e from segs),
 med as (select median(rate) as r_median from rates where rate > 0),
 loc as (select iv.id, avg(r.rate) as local from iv join rates r on r.chrom = iv.chrom and r.rate > 0
  and r.window_start between iv.s // 1000000 * 1000000 and (iv.e - 1) // 1000000 * 1000000 group by iv.id),
 ivr as (select iv.*, coalesce(l.local, med.r_median) as rate, l.local is not null as known, med.r_median from iv left join loc l on l.id = iv.id cross join med)"""


@check("c07_interval_rates", sql(f"with {INTERVALS_SQL} select id, round(rate, 6) as rate, known, round(r_median, 6) as r_median from ivr", "segs", "rates"))
def _(v):
    return S.interval_rates(intervals(v), v.rates, "id").select("id", F.round("rate", 6).alias("rate"), "known", F.round("r_median", 6).alias("r_median"))


@check("c08_run_covariates", sql("""
select r.sample, r.chrom, r.start_pos, round(avg(h.rate) + 1e-9, 6) as rate, round(avg(h.hbar) + 1e-9, 6) as hbar from segs r
 join calls c on c.sample = r.sample and c.chrom = r.chrom and c.pos between r.start_pos and r.end_pos
 left join hwin h on h.chrom = c.chrom and h.window_start = c.pos // 1000000 * 1000000 group by 1, 2, 3""", "segs", "hwin"))
def _(v):
    keys = ["sample", "chrom"]
    runs = v.null().segments
    cov = S.run_covariates(T.markers_in_runs(v.calls.drop("pop"), runs, keys), v.hbar_windows(), keys)
    return cov.select("sample", "chrom", "start_pos", rd("rate"), rd("hbar"))


@check("c09_variant_in_run", sql("""
with cand as (select t.sample, m.chrom, m.pos, m.idx from typed t join markers m on m.idx = t.idx)
select c.sample, c.chrom, c.pos, min(s.start_pos) as start_pos from cand c left join segs s on s.sample = c.sample and s.chrom = c.chrom
 and c.pos between s.start_pos and s.end_pos group by 1, 2, 3""", "segs"))
def _(v):
    cand = v.typed.select("sample", "chrom", "pos")
    runs = v.null().segments
    return S.first_run_of_variant(cand, runs, ["sample", "chrom"]).select("sample", "chrom", "pos", "start_pos")


def families(v):
    """Line items as linkage intervals and mutations of order families."""
    li = v.table("lineitem")
    iv = li.filter(F.pmod("l_linenumber", F.lit(2)) == 0).select(
        F.pmod("l_orderkey", F.lit(3000)).alias("family"), (F.pmod("l_suppkey", F.lit(2)) + 21).cast("int").alias("chrom"), (F.col("l_quantity") / 2).alias("len_mb"))
    mut = li.filter(F.pmod("l_linenumber", F.lit(2)) == 1).select(
        F.pmod("l_orderkey", F.lit(3000)).alias("family"), (F.pmod("l_suppkey", F.lit(2)) + 21).cast("int").alias("chrom"), (F.pmod("l_partkey", F.lit(2000)) * 6000).alias("pos"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("mutation"))
    return mut, iv


FAMILY_SQL = """iv as (select l_orderkey % 3000 as family, cast(l_suppkey % 2 + 21 as int) as chrom, l_quantity / 2 as len_mb from lineitem where l_linenumber % 2 = 0),
 mut as (select l_orderkey % 3000 as family, cast(l_suppkey % 2 + 21 as int) as chrom, l_partkey % 2000 * 6000 as pos,
  concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) as mutation from lineitem where l_linenumber % 2 = 1),
 best as (select family, chrom, min(len_mb) as roh_mb, count(*) as n_intervals from iv group by 1, 2),
 joined as (select m.*, b.roh_mb, coalesce(b.n_intervals, 0) as n_intervals from mut m left join best b on b.family = m.family and b.chrom = m.chrom)"""


@check("c10_smallest_interval", sql(f"with {FAMILY_SQL} select family, chrom, pos, mutation, roh_mb, n_intervals from joined"))
def _(v):
    return N.smallest_interval(*families(v))


@check("c10_match_counts", sql(f"with {FAMILY_SQL} select count(case when n_intervals > 0 then 1 end) as n_matched, count(case when n_intervals > 1 then 1 end) as n_multi, count(case when n_intervals = 0 then 1 end) as n_missed from joined"))
def _(v):
    return N.match_counts(N.smallest_interval(*families(v)))


@check("c11_locus_rate", sql(f"with {LOCI_SQL} select l.case_id, round(r.rate, 6) as rate from loci l left join rates r on r.chrom = l.chrom and r.window_start = l.midpoint // 1000000 * 1000000", "rates"))
def _(v):
    return N.locus_rates(loci(v), v.rates).select("case_id", F.round("rate", 6).alias("rate"))


@check("c12_scenarios", sql("""select w.chrom, w.window_start, p.prior, l.length_mb, round(p.prior * l.length_mb * w.rate, 6) as load from rates w
 cross join (select unnest([0.0625, 0.0156, 0.005]::double[]) as prior) p cross join (select unnest([1.5, 5.0, 10.0]::double[]) as length_mb) l""", "rates"))
def _(v):
    grid = S.with_scenarios(v.rates, prior=[0.0625, 0.0156, 0.005], length_mb=[1.5, 5.0, 10.0])
    return grid.select("chrom", "window_start", "prior", "length_mb", F.round(F.col("prior") * F.col("length_mb") * F.col("rate"), 6).alias("load"))


def arithmetic_draw(*cols):
    """Integer draws that SQL can repeat exactly."""
    total = F.lit(12345).cast("long")
    for i, c in enumerate(cols):
        total = total + c.cast("long") * (7919 + 104729 * i * i)
    # Reduced first: a position beyond 1.7e9 would overflow the product, and the remainder is the same.
    x = F.pmod(F.pmod(total, F.lit(2147483647)) * 48271 + 11, F.lit(2147483647))
    return F.pmod(x * 69621 + 7, F.lit(2147483647))


def draw_sql(*cols):
    total = "12345" + "".join(f" + cast({c} as bigint)*{7919 + 104729 * i * i}" for i, c in enumerate(cols))
    return f"(((({total})*48271 + 11) % 2147483647)*69621 + 7) % 2147483647"


def founders(v):
    """Indexed samples per population; a pair overlaps at the markers typed in both."""
    return R.index_units(v.panel.select("pop", "sample"), ["pop"], "sample", F.floor(F.col("sample") / 64))


PAIRS_SQL = f"""ix as (select pop, sample, row_number() over (partition by pop order by sample) - 1 as idx, count(*) over (partition by pop) as n_units from panel),
 pr as (select pop, pair, n_units, ({draw_sql('pair', '1')}) % n_units as i from (select distinct pop, n_units from ix) cross join (select unnest(range(40)) as pair)),
 pairs as (select pr.pop, pr.pair, a.sample as unit_a, b.sample as unit_b, ({draw_sql('pair', '3')}) % 2 as hap_a, ({draw_sql('pair', '4')}) % 2 as hap_b
  from pr join ix a on a.pop = pr.pop and a.idx = pr.i
  join ix b on b.pop = pr.pop and b.idx = (pr.i + 1 + ({draw_sql('pair', '2')}) % (pr.n_units - 1)) % pr.n_units),
 pm as (select p.pop, p.pair, a.chrom, a.pos, a.allele = b.allele as hom from pairs p join haps a on a.sample = p.unit_a and a.hap = p.hap_a
  join haps b on b.sample = p.unit_b and b.hap = p.hap_b and b.chrom = a.chrom and b.pos = a.pos)"""


@check("c13_haplotype_pairs", sql(f"with {PAIRS_SQL} select pop, pair, chrom, count(*) as n, count(case when hom then 1 end) as n_match from pm group by 1, 2, 3", "haps"))
def _(v):
    pairs = R.haplotype_pairs(founders(v), ["pop"], "sample", 40, arithmetic_draw)
    match = R.pair_matches(pairs, v.haplotypes, ["pop"], "sample")
    return match.groupBy("pop", "pair", "chrom").agg(F.count("*").alias("n"), F.count_if("hom").alias("n_match"))


@check("c14_trio_alignment", sql("select * from trio", "trio"))
def _(v):
    return v.trio


@check("c15_curve_interpolation", sql(f"""
with bf as (select pop, l_bp, log10({EMISSION} / greatest(p_bg, 1e-12)) as y from curve),
 x as (select sample, chrom, start_pos, pop, least(greatest(len_bp * 3.7, 100000), 12000000) as x from segs)
select x.sample, x.chrom, x.start_pos, round(a.y + (b.y - a.y) * (x.x - a.l_bp) / 50000, 5) as log10_bf from x
 join bf a on a.pop = x.pop and a.l_bp = least(100000 + cast(floor((x.x - 100000) / 50000) as bigint) * 50000, 11950000) join bf b on b.pop = x.pop and b.l_bp = a.l_bp + 50000""", "curve"))
def _(v):
    x = v.null().segments
    out = S.interpolate_curve(x, v.curve(), F.col("len_bp") * 3.7 / 1e6)
    return out.select("sample", "chrom", "start_pos", F.round("log10_bf", 5).alias("log10_bf"))


@check("c15_irregular_grid", sql("""with k as (select chrom, center, pat from cmap), p as (select distinct chrom, pos from markers),
 lo as (select p.chrom, p.pos, k.center as x0, k.pat as y0 from p asof left join k on k.chrom = p.chrom and p.pos >= k.center),
 hi as (select p.chrom, p.pos, k.center as x1, k.pat as y1 from p asof left join k on k.chrom = p.chrom and p.pos < k.center)
select chrom, pos, round(case when x0 is null then y1 when x1 is null or pos = x0 then y0 else y0 + (y1 - y0) * ((pos - x0) / (x1 - x0)::double) end + 1e-9, 6) as rate
from lo join hi using (chrom, pos)""", "cmap"))
def _(v):
    """The paternal map at every marker: its centres have holes, and markers lie before, between and behind them."""
    knots = v.combined_map.select("chrom", "center", F.col("pat").alias("rate"))
    points = v.markers.select("chrom", "pos").distinct()
    return A.interpolate(points, knots, ["chrom"], "pos", "center", "rate", F.floor(F.col("_x") / 5_000_000)).select("chrom", "pos", rd("rate"))


@check("c16_burden_screen", sql("select pop, count(*) as n, cast(sum(len_bp) as bigint) as total_bp from segs_kept group by pop", "segs_kept"))
def _(v):
    null = v.null()
    kept = B.screened(null.burden, 0.0156)
    return B.screen_segments(null.segments, kept, PB.SAMPLE).groupBy("pop").agg(F.count("*").alias("n"), F.sum("len_bp").alias("total_bp"))


@check("c17_exceedance_join", sql("""select s.pop, g.l_bp, count(*) as n_longer, cast(sum(s.len_bp - g.l_bp) as bigint) as excess_bp from segs s join grid g on s.len_bp > g.l_bp group by 1, 2""", "segs", "grid"))
def _(v):
    """The theta join as a reverse cumulative count over grid cells."""
    null = v.null()
    curve = B.exceedance_curve(null.segments, null.burden, ["pop"])
    cells = null.segments.withColumn("k", B.grid_cell(F.col("len_bp") - 1)).filter(F.col("k").isNotNull()).groupBy("pop", "k").agg(F.count("*").alias("c"))
    up = W.partitionBy("pop").orderBy(F.col("l_bp").desc()).rowsBetween(W.unboundedPreceding, 0)
    counts = cells.withColumn("l_bp", B.grid_length(F.col("k"))).select("pop", "l_bp", "c")
    joined = curve.select("pop", "l_bp", "excess_bp").join(counts, ["pop", "l_bp"], "left").withColumn("n_longer", F.sum(F.coalesce("c", F.lit(0))).over(up))
    return joined.filter(F.col("n_longer") > 0).select("pop", "l_bp", "n_longer", "excess_bp")


@check("c18_noise_models", sql("""
with het as (select pop, chrom, pos // 1000000 * 1000000 as window_start, avg(2*(afm/1000)*(1-afm/1000)) as q from site_freq where afm > 0 and afm < 1000 and (chrom = 21 or pop > 1) group by 1, 2, 3),
 h as (select p.pop, w.chrom, w.window_start, w.hbar from hwin w cross join (select unnest(range(5)) as pop) p)
select h.pop, h.chrom, h.window_start, round(h.hbar, 6) as hbar, round(1 - coalesce(q, 0.0), 6) as p_legacy from h left join het using (pop, chrom, window_start)""", "site_freq", "hwin"))
def _(v):
    legacy = D.window_heterozygosity(v.site_freq.filter((F.col("chrom") == 21) | (F.col("pop") > 1)))
    pops = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    h = v.hbar_windows().drop("rate").withColumn("pop", pops)
    return D.noise_side_by_side(h, legacy).select("pop", "chrom", "window_start", F.round("hbar", 6).alias("hbar"), F.round("p_legacy", 6).alias("p_legacy"))
