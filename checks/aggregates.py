"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.joins import MANIFEST_SQL, arithmetic_draw, manifest
from checks.registry import check
from checks.scans import AGREE_WIN, LOCI_SQL, TRACE_SQL, TWO_SETS, loci, two_call_sets
from checks.views import EMISSION, THR, curve_sql, lstar_sql, rd, runs_sql, sql
from zygospan.config import DEFAULTS
from zygospan.functions import evidence as E
from zygospan.operators import background as B
from zygospan.operators import calibrate as K
from zygospan.operators import diversity as D
from zygospan.operators import enrich as N
from zygospan.operators import maps as M
from zygospan.operators import platform as P
from zygospan.operators import resample as R
from zygospan.operators import trio as T
from zygospan.operators.runs import call_runs
from zygospan.plans import background as PB
from zygospan.plans import trio as PT

HET = """het as (select pop, chrom, pos // 1000000 * 1000000 as window_start, count(*) as n_variants, avg(2*(afm/1000)*(1-afm/1000)) as mean_2pq
 from site_freq where afm > 0 and afm < 1000 group by 1, 2, 3)"""


HETW_RATES = HET + ", hw as (select h.*, coalesce(r.rate, 0.0) as rate from het h left join rates r using (chrom, window_start))"


@check("d01_window_heterozygosity", sql(f"with {HET} select pop, chrom, window_start, n_variants, round(mean_2pq + 1e-9, 6) as mean_2pq from het", "site_freq"))
def _(v):
    return D.window_heterozygosity(v.site_freq).select("pop", "chrom", "window_start", "n_variants", rd("mean_2pq"))


ATLAS = HET + f""",
 atlas as (select h.*, coalesce(r.rate, 0.0) as rate from het h left join rates r using (chrom, window_start)),
 post as (select *, 0.0625*{EMISSION}/(0.0625*{EMISSION} + 0.9375*pow(greatest(1e-12, 1-mean_2pq), greatest(1.0, 10.0*rate/0.5))) as posterior from atlas)"""


@check("d02_calibrated_share", sql(f"with {ATLAS} select pop, count(case when rate > 0 then 1 end) as n_known, count(case when rate > 0 and posterior >= 0.95 then 1 end) as n_calibrated from post group by pop", "site_freq", "rates"))
def _(v):
    w = D.window_heterozygosity(v.site_freq).join(v.rates, ["chrom", "window_start"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    post = E.posterior_legacy_2pq(F.lit(10.0), F.col("rate"), F.col("mean_2pq"), 0.0625)
    return D.calibrated_share(w, post, ["pop"]).drop("share")


@check("d02_calibrated_share_total", sql(f"""with {ATLAS} select case when grouping(chrom) = 1 then 'TOTAL' else cast(chrom as varchar) end as chrom, count(case when rate > 0 then 1 end) as n_known,
 count(case when rate > 0 and posterior >= 0.95 then 1 end) as n_calibrated, round(count(case when rate > 0 and posterior >= 0.95 then 1 end) / count(case when rate > 0 then 1 end) + 1e-9, 6) as share from post group by rollup(chrom)""", "site_freq", "rates"))
def _(v):
    w = D.window_heterozygosity(v.site_freq).join(v.rates, ["chrom", "window_start"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    post = E.posterior_legacy_2pq(F.lit(10.0), F.col("rate"), F.col("mean_2pq"), 0.0625)
    return D.calibrated_share_with_total(w, post).select("chrom", "n_known", "n_calibrated", rd("share"))


@check("d03_weighted_diversity", sql(f"with {HET} select pop, round(sum(mean_2pq*n_variants)/sum(n_variants) + 1e-9, 6) as mean_2pq, cast(sum(n_variants) as bigint) as n_variants from het group by pop", "site_freq"))
def _(v):
    return D.weighted_diversity(D.window_heterozygosity(v.site_freq)).select("pop", rd("mean_2pq"), "n_variants")


def blocks(v):
    """Common markers with genetic position and block number."""
    return M.add_cm(v.common, M.cumulative_cm(v.rates)).withColumn("blk", M.block_id())


CM = """endcm as (select chrom, max(cm_start + rate) as e from cum group by chrom),
 cmark as (select c.*, floor(coalesce(u.cm_start + u.rate * (c.pos - u.window_start) / 1000000, e.e) / 0.5) as blkf,
  coalesce(u.cm_start + u.rate * (c.pos - u.window_start) / 1000000, e.e) as cm
  from common c left join cum u on u.chrom = c.chrom and u.window_start = c.pos // 1000000 * 1000000 join endcm e on e.chrom = c.chrom),
 mk as (select pop, chrom, pos, maf, cm, cast(blkf as bigint) as blk from cmark)"""
THIN = CM + """,
 numbered as (select *, row_number() over (partition by pop, chrom, blk order by pos) - 1 as ord, count(*) over (partition by pop, chrom, blk) as n from mk),
 thin as (select pop, chrom, pos, blk, case when n <= 25 then ord else k.i end as slot from numbered left join (select unnest(range(25)) as i) k
  on n > 25 and k.i * n // 25 = ord where n <= 25 or k.i is not null)"""
HOM = THIN + """,
 hs as (select t.pop, t.chrom, t.blk, h.sample, h.hap, string_agg(t.slot || ':' || h.allele, ',' order by t.slot) as hs
  from thin t join haps h on h.pop = t.pop and h.chrom = t.chrom and h.pos = t.pos group by 1, 2, 3, 4, 5),
 cls as (select pop, chrom, blk, hs, count(*) as c from hs group by 1, 2, 3, 4),
 hom as (select pop, chrom, blk, cast(sum(c) as bigint) as n_hap, count(*) as n_distinct, sum(c*(c-1)) / (sum(c)*(sum(c)-1)) as hom from cls group by 1, 2, 3)"""
HBAR = HOM + """,
 firstany as (select chrom, blk, min(pos) as fp from mk group by 1, 2),
 hbw as (select h.pop, h.chrom, f.fp // 1000000 * 1000000 as window_start, avg(h.hom) as hbar, count(*) as n_blocks, avg(h.n_distinct) as mean_distinct, avg(h.n_hap) as mean_n
  from hom h join firstany f on f.chrom = h.chrom and f.blk = h.blk group by 1, 2, 3)"""


@check("d04_block_homozygosity", sql(f"with {HOM} select pop, chrom, blk, n_hap, n_distinct, round(hom + 1e-9, 6) as hom from hom", "common", "cum", "haps"))
def _(v):
    keys = ["pop", "chrom", "blk"]
    codes = D.haplotype_codes(D.thin_blocks(blocks(v).select("pop", "chrom", "pos", "blk"), keys), v.haplotypes, keys, ["sample", "hap"])
    return D.unbiased_homozygosity(codes, keys).select(*keys, "n_hap", "n_distinct", rd("hom"))


@check("d05_window_hbar", sql(f"with {HBAR} select pop, chrom, window_start, round(hbar + 1e-9, 6) as hbar, n_blocks, round(mean_distinct + 1e-9, 6) as mean_distinct, round(mean_n + 1e-9, 6) as mean_n from hbw", "common", "cum", "haps"))
def _(v):
    out = D.window_hbar(blocks(v).select("pop", "chrom", "pos", "blk"), v.haplotypes)
    return out.select("pop", "chrom", "window_start", rd("hbar"), "n_blocks", rd("mean_distinct"), rd("mean_n"))


@check("d05_window_hbar_own_anchor", sql(f"""with {HOM}, fp as (select pop, chrom, blk, min(pos) as fp from mk group by 1, 2, 3)
 select h.pop, h.chrom, f.fp // 1000000 * 1000000 as window_start, round(avg(h.hom) + 1e-9, 6) as hbar, count(*) as n_blocks from hom h join fp f using (pop, chrom, blk) group by 1, 2, 3""", "common", "cum", "haps"))
def _(v):
    out = D.window_hbar(blocks(v).select("pop", "chrom", "pos", "blk"), v.haplotypes, anchor="pop")
    return out.select("pop", "chrom", "window_start", rd("hbar"), "n_blocks")


@check("d06_run_summary", sql("select sample, chrom, start_pos, end_pos, n_markers, len_bp from runs", "runs"))
def _(v):
    return call_runs(v.calls, ["sample", "chrom"]).drop("gap")


@check("d07_sample_burden", sql("select pop, sample, span_bp, roh_bp, round(f_roh + 1e-9, 6) as f_roh, is_outlier from burden", "burden"))
def _(v):
    return v.null().burden.select("pop", "sample", "span_bp", "roh_bp", rd("f_roh"), "is_outlier")


@check("d08_exceedance_curve", sql("select pop, l_bp, excess_bp, exposure_bp, round(p_bg + 1e-9, 6) as p_bg from curve", "curve"))
def _(v):
    null = v.null()
    return B.exceedance_curve(null.segments, null.burden, ["pop"]).select("pop", "l_bp", "excess_bp", "exposure_bp", rd("p_bg"))


@check("d08_exceedance_curve_screened", sql("select pop, l_bp, excess_bp, round(p_bg + 1e-9, 6) as p_bg from curve_kept", "curve_kept"))
def _(v):
    return PB.background_curves(v.null()).select("pop", "l_bp", "excess_bp", rd("p_bg"))


@check("d09_decisive_length", sql(lstar_sql("curve", "pop"), "curve"))
def _(v):
    return B.decisive_length(v.curve(), ["pop"])


@check("d10_upper_percentiles", sql("""
with kept as (select pop, len_bp, row_number() over (partition by pop order by len_bp) as rk, count(*) over (partition by pop) as nk from segs),
 tot as (select pop, count(*) as n_all from runs group by pop), ask as (select t.*, q.pct from tot t cross join (select unnest([50.0, 90.0, 99.0, 99.9]::double[]) as pct) q),
 k as (select distinct pop, nk from kept)
select a.pop, a.pct, coalesce(max(x.len_bp), 0) as len_bp from ask a join k on k.pop = a.pop
 left join kept x on x.pop = a.pop and a.pct / 100 * a.n_all - (a.n_all - k.nk) > 0 and x.rk = least(k.nk, ceil(a.pct / 100 * a.n_all - (a.n_all - k.nk))) group by 1, 2""", "segs"))
def _(v):
    runs = v.runs()
    return B.upper_lengths(runs.filter(F.col("len_bp") > 5000), runs.groupBy("pop").agg(F.count("*").alias("n_all")), ["pop"], [50.0, 90.0, 99.0, 99.9])


@check("d11_trace_windows", sql(f"with {TRACE_SQL} select * from tw", "trio"))
def _(v):
    return T.trace_windows(v.trio).select("trio", "chrom", "window_start", "pat_hap0", "pat_hap1", "mat_hap0", "mat_hap1")


@check("d12_agreement_windows", sql(f"with {TWO_SETS}, {AGREE_WIN} select *, round(n_agree / (n_agree + n_disagree) + 1e-9, 6) as agree_frac from aw", "genotypes", "sites"))
def _(v):
    left, right = two_call_sets(v)
    sites = T.phase_agreement(T.shared_calls(left, right, ("sample", "chrom", "pos")))
    return T.agreement_windows(sites, ("sample", "chrom")).select("sample", "chrom", "window_start", "n_agree", "n_disagree", rd("agree_frac"))


@check("d12_agreement_summary", sql(f"""with {TWO_SETS} select sample, count(*) as n_shared, count(case when not same_alleles then 1 end) as n_mismatched, count(case when comparable then 1 end) as n_both_het,
 count(case when agree then 1 end) as n_agree, count(case when not agree then 1 end) as n_disagree from agree group by sample""", "genotypes", "sites"))
def _(v):
    left, right = two_call_sets(v)
    return T.agreement_summary(T.phase_agreement(T.shared_calls(left, right, ("sample", "chrom", "pos"))), ["sample"])


@check("d13_phase_convention", sql("""
with c as (select trio, avg(case when (c0 = f0 or c0 = f1) and (c1 = m0 or c1 = m1) then 1.0 else 0.0 end) as share_a,
 avg(case when (c0 = m0 or c0 = m1) and (c1 = f0 or c1 = f1) then 1.0 else 0.0 end) as share_b, count(*) as n_sites from trio group by trio)
select trio, round(share_a + 1e-9, 6) as share_a, round(share_b + 1e-9, 6) as share_b, n_sites, case when share_a >= share_b then 'A' else 'B' end as convention from c""", "trio"))
def _(v):
    return T.phase_consistency(v.trio).select("trio", rd("share_a"), rd("share_b"), "n_sites", "convention")


def centromeres(v):
    """Two mapped chromosomes with a span each, and one that the map lacks."""
    ends = v.recmap.groupBy("chrom").agg(F.max("center").alias("m"))
    real = ends.select("chrom", F.floor(F.col("m") / 3).alias("cen_start"), (F.floor(F.col("m") / 3) + 1_500_000).alias("cen_end"))
    return real.unionByName(real.withColumn("chrom", F.col("chrom") + 100))


ARMS = """cen0 as (select chrom, max(center) // 3 as cen_start, max(center) // 3 + 1500000 as cen_end from cmap group by chrom),
 cen as (select * from cen0 union all select chrom + 100, cen_start, cen_end from cen0),
 am as (select c.chrom, case when c.center < cen.cen_start then 'p' when c.center > cen.cen_end then 'q' end as arm, c.* exclude (chrom) from cmap c join cen on cen.chrom = c.chrom),
 ag as (select chrom, arm, count(*) as n_win, (max(center) - min(center) + 1000000) / 1e6 as span_mb, sum(pat) as cm_pat, sum(mat) as cm_mat from am where arm is not null group by 1, 2),
 arms as (select cen.chrom, a.arm, coalesce(ag.n_win, 0) as n_win, span_mb, cm_pat, cm_mat, (cm_pat + cm_mat)/2 as cm_avg, (cm_pat + cm_mat)/2/n_win as mean_rate, 0.5*(1-exp(-(cm_pat + cm_mat)/100)) as theta
  from cen cross join (select unnest(['p', 'q']) as arm) a left join ag on ag.chrom = cen.chrom and ag.arm = a.arm)"""


@check("d14_arm_summary", sql(f"with {ARMS} select chrom, arm, n_win, span_mb, round(cm_pat + 1e-9, 6) as cm_pat, round(cm_mat + 1e-9, 6) as cm_mat, round(cm_avg + 1e-9, 6) as cm_avg, round(mean_rate + 1e-9, 6) as mean_rate, round(theta + 1e-9, 6) as theta from arms", "cmap"))
def _(v):
    out = M.arm_summary(v.combined_map, centromeres(v))
    return out.select("chrom", "arm", "n_win", "span_mb", *[rd(c) for c in ("cm_pat", "cm_mat", "cm_avg", "mean_rate", "theta")])


@check("d14_arm_totals", sql(f"""with {ARMS} select coalesce(arm, 'ALL') as arm, round(sum(cm_pat) + 1e-9, 6) as cm_pat, round(sum(cm_mat) + 1e-9, 6) as cm_mat, round(sum(cm_avg) + 1e-9, 6) as cm_avg,
 round(sum(cm_mat)/sum(cm_pat) + 1e-9, 6) as ratio_mf from arms group by grouping sets ((arm), ())""", "cmap"))
def _(v):
    out = M.arm_totals(M.arm_summary(v.combined_map, centromeres(v)))
    return out.select("arm", *[rd(c) for c in ("cm_pat", "cm_mat", "cm_avg", "ratio_mf")])


@check("d15_chromosome_means", sql("select chrom, round(avg(rate) + 1e-9, 6) as mean_rate, count(*) as n from cmap group by chrom", "cmap"))
def _(v):
    return M.chromosome_means(v.combined_map).select("chrom", rd("mean_rate"), "n")


@check("d15_rate_distribution", sql("""select count(*) as n_windows, min(rate) as r_min, max(rate) as r_max, round(median(rate) + 1e-9, 6) as r_median, round(quantile_cont(rate, 0.1) + 1e-9, 6) as p10, round(quantile_cont(rate, 0.25) + 1e-9, 6) as p25,
 round(quantile_cont(rate, 0.5) + 1e-9, 6) as p50, round(quantile_cont(rate, 0.75) + 1e-9, 6) as p75, round(quantile_cont(rate, 0.9) + 1e-9, 6) as p90 from rates where rate > 0""", "rates"))
def _(v):
    return M.rate_summary(v.rates).select("n_windows", "r_min", "r_max", *[rd(c) for c in ("r_median", "p10", "p25", "p50", "p75", "p90")])


@check("d15_exact_quantiles", sql("""select l_returnflag as flag, q.prob, round(quantile_cont(l_extendedprice, 0.5) * 0 + case q.prob when 0.1 then quantile_cont(l_extendedprice, 0.1) when 0.5 then quantile_cont(l_extendedprice, 0.5)
 else quantile_cont(l_extendedprice, 0.99) end + 1e-9, 4) as quantile from lineitem cross join (select unnest([0.1, 0.5, 0.99]::double[]) as prob) q group by 1, 2"""))
def _(v):
    from zygospan.operators.blocked import exact_quantiles

    li = v.table("lineitem").withColumnRenamed("l_returnflag", "flag")
    return exact_quantiles(li, ["flag"], "l_extendedprice", [0.1, 0.5, 0.99], F.floor(F.col("l_extendedprice") / 500)).select("flag", "prob", rd("quantile", 4))


@check("d16_equal_evidence", sql("""with q as (select median(rate) as m, quantile_cont(rate, [0.1, 0.25, 0.5, 0.75, 0.9]) as v from rates where rate > 0)
 select cast(p.p as int) as percentile, round(v[p.i] + 1e-9, 6) as rate, round(m * 10.0 / v[p.i] + 1e-9, 6) as length_mb from q cross join (values (1, 10), (2, 25), (3, 50), (4, 75), (5, 90)) p(i, p)""", "rates"))
def _(v):
    return M.equal_evidence_lengths(v.rates).select("percentile", rd("rate"), rd("length_mb"))


def trials(v):
    """Labelled documents as scored trials."""
    rows = v.table("documents").join(v.table("labels"), "doc_id")
    return rows.select(
        F.pmod("doc_id", F.lit(5)).alias("pop"), (F.pmod("n_chars", F.lit(6000)) / F.lit(1000.0)).alias("l_obs"), F.col("quality").cast("int").alias("label"),
        (F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 11, F.lit(1001)) / F.lit(1000.0)).alias("posterior"),
    )


TRIALS = """tr as (select d.doc_id % 5 as pop, n_chars % 6000 / 1000.0 as l_obs, quality as label, ((n_chars*37 + d.doc_id*11) % 1001) / 1000.0 as posterior,
  n_chars % 6000 as l_int, (n_chars*37 + d.doc_id*11) % 1001 as p_int from documents d join labels l using (doc_id)),
 bins as (select pop, cast(least(floor(posterior*10), 9) as bigint) as bin, avg(posterior) as mp, avg(label) as ob, count(*) as n from tr group by 1, 2)"""


@check("d17_reliability_bins", sql(f"with {TRIALS} select pop, bin, round(mp + 1e-9, 6) as mean_posterior, round(ob + 1e-9, 6) as observed, n from bins"))
def _(v):
    return K.reliability(trials(v)).select("pop", "bin", rd("mean_posterior"), rd("observed"), "n")


@check("d18_calibration_error", sql(f"with {TRIALS} select pop, round(sum(n*abs(ob - mp))/sum(n) + 1e-9, 6) as ece, cast(sum(n) as bigint) as n from bins group by pop"))
def _(v):
    return K.calibration_error(K.reliability(trials(v))).select("pop", rd("ece"), "n")


@check("d19_false_discovery", sql(f"""with {TRIALS} select pop, round(1 - avg(case when l_obs >= 0.7 then label end) + 1e-9, 6) as fdr_0_7mb, round(1 - avg(case when l_obs >= 1.5 then label end) + 1e-9, 6) as fdr_1_5mb,
 round(1 - avg(case when posterior >= 0.95 then label end) + 1e-9, 6) as fdr_posterior, count(*) as n from tr group by pop"""))
def _(v):
    return K.false_discovery(trials(v), [0.7, 1.5]).select("pop", rd("fdr_0_7mb"), rd("fdr_1_5mb"), rd("fdr_posterior"), "n")


@check("d20_truth_lstar", sql(f"""with {TRIALS}, g as (select 100 + 50*i as l from (select unnest(range(159)) as i)),
 c as (select t.pop, g.l, count(*) as n, 1 - avg(t.label) as fdr from tr t join g on t.l_int >= g.l group by 1, 2), p as (select distinct pop from tr)
 select p.pop, coalesce(min(case when n >= 20 and fdr <= 0.35 then l end) / 1000.0, 'inf'::double) as lstar_mb from p left join c on c.pop = p.pop group by 1"""))
def _(v):
    return K.truth_lstar(trials(v), target=0.35)


BOOT = """bw as (select pop, b, idx, count(*) as w from (select ix.pop, b.b, ({d}) % ix.n_units as idx from ix cross join (select unnest(range(1, 21)) as b) b) group by 1, 2, 3),
 wt as (select bw.pop, bw.b, ix.sample, bw.w from bw join ix on ix.pop = bw.pop and ix.idx = bw.idx),
 be as (select w.pop, w.b, sum(w.w * k.span_bp) as expo from wt w join {src} k on k.sample = w.sample group by 1, 2),
 bc as (select w.pop, w.b, g.l_bp, sum(w.w * greatest(0, s.len_bp - g.l_bp)) as ex from wt w join {segs} s on s.sample = w.sample cross join grid g group by 1, 2, 3),
 br as (select c.pop, c.b, coalesce(min(case when c.ex / e.expo <= {thr} then c.l_bp end) / 1e6, 'inf'::double) as lstar_mb from bc c join be e on e.pop = c.pop and e.b = c.b group by 1, 2)"""


def boot_sql(src, segs):
    from checks.joins import draw_sql

    ix = f"ix as (select pop, sample, row_number() over (partition by pop order by sample) - 1 as idx, count(*) over (partition by pop) as n_units from {src})"
    return f"{ix}, {BOOT.format(d=draw_sql('b.b', 'ix.idx'), src=src, segs=segs, thr=THR)}"


def boot_draw(b, d):
    return arithmetic_draw(b, d)


@check("d21_bootstrap_replicates", sql(f"with {boot_sql('kept', 'segs_kept')} select pop, cast(b as int) as b, lstar_mb from br", "segs_kept", "grid"))
def _(v):
    null = v.null()
    kept = B.screened(null.burden, DEFAULTS.outlier_f)
    inside = B.screen_segments(null.segments, kept, PB.SAMPLE)
    return R.bootstrap_lstar(inside, kept, ["pop"], 20, F.floor(F.col("sample") / 64), boot_draw)


SURFACE = """lad as (select * from (values ('none', 1e9), ('0.0500', 0.05), ('0.0156', 0.0156), ('0.0050', 0.005)) t(screen, cut)),
 kp as (select b.pop, b.sample, b.span_bp, l.screen from burden b join lad l on b.f_roh <= l.cut),
 ex as (select pop, screen, count(*) as n_kept, sum(span_bp) as e from kp group by 1, 2),
 cv as (select s.pop, s.gap, k.screen, g.l_bp, sum(greatest(0, s.len_bp - g.l_bp)) as x from segs3 s join kp k on k.sample = s.sample cross join grid g group by 1, 2, 3, 4)"""


@check("d22_lstar_surface", sql(f"""with {SURFACE} select c.pop, cast(c.gap as int) as gap, c.screen, coalesce(min(case when c.x / e.e <= {THR} then c.l_bp end) / 1e6, 'inf'::double) as lstar_mb, max(e.n_kept) as n_kept
 from cv c join ex e on e.pop = c.pop and e.screen = c.screen group by 1, 2, 3""", "segs3", "burden", "grid"))
def _(v):
    null = v.null((0, 1, 2))
    return B.lstar_surface(null.segments, null.burden, [None, 0.05, 0.0156, 0.005])


PLATFORM = """sel as (select 'full' as platform, pop, chrom, pos from common union all
  select 'every_' || k.k, pop, chrom, pos from (select *, row_number() over (partition by pop, chrom order by pos) - 1 as at from common) c cross join (select unnest([2, 5, 10, 20]) as k) k where c.at % k.k = 0),
 pc as (select s.platform, c.pop, c.sample, c.chrom, c.pos, c.hom from calls c join sel s on s.pop = c.pop and s.chrom = c.chrom and s.pos = c.pos)""" + ",\n " + runs_sql("pr", "pc", "platform, pop, sample, chrom") + """,
 ps as (select * from pr where len_bp > 5000),
 pb as (select t.platform, t.pop, t.sample, b.span_bp, cast(coalesce(r.roh, 0) as bigint) as roh_bp, coalesce(r.roh, 0) / b.span_bp as f_roh, coalesce(r.roh, 0) / b.span_bp > 0.0156 as is_outlier
  from (select p.platform, p.pop, b.sample from (select distinct platform, pop from sel) p join burden b on b.pop = p.pop) t join burden b on b.sample = t.sample
  left join (select platform, sample, sum(case when len_bp >= 1000000 then len_bp else 0 end) as roh from pr group by 1, 2) r on r.platform = t.platform and r.sample = t.sample)"""


def platforms(v, steps=(2, 5, 10, 20)):
    sel = PB.platform_selections(v.common, steps)
    return sel, v.platform_null(sel, ["full", *[f"every_{k}" for k in steps]])


def _plstar(name, src, segs):
    return f"{name}e as (select platform, pop, cast(sum(span_bp) as bigint) as exposure_bp from {src} group by 1, 2), " + curve_sql(f"{name}c", segs, f"{name}e", "platform, pop") + f", {name}l as ({lstar_sql(f'{name}c', 'platform, pop', f'lstar_{name}_mb')})"


@check("d23_platform_lstar", sql(f"""with {PLATFORM}, pk as (select * from pb where not is_outlier), pks as (select s.* from ps s join pk on pk.platform = s.platform and pk.sample = s.sample),
 {_plstar('all', 'pb', 'ps')}, {_plstar('screened', 'pk', 'pks')},
 ax as (select platform, pop, chrom, count(*) as m from sel group by 1, 2, 3), full_ax as (select pop, chrom, max(pos) - min(pos) as sp from common group by 1, 2),
 den as (select a.platform, a.pop, sum(a.m) / (sum(f.sp) / 1e6) as density from ax a join full_ax f on f.pop = a.pop and f.chrom = a.chrom group by 1, 2)
 select b.platform, b.pop, b.n, b.n_outliers, a.lstar_all_mb, s.lstar_screened_mb, round(d.density + 1e-9, 6) as density
 from (select platform, pop, count(*) as n, count(case when is_outlier then 1 end) as n_outliers from pb group by 1, 2) b left join alll a using (platform, pop) left join screenedl s using (platform, pop) left join den d using (platform, pop)""", "calls", "common", "burden", "grid"))
def _(v):
    sel, null = platforms(v)
    axis = P.marker_axis(v.common).drop("n_markers")
    counts = sel.groupBy("platform", "pop", "chrom").agg(F.count("*").alias("n_markers")).join(axis, ["pop", "chrom"])
    out = B.platform_table(null.segments, null.burden, counts)
    return out.withColumn("density", F.round(F.col("density") + 1e-9, 6))


@check("d24_quantile_matched_screen", sql(f"""with {PLATFORM}, k as (select pop, count(*) as k from pb where platform = 'full' and is_outlier group by pop),
 rk as (select *, row_number() over (partition by platform, pop order by f_roh desc, sample) as r from pb)
 select rk.platform, rk.pop, count(*) as n, cast(sum(rk.sample) as bigint) as sum_sample, cast(sum(rk.roh_bp) as bigint) as roh_bp from rk left join k on k.pop = rk.pop where rk.r > coalesce(k.k, 0) group by 1, 2""", "calls", "common", "burden"))
def _(v):
    _, null = platforms(v)
    out = B.quantile_matched(null.burden, "full", F.floor(F.col("sample") / 64))
    return out.groupBy("platform", "pop").agg(F.count("*").alias("n"), F.sum("sample").alias("sum_sample"), F.sum("roh_bp").alias("roh_bp"))


@check("d24_burden_quantiles", sql("""select pop, q.prob, round(case q.prob when 0.5 then quantile_cont(f_roh, 0.5) else quantile_cont(f_roh, 0.9) end + 1e-9, 6) as quantile from burden cross join (select unnest([0.5, 0.9]::double[]) as prob) q group by 1, 2""", "burden"))
def _(v):
    return B.burden_quantiles(v.null().burden, ["pop"]).select("pop", "prob", rd("quantile"))


@check("d25_manifest_overlap", sql(f"with {MANIFEST_SQL} select 'A1' as array, count(*) as n_probes, count(c.pos) as n_hits, round(count(c.pos) / count(*) + 1e-9, 6) as share from manifest m left join common c on c.pop = 0 and c.chrom = m.chrom and c.pos = m.pos", "common"))
def _(v):
    m = manifest(v).withColumn("array", F.lit("A1"))
    return P.manifest_overlap(v.common, m, 0).select("array", "n_probes", "n_hits", rd("share"))


RATE_BINS = """ed as (select quantile_cont(rate, [0.2, 0.4, 0.6, 0.8]) as e from rates where rate > 0),
 bn as (select cast(b.b as int) as bin, case when b.b = 0 then '-inf'::double else e[b.b] end as lo, case when b.b = 4 then 'inf'::double else e[b.b + 1] end as hi from ed cross join (select unnest(range(5)) as b) b),
 rb as (select bn.*, avg(r.rate) as mean_rate, count(r.rate) as footprint_windows from bn left join rates r on r.rate > 0 and r.rate >= bn.lo and r.rate < bn.hi group by 1, 2, 3),
 ec as (select chrom, max(cm_start + rate) as e from cum group by chrom),
 sr as (select s.*, (coalesce(b.cm_start + b.rate * (s.end_pos - b.window_start) / 1000000, e.e) - coalesce(a.cm_start + a.rate * (s.start_pos - a.window_start) / 1000000, e.e)) / (s.len_bp / 1e6) as rate
  from segs_kept s join ec e on e.chrom = s.chrom left join cum a on a.chrom = s.chrom and a.window_start = s.start_pos // 1000000 * 1000000 left join cum b on b.chrom = s.chrom and b.window_start = s.end_pos // 1000000 * 1000000),
 sb as (select s.*, rb.bin from sr s join rb on s.rate >= rb.lo and s.rate < rb.hi)"""
BIN_EXPO = "bexpo as (select bin, (select count(*) from kept) * footprint_windows * 1000000 as exposure_bp from rb)"


@check("d26_rate_bins", sql(f"with {RATE_BINS} select bin, round(mean_rate + 1e-9, 6) as mean_rate, footprint_windows from rb", "segs_kept", "cum"))
def _(v):
    return B.rate_bins(v.rates).select("bin", rd("mean_rate"), "footprint_windows")


@check("d26_rate_binned_lstar", sql(f"""with {RATE_BINS}, {BIN_EXPO}, {curve_sql('bcv', 'sb', 'bexpo', 'bin')}, bl as ({lstar_sql('bcv', 'bin')})
 select rb.bin, rb.footprint_windows, coalesce(c.n, 0) as n_segments, coalesce(bl.lstar_mb, 'inf'::double) as lstar_mb from rb left join (select bin, count(*) as n from sb group by bin) c using (bin) left join bl using (bin)""", "segs_kept", "cum", "grid"))
def _(v):
    out = PB.rate_binned(v.null(), M.cumulative_cm(v.rates), v.rates, 0.05)
    return out.select("bin", "footprint_windows", "n_segments", "lstar_mb")


@check("d27_binomial_tail", sql("""with t as (select s_suppkey as id, s_suppkey % 40 as k, s_suppkey % 40 + s_suppkey % 57 as n, (s_suppkey % 19 + 1) / 20.0 as p from supplier),
 x as (select t.*, i.i from t cross join (select unnest(range(200)) as i) i where i.i between t.k and t.n)
 select t.id, round(case when t.k = 0 then 1.0 else coalesce(sum(exp(lgamma(x.n + 1) - lgamma(x.i + 1) - lgamma(x.n - x.i + 1) + x.i * ln(x.p) + (x.n - x.i) * ln(1 - x.p))), 0.0) end + 1e-9, 6) as p_value from t left join x on x.id = t.id group by t.id, t.k"""))
def _(v):
    k = F.col("s_suppkey")
    t = v.table("supplier").select(k.alias("id"), F.pmod(k, F.lit(40)).alias("k"), (F.pmod(k, F.lit(40)) + F.pmod(k, F.lit(57))).alias("n"), ((F.pmod(k, F.lit(19)) + 1) / F.lit(20.0)).alias("p"))
    return N.binomial_tail(t, ["id"]).select("id", rd("p_value"))


ENRICH = LOCI_SQL + """,
 lr as (select l.*, r.rate from loci l left join rates r on r.chrom = l.chrom and r.window_start = l.midpoint // 1000000 * 1000000),
 md as (select median(rate) as m, count(*) as nw from rates where rate > 0), bs as (select md.m, md.nw, count(case when rate >= 1.5*m then 1 end)/max(nw) as f15, count(case when rate >= 2*m then 1 end)/max(nw) as f20 from rates cross join md where rate > 0 group by 1, 2)"""


@check("d28_locus_enrichment", sql(f"""with {ENRICH} select case when grouping(source) = 1 then 'COMBINED' else source end as source, count(*) as n, count(case when rate >= 1.5*m then 1 end) as n_15, count(case when rate >= 2*m then 1 end) as n_20,
 count(case when roh_mb <= 5 then 1 end) as n_short, round(max(f15) + 1e-9, 6) as frac_15, round(max(f20) + 1e-9, 6) as frac_20 from lr cross join bs group by rollup(source)""", "rates"))
def _(v):
    out = N.hot_counts(N.locus_rates(loci(v), v.rates), N.baseline(v.rates), "source", "COMBINED")
    return out.select("source", "n", "n_15", "n_20", "n_short", rd("frac_15"), rd("frac_20"))


@check("d28_rate_percentile", sql(f"""with {ENRICH}, pc as (select r.rate, 100 * (select count(*) from rates x where x.rate > 0 and x.rate <= r.rate) / (select nw from md) as percentile from (select distinct rate from rates where rate > 0) r)
 select lr.case_id, round(pc.percentile + 1e-9, 6) as percentile from lr left join pc on pc.rate = lr.rate""", "rates"))
def _(v):
    return N.rate_percentile(N.locus_rates(loci(v), v.rates), v.rates).select("case_id", rd("percentile"))


@check("d30_case_descriptives", sql(f"""with {LOCI_SQL} select case_class, count(roh_mb) as n, round(avg(roh_mb) + 1e-9, 6) as mean_mb, round(stddev_samp(roh_mb) + 1e-9, 6) as sd_mb, round(median(roh_mb) + 1e-9, 6) as median_mb, min(roh_mb) as min_mb, max(roh_mb) as max_mb,
 round(avg(case when roh_mb <= 3 then 1.0 else 0.0 end) + 1e-9, 6) as share_le_3, round(avg(case when roh_mb <= 5 then 1.0 else 0.0 end) + 1e-9, 6) as share_le_5, round(avg(case when roh_mb <= 10 then 1.0 else 0.0 end) + 1e-9, 6) as share_le_10 from loci where roh_mb is not null group by case_class""", "markers"))
def _(v):
    out = N.case_descriptives(loci(v), ["case_class"])
    return out.select("case_class", "n", "min_mb", "max_mb", *[rd(c) for c in ("mean_mb", "sd_mb", "median_mb", "share_le_3", "share_le_5", "share_le_10")])


_FLOORS = (100_000, 300_000, 1_000_000)
LOADS = """fl as (select unnest([100000, 300000, 1000000]) as floor_bp),
 ld as (select b.pop, b.sample, b.is_outlier, f.floor_bp, count(s.len_bp) as n_roh, coalesce(sum(s.len_bp), 0) as bp from burden b cross join fl f left join segs s on s.sample = b.sample and s.len_bp >= f.floor_bp group by 1, 2, 3, 4),
 ex as (select 'all' as "set", * from ld union all select 'screened', * from ld where not is_outlier),
 ex2 as (select "set", cast(pop as varchar) as pop, floor_bp, n_roh, bp from ex union all select "set", 'POOLED', floor_bp, n_roh, bp from ex)"""


@check("d31_search_space", sql(f"""with {LOADS} select "set", pop, cast(floor_bp as bigint) as floor_bp, count(*) as n_cases, round(avg(n_roh) + 1e-9, 6) as roh_mean, max(n_roh) as roh_max, round(quantile_cont(n_roh, 0.5) + 1e-9, 6) as roh_median, round(quantile_cont(n_roh, 0.25) + 1e-9, 6) as roh_q25,
 round(quantile_cont(n_roh, 0.75) + 1e-9, 6) as roh_q75, round(quantile_cont(cast(bp as double), 0.5)/1e6 + 1e-9, 6) as mb_median, round(quantile_cont(cast(bp as double), 0.75)/1e6 + 1e-9, 6) as mb_q75, round(quantile_cont(cast(bp as double), 0.5)/1e6*7 + 1e-9, 6) as genes_median from ex2 group by 1, 2, 3""", "segs", "burden"))
def _(v):
    null = v.null()
    out = N.search_space(N.case_loads(null.segments, null.burden, _FLOORS))
    return out.select("set", "pop", "floor_bp", "n_cases", "roh_max", *[rd(c) for c in ("roh_mean", "roh_median", "roh_q25", "roh_q75", "mb_median", "mb_q75", "genes_median")])


REPORT = runs_sql("tr", "tcalls", "trio, chrom") + """,
 lr as (select * from tr where len_bp >= 500000),
 inr as (select l.trio, l.chrom, l.start_pos, l.end_pos, l.len_bp, t.pos, t.c0, t.f0, t.f1, t.m0, t.m1 from lr l join trio t on t.trio = l.trio and t.chrom = l.chrom and t.pos between l.start_pos and l.end_pos),
 md as (select trio, chrom, start_pos, end_pos, len_bp, count(*) as n_markers, count(case when f0 is not null and m0 is not null and not ((f0 = c0 or f1 = c0) and (m0 = c0 or m1 = c0)) then 1 end) as n_inconsistent from inr group by 1, 2, 3, 4, 5)"""
TCALLS = "tcalls as (select trio, chrom, pos, c0 = c1 as hom from trio)"


@check("d32_mendel_in_runs", sql(f"with {TCALLS}, {REPORT} select trio, chrom, start_pos, n_markers, n_inconsistent, round(1 - n_inconsistent / n_markers + 1e-9, 6) as parental_sharing, case when n_inconsistent / n_markers > 0.03 then 'POSSIBLE_DELETION' else 'ok' end as deletion_flag from md", "trio"))
def _(v):
    keys = ["trio", "chrom"]
    calls = v.trio.withColumn("hom", F.col("c0") == F.col("c1"))
    runs = call_runs(calls, keys).filter(F.col("len_bp") >= 500_000)
    out = T.mendel_in_runs(T.markers_in_runs(calls, runs, keys), keys)
    return out.select("trio", "chrom", "start_pos", "n_markers", "n_inconsistent", rd("parental_sharing"), "deletion_flag")


TRIO_SCORE = f"""cv as (select i.trio, i.chrom, i.start_pos, i.len_bp, avg(h.rate) as rate, avg(h.hbar) as hbar from inr i left join hwin h on h.chrom = i.chrom and h.window_start = i.pos // 1000000 * 1000000 group by 1, 2, 3, 4),
 sc as (select cv.*, 2.1 * case when rate <= 0 or greatest(hbar, 1e-4) >= 1 then 'inf'::double else greatest(ln({THR}) / ln(greatest(hbar, 1e-4)) * 0.5 / rate, 0.5 / rate) end as lstar,
  case when rate > 0 and hbar > 0 then 0.0625*{EMISSION}/(0.0625*{EMISSION} + 0.9375*pow(greatest(hbar, 1e-4), greatest(1.0, len_bp/1e6*rate/0.5))) else 0.0625 end as posterior from cv),
 rep as (select sc.*, md.n_markers, case when n_inconsistent / n_markers > 0.03 then 'POSSIBLE_DELETION' else 'ok' end as deletion_flag,
  case when sc.len_bp/1e6 >= lstar then 'autozygous' when sc.len_bp/1e6 >= 0.7*lstar then 'borderline' else 'background' end as call from sc join md using (trio, chrom, start_pos))"""


@check("d33_observed_autozygosity", sql(f"""with {TCALLS}, {REPORT}, {TRIO_SCORE}, sp as (select trio, cast(sum(x) as bigint) as span_bp from (select trio, chrom, max(pos) - min(pos) as x from trio group by 1, 2) group by 1)
 select sp.trio, sp.span_bp, cast(coalesce(sum(case when call = 'autozygous' and deletion_flag = 'ok' then len_bp end), 0) as bigint) as auto_bp, round(coalesce(sum(case when call = 'autozygous' and deletion_flag = 'ok' then len_bp end), 0) / sp.span_bp + 1e-9, 6) as f_obs,
 case when sp.trio % 8 = 3 then 0.0625::double when sp.trio % 8 = 7 then 0.25::double end as f_expected from sp left join rep on rep.trio = sp.trio group by 1, 2""", "trio", "hwin"))
def _(v):
    report = PT.roh_report(v.trio, v.hbar_windows(), DEFAULTS.prior)
    out = T.observed_autozygosity(report, B.spans(v.trio, ["trio"]), ["trio"])
    rel = F.when(F.pmod("trio", F.lit(8)) == 3, "first_cousins").when(F.pmod("trio", F.lit(8)) == 7, "incest_first_degree")
    return T.compare_expected(out.withColumn("relationship", rel)).select("trio", "span_bp", "auto_bp", rd("f_obs"), "f_expected")


@check("d34_population_summary", sql(f"""with {HBAR}, w as (select hbw.*, r.rate from hbw left join rates r using (chrom, window_start))
 select pop, round(avg(hbar) + 1e-9, 6) as mean_hbar, round(median(case when rate > 0 then case when greatest(hbar, 1e-4) >= 1 then 'inf'::double else greatest(ln({THR}) / ln(greatest(hbar, 1e-4)) * 0.5 / rate, 0.5 / rate) end end) + 1e-9, 6) as median_callable_mb from w group by pop""", "common", "cum", "haps"))
def _(v):
    w = D.window_hbar(blocks(v).select("pop", "chrom", "pos", "blk"), v.haplotypes).join(v.rates, ["chrom", "window_start"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    return D.population_summary(w, DEFAULTS.prior).select("pop", rd("mean_hbar"), rd("median_callable_mb"))


@check("d35_curve_comparison", sql("""with mr as (select avg(m) as mean_rate from (select chrom, avg(rate) as m from cmap group by chrom))
 select c.pop, c.l_bp, round(c.p_bg + 1e-9, 6) as p_bg, round(pow((c.pop + 1) / 50.0, c.l_bp / 1e6 * mr.mean_rate / 0.5) + 1e-9, 6) as p_analytic from curve c cross join mr""", "curve", "cmap"))
def _(v):
    hb = v.panel.select("pop", ((F.col("pop") + 1) / F.lit(50.0)).alias("mean_hbar")).distinct()
    mr = M.chromosome_means(v.combined_map).agg(F.avg("mean_rate").alias("mean_rate"))
    return B.analytic_comparison(v.curve(), hb, mr).select("pop", "l_bp", rd("p_bg"), rd("p_analytic"))
