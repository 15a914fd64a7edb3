"""Composite jobs and incremental jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.aggregates import (
    BIN_EXPO, HBAR, HETW_RATES, HOM, PLATFORM, _plstar, platforms, LOADS, RATE_BINS, REPORT, SURFACE, TCALLS, TRIO_SCORE, TWO_SETS, AGREE_WIN,
    _FLOORS, boot_draw, boot_sql, TRACE_SQL, ARMS, centromeres, ENRICH,
)
from checks.joins import FAMILY_SQL, INTERVALS_SQL, PAIRS_SQL, arithmetic_draw, draw_sql, families, founders, intervals, manifest, MANIFEST_SQL
from checks.registry import check
from checks.scans import LOCI_SQL, _SUBSET, _gt_rows, loci, two_call_sets
from checks.scalars import _mcl
from checks.sequences import MATCH_SQL, TRACT, TRACT_SQL, XO, states_sql
from checks.views import EMISSION, THR, curve_sql, lstar_sql, rd, runs_sql, sql
from zygospan.config import DEFAULTS
from zygospan.operators import background as B
from zygospan.operators import enrich as N
from zygospan.operators import maps as M
from zygospan.operators import platform as P
from zygospan.operators import trio as T
from zygospan.operators.runs import keep_segments
from zygospan.plans import atlas as PA
from zygospan.plans import background as PB
from zygospan.plans import scoring as PS
from zygospan.plans import trio as PT
from zygospan.sources import sinks, tables, variants
from zygospan.streaming import incremental as I


@check("j01_trio_crossovers", sql(f"with {XO.format(extra='', m=20)} select trio, parent, chrom, prev_pos, new_pos, cast(new_hap as int) as new_hap from xo", "labelled"))
def _(v):
    # Every third trio is written mother first.
    swap = F.pmod("trio", F.lit(3)) == 0
    mixed = v.trio.withColumns({"c0": F.when(swap, F.col("c1")).otherwise(F.col("c0")), "c1": F.when(swap, F.col("c0")).otherwise(F.col("c1"))})
    return PT.run_based_crossovers(mixed, 20).select("trio", "parent", "chrom", "prev_pos", "new_pos", "new_hap")


@check("j02_robust_crossovers", sql(f"""with {XO.format(extra='and o0 = o1', m=10)} select trio, parent, chrom, prev_pos, new_pos,
 row_number() over (partition by trio, parent, chrom order by support desc, new_pos) <= case when parent = 'paternal' then 1 else 2 end as survives from xo""", "labelled"))
def _(v):
    return PT.robust_crossovers(v.trio, 10).select("trio", "parent", "chrom", "prev_pos", "new_pos", "survives")


@check("j03_state_model_crossovers", states_sql("select trio, parent, chrom, prev_pos, new_pos, prev_state, new_state, posterior, gap_bp from switches where n >= 100"))
def _(v):
    return PT.hmm_crossovers(v.trio, 1.2).withColumn("posterior", F.round("posterior", 6))


@check("j04_trace_table", sql(f"""with {TRACE_SQL} select *, window_start + 250000 as window_end, case when pat_hap0 + pat_hap1 < 5 then '.' when greatest(pat_hap0, pat_hap1) / (pat_hap0 + pat_hap1) < 0.8 then 'x'
 when pat_hap0 > pat_hap1 then '0' else '1' end as pat_code from tw""", "trio"))
def _(v):
    return T.trace_windows(v.trio).select("trio", "chrom", "window_start", "window_end", "pat_hap0", "pat_hap1", "mat_hap0", "mat_hap1", "pat_code")


@check("j05_phasing_comparison", sql(f"with {TWO_SETS}, {AGREE_WIN} select cast(chrom as varchar) as chrom, window_start, cast(sum(n_agree) as bigint) as n_agree, cast(sum(n_disagree) as bigint) as n_disagree from aw group by 1, 2", "genotypes", "sites"))
def _(v):
    left, right = two_call_sets(v)
    one = lambda d: d.withColumn("chrom", F.concat_ws(":", "sample", "chrom"))
    out = PT.phasing_comparison(one(left), one(right))
    return out.groupBy(F.split("chrom", ":")[1].alias("chrom"), "window_start").agg(F.sum("n_agree").alias("n_agree"), F.sum("n_disagree").alias("n_disagree"))


@check("j06_legacy_atlas", sql(f"""with {HETW_RATES}, x as (select hw.*, p.prior, l.length_mb, ln(p.prior*{EMISSION}*0.05/(0.95*(1-p.prior))) / ln(1-mean_2pq) as q from hw
 cross join (select unnest([0.0625, 0.0156]::double[]) as prior) p cross join (select unnest([2.0, 10.0]::double[]) as length_mb) l)
 select pop, chrom, window_start, n_variants, prior, length_mb, round(prior*{EMISSION}/(prior*{EMISSION} + (1-prior)*pow(greatest(1e-12, 1-mean_2pq), greatest(1.0, length_mb*rate/0.5))) + 1e-9, 6) as posterior,
 round(case when rate <= 0 then null when q <= 1 then 0.1 when q*0.5/rate <= 50 then greatest(q*0.5/rate, 0.1) end + 1e-9, 6) as length_to_95 from x""", "site_freq", "rates"))
def _(v):
    out = PA.legacy_atlas(v.site_freq, v.combined_map, [0.0625, 0.0156], [2.0, 10.0])
    return out.select("pop", "chrom", "window_start", "n_variants", "prior", "length_mb", rd("posterior"), rd("length_to_95"))


@check("j07_haplotype_atlas", sql(f"""with {HBAR}, w as (select hbw.*, coalesce(r.rate, 0.0) as rate from hbw left join rates r using (chrom, window_start))
 select pop, chrom, window_start, n_blocks, round(hbar + 1e-9, 6) as hbar, round(case when rate > 0 and hbar > 0 then 0.0625*{EMISSION}/(0.0625*{EMISSION} + 0.9375*pow(greatest(1e-4, hbar), greatest(1.0, 2.0*rate/0.5))) else 0.0625 end + 1e-9, 6) as posterior,
 round({_mcl()} + 1e-9, 6) as min_callable_mb from w""", "common", "cum", "haps"))
def _(v):
    out = PA.hbar_atlas(v.common, v.haplotypes, v.combined_map, 0.0625, 2.0)
    return out.select("pop", "chrom", "window_start", "n_blocks", rd("hbar"), rd("posterior"), rd("min_callable_mb"))


CHANCE = PAIRS_SQL + ",\n " + runs_sql("cr", "pm", "pop, pair, chrom", "0, 1, 2") + """,
 cs as (select * from cr where len_bp > 5000), sp as (select pop, sum(x) as exposure_bp from (select pop, pair, chrom, max(pos) - min(pos) as x from pm group by 1, 2, 3) group by 1),
 ce as (select sp.pop, g.gap, sp.exposure_bp from sp cross join (select unnest([0, 1, 2]) as gap) g)"""


CHANCE_ANALYTIC = CHANCE + f""",
 {curve_sql('ccv', 'cs', 'ce', 'pop, gap')}, mr as (select avg(m) as mean_rate from (select chrom, avg(rate) as m from cmap group by chrom)),
 an as (select c.*, pow((c.pop + 1) / 50.0, c.l_bp / 1e6 * mr.mean_rate / 0.5) as p_analytic from ccv c cross join mr where c.gap = 0),
 al as (select pop, coalesce(min(case when p_analytic <= {THR} then l_bp end) / 1e6, 'inf'::double) as lstar_analytic_mb from an group by 1)"""


def chance(v):
    null = PB.chance_null(v.haplotypes, founders(v), 40, (0, 1, 2), arithmetic_draw)
    hbar = v.panel.select("pop", ((F.col("pop") + 1) / F.lit(50.0)).alias("mean_hbar")).distinct()
    return PB.chance_report(null, (0, 1, 2), hbar, M.chromosome_means(v.combined_map).agg(F.avg("mean_rate").alias("mean_rate")), (90.0, 99.0, 99.9))


@check("j08_chance_null", sql(f"with {CHANCE_ANALYTIC} select pop, cast(gap as int) as gap, lstar_mb, lstar_analytic_mb from ({lstar_sql('ccv', 'pop, gap')}) left join al using (pop)", "haps", "cmap", "grid"))
def _(v):
    return chance(v).lstar.select("pop", "gap", "lstar_mb", "lstar_analytic_mb")


@check("j08_chance_curve", sql(f"with {CHANCE_ANALYTIC} select pop, l_bp, round(p_bg + 1e-9, 6) as p_bg, round(p_analytic + 1e-9, 6) as p_analytic from an", "haps", "cmap", "grid"))
def _(v):
    return chance(v).curve.select("pop", "l_bp", rd("p_bg"), rd("p_analytic"))


@check("j08_chance_percentiles", sql(f"""with {CHANCE}, kp as (select pop, len_bp, row_number() over (partition by pop order by len_bp) as rk, count(*) over (partition by pop) as nk from cs where gap = 0),
 tot as (select pop, count(*) as n_runs, max(len_bp) as max_bp from cr where gap = 0 group by pop), ask as (select t.*, q.pct from tot t cross join (select unnest([90.0, 99.0, 99.9]::double[]) as pct) q)
 select a.pop, a.pct, coalesce(max(x.len_bp), 0) as len_bp, a.n_runs, a.max_bp from ask a join (select distinct pop, nk from kp) k on k.pop = a.pop
 left join kp x on x.pop = a.pop and a.pct / 100 * a.n_runs - (a.n_runs - k.nk) > 0 and x.rk = least(k.nk, ceil(a.pct / 100 * a.n_runs - (a.n_runs - k.nk))) group by 1, 2, 4, 5""", "haps"))
def _(v):
    return chance(v).percentiles.select("pop", "pct", "len_bp", "n_runs", "max_bp")


_HALF = f"sp as (select pop, sample, row_number() over (partition by pop order by {draw_sql('sample')}, sample) as r from panel)"
TRUTH = _HALF + ",\n " + MATCH_SQL.replace("count(*) over (partition by pop) as n from panel)", "count(*) over (partition by pop) as n from sp where r between 9 and 16)").replace(
    f"((({draw_sql('t', '9')}) % 4000000) + 200000) // 2 as half_bp", f"cast(floor({TRACT_SQL} * 1e6 / 2) as bigint) as half_bp") + ",\n " + HOM.replace(
    "join haps h on", "join (select h.* from haps h join sp on sp.sample = h.sample where sp.r <= 8) h on") + """,
 own as (select pop, chrom, blk, min(pos) as fp from mk group by 1, 2, 3),
 hown as (select h.pop, h.chrom, o.fp // 1000000 * 1000000 as window_start, avg(h.hom) as hbar from hom h join own o using (pop, chrom, blk) where h.n_hap >= 2 group by 1, 2, 3),
 """ + runs_sql("tr", "tm", "pop, chrom, t, focal, label") + f""",
 ob as (select pop, chrom, t, label, focal, max(len_bp) / 1e6 as l_obs from tr where focal between start_pos and end_pos group by 1, 2, 3, 4, 5 having max(len_bp) >= 100000),
 scd as (select o.*, case when r.rate > 0 and h.hbar > 0 then 0.0625*{EMISSION}/(0.0625*{EMISSION} + 0.9375*pow(greatest(1e-4, h.hbar), greatest(1.0, l_obs*r.rate/0.5))) else 0.0625 end as posterior
  from ob o left join hown h on h.pop = o.pop and h.chrom = o.chrom and h.window_start = o.focal // 1000000 * 1000000 left join rates r on r.chrom = o.chrom and r.window_start = o.focal // 1000000 * 1000000),
 bins as (select pop, least(cast(floor(posterior*10) as bigint), 9) as bin, avg(posterior) as mp, avg(label) as ob, count(*) as n from scd group by 1, 2)"""
_TRUTH_VIEWS = ("haps", "common", "cum")


def truth(v):
    return PA.truth_calibration(v.panel, v.common, v.haplotypes, v.combined_map, 8, 8, 60, 500, arithmetic_draw, F.floor(F.col("sample") / 64), TRACT, target=0.35)


@check("j09_truth_calibration", sql(f"with {TRUTH} select pop, chrom, t, label, l_obs, round(posterior + 1e-9, 6) as posterior from scd", *_TRUTH_VIEWS))
def _(v):
    return truth(v).trials.select("pop", "chrom", "t", "label", "l_obs", rd("posterior"))


@check("j09_reliability_bins", sql(f"with {TRUTH} select pop, bin, round(mp + 1e-9, 6) as mean_posterior, round(ob + 1e-9, 6) as observed, n from bins", *_TRUTH_VIEWS))
def _(v):
    return truth(v).bins.select("pop", "bin", rd("mean_posterior"), rd("observed"), "n")


@check("j09_truth_summary", sql(f"""with {TRUTH}, ec as (select pop, sum(n * abs(ob - mp)) / sum(n) as ece, cast(sum(n) as bigint) as n from bins group by 1),
 fd as (select pop, 1 - avg(case when l_obs >= 0.7 then label end) as f07, 1 - avg(case when l_obs >= 1.5 then label end) as f15, 1 - avg(case when posterior >= 0.95 then label end) as fp from scd group by 1),
 g as (select 100 + 50*i as l from (select unnest(range(159)) as i)),
 th as (select scd.pop, g.l, count(*) as calls, avg(label) as ok from scd join g on scd.l_obs * 1000 >= g.l - 1e-6 group by 1, 2),
 tl as (select pop, min(l) / 1000 as lstar_mb from th where calls >= 20 and 1 - ok <= 0.35 group by 1)
 select pop, n, round(ece + 1e-9, 6) as ece, round(f07 + 1e-9, 6) as fdr_0_7mb, round(f15 + 1e-9, 6) as fdr_1_5mb, round(fp + 1e-9, 6) as fdr_posterior, coalesce(lstar_mb, 'inf'::double) as lstar_mb
 from ec join fd using (pop) left join tl using (pop)""", *_TRUTH_VIEWS))
def _(v):
    return truth(v).summary.select("pop", "n", rd("ece"), rd("fdr_0_7mb"), rd("fdr_1_5mb"), rd("fdr_posterior"), "lstar_mb")


@check("j10_trio_roh_report", sql(f"""with {TCALLS}, {REPORT}, {TRIO_SCORE} select trio, chrom, start_pos, len_bp, n_markers, round(rate + 1e-9, 5) as rate, round(hbar + 1e-9, 5) as hbar, round(lstar + 1e-9, 5) as lstar_mb, round(posterior + 1e-9, 5) as posterior, call, deletion_flag from rep""", "trio", "hwin"))
def _(v):
    out = PT.roh_report(v.trio, v.hbar_windows(), DEFAULTS.prior)
    return out.select("trio", "chrom", "start_pos", "len_bp", "n_markers", rd("rate", 5), rd("hbar", 5), rd("lstar_mb", 5), rd("posterior", 5), "call", "deletion_flag")


CHILD = """kids as (select c.sample, coalesce(f.pop, m.pop) as pop from panel c left join panel f on f.sample = c.father left join panel m on m.sample = c.mother where c.father is not null),
 kc as (select k.pop, g.sample, g.chrom, g.pos, g.a0 = g.a1 as hom from genotypes g join kids k on k.sample = g.sample join common c on c.pop = k.pop and c.chrom = g.chrom and c.pos = g.pos),
 """ + runs_sql("kr", "kc", "pop, sample, chrom") + """,
 ks as (select * from kr where len_bp > 5000),
 kb as (select s.pop, s.sample, s.span_bp, coalesce(r.roh, 0) / s.span_bp as f_roh, cast(coalesce(r.roh, 0) as bigint) as roh_bp from (select pop, sample, cast(sum(x) as bigint) as span_bp from (select pop, sample, chrom, max(pos) - min(pos) as x from kc group by 1, 2, 3) group by 1, 2) s
  left join (select sample, sum(case when len_bp >= 1000000 then len_bp else 0 end) as roh from kr group by 1) r on r.sample = s.sample),
 kk as (select * from kb where f_roh <= 0.0156), kks as (select s.* from ks s join kk on kk.sample = s.sample),
 ea as (select pop, cast(sum(span_bp) as bigint) as exposure_bp from kb group by 1), ek as (select pop, cast(sum(span_bp) as bigint) as exposure_bp from kk group by 1)"""


@check("j11_children_background", sql(f"""with {CHILD}, {curve_sql('ca', 'ks', 'ea', 'pop')}, {curve_sql('ck', 'kks', 'ek', 'pop')}, la as ({lstar_sql('ca', 'pop', 'lstar_all_mb')}), lk as ({lstar_sql('ck', 'pop', 'lstar_screened_mb')})
 select b.*, la.lstar_all_mb, lk.lstar_screened_mb from (select pop, count(*) as n, count(case when f_roh > 0.0156 then 1 end) as n_outliers, cast(sum(span_bp) as bigint) as span_bp, cast(sum(roh_bp) as bigint) as roh_bp from kb group by 1) b
 left join la using (pop) left join lk using (pop)""", "genotypes", "common", "grid"))
def _(v):
    kids = tables.children_population(v.panel, v.panel, [0, 1, 2, 3, 4])
    calls = PB.homozygosity_calls(v.genotypes, kids, v.common)
    return PB.background_summary(PB.sample_null(calls))


@check("j11_subpopulation_background", sql(f"""with sc as (select 'sub' || (sample % 26) as pop, sample, chrom, pos, hom from calls where pop = 3), {runs_sql('sr', 'sc', 'pop, sample, chrom')},
 ss as (select * from sr where len_bp > 5000), se as (select pop, cast(sum(x) as bigint) as exposure_bp from (select pop, sample, chrom, max(pos) - min(pos) as x from sc group by 1, 2, 3) group by 1), {curve_sql('scv', 'ss', 'se', 'pop')} {lstar_sql('scv', 'pop')}""", "calls", "grid"))
def _(v):
    calls = v.calls.filter(F.col("pop") == 3).withColumn("pop", F.concat(F.lit("sub"), F.pmod("sample", F.lit(26))))
    null = PB.sample_null(calls)
    return B.decisive_length(B.exceedance_curve(null.segments, null.burden, ["pop"]), ["pop"])


@check("j12_lstar_bootstrap", sql(f"""with {boot_sql('kept', 'segs_kept')}, v as (select pop, case when isinf(lstar_mb) then 12.05 else lstar_mb end as x, isinf(lstar_mb) as nc from br), pt as ({lstar_sql('curve_kept', 'pop')})
 select v.pop, max(pt.lstar_mb) as lstar_mb, round(quantile_cont(x, 0.025) + 1e-9, 6) as ci_lo, round(quantile_cont(x, 0.975) + 1e-9, 6) as ci_hi, round(median(x) + 1e-9, 6) as median, round(stddev_samp(x) + 1e-9, 6) as se, count(case when nc then 1 end) as n_unconverged
 from v join pt on pt.pop = v.pop group by v.pop""", "curve_kept"))
def _(v):
    out = PB.lstar_bootstrap(v.null(), 20, F.floor(F.col("sample") / 64), boot_draw)
    return out.select("pop", "lstar_mb", rd("ci_lo"), rd("ci_hi"), rd("median"), rd("se"), "n_unconverged")


LADDER = [None, 0.05, 0.0156, 0.005]
SURFACE_BOOT = f"""{SURFACE}, ix as (select pop, screen, sample, span_bp, row_number() over (partition by pop, screen order by sample) - 1 as idx, count(*) over (partition by pop, screen) as n_units from kp),
 bw as (select pop, screen, b.b, ({draw_sql('b.b', 'ix.idx')}) % n_units as idx, count(*) as w from ix cross join (select unnest(range(1, 21)) as b) b group by 1, 2, 3, 4),
 wt as (select bw.pop, bw.screen, bw.b, ix.sample, ix.span_bp, bw.w from bw join ix using (pop, screen, idx)),
 be as (select pop, screen, b, sum(w * span_bp) as expo from wt group by 1, 2, 3),
 sc as (select sample, gap, least((len_bp - 100000) // 50000, 238) as k, count(*) as c, sum(len_bp) as t from segs3 where len_bp >= 100000 group by 1, 2, 3),
 bc as (select wt.pop, wt.screen, wt.b, sc.gap, sc.k, sum(w * c) as c, sum(w * t) as t from wt join sc using (sample) group by 1, 2, 3, 4, 5),
 fu as (select x.*, g.k, coalesce(bc.c, 0) as c, coalesce(bc.t, 0) as t from (select distinct pop, screen, b, gap from bc) x cross join (select unnest(range(239)) as k) g left join bc using (pop, screen, b, gap, k)),
 cu as (select pop, screen, b, gap, 100000 + 50000 * k as l_bp, sum(c) over w as c, sum(t) over w as t from fu window w as (partition by pop, screen, b, gap order by k desc)),
 bl as (select pop, screen, gap, b, coalesce(min(case when (t - c * l_bp) / expo <= {THR} then l_bp end) / 1e6, 'inf'::double) as l from cu join be using (pop, screen, b) group by 1, 2, 3, 4),
 ci as (select pop, screen, gap, quantile_cont(case when isinf(l) then 12.05 else l end, 0.025) as ci_lo, quantile_cont(case when isinf(l) then 12.05 else l end, 0.975) as ci_hi, count(case when isinf(l) then 1 end) as n_unconverged from bl group by 1, 2, 3)"""


@check("j13_lstar_surface", sql(f"""with {SURFACE_BOOT} select x.*, round(ci_lo + 1e-9, 6) as ci_lo, round(ci_hi + 1e-9, 6) as ci_hi, n_unconverged from (
 select c.pop, cast(c.gap as int) as gap, c.screen, coalesce(min(case when c.x / e.e <= {THR} then c.l_bp end) / 1e6, 'inf'::double) as lstar_mb, max(e.n_kept) as n_kept
 from cv c join ex e on e.pop = c.pop and e.screen = c.screen group by 1, 2, 3) x join ci using (pop, gap, screen)""", "segs3", "burden", "grid"))
def _(v):
    out = PB.lstar_surface(v.null((0, 1, 2)), LADDER, 20, F.floor(F.col("sample") / 64), boot_draw)
    return out.select("pop", "gap", "screen", "lstar_mb", "n_kept", rd("ci_lo"), rd("ci_hi"), "n_unconverged")


DENSITIES = (20.0, 40.0)
PROXY = f"""{MANIFEST_SQL}, hit as (select c.*, 'A1' as platform from common c join manifest m on m.chrom = c.chrom and m.pos = c.pos), sz as (select pop, chrom, count(*) as t from hit group by 1, 2),
 rk as (select c.*, row_number() over (partition by pop, chrom order by maf desc, pos) as r from common c),
 tg as (select pop, chrom, d, least(cast(floor(d * (max(pos) - min(pos)) / 1e6) as bigint), count(*)) as t from common cross join (select unnest([20, 40]) as d) group by 1, 2, 3),
 psel as (select 'full' as platform, pop, chrom, pos from common union all select 'A1', pop, chrom, pos from hit union all select 'A1_proxy', rk.pop, rk.chrom, rk.pos from rk join sz on sz.pop = rk.pop and sz.chrom = rk.chrom where rk.r <= sz.t
  union all select 'top_' || tg.d, rk.pop, rk.chrom, rk.pos from rk join tg on tg.pop = rk.pop and tg.chrom = rk.chrom where rk.r <= tg.t
  union all select 'every_' || k.k, pop, chrom, pos from (select *, row_number() over (partition by pop, chrom order by pos) - 1 as at from common) c cross join (select unnest([2, 5, 10, 20]) as k) k where c.at % k.k = 0)"""


@check("j14_platform_selections", sql(f"with {PROXY} select * from psel", "common"))
def _(v):
    return PB.platform_selections(v.common, densities=DENSITIES, manifest=manifest(v).withColumn("array", F.lit("A1")))


@check("j14_platform_manifest_lstar", sql(f"""with {PROXY}, mc as (select s.platform, c.pop, c.sample, c.chrom, c.pos, c.hom from calls c join psel s on s.pop = c.pop and s.chrom = c.chrom and s.pos = c.pos), {runs_sql('mr', 'mc', 'platform, pop, sample, chrom')},
 ms as (select * from mr where len_bp > 5000), me as (select t.platform, t.pop, cast(sum(b.span_bp) as bigint) as exposure_bp from (select distinct platform, pop, sample from mc) t join burden b on b.sample = t.sample group by 1, 2), {curve_sql('mcv', 'ms', 'me', 'platform, pop')} {lstar_sql('mcv', 'platform, pop')}""", "calls", "common", "burden", "grid"))
def _(v):
    sel = PB.platform_selections(v.common, densities=DENSITIES, manifest=manifest(v).withColumn("array", F.lit("A1")))
    null = v.platform_null(sel, ["full", "A1", "A1_proxy", *[f"top_{d:g}" for d in DENSITIES], *[f"every_{k}" for k in (2, 5, 10, 20)]])
    by = ["platform", "pop"]
    return B.decisive_length(B.exceedance_curve(null.segments, null.burden, by), by)


@check("j14_array_floor", sql(f"""with {PLATFORM}, pk as (select * from pb where not is_outlier), pks as (select s.* from ps s join pk on pk.platform = s.platform and pk.sample = s.sample),
 k as (select pop, count(*) as k from pb where platform = 'full' and is_outlier group by pop), rkd as (select *, row_number() over (partition by platform, pop order by f_roh desc, sample) as r from pb),
 pm as (select rkd.* from rkd left join k on k.pop = rkd.pop where r > coalesce(k.k, 0)), pms as (select s.* from ps s join pm on pm.platform = s.platform and pm.sample = s.sample),
 {_plstar('all', 'pb', 'ps')}, {_plstar('screened', 'pk', 'pks')}, {_plstar('matched', 'pm', 'pms')}
 select b.*, a.lstar_all_mb, s.lstar_screened_mb, m.lstar_matched_mb from (select platform, pop, count(*) as n, count(case when is_outlier then 1 end) as n_outliers, round(median(f_roh) + 1e-9, 6) as median_f, round(quantile_cont(f_roh, 0.9) + 1e-9, 6) as p90_f from pb group by 1, 2) b
 left join alll a using (platform, pop) left join screenedl s using (platform, pop) left join matchedl m using (platform, pop)""", "calls", "common", "burden", "grid"))
def _(v):
    sel, null = platforms(v)
    counts = sel.groupBy("platform", "pop", "chrom").agg(F.count("*").alias("n_markers")).join(P.marker_axis(v.common).drop("n_markers"), ["pop", "chrom"])
    out = PB.array_floor(null, counts, "full", F.floor(F.col("sample") / 64))
    return out.select("platform", "pop", "n", "n_outliers", rd("median_f"), rd("p90_f"), "lstar_all_mb", "lstar_screened_mb", "lstar_matched_mb")


_KF = "0.0625*0.05/(0.95*0.9375)"


@check("j15_emission_sensitivity", sql(f"""with d as (select c.*, (1500 + 400*pop) * (l_bp/1e6) as n from curve_kept c)
 select pop, coalesce(min(case when p_bg <= {_KF}*{EMISSION} then l_bp end)/1e6, 'inf'::double) as lstar_flat_mb, coalesce(min(case when p_bg <= {_KF}*greatest(1e-6, 1 - greatest(0, n - 1)*pow(0.001, 2)) then l_bp end)/1e6, 'inf'::double) as lstar_tol_mb,
 coalesce(min(case when p_bg <= {_KF}*pow(0.999, n) then l_bp end)/1e6, 'inf'::double) as lstar_strict_mb,
 coalesce(min(case when p_bg <= {_KF}*(pow(0.999, round_even(n, 0)) + round_even(n, 0)*0.001*pow(0.999, round_even(n, 0) - 1)) then l_bp end)/1e6, 'inf'::double) as lstar_budget_mb from d group by pop""", "curve_kept"))
def _(v):
    density = v.panel.select("pop", (1500 + 400 * F.col("pop")).cast("double").alias("density")).distinct()
    return B.emission_sensitivity(PB.background_curves(v.null()), density)


BIN_BOOT = f"""ix as (select sample, row_number() over (order by sample) - 1 as idx, count(*) over () as n_units from kept),
 bw as (select b.b, ({draw_sql('b.b', 'ix.idx')}) % n_units as idx, count(*) as w from ix cross join (select unnest(range(1, 21)) as b) b group by 1, 2),
 wt as (select bw.b, ix.sample, bw.w from bw join ix using (idx)),
 bc as (select wt.b, sb.bin, g.l_bp, sum(w * greatest(0, sb.len_bp - g.l_bp)) as ex from wt join sb using (sample) cross join grid g group by 1, 2, 3),
 br as (select bin, b, min(case when ex / exposure_bp <= {THR} then l_bp end) / 1e6 as l from bc join bexpo using (bin) group by 1, 2),
 ci as (select bin, round(quantile_cont(l, 0.025) + 1e-9, 6) as ci_lo, round(quantile_cont(l, 0.975) + 1e-9, 6) as ci_hi, 20 - count(l) as n_unconverged from br group by 1)"""


@check("j16_rate_binned_lstar", sql(f"""with {RATE_BINS}, {BIN_EXPO}, {curve_sql('bcv', 'sb', 'bexpo', 'bin')}, bl as ({lstar_sql('bcv', 'bin')}), {BIN_BOOT}
 select rb.bin, coalesce(bl.lstar_mb, 'inf'::double) as lstar_mb, round({_mcl('mean_rate', '0.05')} + 1e-9, 6) as lstar_closed_mb, ci_lo, ci_hi, coalesce(n_unconverged, 20) as n_unconverged
 from rb left join bl using (bin) left join ci using (bin)""", "segs_kept", "cum", "grid"))
def _(v):
    out = PB.rate_binned(v.null(), M.cumulative_cm(v.rates), v.rates, 0.05, replicates=20, block=F.floor(F.col("sample") / 64), draw=boot_draw)
    return out.select("bin", "lstar_mb", rd("lstar_closed_mb"), rd("ci_lo"), rd("ci_hi"), "n_unconverged")


SCORE = INTERVALS_SQL + f""",
 bf as (select pop, l_bp, log10({EMISSION}/greatest(p_bg, 1e-12)) as y from curve),
 ls as (select pop, coalesce(min(case when 0.0625*pow(10, y)/(0.0625*pow(10, y) + 0.9375) >= 0.95 then l_bp end)/1e6, 'inf'::double) as lstar_eff from bf group by pop),
 worst as (select min(pop) as pop from ls where lstar_eff = (select max(lstar_eff) from ls)),
 q0 as (select ivr.id, ivr.chrom, ivr.s, ivr.e, ivr.rate, ivr.r_median, cast(case when ivr.pop = 4 then worst.pop else ivr.pop end as bigint) as pop, least(greatest((e - s)*(rate/r_median), 100000), 12000000) as x from ivr cross join worst),
 q1 as (select q0.*, a.y + (b.y - a.y)*(x - a.l_bp)/50000 as log10_bf from q0 join bf a on a.pop = q0.pop and a.l_bp = least(100000 + cast(floor((x - 100000)/50000) as bigint)*50000, 11950000) join bf b on b.pop = q0.pop and b.l_bp = a.l_bp + 50000),
 q2 as (select q1.*, 0.0625*pow(10, log10_bf)/(0.0625*pow(10, log10_bf) + 0.9375) as posterior, ls.lstar_eff*(r_median/rate) as lstar_locus_mb from q1 join ls on ls.pop = q1.pop)"""


@check("j17_score_intervals", sql(f"with {SCORE} select id, pop, round(log10_bf + 1e-9, 5) as log10_bf, round(posterior + 1e-9, 5) as posterior, round(lstar_locus_mb + 1e-9, 5) as lstar_locus_mb, case when posterior >= 0.95 then 'FLAG' when posterior >= 0.5 then 'REVIEW' else 'BACKGROUND' end as decision from q2", "segs", "rates", "curve"))
def _(v):
    name = F.when(F.col("pop") == 4, "UNKNOWN").otherwise(F.col("pop").cast("string"))
    curve = v.curve().withColumn("pop", F.col("pop").cast("string"))
    out = PS.score_roh(intervals(v).withColumn("pop", name), v.rates, curve)
    return out.select("id", F.col("pop").cast("long").alias("pop"), rd("log10_bf", 5), rd("posterior", 5), rd("lstar_locus_mb", 5), "decision")


@check("j18_case_series", sql(f"""with {LOCI_SQL}, cs as (select *, greatest(0, midpoint - cast(floor(roh_mb*1e6/2) as bigint)) as s, midpoint + cast(floor(roh_mb*1e6/2) as bigint) as e from loci where roh_mb is not null),
 md as (select median(rate) as m from rates where rate > 0), lo as (select cs.case_id, avg(r.rate) as r from cs join rates r on r.chrom = cs.chrom and r.rate > 0 and r.window_start between cs.s // 1000000 * 1000000 and (cs.e - 1) // 1000000 * 1000000 group by 1),
 bf as (select l_bp, log10({EMISSION}/greatest(p_bg, 1e-12)) as y from curve where pop = 0),
 x as (select cs.*, pn.penalty, pr.prior, least(greatest((e - s)*(coalesce(lo.r, md.m)/md.m)/pn.penalty, 100000), 12000000) as x from cs left join lo using (case_id) cross join md cross join (select unnest([1.5, 1.0]::double[]) as penalty) pn cross join (select unnest([0.0625, 0.005]::double[]) as prior) pr),
 y as (select x.*, a.y + (b.y - a.y)*(x.x - a.l_bp)/50000 as log10_bf from x join bf a on a.l_bp = least(100000 + cast(floor((x.x - 100000)/50000) as bigint)*50000, 11950000) join bf b on b.l_bp = a.l_bp + 50000)
 select case_id, penalty, prior, round(log10_bf + 1e-9, 5) as log10_bf, round(prior*pow(10, log10_bf)/(prior*pow(10, log10_bf) + 1 - prior) + 1e-9, 5) as posterior, roh_mb >= 10 as above_cutoff from y""", "rates", "curve"))
def _(v):
    curve = v.curve().filter(F.col("pop") == 0)
    out = PS.score_cases(loci(v), v.rates, curve.withColumn("pop", F.lit("p0")), "p0", [0.0625, 0.005])
    return out.select("case_id", "penalty", "prior", rd("log10_bf", 5), rd("posterior", 5), "above_cutoff")


def scenarios(v):
    """A prior per region and a platform per penalty among the nations."""
    priors = v.table("region").select(((F.col("r_regionkey") * 3 + 1) / F.lit(100.0)).alias("prior"), F.col("r_name").alias("prior_label"))
    step = F.pmod("n_nationkey", F.lit(3))
    platforms = v.table("nation").select((1 + step / F.lit(4.0)).alias("penalty"), F.concat(F.lit("array"), step.cast("string")).alias("platform"))
    return priors, platforms


SCENARIO_SQL = """pr as (select (r_regionkey * 3 + 1) / 100.0 as prior, r_name as prior_label from region),
 pn as (select distinct 1 + (n_nationkey % 3) / 4.0 as penalty, 'array' || (n_nationkey % 3) as platform from nation)"""


@check("a12_scenario_tables", sql(f"""with {LOCI_SQL}, {SCENARIO_SQL}, cs as (select *, greatest(0, midpoint - cast(floor(roh_mb*1e6/2) as bigint)) as s, midpoint + cast(floor(roh_mb*1e6/2) as bigint) as e from loci where roh_mb is not null),
 md as (select median(rate) as m from rates where rate > 0), lo as (select cs.case_id, avg(r.rate) as r from cs join rates r on r.chrom = cs.chrom and r.rate > 0 and r.window_start between cs.s // 1000000 * 1000000 and (cs.e - 1) // 1000000 * 1000000 group by 1),
 bf as (select l_bp, log10({EMISSION}/greatest(p_bg, 1e-12)) as y from curve where pop = 0),
 x as (select cs.*, pn.*, pr.*, least(greatest((e - s)*(coalesce(lo.r, md.m)/md.m)/pn.penalty, 100000), 12000000) as x from cs left join lo using (case_id) cross join md cross join pn cross join pr),
 y as (select x.*, a.y + (b.y - a.y)*(x.x - a.l_bp)/50000 as log10_bf from x join bf a on a.l_bp = least(100000 + cast(floor((x.x - 100000)/50000) as bigint)*50000, 11950000) join bf b on b.l_bp = a.l_bp + 50000)
 select case_id, platform, prior_label, round(log10_bf + 1e-9, 5) as log10_bf, round(prior*pow(10, log10_bf)/(prior*pow(10, log10_bf) + 1 - prior) + 1e-9, 5) as posterior, roh_mb >= 10 as above_cutoff from y""", "rates", "curve"))
def _(v):
    curve = v.curve().filter(F.col("pop") == 0).withColumn("pop", F.lit("p0"))
    out = PS.score_case_tables(loci(v), v.rates, curve, "p0", *scenarios(v))
    return out.select("case_id", "platform", "prior_label", rd("log10_bf", 5), rd("posterior", 5), "above_cutoff")


@check("j19_fixed_threshold", sql("""with q as (select median(rate) as m, quantile_cont(rate, [0.1, 0.9]) as v from rates where rate > 0) select round(m + 1e-9, 6) as r_median, round(m*10/v[1] + 1e-9, 6) as slow_mb, round(m*10/v[2] + 1e-9, 6) as fast_mb, round(v[2]/v[1] + 1e-9, 6) as fold from q""", "rates"))
def _(v):
    rates = v.rates.filter(F.col("rate") > 0).withColumn("pop", F.explode(F.array(F.lit("EUR"), F.lit("AFR"))))
    table = M.equal_evidence_lengths(tables.dedupe_rates(rates, positive=True))
    at = lambda p, c: F.max(F.when(F.col("percentile") == p, F.col(c)))
    out = table.agg(at(50, "rate").alias("r_median"), at(10, "length_mb").alias("slow_mb"), at(90, "length_mb").alias("fast_mb"), (at(90, "rate") / at(10, "rate")).alias("fold"))
    return out.select(*[rd(c) for c in out.columns])


@check("j20_arm_report", sql(f"with {ARMS} select chrom, arm, n_win, round(cm_avg + 1e-9, 6) as cm_avg, round(theta + 1e-9, 6) as theta from arms", "cmap"))
def _(v):
    pat = v.recmap.select("chrom", "center", F.col("pat").alias("rate"))
    mat = v.recmap.filter(F.col("mat").isNotNull()).select("chrom", "center", F.col("mat").alias("rate"))
    return M.arm_summary(tables.combine_sexes(pat, mat), centromeres(v)).select("chrom", "arm", "n_win", rd("cm_avg"), rd("theta"))


def _tail(k, n, p):
    return f"case when {k} = 0 then 1.0 else coalesce((select sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i*ln({p}) + ({n} - i)*ln(1 - {p}))) from (select unnest(range({k}, {n} + 1)) as i)), 0.0) end"


@check("j21_locus_enrichment", sql(f"""with {ENRICH}, ct as (select case when grouping(source) = 1 then 'COMBINED' else source end as source, count(*) as n, count(case when rate >= 1.5*m then 1 end) as k15, count(case when rate >= 2*m then 1 end) as k20, max(f15) as f15, max(f20) as f20 from lr cross join bs group by rollup(source)),
 t as (select ct.*, i.i from ct cross join (select unnest(range(0, (select max(n) + 1 from ct))) as i) i where i.i <= ct.n)
 select source, n, k15 as n_15, k20 as n_20, round(case when k15 = 0 then 1.0 else sum(case when i >= k15 then exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln(f15)+(n-i)*ln(1-f15)) else 0 end) end + 1e-9, 6) as p_15,
 round(case when k20 = 0 then 1.0 else sum(case when i >= k20 then exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln(f20)+(n-i)*ln(1-f20)) else 0 end) end + 1e-9, 6) as p_20 from t group by 1, 2, 3, 4, f15, f20""", "rates"))
def _(v):
    return PS.locus_enrichment(loci(v), v.rates).select("source", "n", "n_15", "n_20", rd("p_15"), rd("p_20"))


STRATIFIED = FAMILY_SQL + """,
 sl as (select j.*, r.rate from joined j join rates r on r.chrom = j.chrom and r.window_start = j.pos // 1000000 * 1000000 and r.rate > 0 where j.roh_mb is not null),
 st as (select * from (values ('ROH <= 3 Mb', -1e9, 3.0), ('ROH <= 5 Mb', -1e9, 5.0), ('ROH 5-10 Mb', 5.0, 10.0), ('ROH > 10 Mb', 10.0, 1e9)) t(stratum, lo, hi)),
 md as (select median(rate) as m, count(*) as nw from rates where rate > 0), bs as (select md.m, count(case when rate >= 1.5*m then 1 end)/max(nw) as f15, count(case when rate >= 2*m then 1 end)/max(nw) as f20 from rates cross join md where rate > 0 group by 1),
 ct as (select stratum, count(*) as n, count(case when rate >= 1.5*m then 1 end) as k15, count(case when rate >= 2*m then 1 end) as k20, max(f15) as f15, max(f20) as f20 from sl join st on roh_mb > lo and roh_mb <= hi cross join bs group by 1)"""


@check("d29_stratified_enrichment", sql(f"""with {STRATIFIED}, t as (select ct.*, i.i from ct cross join (select unnest(range(0, (select max(n) + 1 from ct))) as i) i where i.i <= ct.n)
 select stratum, n, k15 as n_15, k20 as n_20, round(case when k15 = 0 then 1.0 else sum(case when i >= k15 then exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln(f15)+(n-i)*ln(1-f15)) else 0 end) end + 1e-9, 6) as p_15,
 round(case when k20 = 0 then 1.0 else sum(case when i >= k20 then exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln(f20)+(n-i)*ln(1-f20)) else 0 end) end + 1e-9, 6) as p_20 from t group by 1, 2, 3, 4, f15, f20""", "rates"))
def _(v):
    return PS.stratified_enrichment(*families(v), v.rates).select("stratum", "n", "n_15", "n_20", rd("p_15"), rd("p_20"))


@check("j22_search_space", sql(f"""with {LOADS} select "set", pop, cast(floor_bp as bigint) as floor_bp, count(*) as n_cases, cast(sum(n_roh) as bigint) as n_roh, cast(sum(bp) as bigint) as roh_len_bp from ex2 where pop = 'POOLED' group by 1, 2, 3""", "segs", "burden"))
def _(v):
    null = v.null()
    loads = N.case_loads(null.segments, null.burden, _FLOORS)
    both = loads.withColumn("set", F.explode(F.when(F.col("is_outlier"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("screened")))))
    return both.groupBy("set", F.lit("POOLED").alias("pop"), "floor_bp").agg(F.count("*").alias("n_cases"), F.sum("n_roh").alias("n_roh"), F.sum("roh_len_bp").alias("roh_len_bp"))


@check("j23_cohort_subset", sql("select chrom, count(*) as n_sites, cast(sum(ac) as bigint) as ac from (" + _SUBSET.format(drop="none") + ") group by chrom", "genotypes", "sites"))
def _(v):
    path = f"{sinks.shared_dir(v.spark)}/subset-{uuid.uuid4().hex}"
    rows = _gt_rows(v).withColumn("sample", F.concat(F.when(F.pmod("sample", F.lit(10)) < 4, "HG").otherwise("XX"), "sample"))
    sinks.write_partitions(variants.cohort_subset(rows, F.col("sample").startswith("HG"), 0.05), path)
    sites = v.spark.read.parquet(path).select("chrom", "pos", "ac").distinct()
    return sites.groupBy("chrom").agg(F.count("*").alias("n_sites"), F.sum("ac").alias("ac"))


@check("k01_incremental_ingest", sql("select g.chrom, count(*) as n, cast(sum(g.a0 + 2*g.a1) as bigint) as code from genotypes g join sites s on s.idx = g.idx where length(s.alt) = 1 group by g.chrom", "genotypes", "sites"))
def _(v):
    """Two arrivals, three runs: the last run finds nothing new."""
    base = f"{sinks.shared_dir(v.spark)}/ingest-{uuid.uuid4().hex}"
    rows = _gt_rows(v)
    for chrom in (21, 22):
        rows.filter(F.col("chrom") == chrom).write.mode("append").parquet(f"{base}/in")
        for _ in range(chrom - 20):
            I.ingest_available(v.spark, f"{base}/in", rows.schema, lambda d: variants.snvs(d), f"{base}/out", f"{base}/cp")
    out = v.spark.read.parquet(f"{base}/out")
    code = F.substring("gt", 1, 1).cast("int") + 2 * F.substring("gt", 3, 1).cast("int")
    return out.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(code).alias("code"))


@check("k02_incremental_curve", sql("select pop, l_bp, exposure_bp, excess_bp, round(p_bg + 1e-9, 6) as p_bg from curve", "curve"))
def _(v):
    """Segments and calls arrive apart, calls cut across each chromosome; the curve comes from the folded states alone."""
    base = f"{sinks.shared_dir(v.spark)}/partials-{uuid.uuid4().hex}"
    null = v.null()
    for chrom in (21, 22):
        null.segments.filter(F.col("chrom") == chrom).write.mode("append").parquet(f"{base}/in")
        I.merge_partials_available(v.spark, f"{base}/in", null.segments.schema, f"{base}/out", f"{base}/cp")
    for half in (0, 1):
        v.calls.filter(F.pmod(F.floor(F.col("pos") / 1_000_000), F.lit(2)) == half).write.mode("append").parquet(f"{base}/calls")
        I.merge_extents_available(v.spark, f"{base}/calls", v.calls.schema, f"{base}/extents", f"{base}/cp2")
    curve = I.incremental_curve(v.spark, f"{base}/out", f"{base}/extents")
    return curve.select("pop", "l_bp", "exposure_bp", "excess_bp", rd("p_bg"))
