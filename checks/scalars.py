"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggregates import HETW_RATES
from checks.joins import INTERVALS_SQL, intervals
from checks.registry import check
from checks.scans import LOCI_SQL, loci
from checks.views import EMISSION, THR, rd, sql
from zygospan.functions import codes as C
from zygospan.functions import evidence as E
from zygospan.operators import diversity as D
from zygospan.operators import scoring as S



def het_windows(v):
    w = D.window_heterozygosity(v.site_freq).join(v.rates, ["chrom", "window_start"], "left")
    return w.withColumn("rate", F.coalesce("rate", F.lit(0.0)))




@check("g01_haldane", sql("select chrom, window_start, round(0.5*(1-exp(-2*rate/100)) + 1e-9, 6) as theta, round(greatest(least(0.5*(1-exp(-2*(50000*(rate/1e8)))), 0.5-1e-12), 1e-15)*1000 + 1e-9, 6) as switch_per_mille from rates", "rates"))
def _(v):
    return v.rates.withColumn("theta", E.haldane(F.col("rate") / 100)).withColumn("switch_per_mille", E.switch_probability(F.lit(50000.0), F.col("rate")) * 1000).select("chrom", "window_start", rd("theta"), rd("switch_per_mille"))


@check("g02_legacy_posterior", sql(f"""with {HETW_RATES} select pop, chrom, window_start, p.prior, l.length_mb, round(p.prior*{EMISSION}/(p.prior*{EMISSION} + (1-p.prior)*pow(greatest(1e-12, 1-mean_2pq), greatest(1.0, l.length_mb*rate/0.5))) + 1e-9, 6) as posterior
 from hw cross join (select unnest([0.0625, 0.005]::double[]) as prior) p cross join (select unnest([1.5, 5.0, 10.0]::double[]) as length_mb) l""", "site_freq", "rates"))
def _(v):
    grid = S.with_scenarios(het_windows(v), prior=[0.0625, 0.005], length_mb=[1.5, 5.0, 10.0])
    post = E.posterior_legacy_2pq(F.col("length_mb"), F.col("rate"), F.col("mean_2pq"), F.col("prior"))
    return grid.withColumn("posterior", post).select("pop", "chrom", "window_start", "prior", "length_mb", rd("posterior"))


@check("g03_length_to_posterior", sql(f"""with {HETW_RATES}, x as (select *, ln(0.0625*{EMISSION}*(1-t)/(t*0.9375)) / ln(1-mean_2pq) as q from hw cross join (select unnest([0.5, 0.95, 0.99]::double[]) as t) t)
 select pop, chrom, window_start, t as target, round(case when rate <= 0 then null when q <= 1 then 0.1 when q*0.5/rate <= 50 then greatest(q*0.5/rate, 0.1) end + 1e-9, 6) as length_mb from x""", "site_freq", "rates"))
def _(v):
    w = het_windows(v)
    out = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), E.length_to_posterior(F.col("rate"), F.col("mean_2pq"), 0.0625, t).alias("length_mb")) for t in (0.5, 0.95, 0.99)]))
    return w.select("pop", "chrom", "window_start", out.alias("x")).select("pop", "chrom", "window_start", "x.target", F.col("x.length_mb").alias("length_mb")).withColumn("length_mb", F.round(F.col("length_mb") + 1e-9, 6))


@check("g04_block_posterior", sql(f"""select chrom, window_start, round(case when rate > 0 and hbar > 0 then 0.0625*{EMISSION}/(0.0625*{EMISSION} + 0.9375*pow(greatest(1e-4, hbar), greatest(1.0, 2.0*rate/0.5))) else 0.0625 end + 1e-9, 6) as posterior from hwin""", "hwin"))
def _(v):
    return v.hbar_windows().withColumn("posterior", E.posterior_block(2.0, F.col("rate"), F.col("hbar"), 0.0625)).select("chrom", "window_start", rd("posterior"))


def _mcl(rate="rate", hbar="hbar"):
    return f"case when {rate} <= 0 or greatest({hbar}, 1e-4) >= 1 then 'inf'::double else greatest(ln({THR})/ln(greatest({hbar}, 1e-4))*0.5/{rate}, 0.5/{rate}) end"


@check("g05_min_callable_length", sql(f"select chrom, window_start, round({_mcl()} + 1e-9, 6) as min_mb from hwin", "hwin"))
def _(v):
    return v.hbar_windows().withColumn("min_mb", E.min_callable_length(F.col("rate"), F.col("hbar"), 0.0625)).select("chrom", "window_start", rd("min_mb"))


@check("g06_corrected_lstar", sql(f"select chrom, window_start, round(2.1*{_mcl()} + 1e-9, 6) as lstar_mb from hwin", "hwin"))
def _(v):
    return v.hbar_windows().withColumn("lstar_mb", E.corrected_lstar(F.col("rate"), F.col("hbar"), 0.0625)).select("chrom", "window_start", rd("lstar_mb"))


@check("g07_log10_bayes_factor", sql(f"select pop, l_bp, round(log10({EMISSION}/greatest(p_bg, 1e-12)) + 1e-9, 6) as log10_bf from curve", "curve"))
def _(v):
    return v.curve().select("pop", "l_bp", rd("log10_bf"))


@check("g08_posterior_from_bf", sql(f"with b as (select pop, l_bp, {EMISSION}/greatest(p_bg, 1e-12) as bf from curve) select pop, l_bp, round(0.0156*bf/(0.0156*bf + 1 - 0.0156) + 1e-9, 6) as posterior from b", "curve"))
def _(v):
    return v.curve().withColumn("posterior", E.posterior_from_bf(F.col("log10_bf"), 0.0156)).select("pop", "l_bp", rd("posterior"))


@check("g09_threshold", sql(f"select pop, count(case when p_bg <= {THR} then 1 end) as n_below, round({THR} * 1000, 6) as thr_per_mille from curve group by pop", "curve"))
def _(v):
    thr = E.threshold_p(0.0625, 0.95)
    return v.curve().groupBy("pop").agg(F.count_if(F.col("p_bg") <= thr).alias("n_below")).withColumn("thr_per_mille", F.round(F.lit(thr * 1000), 6))


@check("g10_effective_length", sql(f"with {INTERVALS_SQL} select id, round((e - s)/1e6*(rate/r_median)/1.5 + 1e-9, 6) as l_eff_mb from ivr", "segs", "rates"))
def _(v):
    iv = S.interval_rates(intervals(v), v.rates, "id")
    out = E.effective_length((F.col("end") - F.col("start")) / 1e6, F.col("rate"), F.col("r_median"), 1.5)
    return iv.withColumn("l_eff_mb", out).select("id", rd("l_eff_mb"))


@check("g11_locus_decisive_length", sql(f"with {INTERVALS_SQL} select id, round(1.6*(r_median/rate)*1.5 + 1e-9, 6) as lstar_locus_mb from ivr", "segs", "rates"))
def _(v):
    iv = S.interval_rates(intervals(v), v.rates, "id")
    return iv.withColumn("lstar_locus_mb", E.locus_decisive_length(1.6, F.col("rate"), F.col("r_median"), 1.5)).select("id", rd("lstar_locus_mb"))


@check("g12_decision_band", "select doc_id, case when n_chars % 1000 >= 950 then 'FLAG' when n_chars % 1000 >= 500 then 'REVIEW' else 'BACKGROUND' end as decision from documents")
def _(v):
    return v.table("documents").select("doc_id", C.decision(F.pmod("n_chars", F.lit(1000)) / 1000.0).alias("decision"))


@check("g13_roh_call", sql("select sample, chrom, start_pos, case when len_bp >= 500000 then 'autozygous' when len_bp >= 350000 then 'borderline' else 'background' end as call from segs", "segs"))
def _(v):
    return v.null().segments.select("sample", "chrom", "start_pos", C.roh_call(F.col("len_bp").cast("double"), F.lit(500000.0)).alias("call"))


@check("g14_prior_choice", sql("select sample, round(case when sample % 3 = 0 then 0.0625 else least(greatest(f_roh, 1e-4), 0.5) end + 1e-9, 6) as prior from burden", "burden"))
def _(v):
    f = F.when(F.pmod("sample", F.lit(3)) != 0, F.col("f_roh"))
    return v.null().burden.withColumn("prior", E.choose_prior(0.0625, f)).select("sample", rd("prior"))


@check("g15_unknown_population", sql(f"""with b as (select pop, l_bp, {EMISSION}/greatest(p_bg, 1e-12) as bf from curve), l as (select pop, coalesce(min(case when 0.0625*bf/(0.0625*bf + 0.9375) >= 0.95 then l_bp end)/1e6, 'inf'::double) as lstar_eff_mb from b group by pop)
 select min(pop) as pop, max(lstar_eff_mb) as lstar_eff_mb from l where lstar_eff_mb = (select max(lstar_eff_mb) from l)""", "curve"))
def _(v):
    return S.conservative_population(S.curve_lstar(v.curve(), 0.0625))


@check("g16_emission_models", sql("""with d as (select pop, l_bp, (1500 + 400*pop) * (l_bp/1e6) as n from (select distinct pop from panel) cross join grid)
 select pop, l_bp, round(pow(0.999, 1000) + 1e-9, 6) as flat, round(greatest(1e-6, 1 - greatest(0, n - 1)*pow(0.001, 2)) + 1e-9, 6) as tol, round(pow(0.999, n) + 1e-9, 6) as strict,
 round(pow(0.999, round_even(n, 0)) + round_even(n, 0)*0.001*pow(0.999, round_even(n, 0) - 1) + 1e-9, 6) as budget from d""", "panel", "grid"))
def _(v):
    k = F.explode(F.sequence(F.lit(0), F.lit(238)))
    rows = v.panel.select("pop").distinct().withColumn("k", k).withColumn("l_bp", F.col("k").cast("long") * 50000 + 100000)
    for m in ("flat", "tol", "strict", "budget"):
        rows = rows.withColumn(m, E.emission_model(m, (1500 + 400 * F.col("pop")).cast("double"), F.col("l_bp") / 1e6))
    return rows.select("pop", "l_bp", *[rd(m) for m in ("flat", "tol", "strict", "budget")])


@check("g17_locus_interval", sql(f"with {LOCI_SQL} select case_id, greatest(0, midpoint - cast(floor(roh_mb*1e6/2) as bigint)) as \"start\", midpoint + cast(floor(roh_mb*1e6/2) as bigint) as \"end\" from loci where roh_mb is not null", "markers"))
def _(v):
    a, b = E.locus_interval(F.col("midpoint"), F.col("roh_mb"))
    return loci(v).filter(F.col("roh_mb").isNotNull()).select("case_id", a.alias("start"), b.alias("end"))


@check("g18_rate_ratio", sql("select chrom, window_start, round(rate / m + 1e-9, 6) as ratio from rates cross join (select median(rate) as m from rates where rate > 0)", "rates"))
def _(v):
    from zygospan.operators.blocked import attach

    return attach(v.rates, S.median_rate(v.rates)).withColumn("ratio", F.col("rate") / F.col("r_median")).select("chrom", "window_start", rd("ratio"))


@check("g19_flags", sql("select pop, count(case when f_roh > 0.0156 then 1 end) as n_outlier, count(case when roh_bp >= 1500000 then 1 end) as n_above from burden group by pop", "burden"))
def _(v):
    return v.null().burden.groupBy("pop").agg(F.count_if("is_outlier").alias("n_outlier"), F.count_if(F.col("roh_bp") >= 1_500_000).alias("n_above"))


@check("g20_mutation_strings", "select c_custkey as id, cast(c_custkey % 22 + 1 as varchar) as chrom, c_custkey*12345 as pos from customer")
def _(v):
    from zygospan.sources.tables import parse_mutation

    k = F.col("c_custkey")
    text = F.concat(F.lit("chr"), F.pmod(k, F.lit(22)) + 1, F.lit(":"), F.format_number(k * 12345, 0), F.lit("G>A"))
    c, p = parse_mutation(F.col("t"))
    return v.table("customer").select(k.alias("id"), text.alias("t")).select("id", c.alias("chrom"), p.alias("pos"))
