"""Evidence formulas as column builders: posteriors, Bayes factors, lengths."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings

INF = float("inf")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haldane(morgans: Column) -> Column:
    """Recombination fraction over a map distance, no interference."""
    return 0.5 * (1 - F.exp(-2 * morgans))


def switch_probability(distance_bp: Column, rate) -> Column:
    theta = haldane(distance_bp * (_col(rate) / 1e8))
    return F.greatest(F.least(theta, F.lit(0.5 - 1e-12)), F.lit(1e-15))


def _bayes(chance: Column, prior, s: Settings) -> Column:
    hit = _col(prior) * s.emission
    return hit / (hit + (1 - _col(prior)) * chance)


def n_blocks(length_mb, rate: Column, s: Settings = DEFAULTS) -> Column:
    """Independent blocks inside a run, at least one."""
    return F.greatest(F.lit(1.0), _col(length_mb) * rate / s.block_cm)


def posterior_legacy_2pq(length_mb, rate, mean_2pq, prior, s: Settings = DEFAULTS) -> Column:
    """Posterior under the retired per-site heterozygosity noise term."""
    match = F.greatest(F.lit(1e-12), 1 - mean_2pq)
    return _bayes(F.pow(match, n_blocks(length_mb, rate, s)), prior, s)


def posterior_block(length_mb, rate, hbar, prior, s: Settings = DEFAULTS, fallback=True) -> Column:
    """Posterior under block homozygosity; the prior itself where no covariate is known."""
    match = F.greatest(F.lit(s.homozygosity_floor), hbar)
    post = _bayes(F.pow(match, n_blocks(length_mb, rate, s)), prior, s)
    if not fallback:
        return post
    return F.when((rate > 0) & (hbar > 0), post).otherwise(_col(prior))


def _log_threshold(prior, target: float, s: Settings) -> Column:
    p = _col(prior)
    return F.ln(p * s.emission * (1 - target) / (target * (1 - p)))


def length_to_posterior(
    rate, mean_2pq, prior, target: float = 0.95, lo: float = 0.1, hi: float = 50.0,
    s: Settings = DEFAULTS,
) -> Column:
    """Length (Mb) where the legacy posterior meets ``target``; null if beyond ``hi``.

    The posterior is monotone in the number of blocks, so it inverts exactly.
    """
    match = F.greatest(F.lit(1e-12), 1 - mean_2pq)
    blocks = F.try_divide(_log_threshold(prior, target, s), F.ln(match))
    length = F.try_divide(blocks * s.block_cm, rate)
    return (
        F.when(rate <= 0, F.lit(None).cast("double"))
        .when((match < 1) & (blocks <= 1), F.lit(lo))
        .when((match < 1) & (length <= hi), F.greatest(length, F.lit(lo)))
    )


def min_callable_length(rate, hbar, prior, target: float | None = None, s: Settings = DEFAULTS) -> Column:
    """Shortest run (Mb) whose block posterior reaches the target; inf if none."""
    target = s.target_posterior if target is None else target
    match = F.greatest(F.lit(s.homozygosity_floor), hbar)
    blocks = F.try_divide(_log_threshold(prior, target, s), F.ln(match))
    return F.when((rate <= 0) | (match >= 1), F.lit(INF)).otherwise(
        F.try_divide(F.greatest(blocks, F.lit(1.0)) * s.block_cm, rate)
    )


def corrected_lstar(rate, hbar, prior, s: Settings = DEFAULTS) -> Column:
    return s.lstar_correction * min_callable_length(rate, hbar, prior, s=s)


def log10_bf(p_bg: Column, s: Settings = DEFAULTS) -> Column:
    return F.log10(F.lit(s.emission) / F.greatest(p_bg, F.lit(1e-12)))


def posterior_from_bf(log10bf: Column, prior) -> Column:
    bf = F.pow(F.lit(10.0), log10bf)
    return _col(prior) * bf / (_col(prior) * bf + (1 - _col(prior)))


def effective_length(length_mb, rate, rate_median, penalty) -> Column:
    return _col(length_mb) * (rate / rate_median) / _col(penalty)


def locus_decisive_length(lstar_eff, rate, rate_median, penalty) -> Column:
    return _col(lstar_eff) * (rate_median / rate) * _col(penalty)


def choose_prior(declared, f_roh: Column | None = None, s: Settings = DEFAULTS) -> Column:
    """The measured F_ROH, clamped, where given; else the declared prior."""
    if f_roh is None:
        return _col(declared)
    lo, hi = s.prior_range
    clamped = F.least(F.greatest(f_roh, F.lit(lo)), F.lit(hi))
    return F.when(f_roh.isNull(), _col(declared)).otherwise(clamped)


def emission_model(model: str, density, length_mb: Column, s: Settings = DEFAULTS) -> Column:
    """Chance that a tract of N markers reads as one run, under four error models."""
    e = s.geno_error
    n = _col(density) * length_mb
    if model == "flat":
        return F.lit(s.emission)
    if model == "tol":
        return F.greatest(F.lit(1e-6), 1 - F.greatest(F.lit(0.0), n - 1) * e ** (s.gap_tol + 1))
    if model == "strict":
        return F.pow(F.lit(1 - e), n)
    if model == "budget":
        whole = F.bround(n, 0)
        total, choose = F.lit(0.0), F.lit(1.0)
        for k in range(s.gap_tol + 1):
            if k:
                choose = choose * (whole - (k - 1)) / k
            total = total + F.greatest(choose, F.lit(0.0)) * e**k * F.pow(F.lit(1 - e), whole - k)
        return total
    raise ValueError(f"unknown emission model {model!r}")


def threshold_p(prior: float, target: float, s: Settings = DEFAULTS) -> float:
    """Largest chance probability that still reaches ``target`` at ``prior``."""
    return replace(s, prior=prior, target_posterior=target).threshold


def locus_interval(midpoint: Column, width_mb: Column) -> tuple[Column, Column]:
    half = F.floor(width_mb * 1e6 / 2).cast("long")
    return F.greatest(F.lit(0), midpoint - half), midpoint + half
