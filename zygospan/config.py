"""Numeric settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """All thresholds in one place; lengths are integer base pairs."""

    maf_min: float = 0.05
    gap_tol: int = 1
    max_gap_bp: int = 1_000_000
    min_keep_bp: int = 5_000
    burden_min_bp: int = 1_000_000
    outlier_f: float = 0.0156
    window_bp: int = 1_000_000
    block_cm: float = 0.5
    block_max_markers: int = 25
    homozygosity_floor: float = 1e-4
    geno_error: float = 0.001
    prior: float = 0.0625
    target_posterior: float = 0.95
    review_posterior: float = 0.50
    prior_range: tuple[float, float] = (1e-4, 0.5)
    array_penalty: float = 1.5
    lstar_correction: float = 2.1
    deletion_fraction: float = 0.03
    report_min_bp: int = 500_000
    genes_per_mb: float = 7.0
    grid_start_bp: int = 100_000
    grid_step_bp: int = 50_000
    grid_points: int = 239
    # Width of the position blocks that split one chromosome over tasks.
    scan_block_bp: int = 5_000_000

    @property
    def emission(self) -> float:
        """P(a truly autozygous tract reads as homozygous), 1000 markers."""
        return (1.0 - self.geno_error) ** 1000

    @property
    def threshold_factor(self) -> float:
        """Chance probability at the target posterior, per unit of emission."""
        odds = self.target_posterior / (1.0 - self.target_posterior)
        return self.prior / (1.0 - self.prior) / odds

    @property
    def threshold(self) -> float:
        return self.threshold_factor * self.emission


DEFAULTS = Settings()

POPULATIONS = ("EUR", "AFR", "EAS", "SAS", "AMR")
