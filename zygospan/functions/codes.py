"""Verdict codes of windowed haplotype and phasing tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dominant(n0: Column, n1: Column) -> Column:
    return F.when(n0 > n1, "0").when(n1 > n0, "1").otherwise("-")


def purity(n0: Column, n1: Column) -> Column:
    total = n0 + n1
    return F.when(total > 0, F.try_divide(F.greatest(n0, n1), total)).otherwise(F.lit(0.0))


def trace_code(n0: Column, n1: Column) -> Column:
    """``.`` under five sites, ``x`` when mixed, else the dominant haplotype."""
    return (
        F.when(n0 + n1 < 5, ".")
        .when(purity(n0, n1) < 0.80, "x")
        .otherwise(F.when(n0 > n1, "0").otherwise("1"))
    )


def agreement_code(n_agree: Column, n_disagree: Column) -> Column:
    total = n_agree + n_disagree
    share = F.try_divide(n_agree, total)
    return (
        F.when(total < 5, ".")
        .when(share >= 0.95, "A")
        .when(share >= 0.80, "a")
        .when(share <= 0.05, "D")
        .when(share <= 0.20, "d")
        .otherwise("x")
    )


def decision(post: Column, flag: float = 0.95, review: float = 0.50) -> Column:
    return F.when(post >= flag, "FLAG").when(post >= review, "REVIEW").otherwise("BACKGROUND")


def roh_call(length: Column, lstar: Column) -> Column:
    return (
        F.when(length >= lstar, "autozygous")
        .when(length >= 0.7 * lstar, "borderline")
        .otherwise("background")
    )
