"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, L, I, D, B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)

PANEL = _schema(("sample", S), ("pop", S), ("superpop", S), ("gender", S))
PEDIGREE = _schema(("sample", S), ("father", S), ("mother", S))
RECMAP_TEXT = _schema(("chrom", S), ("pos", S), ("extra", S), ("rate", S))
MANIFEST_TEXT = _schema(
    ("snp", S), ("chrom", S), ("pos", S), ("match", S), ("strand", S), ("top", S)
)
WINDOW_STATS_TEXT = _schema(
    ("chrom", S), ("window_start", S), ("population", S), ("Hbar", S),
    ("n_blocks", S), ("mean_distinct_hap", S), ("mean_n_hap", S), ("cMperMb", S),
)
SEGMENTS = _schema(
    ("sample", S), ("pop", S), ("platform", S), ("gap", I), ("chrom", S),
    ("start_pos", L), ("end_pos", L), ("n_markers", L), ("len_bp", L),
)
LOCI = _schema(
    ("source", S), ("case_id", S), ("gene", S), ("chrom", S), ("midpoint", L),
    ("roh_mb", D), ("case_class", S), ("build", S), ("note", S),
)
PRIORS = _schema(("prior", D), ("prior_label", S))
PLATFORMS = _schema(("penalty", D), ("platform", S))
ROH = _schema(("chrom", S), ("start", L), ("end", L))
