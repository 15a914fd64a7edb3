"""Run segmentation from mismatches alone.

Samples of one cohort share a marker axis, so between two breaking mismatches
every axis marker is homozygous. Only heterozygous rows are shuffled, as marker
numbers with their neighbours' positions, which a linked axis knows. Use it when
every sample of an axis is called at every axis marker; otherwise use ``runs.call_runs``.

``linked_axis``, ``mismatch_rows`` and ``sinks.write_mismatches`` store a layout in which
the scan meets its blocks without a shuffle and the run ends without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zygospan.config import DEFAULTS, Settings
from zygospan.operators.blocked import growing, row_numbers
from zygospan.operators.runs import _by_block, _taken

_EDGE = -1
_FAR = 2**61


def index_axis(markers: DataFrame, by: Sequence[str], s: Settings = DEFAULTS) -> DataFrame:
    """Dense 0-based marker numbers ``idx`` along each axis."""
    ranked = row_numbers(markers, by, F.floor(F.col("pos") / s.scan_block_bp), [F.col("pos")], "idx")
    return ranked.withColumn("idx", F.col("idx") - 1)


def linked_axis(axis: DataFrame, by: Sequence[str], block: int = 10_000) -> DataFrame:
    """``by, idx, pos, before, after``: each marker of ``index_axis`` with its neighbours' positions, null at the ends.

    Further columns stay behind them. Markers are shuffled once.
    """
    by, rest = list(by), [c for c in axis.columns if c not in (*by, "idx", "pos")]
    # Blocks overlap by a marker at each end, so a marker sees both neighbours where it is at home.
    rows = _in_blocks(axis, block, 1).withColumn("_home", F.col("own") == F.col("blk")).repartition(*by, "blk")
    w = W.partitionBy(*by, "blk").orderBy("idx")
    near = rows.withColumns({"before": F.lag("pos").over(w), "after": F.lead("pos").over(w)})
    return near.filter("_home").select(*by, "idx", "pos", "before", "after", *rest)


def mismatch_rows(
    calls: DataFrame, linked: DataFrame, keys: Sequence[str], by: Sequence[str], block: int = 10_000, depth: int = 3,
) -> DataFrame:
    """``keys, by, idx, before, after, own, blk``: the heterozygous ``calls(keys, by, pos, hom)`` ready to be stored.

    A row is repeated in a neighbouring block if it lies within ``depth`` markers of it, the widest gap tolerance that the
    stored rows can serve. Calls that were made from the linked axis and still hold ``idx, before, after`` meet it no more.
    """
    cols = list(dict.fromkeys([*keys, *by]))
    if {"idx", "before", "after"} <= set(calls.columns):
        return _in_blocks(calls.filter(~F.col("hom")).select(*cols, "idx", "before", "after"), block, depth)
    hets = calls.filter(~F.col("hom")).select(*cols, "pos").join(linked, [*by, "pos"])
    return _in_blocks(hets.select(*cols, "idx", "before", "after"), block, depth)


def _in_blocks(hets: DataFrame, block: int, depth: int) -> DataFrame:
    """Rows with their own block and one row more per near block, whose islands they help to size."""
    own, place = F.floor(F.col("idx") / block), F.pmod(F.col("idx"), F.lit(block))
    copies = F.array_compact(F.array(own, F.when(place < depth, own - 1), F.when(place >= block - depth, own + 1)))
    return hets.select("*", own.alias("own"), F.explode(copies).alias("blk"))


def fixed_breaks(axis: DataFrame, by: Sequence[str], max_gap: int) -> DataFrame:
    """Both ends of each axis and its wide gaps, as ``left`` and ``right`` run limits.

    From a linked axis they come without a shuffle, and with the limits' positions.
    """
    by = list(by)
    if "before" in axis.columns:
        limit = lambda left, lpos, right, rpos, at: F.struct(
            left.cast("long").alias("left"), lpos.cast("long").alias("left_pos"), right.cast("long").alias("right"),
            rpos.cast("long").alias("right_pos"), at.cast("long").alias("at"))
        idx, none = F.col("idx"), F.lit(None)
        end = F.col("after").isNull() | (F.col("after") - F.col("pos") > max_gap)
        last = F.col("after").isNull()
        limits = F.array_compact(F.array(
            F.when(F.col("before").isNull(), limit(none, none, idx, F.col("pos"), idx * 2 - 1)),
            F.when(end, limit(idx, F.col("pos"), F.when(~last, idx + 1), F.col("after"), idx * 2 + 1)),
        ))
        return axis.select(*by, F.explode(limits).alias("_l")).select(*by, "_l.*")
    ends = F.explode(F.array(F.struct("idx", F.col("pos").alias("here"), F.lit(None).cast("long").alias("after")),
                             F.struct((F.col("idx") - 1).alias("idx"), F.lit(None).cast("long").alias("here"), F.col("pos").alias("after"))))
    near = axis.select(*by, ends.alias("_e")).groupBy(*by, F.col("_e.idx").alias("idx")).agg(
        F.max("_e.here").alias("_p"), F.max("_e.after").alias("_n")
    )
    wide = F.col("_p").isNull() | F.col("_n").isNull() | (F.col("_n") - F.col("_p") > max_gap)
    return near.filter(wide).select(
        *by, F.when(F.col("_p").isNotNull(), F.col("idx")).alias("left"),
        F.when(F.col("_n").isNotNull(), F.col("idx") + 1).alias("right"), (F.col("idx") * 2 + 1).alias("at"),
    )


def sparse_runs(
    hets: DataFrame, members: DataFrame, axis: DataFrame, keys: Sequence[str], by: Sequence[str],
    gaps: Sequence[int] = (1,), min_markers: int = 1, max_gap: int = DEFAULTS.max_gap_bp, block: int = 10_000,
    apart: bool = False,
) -> DataFrame:
    """The runs of ``call_runs`` from ``hets(keys, by, idx)``.

    ``members(keys, by)`` lists every sample and axis, also those without mismatch;
    ``axis(by, idx, pos)`` comes from ``index_axis``. ``min_markers = 2`` leaves out
    runs of length zero in the scan. With ``linked_axis`` and the rows of
    ``mismatch_rows``, stored for the same ``block``, nothing is looked up. With ``apart``, runs inside a block are not
    shuffled again, for which the rows are sorted and scanned twice.
    """
    keys, by, depth = list(keys), list(by), max(gaps)
    idx = F.col("idx")
    if "before" not in axis.columns:
        axis = linked_axis(axis.select(*by, "idx", "pos"), by, block)
    if "before" not in hets.columns:
        # Mismatches meet the axis once, where the ends of all runs would have to meet it twice.
        hets = hets.join(growing(axis.select(*by, "idx", "before", "after")), [*by, "idx"])
    stored = hets if "blk" in hets.columns else _in_blocks(hets.select(*keys, *by, "idx", "before", "after"), block, depth)
    group = list(dict.fromkeys([*keys, *by]))
    # A mismatch limits runs at its neighbours, whose numbers follow from its own.
    none = F.lit(None).cast("long")
    limits = [F.col("before").alias("left_pos"), F.col("after").alias("right_pos")]
    rows = stored.select(
        *group, F.col("blk").alias("_blk"), (idx * 2).alias("at"), none.alias("left"), none.alias("right"), *limits,
        F.lit(True).alias("_het"), (F.col("own") == F.col("blk")).alias("_own"),
    )
    fixed = members.join(fixed_breaks(axis, by, max_gap), by).select(
        *group, F.floor(F.col("at") / 2 / block).alias("_blk"), "at", "left", "right", "left_pos", "right_pos",
        F.lit(False).alias("_het"), F.lit(True).alias("_own"),
    )
    # Mismatches and fixed limits meet in one shuffle; every gap tolerance is read off the same sorted rows.
    runs = _runs_between(rows.unionByName(fixed), group, [int(g) for g in gaps], min_markers, apart)
    n_markers = (F.col("end_idx") - F.col("start_idx") + 1).alias("n_markers")
    out = runs.select(*group, "gap", "start_idx", "end_idx", "start_pos", "end_pos", n_markers)
    return out.select(*group, "gap", "start_pos", "end_pos", "n_markers", (F.col("end_pos") - F.col("start_pos")).alias("len_bp"))


def _runs_between(rows: DataFrame, group: list[str], gaps: list[int], min_markers: int, apart: bool) -> DataFrame:
    """``group, gap, start_idx, start_pos, end_idx, end_pos`` from each break to the next.

    A block gives its inner runs, and per gap tolerance one row with its first and last break, by which blocks are joined.
    """
    names = [*group, "_blk"]

    def scan(table: pa.Table, edges: bool | None = None) -> pa.Table:
        at, het, own, rank = (table[c].to_numpy() for c in ("at", "_het", "_own", "_rn"))
        # A missing limit is one that no run can reach.
        left = np.where(het, at // 2 - 1, table["left"].fill_null(-_FAR).to_numpy())
        right = np.where(het, at // 2 + 1, table["right"].fill_null(_FAR).to_numpy())
        left_pos, right_pos = (table[c].fill_null(0).to_numpy() for c in ("left_pos", "right_pos"))
        whole = np.cumsum(rank == 1)
        h = np.flatnonzero(het)
        meets = (np.diff(at[h], prepend=0) == 2) & (np.diff(whole[h], prepend=0) == 0)
        first = np.flatnonzero(~meets)
        size = np.diff(np.append(first, len(h)))
        size = np.repeat(size, size)
        out = []
        for g in gaps:
            breaks = ~het
            breaks[h] = own[h] & (size > g)
            b = np.flatnonzero(breaks)
            new = np.diff(whole[b], prepend=0) > 0
            inner = np.flatnonzero(~new)
            inner = inner[left[b[inner]] - right[b[inner - 1]] + 1 >= min_markers]
            i, j = b[inner - 1], b[inner]
            fb, lb = b[new], b[np.append(new[1:], True)] if len(b) else b
            # Of a block's row the end belongs to the run that comes in, the start to the one that goes out.
            if edges is not None:
                i, j, fb, lb = (i[:0], j[:0], fb, lb) if edges else (i, j, fb[:0], lb[:0])
            out.append((np.append(j, fb), np.append(i, lb), np.arange(len(i) + len(fb)) >= len(i), np.full(len(i) + len(fb), g, np.int32)))
        e, s, edge, gap = (np.concatenate(x) for x in zip(*out))
        more = {"gap": gap, "_edge": edge, "_at": at[e], "start_idx": right[s], "start_pos": right_pos[s], "end_idx": left[e], "end_pos": left_pos[e]}
        return _taken(table, names, e, more)

    ends = "start_idx long, start_pos long, end_idx long, end_pos long"
    of = lambda cols, more: StructType([*[rows.schema[c] for c in cols], *StructType.fromDDL(more).fields])
    by_block = lambda work: _by_block(rows, names, "at", False, work, of(names, "gap int, _edge boolean, _at long, " + ends))
    found = by_block(partial(scan, edges=True) if apart else scan)
    found = found.withColumn("_grp", F.when(F.col("_edge"), _EDGE).otherwise(F.col("_blk"))).drop("_blk")

    def stitch(table: pa.Table) -> pa.Table:
        edge, rank, s, s_pos, e, e_pos = (table[c].to_numpy() for c in ("_edge", "_rn", "start_idx", "start_pos", "end_idx", "end_pos"))
        s, s_pos = np.where(edge, np.roll(s, 1), s), np.where(edge, np.roll(s_pos, 1), s_pos)
        kept = np.flatnonzero((~edge | (rank > 1)) & (e - s + 1 >= min_markers))
        return _taken(table, [*group, "gap"], kept, {"start_idx": s[kept], "start_pos": s_pos[kept], "end_idx": e[kept], "end_pos": e_pos[kept]})

    runs = _by_block(found, [*group, "gap", "_grp"], "_at", False, stitch, of(group, "gap int, " + ends))
    # Both scans read the same shuffle.
    return runs.unionByName(by_block(partial(scan, edges=False)).select(*runs.columns)) if apart else runs
