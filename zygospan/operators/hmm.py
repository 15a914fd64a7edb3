"""Two-state transmission model over Mendelian-deterministic sites.

A chromosome is never handed to one task: every position block is reduced to a
2x2 transfer matrix, the few matrices of a chromosome are chained, and each
block is then solved on its own from the messages at its two ends. The result
equals a scan over the whole chromosome. Inside a task the groups of an Arrow
batch advance together, one site per step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zygospan.config import DEFAULTS, Settings

KEYS = ["trio", "parent", "chrom"]
_CELLS = [f"{k}{i}{j}" for k in "sv" for i in (0, 1) for j in (0, 1)]


def _whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of complete key groups with their start rows; rows arrive sorted by key."""
    def starts(pdf):
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = True
        for k in keys:
            col = pdf[k].to_numpy()
            new[1:] |= col[1:] != col[:-1]
        return np.flatnonzero(new)

    rest = None
    for pdf in frames:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        at = starts(pdf)
        rest = pdf.iloc[at[-1]:].reset_index(drop=True)
        if len(at) > 1:
            yield pdf.iloc[: at[-1]], at[:-1]
    if rest is not None:
        yield rest, np.zeros(1, dtype=int)


class _Lockstep:
    """Rows of several groups as a padded grid, longest group first."""

    def __init__(self, starts: np.ndarray, n_rows: int):
        sizes = np.diff(np.append(starts, n_rows))
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[order], sizes[order]
        self.depth = int(self.sizes[0])
        # How many groups still have a row at each step.
        self.alive = np.searchsorted(-self.sizes, -np.arange(self.depth), side="left")
        self.rows = np.minimum(self.starts[:, None] + np.arange(self.depth), n_rows - 1)
        self.valid = np.arange(self.depth) < self.sizes[:, None]

    def grid(self, flat: np.ndarray) -> np.ndarray:
        return flat[self.rows]

    def flat(self, grid: np.ndarray, n_rows: int) -> np.ndarray:
        out = np.empty((n_rows, *grid.shape[2:]), dtype=grid.dtype)
        out[self.rows[self.valid]] = grid[self.valid]
        return out


def _emissions(pdf: pd.DataFrame, eps: float) -> np.ndarray:
    """Log emission of each site under both states."""
    seen = pdf["observed"].to_numpy()
    return np.stack([np.where(seen == pdf[c].to_numpy(), np.log1p(-eps), np.log(eps)) for c in ("p0", "p1")], axis=1)


def _theta(distance: np.ndarray, rate: float) -> np.ndarray:
    """Switch probability over each distance in bp."""
    return np.clip(-0.5 * np.expm1(-2.0 * distance * (rate / 1e8)), 1e-15, 0.5 - 1e-12)


def _spread(vec: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One transition of probability vectors on the last axis."""
    t = theta.reshape(theta.shape + (1,) * (vec.ndim - theta.ndim))
    return vec * (1 - t) + vec[..., ::-1] * t


def _best(vec: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One transition of best log scores and the state each came from; ties from 0."""
    t = theta.reshape(theta.shape + (1,) * (vec.ndim - theta.ndim))
    stay, switch = np.log1p(-t)[..., 0], np.log(t)[..., 0]
    from0 = np.stack([vec[..., 0] + stay, vec[..., 0] + switch], axis=-1)
    from1 = np.stack([vec[..., 1] + switch, vec[..., 1] + stay], axis=-1)
    return np.maximum(from0, from1), (from0 < from1).astype(np.int8)


def _heads(pdf: pd.DataFrame, rows: np.ndarray, cols: Sequence[str]) -> dict:
    return {c: pdf[c].to_numpy()[rows] for c in cols}


def _transfer(pdf: pd.DataFrame, starts: np.ndarray, rate: float, eps: float) -> pd.DataFrame:
    """Block matrices from the state at the first to the state at the last site."""
    step = _Lockstep(starts, len(pdf))
    pos, emit = step.grid(pdf["pos"].to_numpy()), step.grid(_emissions(pdf, eps))
    prob, theta = np.exp(emit), _theta(np.diff(pos, axis=1), rate)
    eye = np.eye(2)
    with np.errstate(divide="ignore"):
        total, best = prob[:, 0, None, :] * eye, emit[:, 0, None, :] + np.log(eye)
        scale = np.zeros(total.shape[:2])
        for i in range(1, step.depth):
            n = step.alive[i]
            t = theta[:n, i - 1]
            nxt = _spread(total[:n], t) * prob[:n, i, None, :]
            size = nxt.sum(axis=-1)
            total[:n], scale[:n] = nxt / size[..., None], scale[:n] + np.log(size)
            best[:n] = _best(best[:n], t)[0] + emit[:n, i, None, :]
        cells = np.concatenate([(np.log(total) + scale[..., None]).reshape(-1, 4), best.reshape(-1, 4)], axis=1)
    ends = step.starts + step.sizes - 1
    out = {**_heads(pdf, step.starts, [*KEYS, "_blk"]), "first_pos": pdf["pos"].to_numpy()[step.starts],
           "last_pos": pdf["pos"].to_numpy()[ends]}
    return pd.DataFrame({**out, **{c: cells[:, j] for j, c in enumerate(_CELLS)}})


def _chain(pdf: pd.DataFrame, starts: np.ndarray, rate: float) -> pd.DataFrame:
    """Messages at both ends of every block, from the matrices of each chromosome."""
    step = _Lockstep(starts, len(pdf))
    mats = step.grid(pdf[_CELLS].to_numpy(dtype=float).reshape(-1, 2, 2, 2))
    sums, bests = mats[:, :, 0], mats[:, :, 1]
    gap = step.grid(pdf["first_pos"].to_numpy())[:, 1:] - step.grid(pdf["last_pos"].to_numpy())[:, :-1]
    theta = _theta(gap, rate)
    shape = (len(step.starts), step.depth, 2)
    enter, score = np.full(shape, 0.5), np.full(shape, np.log(0.5))
    come = np.zeros(shape, dtype=np.int8)
    # Matrix rows of one block share a factor that cancels in every message.
    weight = np.exp(sums - sums.max(axis=(2, 3), keepdims=True))
    for b in range(1, step.depth):
        n = step.alive[b]
        out = (enter[:n, b - 1, :, None] * weight[:n, b - 1]).sum(axis=1)
        enter[:n, b] = _spread(out / out.sum(axis=-1, keepdims=True), theta[:n, b - 1])
        last = (score[:n, b - 1, :, None] + bests[:n, b - 1]).max(axis=1)
        score[:n, b], come[:n, b] = _best(last, theta[:n, b - 1])
    leave, end = np.full(shape, 0.5), np.zeros(shape[:2], dtype=np.int8)
    for b in range(step.depth - 1, -1, -1):
        n, more = step.alive[b], step.alive[b + 1] if b + 1 < step.depth else 0
        if more:
            back = (weight[:more, b + 1] * leave[:more, b + 1, None, :]).sum(axis=-1)
            leave[:more, b] = _spread(back / back.sum(axis=-1, keepdims=True), theta[:more, b])
            nxt = score[:more, b + 1, :, None] + bests[:more, b + 1]
            col = np.take_along_axis(nxt, end[:more, b + 1, None, None].astype(int), axis=2)[..., 0]
            first = (col[:, 0] < col[:, 1]).astype(int)
            end[:more, b] = np.take_along_axis(come[:more, b + 1], first[:, None], axis=1)[:, 0]
        if n > more:
            last = (score[more:n, b, :, None] + bests[more:n, b]).max(axis=1)
            end[more:n, b] = last[:, 0] < last[:, 1]
    n_rows, cols = len(pdf), pdf[[*KEYS, "_blk"]].copy()
    for name, grid in (("in_", enter), ("score_", score), ("out_", leave)):
        flat = step.flat(grid, n_rows)
        cols[f"{name}0"], cols[f"{name}1"] = flat[:, 0], flat[:, 1]
    cols["end_state"] = step.flat(end, n_rows).astype(int)
    return cols


def _solve(pdf: pd.DataFrame, starts: np.ndarray, rate: float, eps: float) -> pd.DataFrame:
    """Posteriors and best path inside each block, given its end messages."""
    step = _Lockstep(starts, len(pdf))
    pos, emit = step.grid(pdf["pos"].to_numpy()), step.grid(_emissions(pdf, eps))
    prob, theta = np.exp(emit), _theta(np.diff(pos, axis=1), rate)
    head = lambda name: pdf[[f"{name}0", f"{name}1"]].to_numpy(dtype=float)[step.starts]
    fwd, back = np.empty(prob.shape), np.zeros(prob.shape, dtype=np.int8)
    first = head("in_") * prob[:, 0]
    fwd[:, 0] = first / first.sum(axis=1, keepdims=True)
    best = head("score_") + emit[:, 0]
    for i in range(1, step.depth):
        n, t = step.alive[i], theta[: step.alive[i], i - 1]
        nxt = _spread(fwd[:n, i - 1], t) * prob[:n, i]
        fwd[:n, i] = nxt / nxt.sum(axis=1, keepdims=True)
        moved, back[:n, i] = _best(best[:n], t)
        best[:n] = moved + emit[:n, i]
    bwd, state = head("out_"), pdf["end_state"].to_numpy()[step.starts].astype(int)
    post, path = np.empty(prob.shape[:2]), np.empty(prob.shape[:2], dtype=int)
    for i in range(step.depth - 1, -1, -1):
        n, more = step.alive[i], step.alive[i + 1] if i + 1 < step.depth else 0
        if more:
            nxt = _spread(bwd[:more] * prob[:more, i + 1], theta[:more, i])
            bwd[:more] = nxt / nxt.sum(axis=1, keepdims=True)
            state[:more] = np.take_along_axis(back[:more, i + 1], state[:more, None], axis=1)[:, 0]
        both = fwd[:n, i] * bwd[:n]
        post[:n, i], path[:n, i] = both[:, 0] / both.sum(axis=1), state[:n]
    out = pdf[[*KEYS, "_blk", "pos"]].copy()
    out["p0"] = step.flat(post, len(pdf))
    out["p1"], out["state"] = 1 - out["p0"], step.flat(path, len(pdf))
    return out


def _apply(df: DataFrame, keys: Sequence[str], order: str, fn: Callable, schema: str) -> DataFrame:
    """Run ``fn(frame, starts)`` on whole key groups of each sorted partition."""
    keys = list(keys)

    def job(frames):
        for pdf, starts in _whole_groups(frames, keys):
            yield fn(pdf.reset_index(drop=True), starts)

    return df.sortWithinPartitions(*keys, order).mapInPandas(job, schema)


def transmission_states(
    sites: DataFrame, rate: float, s: Settings = DEFAULTS, block: int = DEFAULTS.scan_block_bp
) -> DataFrame:
    """Posterior ``p0, p1`` and most likely ``state`` of every site.

    ``sites(trio, parent, chrom, pos, p0, p1, observed)``; switches follow a
    constant ``rate`` in cM/Mb, ties in the best path go to state 0.
    """
    eps = s.geno_error
    typed = ", ".join(f"{c} {sites.schema[c].dataType.simpleString()}" for c in KEYS) + ", _blk long"
    rows = sites.select(*KEYS, "pos", "p0", "p1", "observed").withColumn("_blk", F.floor(F.col("pos") / block))
    # A fixed partition count: sizing by bytes would put this CPU-bound work on few tasks.
    parts = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *KEYS, "_blk")
    cells = ", ".join(f"{c} double" for c in _CELLS)
    blocks = _apply(rows, [*KEYS, "_blk"], "pos", lambda p, at: _transfer(p, at, rate, eps),
                    f"{typed}, first_pos long, last_pos long, {cells}")
    ends = ", ".join(f"{n}_{k} double" for n in ("in", "score", "out") for k in (0, 1))
    messages = _apply(blocks.repartition(parts, *KEYS), KEYS, "_blk", lambda p, at: _chain(p, at, rate),
                      f"{typed}, {ends}, end_state int")
    # The rows keep their partitioning through the join, whichever kind it becomes.
    joined = rows.join(messages, [*KEYS, "_blk"])
    return _apply(joined, [*KEYS, "_blk"], "pos", lambda p, at: _solve(p, at, rate, eps),
                  f"{typed}, pos long, p0 double, p1 double, state int")


def state_crossovers(states: DataFrame, min_posterior: float = 0.95) -> DataFrame:
    """Switches of the best path that the posterior supports.

    Sites are compared inside their block; only each block's last site is carried over.
    """
    w = W.partitionBy(*KEYS, "_blk").orderBy("pos")
    over = W.partitionBy(*KEYS).orderBy("_blk")
    here = F.struct("pos", "state", F.when(F.col("state") == 0, F.col("p0")).otherwise(F.col("p1")).alias("post"))
    # Only switches and the two edge sites of a block leave it.
    rows = states.select(*KEYS, "_blk", "pos", here.alias("_here"), F.lag(here).over(w).alias("_prev"), F.lead("pos").over(w).isNull().alias("_last"))
    rows = rows.filter(F.col("_prev").isNull() | F.col("_last") | (F.col("_prev.state") != F.col("_here.state")))
    per = rows.groupBy(*KEYS, "_blk").agg(
        F.max(F.when(F.col("_prev").isNull(), F.col("_here"))).alias("_first"),
        F.max(F.when(F.col("_last"), F.col("_here"))).alias("_end"),
        F.collect_list(F.when(F.col("_prev.state") != F.col("_here.state"), F.struct(F.col("_prev").alias("a"), F.col("_here").alias("b")))).alias("_in"),
    )
    across = F.struct(F.lag("_end").over(over).alias("a"), F.col("_first").alias("b"))
    pairs = per.withColumn("_x", across).select(*KEYS, F.explode(F.concat("_in", F.array("_x"))).alias("_p"))
    return pairs.filter(F.col("_p.a.state") != F.col("_p.b.state")).select(
        *KEYS, F.col("_p.a.pos").alias("prev_pos"), F.col("_p.b.pos").alias("new_pos"),
        F.col("_p.a.state").alias("prev_state"), F.col("_p.b.state").alias("new_state"),
        F.col("_p.b.post").alias("posterior"), (F.col("_p.b.pos") - F.col("_p.a.pos")).alias("gap_bp"),
    ).filter(F.col("posterior") >= min_posterior)
