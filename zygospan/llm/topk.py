"""Exact top-k search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zygospan.llm.common import cut

SCALE = 1024
BLOCK = 8192
QUERY_BLOCK = 2048


def threshold_topk(vectors: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``ids, scores`` of the best ``k`` rows, ties to the smaller id.

    ``order[:, d]`` lists the rows by falling value of dimension ``d``; a negative weight reads it from the end. Depth
    by depth the rows met are scored in full, until no row below the lists' current places can reach the kth score.
    """
    n = len(vectors)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(n, dtype=bool)
    scores = np.full(n, np.iinfo(np.int64).min)
    out, depth = ids == own, 0
    while depth < n:
        reach = min(n, max(step, 2 * depth))
        fresh = np.zeros(n, dtype=bool)
        fresh[order[depth:reach, up].ravel()] = True
        fresh[order[n - reach : n - depth, down].ravel()] = True
        new = np.flatnonzero(fresh & ~seen & ~out)
        scores[new] = vectors[new] @ query
        seen |= fresh
        depth = reach
        found = scores[seen & ~out]
        if len(found) >= k:
            bound = vectors[order[depth - 1, up], up] @ query[up] + vectors[order[n - depth, down], down] @ query[down]
            if np.partition(found, len(found) - k)[len(found) - k] > bound:
                break
        if not len(up) and not len(down):
            break
    if not len(up) and not len(down):
        seen[:], scores[:] = True, 0
    rows = np.flatnonzero(seen & ~out)
    best = rows[np.lexsort((ids[rows], -scores[rows]))[:k]]
    return ids[best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's best rows by integer inner product; exact.

    Both tables have ``vec_id, embedding``; a component counts as ``floor(scale * x)``. Vectors that are null or hold a
    null or non-finite component, and null ids, take no part; vectors meet only those of their own length. A query does
    not return rows with its own id; equal scores go to the smaller id; repeated rows are returned each, repeated queries
    asked once. Blocks of rows
    meet blocks of queries, each pair in a task of bounded size, and pass on ``k`` rows a query.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v.cast("double")))

    def clean(df: DataFrame) -> DataFrame:
        whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
        return df.filter(sound).select(F.col("vec_id").cast("long"), whole.alias("v"), F.size(x).alias("dim"), F.monotonically_increasing_id().alias("_uid"))

    rows, asked = cut(clean(vectors), "vectors"), cut(clean(queries.dropDuplicates(["vec_id", "embedding"])), "query_vectors")
    n_blocks, n_asked = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // query_block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("_uid"), F.lit(n_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("_uid"), F.lit(n_asked)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {c: pa.array([], t) for c, t in (("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        dim = int(left["dim"][0].as_py())
        v = left["v"].combine_chunks().flatten().to_numpy().reshape(left.num_rows, dim)
        ids = left["vec_id"].to_numpy()
        order = np.argsort(-v, axis=0, kind="stable").astype(np.int32)
        asked_v = right["v"].combine_chunks().flatten().to_numpy().reshape(right.num_rows, dim)
        parts = [(q, *threshold_topk(v, ids, order, a, q, k)) for q, a in zip(right["vec_id"].to_pylist(), asked_v)]
        return pa.table({
            "asked": pa.array(np.repeat(right["_uid"].to_numpy(), [len(i) for _, i, _ in parts])),
            "query_id": pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in parts]).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in parts]).astype(np.int64)), "score": pa.array(np.concatenate([s for _, _, s in parts]).astype(np.int64)),
        })

    keys = ("dim", "b", "q")
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "asked long, query_id long, vec_id long, score long")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
