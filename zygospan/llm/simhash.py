"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a string within half the radius of both. Every distinct
fingerprint emits all strings of its half ball; equal strings meet by a shuffle, and what meets is verified. Emission
runs in rounds over the strings' hashes, so only a slice of the variants lies on disk at a time.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import column, cut, release, small_batches
from zygospan.llm.exact_dedup import keep_rows
from zygospan.llm.graph import components, local_forest

WORDS = 4
RADIUS = 4
ROUNDS = 4
SEED = 42
BUCKET_VARIANTS = 2_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, width: int = WORDS, seed: int = SEED, step: int = 1 << 15) -> int:
    """Majority bits of the shingles' hashes; zero without a word. Long texts are hashed ``step`` shingles at a time."""
    words = TOKEN.findall((text or "").translate(UPPER))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, step):
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), seed) for i in range(a, min(n, a + step))]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def masks(radius: int) -> np.ndarray:
    """All 64-bit strings with at most ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(64), k)], dtype=np.uint64)


def fingerprints(docs: DataFrame, width: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, x, fp`` per row; ``fp`` holds the 64 bits as a signed long, ``x`` is xxhash64 of the text."""
    def run(batches):
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, width, seed) for t in column(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "x", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("x")).mapInArrow(run, "doc_id long, x long, fp long")


def collisions(fps: DataFrame, radius: int, round_: int, rounds: int, buckets: int) -> DataFrame:
    """Links ``a, b`` found among the variants of one round: a spanning forest of what meets in each bucket."""
    half = masks(radius // 2)

    def emit(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fps), 512):
                own = all_fps[i : i + 512]
                v = (own[:, None] ^ half[None, :]).ravel()
                owner = np.repeat(np.arange(len(own), dtype=np.uint32), len(half))
                h = (v * SPREAD) >> np.uint64(32)
                here = (h % np.uint64(rounds)) == round_
                v, owner, h = v[here], owner[here], h[here]
                bucket = ((h // np.uint64(rounds)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                v, owner, bucket = v[order], owner[order], bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                rows = [(int(bucket[a]), v[a:b].tobytes(), *_runs(owner[a:b], own)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
                names, kinds = ("bucket", "variants", "owners", "counts"), (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], list(names))

    def meet(table: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(table["variants"].to_pylist()), dtype=np.uint64)
        fp = np.repeat(np.frombuffer(b"".join(table["owners"].to_pylist()), dtype=np.uint64), np.frombuffer(b"".join(table["counts"].to_pylist()), dtype=np.uint16))
        order = np.argsort(v)
        v, fp = v[order], fp[order]
        same = v[1:] == v[:-1]
        # Neighbours in the sorted list that share a variant lie within twice half the radius; the count confirms it.
        a, b = fp[:-1][same], fp[1:][same]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        a, b = local_forest(a[near].view(np.int64), b[near].view(np.int64))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = fps.mapInArrow(emit, "bucket int, variants binary, owners binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(meet, "a long, b long")


def _runs(owner: np.ndarray, own: np.ndarray) -> tuple[bytes, bytes]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    counts = np.diff(np.append(cuts, len(owner))).astype(np.uint16)
    return own[owner[cuts]].tobytes(), counts.tobytes()


def links(fps: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) whose closure is that of all pairs within ``radius``."""
    spark = fps.sparkSession
    size = sum(1 for _ in masks(radius // 2))
    n = fps.count()
    buckets = max(64, -(-n * size // (rounds * BUCKET_VARIANTS)))
    out = None
    for r in range(rounds):
        found = cut(collisions(fps, radius, r, rounds, buckets), "ball_links")
        release(spark)
        out = found if out is None else out.unionByName(found)
    return cut(out.distinct(), "ball_links")


def near_duplicates(docs: DataFrame, width: int = WORDS, radius: int = RADIUS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``doc_id, x, fp, component_id, root`` per row of ``docs``; ``root`` names a component even if it has no id.

    Fingerprints at most ``radius`` bits apart are linked; ``component_id`` is the smallest doc_id reachable. A text
    without a word, or a null one, has fingerprint zero and is linked like any other. Repeated rows share a fingerprint
    and so a component. A null doc_id is never the smallest unless the component has no other. ``radius`` must be
    even; empty tables give no rows.
    """
    prints = cut(fingerprints(docs, width, seed), "simhashes")
    distinct = cut(prints.select("fp").distinct(), "simhash_values")
    roots = components(links(distinct, radius, rounds))
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(roots, F.col("fp") == F.col("node"), "left")
    lowest = cut(lowest.select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "simhash_roots")
    best = cut(lowest.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash_components")
    names = cut(lowest.select("fp", "root").join(best, "root"), "simhash_names")
    return prints.join(names, "fp").select("doc_id", "x", "fp", "component_id", "root")


def keep_near(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` per component, that of its smallest doc_id; among texts that share it, the least hash."""
    found = cut(near_duplicates(docs, **settings), "near_duplicates")
    best = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = best.groupBy("component_id", "root").agg(F.min("x").alias("x")).select(F.col("component_id").alias("doc_id"), "x")
    return keep_rows(docs, kept)
