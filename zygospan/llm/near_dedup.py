"""Near duplicates by the Jaccard similarity of word shingles, which decides on every candidate.

SimHash ball hashing (``simhash.links``) finds the texts whose fingerprints nearly agree; similar texts that it misses, as a
similarity of 0.8 leaves more than its bits differing, are found by MinHash bands.
Texts that share a band meet its least member first, so a large group of near copies costs one comparison a member, not
one a pair. Only a band that still holds several components is compared inside, in one task: all pairs across them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm import simhash
from zygospan.llm.common import column, cut, release, small_batches
from zygospan.llm.exact_dedup import keep_rows
from zygospan.llm.graph import components

WORDS = 5
#: Least similarity as a fraction. A pair at 0.8 misses all of 32 bands of 4 with a chance of (1 - 0.8^4)^32 = 5e-8.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, DEPTH = 32, 4
SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * DEPTH, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, ASCII letters lowered; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(width, len(h))):
        out = mixed((out ^ h[i : i + n]) + MIX)
    return np.unique(out)


def bands(grams: np.ndarray, step: int = 1 << 12) -> np.ndarray:
    """One key per band over the least values of its permutations; a text without a word has none."""
    if not len(grams):
        return np.empty(0, dtype=np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), step):
        least = np.minimum(least, (FACTORS[:, None] * grams[None, i : i + step]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, DEPTH).T:
        key = mixed((key ^ part) + MIX)
    return key.view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(p.view(np.int64) for p in parts)])))


def prints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id, x, node, fp, bands`` per row; ``x`` is xxhash64 of the text, equal shingle sets share a ``node``."""
    def run(batches):
        for batch in small_batches(batches):
            sets = [shingles(t, width) for t in column(batch, "text")]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64)
            fps = np.array([simhash.fingerprint(t, width) for t in column(batch, "text")], dtype=np.uint64)
            parts = [batch.column(0), batch.column(2), *(pa.array(v.view(np.int64)) for v in (nodes, fps)), lists([bands(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(parts, ["doc_id", "x", "node", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("x"))
    return rows.mapInArrow(run, "doc_id long, x long, node long, fp long, bands array<long>")


def ball_pairs(names: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``names(node, fp)`` to compare: the links of the fingerprints' balls, between the least node of each
    fingerprint, and that node with all others of its own."""
    lead = cut(names.groupBy("fp").agg(F.min("node").alias("lead")), "near_leads")
    ball = simhash.links(lead.select("fp"))
    end = lambda c: lead.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    across = ball.join(end("a"), "a").join(end("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    same = names.join(lead, "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return cut(across.unionByName(same), "near_ball")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = WORDS) -> DataFrame:
    """``node, grams, n`` for the texts whose hash ``x`` is in ``wanted``."""
    def run(batches):
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), lists([shingles(t, width) for t in column(batch, "text")])], ["node", "grams"])

    rows = docs.select("text", F.xxhash64("text").alias("x")).join(wanted.select("x", "node"), "x").select("text", "node")
    rows = rows.mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])
    return rows.select("node", "grams", F.size("grams").alias("n"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have the least similarity or more, in whole numbers."""
    own = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams"), F.col("n").alias(f"{c}_n"))
    both = pairs.join(own("b"), "b").join(own("a"), "a")
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    return both.filter(DENOMINATOR * common >= NUMERATOR * (F.col("a_n") + F.col("b_n") - common)).select("a", "b")


def links_across(table: pa.Table) -> pa.Table:
    """Fewest links ``a, b`` that join the components of one band as its similar pairs do; all pairs count, few leave."""
    node, sets = table["node"].to_numpy(), table["grams"].combine_chunks()
    label = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    gram = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    order, ends = np.argsort(gram, kind="stable"), np.cumsum(n)
    holders = np.repeat(np.arange(len(n)), n)[order]
    at = np.searchsorted(gram[order], np.arange(gram.max() + 2))
    out = []
    for i in range(len(n) - 1):
        apart = (label != label[i]) & (DENOMINATOR * np.minimum(n, n[i]) >= NUMERATOR * np.maximum(n, n[i]))
        apart[: i + 1] = False
        if not apart.any():
            continue
        common = np.bincount(np.concatenate([holders[at[g] : at[g + 1]] for g in gram[ends[i] - n[i] : ends[i]]]), minlength=len(n))
        for j in np.flatnonzero(apart & (DENOMINATOR * common >= NUMERATOR * (n + n[i] - common))):
            if label[j] != label[i]:
                out.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def near_groups(docs: DataFrame, width: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """``node, x, best`` per distinct shingle set, and ``node, root`` of those that are linked."""
    spark = docs.sparkSession
    found = cut(prints(docs, width), "near_prints")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "x")
    names = cut(found.groupBy("node").agg(F.min("x").alias("x"), F.min(first).alias("best"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "near_names")
    ball = ball_pairs(names)
    rows = cut(names.select("node", F.explode("bands").alias("key")), "near_bands")
    shared = cut(rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key", "a"), "near_centres")
    met = cut(rows.join(shared, "key"), "near_met")
    release(spark)
    pairs = met.filter("node <> a").select("a", F.col("node").alias("b")).unionByName(ball).distinct()
    pairs = cut(pairs, "near_pairs")
    asked = met.select("node").unionByName(ball.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = cut(shingle_sets(docs, names.join(asked, "node"), width), "near_sets")
    links = cut(similar(pairs, sets), "near_links")
    roots = cut(components(links), "near_roots")
    # What its band's centre did not link is compared inside the band.
    rooted = cut(met.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near_met")
    open_ = cut(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "near_open")
    left = rooted.join(open_, "key").join(sets, "node").select("key", "node", "root", "grams")
    more = cut(left.groupBy("key").applyInArrow(links_across, "a long, b long").distinct(), "near_links")
    release(spark)
    return names, roots if more.isEmpty() else components(links.unionByName(more))


def keep_near(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """One row of ``docs`` per group of near copies, that of its smallest doc_id; among texts that share it, the least hash.

    Two texts are near copies if the Jaccard similarity of their shingle sets is at least 0.8; a group is what such
    pairs connect. Texts without a word, or null, are alike. A null doc_id stays only where the group has no other.
    """
    names, roots = near_groups(docs, width)
    best = names.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return keep_rows(docs, best.select("best.doc_id", "best.x"))
