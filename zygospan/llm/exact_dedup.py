"""Exact duplicates by composable polynomial fingerprints.

A text is hashed in chunks; the hashes of two neighbours combine to that of their concatenation by
``h(xy) = h(x) * B^len(y) + h(y)`` modulo a prime, twice over. Rows with equal length and fingerprints are then
compared chunk by chunk; groups that differ in some chunk are separated by a full digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import column, cut, fresh, release, small_batches

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 918273645)


def powers(chunk: int = CHUNK, primes=PRIMES, bases=BASES) -> list[np.ndarray]:
    """Per modulus the powers ``B^(chunk-1) .. B^0``."""
    out = []
    for p, b in zip(primes, bases):
        row = [1]
        for _ in range(chunk - 1):
            row.append(row[-1] * b % p)
        out.append(np.array(row[::-1], dtype=np.uint64))
    return out


def chunk_hashes(data: bytes, table: list[np.ndarray], primes=PRIMES) -> list[tuple[int, int, int]]:
    """``(length, h1, h2)`` of each chunk; a byte counts as its value plus one, so zeros lengthen the text too."""
    chunk, out = len(table[0]), []
    raw = np.frombuffer(data, dtype=np.uint8)
    for i in range(0, len(raw), chunk):
        x = raw[i : i + chunk].astype(np.uint64) + np.uint64(1)
        out.append((len(x), *(int((x * t[chunk - len(x):]).sum()) % p for t, p in zip(table, primes))))
    return out


def combine(parts, primes=PRIMES, bases=BASES) -> tuple[int, int, int]:
    """Fingerprint of a concatenation from those of its parts, in order; associative."""
    n, h = 0, [0, 0]
    for length, *hs in parts:
        h = [(a * pow(b, length, p) + x) % p for a, x, p, b in zip(h, hs, primes, bases)]
        n += length
    return n, h[0], h[1]


def fingerprints(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES, bases=BASES) -> DataFrame:
    """``uid, doc_id, x, n_bytes, h1, h2, text_sha256`` per row; a null text counts as empty.

    The tasks hash chunks; the built-in fold over the chunk list applies the length-shifted arithmetic.
    """
    table = powers(chunk, primes, bases)

    def run(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("n", "h1", "h2", "s1", "s2")]))
        for batch in small_batches(batches):
            parts, shas = [], []
            for text in column(batch, "text"):
                data = (text or "").encode()
                parts.append([
                    {"n": n, "h1": a, "h2": b, "s1": pow(bases[0], n, primes[0]), "s2": pow(bases[1], n, primes[1])}
                    for n, a, b in chunk_hashes(data, table, primes)
                ])
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3)), pa.array(parts, kind), pa.array(shas, pa.string())],
                ["uid", "doc_id", "x", "parts", "text_sha256"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("x"))
    rows = rows.mapInArrow(run, "uid long, doc_id long, x long, parts array<struct<n:long,h1:long,h2:long,s1:long,s2:long>>, text_sha256 string")
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "h1", "h2")))
    whole = F.aggregate("parts", zero, lambda a, c: F.struct(
        (a["n"] + c["n"]).alias("n"), ((a["h1"] * c["s1"] + c["h1"]) % primes[0]).alias("h1"), ((a["h2"] * c["s2"] + c["h2"]) % primes[1]).alias("h2"),
    ))
    return rows.select("uid", "doc_id", "x", whole.alias("w"), "text_sha256").select(
        "uid", "doc_id", "x", F.col("w.n").alias("n_bytes"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), "text_sha256"
    )


KEY = ["n_bytes", "h1", "h2"]


def colliding_groups(docs: DataFrame, prints: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Keys of groups whose rows are not all equal, found chunk by chunk.

    The least and the greatest value of a chunk are kept per map task, so a group of any size sends two per task.
    """
    members = prints.join(groups.select(*KEY), KEY).select("doc_id", "x", *KEY).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.coalesce("text", F.lit("")).cast("binary").alias("_b"), F.xxhash64("text").alias("_x"))
    rows = texts.join(members, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_x") == F.col("x")) & (F.octet_length("_b") == F.col("n_bytes")))
    pieces = rows.select(*KEY, "_b", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("n_bytes", F.lit(1)) - 1) / chunk).cast("int"))).alias("k")).select(
        *KEY, "k", F.substring("_b", F.col("k") * chunk + 1, F.lit(chunk)).alias("piece")
    )
    ends = pieces.groupBy(*KEY, "k").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    return ends.filter("lo <> hi").select(*KEY).distinct()


def exact_duplicates(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES, bases=BASES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes`` and the join key ``x``.

    Of equal texts the row with the largest doc_id stays. Null texts equal empty ones; a null doc_id ranks below all
    others; of repeated rows with the same id and text exactly one stays. No rows in, no rows out; columns other than
    ``doc_id`` and ``text`` are ignored.
    """
    prints = cut(fingerprints(docs, chunk, primes, bases), "prints")
    groups = cut(prints.groupBy(*KEY).count().filter("count > 1"), "print_groups")
    bad = cut(colliding_groups(docs, prints, groups, chunk), "print_collisions")
    release(docs.sparkSession)
    split = prints.join(bad.withColumn("bad", F.lit(True)), KEY, "left").withColumn("sub", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad")
    best = split.groupBy(*KEY, "sub").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "uid")).alias("best"),
    ).filter("group_size > 1")
    best = cut(best.select(*KEY, "sub", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid")), "print_best")
    alone = F.col("group_size").isNull()
    return split.join(best, [*KEY, "sub"], "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"), "text_sha256", "n_bytes", "x",
    )


def keep_exact(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, exact_duplicates(docs, chunk).filter("kept").select("doc_id", "x"))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``(doc_id, x)`` of ``kept``, x being xxhash64 of the text.

    Only ids that occur on several equal rows are reduced by an aggregate; the rest passes a semi-join.
    """
    x = F.xxhash64("text")
    i, h, row = (fresh(docs.columns, n) for n in ("_keep_id", "_keep_x", "_keep_row"))
    kept = kept.select(F.col("doc_id").alias(i), F.col("x").alias(h)).distinct()
    on = lambda k: F.col("doc_id").cast("long").eqNullSafe(k[i]) & (x == k[h])
    times = cut(docs.groupBy(F.col("doc_id").cast("long").alias(i), x.alias(h)).count().filter("count > 1").drop("count"), "repeated_rows")
    if times.isEmpty():
        return docs.join(kept, on(kept), "left_semi")
    once = docs.join(kept, on(kept), "left_semi").join(times, on(times), "left_anti")
    both = times.join(kept.withColumnsRenamed({i: f"{i}k", h: f"{h}k"}), F.col(i).eqNullSafe(F.col(f"{i}k")) & (F.col(h) == F.col(f"{h}k")), "left_semi")
    more = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col("doc_id").cast("long").alias("d"), x.alias("x"))
    more = more.join(both, F.col("d").eqNullSafe(F.col(i)) & (F.col("x") == F.col(h)))
    firsts = more.groupBy(i, h).agg(F.first(row).alias(row))
    return once.unionByName(firsts.select(f"{row}.*"))
