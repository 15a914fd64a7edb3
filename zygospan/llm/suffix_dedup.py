"""Repeated substrings by a distributed difference-cover suffix order.

Suffixes at positions of a perfect difference cover modulo 21 are sampled and named by the tuple of bytes they start
with. Any two suffixes with a common prefix of ``length`` bytes have, at one and the same distance below 21, sampled
suffixes with equal names; so names that occur once rule out all suffixes that hang on them, and the names that are
left recurse to whole prefixes: each remaining suffix is keyed by its prefix of ``length`` bytes, the keys are sorted,
and neighbours with equal prefixes form a class whose smallest document keeps the text.

Names are ordered by 64-bit fingerprints rather than alphabetically (equality is all that is asked), and suffixes are
compared to ``length`` bytes only. Documents lie in blocks; a block sends its distinct names, sorted and packed, to
buckets and gets a bit back for each, so a passage that fills the corpus costs one entry per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import cut, release

LENGTH = 50
COVER = (0, 1, 4, 14, 16)  # every difference modulo 21 occurs
PERIOD = 21
BLOCK_BYTES = 2 << 20
BUCKET_NAMES = 2_000_000
FILLER = 8  # bytes after a block's text, so that words of eight bytes can be read at every place

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``raw`` ends with ``FILLER`` spare bytes."""
    n = len(raw) - FILLER
    out = np.empty(n, dtype=np.uint64)
    for r in range(min(8, n)):
        k = (n - r + 7) // 8
        out[r::8] = np.frombuffer(raw, dtype="<u8", count=k, offset=r)
    return out


def prefix_names(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the ``length`` bytes from each place ``at``, read as overlapping words."""
    h = np.full(len(at), length, dtype=np.uint64)
    for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        h ^= words[at + step]
        h *= _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
    return h


class Block:
    """Texts of a block end to end, with the order of their documents. Null ids come after all others."""

    def __init__(self, docs: list[tuple[int | None, bytes]], length: int):
        self.ids = np.array([2**63 - 1 if i is None else i for i, _ in docs], dtype=np.int64)
        sizes = np.array([len(t) for _, t in docs], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = np.frombuffer(b"".join(t for _, t in docs) + bytes(FILLER), dtype=np.uint8)
        self.words, self.length, self.tuple = eights(self.raw), length, length - PERIOD + 1

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover places whose tuple lies in their document, and the row of the document."""
        at, row = [], []
        grid = np.array(COVER, dtype=np.int64)
        for k, (a, b) in enumerate(zip(self.starts, self.ends)):
            last = b - a - self.tuple
            if b - a < self.length:
                continue
            p = (np.arange(0, last + 1, PERIOD)[:, None] + grid).ravel()
            p = p[p <= last] + a
            at.append(p)
            row.append(np.full(len(p), k, dtype=np.int32))
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(at), np.concatenate(row)) if at else (none, none.astype(np.int32))

    def sample_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct names, whether each is met in two documents here, and the place's index into them."""
        at, row = self.sampled()
        names = prefix_names(self.words, at, self.tuple)
        return at, *_distinct(names, self.ids[row] if len(row) else row.astype(np.int64))

    def suffixes(self, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Places of suffixes with ``length`` bytes in their document that hang on a sampled place with a repeated name."""
        edge = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.add.at(edge, np.maximum(at[hit] - PERIOD + 1, 0), 1)
        np.add.at(edge, at[hit] + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        whole = np.zeros(len(self.words) + 1, dtype=np.int32)
        long_ = self.ends - self.starts >= self.length
        np.add.at(whole, self.starts[long_], 1)
        np.add.at(whole, self.ends[long_] - self.length + 1, -1)
        return np.flatnonzero(near & (np.cumsum(whole[:-1]) > 0))

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def suffix_names(self, at: np.ndarray):
        """Sorted distinct prefix names, the least id of each here, and each suffix's index into them."""
        names = prefix_names(self.words, at, self.length)
        ids = self.ids[self.rows_of(at)]
        order = np.lexsort((ids, names))
        first = np.ones(len(order), dtype=bool)
        first[1:] = names[order][1:] != names[order][:-1]
        index = np.empty(len(order), dtype=np.int64)
        index[order] = np.cumsum(first) - 1
        return names[order][first], ids[order][first], index, ids


def _distinct(names: np.ndarray, ids: np.ndarray):
    order = np.argsort(names, kind="stable")
    s, d = names[order], ids[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    index = np.empty(len(s), dtype=np.int64)
    index[order] = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    many = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins) if len(begins) else np.zeros(0, dtype=bool)
    return s[first], many, index


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def pack_names(names: np.ndarray, buckets: int) -> bytes:
    """Names without what their bucket says: seven bytes each, of which nothing is lost from 256 buckets up."""
    rest = (names >> np.uint64(32)) // np.uint64(buckets) << np.uint64(32) | names & np.uint64(0xFFFFFFFF)
    return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpack_names(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def removed_spans(block: Block, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """Maximal runs covered by the prefixes that start at ``at``, per document, in its own places."""
    edge = np.zeros(len(block.words) + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.length, -1)
    covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    step = np.diff(covered)
    out: list[list[tuple[int, int]]] = [[] for _ in block.ids]
    # Prefixes never cross a document, but runs of two documents may touch: they are cut at its end.
    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
        k = int(np.searchsorted(block.ends, a, side="right"))
        while a < b:
            stop = min(b, block.ends[k])
            if stop > a:
                out[k].append((int(a - block.starts[k]), int(stop - block.starts[k])))
            a, k = max(a, stop), k + 1
    return out


def _blocks(batches, length: int):
    """Groups a stream of rows sorted by block, replies first, into ``(block, docs, replies, copies)``."""
    now, docs, replies, copies = None, [], {}, {}
    for batch in batches:
        at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        block, kind, doc_id, x, bucket = (at[c].to_pylist() for c in ("_block", "_kind", "doc_id", "_x", "_bucket"))
        for i in range(batch.num_rows):
            if block[i] != now:
                if docs:
                    yield now, docs, replies, copies
                now, docs, replies, copies = block[i], [], {}, {}
            if kind[i] < 2:
                replies[kind[i], bucket[i]] = at["_data"][i].as_py()
            elif kind[i] == 2:
                copies[doc_id[i], x[i]] = True
            else:
                docs.append((doc_id[i], x[i], at["_data"][i].as_py()))
    if docs:
        yield now, docs, replies, copies


def _own(docs, copies):
    """Texts of a block that stand for themselves: repeated rows and later copies of an equal text do not."""
    return [(i, t) for i, x, t in docs if (i, x) not in copies]


def _bits(index_bits: dict[int, bytes], buckets: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Replies put back on a block's names; ``order`` is the one they were sent in."""
    out = np.zeros(len(buckets), dtype=bool)
    for a, b in _ranges(buckets[order]):
        data = index_bits.get(int(buckets[order[a]]))
        if data is not None:
            out[order[a:b]] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=b - a).astype(bool)
    return out


def _ranges(sorted_: np.ndarray):
    if len(sorted_):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1, [len(sorted_)]])
        yield from zip(cuts[:-1], cuts[1:])


SENT = "bucket int, block long, names binary, ids binary, counts binary"
_SENT = (("bucket", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()))


def _send_samples(length: int, buckets: int):
    """Per block and bucket the distinct sample names, four bytes each beyond the bucket."""
    def run(batches):
        for block, docs, _, copies in _blocks(batches, length):
            b = Block(_own(docs, copies), length)
            _, names, _, _ = b.sample_names()
            to = bucket_of(names, buckets)
            order = np.argsort(to, kind="stable")
            rows = [(int(to[order[i]]), block, names[order[i:j]].astype("<u4").tobytes(), b"", b"") for i, j in _ranges(to[order])]
            yield _batch(rows, _SENT)
    return run


def _send_suffixes(length: int, buckets: int, wide: int):
    """Per block and bucket the distinct prefix names of the suffixes left, grouped by the least document here."""
    def run(batches):
        for block, docs, replies, copies in _blocks(batches, length):
            b = Block(_own(docs, copies), length)
            names, ids, _, _ = b.suffix_names(_left(b, replies, buckets))
            to = bucket_of(names, wide)
            order = np.lexsort((ids, to))
            rows = []
            for i, j in _ranges(to[order]):
                part = order[i:j]
                cuts = [a for a, _ in _ranges(ids[part])]
                counts = np.diff([*cuts, len(part)]).astype("<u4")
                rows.append((int(to[part[0]]), block, pack_names(names[part], wide), ids[part][cuts].astype("<i8").tobytes(), counts.tobytes()))
            yield _batch(rows, _SENT)
    return run


def _left(b: Block, replies: dict, buckets: int) -> np.ndarray:
    at, names, many, index = b.sample_names()
    to = bucket_of(names, buckets)
    elsewhere = _bits({k[1]: v for k, v in replies.items() if k[0] == 0}, to, np.argsort(to, kind="stable"))
    return b.suffixes(at, (many | elsewhere)[index])


def _batch(rows: list[tuple], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _reply(table: pa.Table, shared: np.ndarray, sizes: list[int]) -> pa.Table:
    """One bit per name sent, back to its block; blocks without a set bit get no row."""
    ends = np.cumsum(sizes)
    blocks, data = [], []
    for block, n, e in zip(table["block"].to_pylist(), sizes, ends):
        part = shared[e - n : e]
        if part.any():
            blocks.append(block)
            data.append(np.packbits(part).tobytes())
    bucket = table["bucket"][0].as_py()
    return pa.table({"_block": pa.array(blocks, pa.int64()), "_bucket": pa.array([bucket] * len(data), pa.int32()), "_data": pa.array(data, pa.binary())})


def _meet_samples(table: pa.Table) -> pa.Table:
    """Sorts a bucket's names; a name that neighbours an equal one occurs in another block too."""
    sent = table["names"].to_pylist()
    names = np.frombuffer(b"".join(sent), dtype="<u4")
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    shared = np.zeros(len(names), dtype=bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return _reply(table, shared, [len(s) // 4 for s in sent])


def _meet_suffixes(table: pa.Table) -> pa.Table:
    """Sorts a bucket's prefixes; in a run of equal neighbours all but the least document's have an earlier copy."""
    sent = table["names"].to_pylist()
    names = unpack_names(b"".join(sent))
    ids = np.repeat(np.frombuffer(b"".join(table["ids"].to_pylist()), dtype="<i8"), np.frombuffer(b"".join(table["counts"].to_pylist()), dtype="<u4"))
    order = np.argsort(names, kind="stable")
    s, d = names[order], ids[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    begins = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(d, begins), np.diff(np.append(begins, len(s)))) if len(begins) else d
    earlier = np.zeros(len(names), dtype=bool)
    earlier[order] = least < d
    return _reply(table, earlier, [len(x) // 7 for x in sent])


def _finish(length: int, buckets: int, wide: int, with_text: bool):
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
             ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]

    def run(batches):
        for _, docs, replies, copies in _blocks(batches, length):
            b = Block(_own(docs, copies), length)
            at = _left(b, replies, buckets)
            names, least, index, ids = b.suffix_names(at)
            to = bucket_of(names, wide)
            earlier = _bits({k[1]: v for k, v in replies.items() if k[0] == 1}, to, np.lexsort((least, to)))
            gone = at[earlier[index] | (ids > least[index])] if len(at) else at
            spans = iter(removed_spans(b, gone))
            rows = []
            for doc_id, x, text in docs:
                own = next(spans) if (doc_id, x) not in copies else [(0, len(text))] if len(text) >= length else []
                cuts = [0, *(p for s in own for p in s), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                rows.append((doc_id, len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), [{"start": s, "stop": e} for s, e in own], kept if with_text else None))
            yield _batch(rows, kinds)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_names: int = BUCKET_NAMES, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` per row of ``docs``.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller doc_id; strings are
    judged on the input and never cross documents. Null texts are empty. Null ids come after all others and, like rows
    that share an id, take nothing from one another. ``kept`` holds the bytes that stay if ``with_text`` is set.
    ``length`` must be at least 29. Texts, samples and suffixes pass through tasks a block or a bucket at a time.
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    sizes = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_x"), F.octet_length(text).alias("n"), F.sha2(text, 256).alias("sha"))
    sizes = cut(sizes, "repeat_sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    # The sample has 5 names in 21 bytes; the bucket counts follow the input's size.
    buckets = max(64, -(-total * len(COVER) // (PERIOD * bucket_names)))
    wide = max(256, -(-total // (2 * bucket_names)))
    same = cut(sizes.groupBy("sha", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "repeat_groups")
    copies = sizes.join(same, ["sha", "n"]).filter("doc_id > least or (doc_id is null and least is not null)").select("doc_id", "_x").distinct()
    copies = cut(copies, "repeat_copies")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks))
    pick = lambda df, kind, data, bucket: df.select(
        F.col("_block") if "_block" in df.columns else block.alias("_block"), F.lit(kind).alias("_kind"),
        (F.col("doc_id") if "doc_id" in df.columns else F.lit(None)).cast("long").alias("doc_id"), (F.col("_x") if "_x" in df.columns else F.lit(None)).cast("long").alias("_x"),
        bucket.cast("int").alias("_bucket"), data.alias("_data"),
    )
    none, empty = F.lit(None), F.lit(None).cast("binary")
    texts = pick(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_x"), text.alias("_text")), 3, F.col("_text"), none)
    tasks = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // 8)))

    def stream(*replies: DataFrame) -> DataFrame:
        rows = texts.unionByName(pick(copies, 2, empty, none))
        for kind, r in enumerate(replies):
            rows = rows.unionByName(pick(r, kind, F.col("_data"), F.col("_bucket")))
        return rows.repartition(tasks, "_block").sortWithinPartitions("_block", "_kind", "doc_id", "_x")

    replied = "_block long, _bucket int, _data binary"
    names = stream().mapInArrow(_send_samples(length, buckets), SENT)
    samples = cut(names.groupBy("bucket").applyInArrow(_meet_samples, replied), "repeat_samples")
    release(spark)
    names = stream(samples).mapInArrow(_send_suffixes(length, buckets, wide), SENT)
    suffixes = cut(names.groupBy("bucket").applyInArrow(_meet_suffixes, replied), "repeat_suffixes")
    release(spark)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"
    return stream(samples, suffixes).mapInArrow(_finish(length, buckets, wide, with_text), schema)
