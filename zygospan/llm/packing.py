"""Packing documents into fixed-length sequences by best-two-fit.

Documents become token pieces; pieces are dealt over shards and each shard is packed on its own. A bin is filled
greedily with the longest piece that fits; then its smallest piece gives way to two unpacked ones if they fill the
widened gap more tightly. Badly filled bins of all shards are packed again together while that spares enough of them.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import Words, column, cut, fresh, small_batches

LENGTH = 2048
END = 0
SHARD_PIECES = 8192
WELL_FILLED = 0.98
CACHE_WORDS = 300_000
TOKENIZER = "word_bpe_49k.json"
# Words whose lower-case form and parts do not hang on their context, and the parts the tokenizer's own pattern cuts.
_LETTER = "a-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[!-~{_LETTER}]*")
_LETTERS = re.compile(f"[{_LETTER}]+")
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|\n|[^{_LETTER}0-9\n]+")


_SEPARATOR = np.isin(np.arange(256), [9, 10, 32])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def word_hashes(data: bytes, start: np.ndarray, length: np.ndarray, longest: int = 64) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each slice of ``data``, which ends in eight bytes of padding; eight bytes a step."""
    raw = np.frombuffer(data, dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 7,), (1,))
    out = [length.astype(np.uint64) * m for m in _MIX]
    for at in range(0, min(longest, int(length.max(initial=0))), 8):
        here = np.flatnonzero(length > at)
        chunk = eight[start[here] + at] & _MASKS[np.minimum(length[here] - at, 8)]
        for h, m in zip(out, _MIX[::-1]):
            x = (h[here] ^ chunk) * m
            h[here] = (x ^ (x >> np.uint64(29))) * _MIX[0]
    for i in np.flatnonzero(length > longest).tolist():
        word = data[start[i] : start[i] + length[i]]
        for k, h in enumerate(out):
            h[i] = xxhash.xxh64_intdigest(word, k)
    return out


class WordTokenizer:
    """Ids of whole texts by the named tokenizer, which joins nothing over white space: words are encoded once and kept.

    The words of a block are told apart by two hashes and looked up together; the table holds their ids end to end.
    A full table forgets the words that only one block held since it was last full. A word of plain letters, digits and marks
    is taken apart as the tokenizer does it, so that its parts are shared with other words; letter runs go through the
    tokenizer many at a time, as each ends in a token of its own kind.
    """

    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores by themselves
        self.tokenizer, self.most, self.parts = Tokenizer.from_file(path), most, Words()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.met, self.pool = np.empty(0, bool), np.empty(0, "<u4")

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for all tasks of a worker process."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        parts = [t.encode() for t in texts]
        data = b" ".join(parts) + bytes(8)
        first = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        ends = np.append(np.flatnonzero(_SEPARATOR[np.frombuffer(data, dtype=np.uint8)[:-8]]), len(data) - 8)
        start = np.r_[0, ends[:-1] + 1]
        start, length = start[ends > start], (ends - start)[ends > start]
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(len(texts), dtype=np.int64)
        key, check = word_hashes(data, start, length)
        own, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        clash = (check != check[at][inverse]).any()
        if clash:
            # Two words of this block share the first hash: both hashes together tell them apart, in a table of their own.
            self._clear()
            own, at, inverse = np.unique(key ^ check, return_index=True, return_inverse=True)
        place = self._known(own, check[at], data, start[at], length[at])
        n, at = self.count[place][inverse], self.start[place][inverse]
        ids = self.pool[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if clash:
            self._clear()
        text = np.searchsorted(first, start, side="right") - 1
        return ids, np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)

    def _known(self, key: np.ndarray, check: np.ndarray, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places in the table of distinct words, given in the order of their keys; new ones are learned."""
        if len(self.key) > self.most:
            self._forget()
        at = np.searchsorted(self.key, key)
        found = np.zeros(len(key), dtype=bool)
        inside = at < len(self.key)
        found[inside] = self.key[at[inside]] == key[inside]
        if (self.check[at[found]] != check[found]).any():
            self._clear()
            at, found = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
        new = ~found
        if new.any():
            words = [data[a : a + n].decode() for a, n in zip(start[new].tolist(), length[new].tolist())]
            ids, count = self._learn(words)
            where = at[new]
            self.start = np.insert(self.start, where, len(self.pool) + np.cumsum(count) - count)
            self.count = np.insert(self.count, where, count)
            self.key, self.check = np.insert(self.key, where, key[new]), np.insert(self.check, where, check[new])
            self.met = np.insert(self.met, where, False)
            self.pool = np.concatenate([self.pool, ids])
            at = at + np.cumsum(new) - new
        self.met[at[found]] = True
        return at

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met)
        if 2 * len(kept) > self.most:
            kept = kept[:0]
        n, at = self.count[kept], self.start[kept]
        self.pool = self.pool[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.start, self.count = np.cumsum(n) - n, n
        self.key, self.check, self.met = self.key[kept], self.check[kept], np.zeros(len(kept), dtype=bool)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words end to end, and how many each has."""
        if len(self.parts) > self.most:
            self.parts = self.parts.next()
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None and "<|" not in w for w in words), dtype=bool, count=len(words))
        split = _PART.findall("\n".join([w for w, p in zip(words, plain.tolist()) if p]).lower())
        self._learn_parts([p for p in dict.fromkeys(split) if p != "\n" and self.parts[p] is None])
        self.parts["\n"] = b""
        found = list(map(self.parts.__getitem__, split))
        ends = np.append(np.flatnonzero(np.fromiter((p == "\n" for p in split), dtype=bool, count=len(split))), len(split))
        upto = np.cumsum([0, *map(len, found)]) >> 2
        count = np.zeros(len(words), dtype=np.int64)
        if plain.any():
            count[plain] = np.diff(upto[ends], prepend=0)
        if plain.all():
            return np.frombuffer(b"".join(found), dtype="<u4"), count
        data = b"".join(found)
        own = iter([data[4 * a : 4 * b] for a, b in zip([0, *upto[ends][:-1].tolist()], upto[ends].tolist())] if plain.any() else ())
        rest = self._encoded([w for w, p in zip(words, plain.tolist()) if not p])
        out = [next(own) if p else next(rest)[1] for p in plain.tolist()]
        return np.frombuffer(b"".join(out), dtype="<u4"), np.fromiter(map(len, out), dtype=np.int64, count=len(out)) >> 2

    def _learn_parts(self, missing: list[str]) -> None:
        runs = [p for p in missing if _LETTERS.fullmatch(p)]
        self.parts.update(self._encoded([p for p in missing if not _LETTERS.fullmatch(p)]))
        for at in range(0, len(runs), 4096):
            some = runs[at : at + 4096]
            lines = [some[i : i + 128] for i in range(0, len(some), 128)]
            for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(line):
                    self.parts.update(self._encoded(line))
                    continue
                data, start = ids.tobytes(), 0
                for p, end in zip(line, ends.tolist()):
                    self.parts[p] = data[4 * start : 4 * end]
                    start = end

    def _encoded(self, texts: list[str]):
        for at in range(0, len(texts), 4096):
            some = texts[at : at + 4096]
            for t, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                yield t, np.array(e.ids, dtype="<u4").tobytes()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian bytes) per piece.

    A document is its ids and a closing 0; a null text counts as empty and is that 0 alone. Only documents longer than
    ``length`` are cut. ``tokenizer`` is a file's path or the name of a public one.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        words = WordTokenizer.shared(tokenizer_path(tokenizer))
        for batch in small_batches(batches, most=2 << 20):
            ids, n = words.encode([t or "" for t in column(batch, "text")])
            ends = np.cumsum(n + 1)
            all_ = np.full(ends[-1], END, dtype="<u4")
            closing = np.zeros(ends[-1], dtype=bool)
            closing[ends - 1] = True
            all_[~closing] = ids
            parts = -(-(n + 1) // length)
            doc = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * length
            size = np.minimum(length, n[doc] + 1 - start)
            first = (ends - n - 1)[doc] + start
            data = memoryview(all_.tobytes())
            cuts = [data[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + size).tolist())]
            out = [
                batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                pa.array(map(zlib.crc32, cuts), pa.int64()),
            ]
            if with_ids:
                out.append(pa.array(map(bytes, cuts), pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``lengths``; equal lengths are used in the order given, from the last."""
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stacks.setdefault(n, []).append(i)
    present = sum(1 << n for n in stacks)  # bit n: some unpacked piece is n long
    mirror = sum(1 << (capacity - n) for n in stacks)

    def pop(n: int) -> int:
        nonlocal present, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            present ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    def put(n: int, i: int) -> None:
        nonlocal present, mirror
        stacks[n].append(i)
        present |= 1 << n
        mirror |= 1 << (capacity - n)

    bins = []
    while present:
        held, gap = [], capacity
        while n := (present & ((1 << (gap + 1)) - 1)).bit_length() - 1 if gap > 0 else 0:
            if n <= 0:
                break
            held.append((n, pop(n)))
            gap -= n
        if gap and present and len(held) > 1:
            small = min(held)
            for total in range(small[0] + gap, small[0], -1):
                # Bit a is set where pieces of a and of total - a are both at hand.
                pairs = present & (mirror >> (capacity - total)) & ((1 << (total // 2 + 1)) - 1)
                while pairs:
                    a = pairs.bit_length() - 1
                    if a and 2 * a != total or a and len(stacks[a]) > 1:
                        break
                    pairs ^= 1 << a
                if pairs:
                    held.remove(small)
                    held += [(total - a, pop(total - a)), (a, pop(a))]
                    put(*small)
                    break
        bins.append([i for _, i in held])
    return bins


def _filler(length: int, level: int, last: bool):
    """Packs one shard; except in the last round, badly filled bins come back without a sequence."""
    def fill(table: pa.Table) -> pa.Table:
        uid, size = table["_uid"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort((uid, size))
        uid, size = uid[order], size[order]
        base = (level << 56) + (int(table["shard"][0].as_py()) << 24)
        out = []
        for b, held in enumerate(best_two_fit(size.tolist(), length)):
            ends = np.cumsum(size[held])
            again = not last and ends[-1] < WELL_FILLED * length
            out.append(np.c_[uid[held], size[held], np.full(len(held), -1 if again else base + b), ends - size[held]])
        out = np.concatenate(out)
        return pa.table({"_uid": out[:, 0], "length": out[:, 1], "sequence_id": out[:, 2], "offset": out[:, 3]})

    return fill


def pack(rows: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``rows`` (as from ``pieces``) with ``sequence_id`` and ``offset``; the sequence numbers mean nothing by themselves.

    Pieces of full length stand alone. Repeated rows are packed each on its own; no rows give none. Columns of the two
    names are replaced, all others kept. A shard holds ``shard_pieces`` pieces at a time: badly filled bins of all
    shards meet again as long as a round spares three pieces in ten; what then is left is packed within its shards.
    """
    uid = fresh(rows.columns, "_uid")
    rows = cut(rows.drop("sequence_id", "offset").withColumn(uid, F.monotonically_increasing_id()), "pieces")
    own = rows.select(F.col(uid).alias("_uid"), "length")
    done = own.filter(F.col("length") >= length).select("_uid", (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, level, final = own.filter(F.col("length") < length), 0, False
    n = todo.count()
    while n:
        shards = -(-n // shard_pieces)
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("_uid", F.lit(level)), F.lit(shards)))
        filled = cut(dealt.groupBy("shard").applyInArrow(_filler(length, level, final or shards == 1), "_uid long, length long, sequence_id long, offset long"), "bins")
        done = done.unionByName(filled.filter("sequence_id >= 0").select("_uid", "sequence_id", "offset"))
        todo = filled.filter("sequence_id < 0").select("_uid", "length")
        left = todo.count()
        n, level, final = left, level + 1, left >= 0.7 * n
    return rows.join(done.withColumnRenamed("_uid", uid), uid).drop(uid)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` per sequence, from pieces that were packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(transform(p, x -> x.ids), X'', (a, b) -> concat(a, b))").alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
