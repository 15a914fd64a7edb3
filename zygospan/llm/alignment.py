"""Cross-tokenizer alignment: two tokenizations of one text, cut wherever tokens of both end.

Divide and conquer: the token end nearest to the middle of an interval that the other side shares, found by bisection,
splits it; both halves go on alike, and an interval without such an end is a group. The intervals of a whole block of
documents advance together. Tokens whose bytes overlap are linked; how often two ids are linked is counted over all
documents, from one row per id pair and block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import Words, column, cut, release, small_batches
from zygospan.llm.packing import tokenizer_path

A_TOKENIZER = "byte_bpe_50k.json"
B_TOKENIZER = "piece_bpe_32k.model"
BLOCK_BYTES = 3 << 20
CACHE_WORDS = 250_000
#: Below this distance an interval is searched token by token, beyond it at once.
NEAR = 64
# A blank that does not plainly end a word: neither tokenizer joins over any other blank.
_UNSURE = re.compile(r"[^!-~¡-ɏ] |^ | $")
# Words in which all versions of the character tables agree on letters, digits and marks.
_SIMPLE = re.compile(r"[!-~¡-ɏ\n]+")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def ranked(path: str, ids: dict[bytes, int]):
    """A faster encoder of the same byte-level vocabulary; None if its merges are not in the order of their ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocabulary, special = told["model"]["vocab"], {x["content"] for x in told["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    order = [vocabulary["".join(m)] for m in merges]
    if any(x >= y for x, y in pairwise(order)) or any(i >= order[0] for t, i in vocabulary.items() if len(t) == 1):
        return None
    own = {t: i for t, i in ids.items() if t.decode("latin-1") not in special}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})


class Pair:
    """Both tokenizers, their tokens' bytes, and the words that were met before."""

    _shared: dict[tuple[str, str], Pair] = {}

    def __init__(self, a: str, b: str, most: int = CACHE_WORDS):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores by themselves
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        byte = byte_alphabet()
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(byte[c] for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.most, self.words = most, Words()
        self.ranked = ranked(a, dict(zip(self.a_bytes, range(len(self.a_bytes)))))
        # Each id in decimal with each sign that may follow it.
        names = [f"{i}{s}".encode() for n, signs in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for s in signs for i in range(n)]
        self.wide = max(map(len, names))
        self.names = np.array(names, dtype=f"S{self.wide}").view(np.uint8).reshape(len(names), self.wide)
        self.name_length = np.array([len(x) for x in names], dtype=np.int64)

    @classmethod
    def shared(cls, a: str, b: str) -> Pair:
        """One for all tasks of a worker process."""
        if (a, b) not in cls._shared:
            cls._shared[a, b] = cls(a, b)
        return cls._shared[a, b]

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text by both tokenizers; a pair of empty bytes where the tokens do not spell it."""
        out = []
        for at in range(0, len(texts), 4096):
            some = texts[at : at + 4096]
            ids = [self._a_ids(some), self.b.encode(some, num_threads=1)]
            spelt = [(" " + t).encode() for t in some]
            flat = [np.fromiter(chain.from_iterable(x), dtype="<u4") for x in ids]
            data = [x.tobytes() for x in flat]
            stops = [np.cumsum([len(x) for x in side]).tolist() for side in ids]
            # Mostly all of them are spelt; only then the lengths need not be looked at one by one.
            fits = all(self._spells(t, x, n, spelt) for t, x, n in zip((self.a_bytes, self.b_bytes), flat, (self.a_length, self.b_length)))
            i = j = 0
            for t, k, m in zip(spelt, *stops):
                good = fits or all(b"".join(map(names.__getitem__, x[u:v].tolist())) == t for names, x, u, v in ((self.a_bytes, flat[0], i, k), (self.b_bytes, flat[1], j, m)))
                out.append((data[0][4 * i : 4 * k], data[1][4 * j : 4 * m]) if good else (b"", b""))
                i, j = k, m
        return out

    @staticmethod
    def _spells(names: list[bytes], ids: np.ndarray, lengths: np.ndarray, spelt: list[bytes]) -> bool:
        """Whether the tokens of all texts together are all their bytes, and no token passes over from one to the next."""
        if b"".join(map(names.__getitem__, ids.tolist())) != b"".join(spelt):
            return False
        return bool(np.isin(np.cumsum([len(t) for t in spelt]), np.cumsum(lengths[ids])).all())

    def _a_ids(self, texts: list[str]) -> list[list[int]]:
        plain = [self.ranked is not None and bool(_SIMPLE.fullmatch(t)) for t in texts]
        other = iter(self.a.encode_batch_fast([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.ranked.encode_ordinary(" " + t) if p else next(other).ids for t, p in zip(texts, plain)]

    def by_words(self, text: str) -> list[tuple[bytes, bytes]]:
        """The ids of each blank-led word of ``text``."""
        if len(self.words) > self.most:
            self.words = self.words.next()
        split = text.split(" ")
        found = list(map(self.words.__getitem__, split))
        open_ = [i for i, v in enumerate(found) if v is None]
        if open_:
            new = list(dict.fromkeys([split[i] for i in open_]))
            self.words.update(zip(new, self.whole(new)))
            for i in open_:
                found[i] = self.words[split[i]]
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Rows that have tokens, in any order, their token counts by both tokenizers, and the ids of all in that order.

        Texts are taken apart at blanks that end a word, all of a block at once, and each distinct word is encoded
        once; a text with any other blank is encoded whole.
        """
        plain, odd = [], []
        for i, t in enumerate(texts):
            if t:
                (odd if _UNSURE.search(t) else plain).append(i)
        found = self.by_words(" ".join([texts[i] for i in plain])) if plain else []
        first = np.cumsum([0, *(texts[i].count(" ") + 1 for i in plain)], dtype=np.int64)[:-1]
        sides = [[v[k] for v in found] for k in (0, 1)]
        size = [np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in sides]
        if plain and not size[0].all():
            # A word that the tokens do not spell leaves its text without any.
            whole = np.minimum.reduceat(size[0], first) > 0
            word = np.repeat(whole, np.diff(np.append(first, len(found))))
            for k in (0, 1):
                sides[k], size[k] = [x for x, w in zip(sides[k], word.tolist()) if w], size[k][word]
            counts = np.diff(np.append(first, len(found)))[whole]
            plain, first = [i for i, w in zip(plain, whole.tolist()) if w], np.cumsum(counts) - counts
        rows, n, ids = plain, [np.empty(0, dtype=np.int64)] * 2, [b""] * 2
        if plain:
            n, ids = [np.add.reduceat(x, first) >> 2 for x in size], [b"".join(x) for x in sides]
        more = [(i, v) for i, v in zip(odd, self.whole([texts[i] for i in odd]) if odd else ()) if v[0]]
        rows = np.array(rows + [i for i, _ in more], dtype=np.int64)
        n = [np.append(n[k], np.array([len(v[k]) >> 2 for _, v in more], dtype=np.int64)) for k in (0, 1)]
        return rows, n, [np.frombuffer(ids[k] + b"".join(v[k] for _, v in more), dtype="<u4").astype(np.int64) for k in (0, 1)]


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, last: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Whether each token of the first side ends where one of the second does.

    Both sides list byte ends in rising order over several documents; ``first`` and ``last`` are the documents' first
    tokens and those behind their last ones. Each interval starts and stops at a shared end.
    """
    cut_ = np.zeros(len(a_ends), dtype=bool)
    cut_[last - 1] = True

    def is_shared(token: np.ndarray) -> np.ndarray:
        end = a_ends[token]
        return b_ends[np.searchsorted(b_ends, end)] == end

    lo, hi = first, last
    while True:
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        if not len(lo):
            return cut_
        middle = (lo + hi - 1) >> 1
        at = np.full(len(lo), -1)
        open_ = np.arange(len(lo))
        for step in range(near):
            for token in (middle - step, middle + step) if step else (middle,):
                p = token[open_]
                ok = (p >= lo[open_]) & (p < hi[open_] - 1)
                ok[ok] = is_shared(p[ok])
                at[open_[ok]] = p[ok]
                open_ = open_[~ok]
            open_ = open_[(middle[open_] - step > lo[open_]) | (middle[open_] + step < hi[open_] - 2)]
            if not len(open_):
                break
        for i in open_:
            inner = np.arange(lo[i], hi[i] - 1)
            inner = inner[is_shared(inner)]
            if len(inner):
                at[i] = inner[np.argmin(np.abs(inner - middle[i]))]
        split = at >= 0
        cut_[at[split]] = True
        # The intervals do not overlap: both ends in rising order keep them and make the next bisections local.
        lo, hi = np.sort(np.concatenate([lo[split], at[split] + 1])), np.sort(np.concatenate([at[split] + 1, hi[split]]))


class Aligned:
    """Tokens, groups and links of a block of documents. ``place`` lists the rows that have tokens."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        self.place, (self.n_a, self.n_b), (self.a, self.b) = pair.encode(texts)
        self.a_ends, self.b_ends = np.cumsum(pair.a_length[self.a]), np.cumsum(pair.b_length[self.b])
        self.a_last, self.b_last = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.a_cut = shared_ends(self.a_ends, self.b_ends, self.a_last - self.n_a, self.a_last)
        self.b_cut = np.zeros(len(self.b), dtype=bool)
        self.b_cut[np.searchsorted(self.b_ends, self.a_ends[self.a_cut])] = True
        self.doc = np.repeat(np.arange(len(self.place)), self.n_a)
        self.n_groups = np.bincount(self.doc[self.a_cut], minlength=len(self.place))

    def digests(self, pair: Pair) -> list[str]:
        """Per document with tokens the SHA-256 of its groups, ``a1,a2|b1;a3|b2``."""
        a_group, b_group = np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut
        a_stop, b_stop = np.flatnonzero(self.a_cut) + 1, np.flatnonzero(self.b_cut) + 1
        name = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        na, nb = len(pair.a_bytes), len(pair.b_bytes)
        name[np.arange(len(self.a)) + np.r_[0, b_stop][a_group]] = self.a + na * self.a_cut
        name[np.arange(len(self.b)) + a_stop[b_group]] = 2 * na + self.b + nb * self.b_cut
        size = pair.name_length[name]
        text = pair.names[name][np.arange(pair.wide) < size[:, None]].tobytes()
        stops = np.r_[0, np.cumsum(size)][np.r_[0, self.a_last + self.b_last]]
        return [hashlib.sha256(text[a : b - 1]).hexdigest() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def links(self, n_b_ids: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and id pair ``a * n_b_ids + b`` of every two tokens that share a byte.

        Each is named by the last byte they share: the end of an A token, or of a B token that ends within one.
        """
        inside = ~self.b_cut
        a_at = np.searchsorted(self.a_ends, self.b_ends[inside])
        b_at = np.searchsorted(self.b_ends, self.a_ends)
        doc = np.concatenate([self.doc, self.doc[a_at]])
        return doc, np.concatenate([self.a * n_b_ids + self.b[b_at], self.a[a_at] * n_b_ids + self.b[inside]])


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


BLOCKS = (
    "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,n_pairs:long>>, "
    "own binary, times binary, pairs array<long>, counts array<long>"
)


def blocks(docs: DataFrame, a: str = A_TOKENIZER, b: str = B_TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of some ``block_bytes`` of text (a longer text is one by itself), see ``BLOCKS``.

    ``pairs`` are the block's distinct id pairs and ``counts`` their links; ``own`` lists each document's distinct
    pairs as steps in ``pairs``, ``times`` its links of each.
    """
    kind = pa.list_(pa.struct([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())]))

    def run(batches):
        pair = Pair.shared(tokenizer_path(a), tokenizer_path(b))
        block = TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, most=block_bytes):
            x = Aligned(pair, column(batch, "text"))
            doc, pairs = x.links(len(pair.b_bytes))
            # Sorted by document and pair: neighbours that agree are one pair of one document.
            distinct, inverse = np.unique(pairs, return_inverse=True)
            key, times = np.unique(doc * len(distinct) + inverse, return_counts=True)
            own_doc, own = np.divmod(key, max(len(distinct), 1))
            counts = np.bincount(inverse, minlength=len(distinct))
            n_pairs = np.bincount(own_doc, minlength=len(x.place))
            step = np.diff(own, prepend=0)
            starts = np.cumsum(n_pairs) - n_pairs
            step[starts[n_pairs > 0]] = own[starts[n_pairs > 0]]
            n_links = np.bincount(doc, minlength=len(x.place))
            rows = [{"doc_id": i, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "n_pairs": 0} for i in column(batch, "doc_id")]
            values = zip(x.place.tolist(), x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), n_links.tolist(), x.digests(pair), n_pairs.tolist())
            for i, *v in values:
                rows[i].update(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs"), v))
            # In the order of their pairs, those without tokens last.
            held = set(x.place.tolist())
            rows = [rows[i] for i in x.place.tolist()] + [r for i, r in enumerate(rows) if i not in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([rows], kind), pa.array([packed(step)], pa.binary()), pa.array([packed(times)], pa.binary()),
                 pa.array([distinct], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                ["block", "docs", "own", "times", "pairs", "counts"],
            )
            block += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def pair_counts(rows: DataFrame, n_b_ids: int) -> DataFrame:
    """``pair, total, best`` from the blocks' counts: links of an id pair over all documents, and whether its second id has no more with any other."""
    totals = rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total"))
    totals = cut(totals, "pair_totals")
    second = F.pmod("pair", F.lit(n_b_ids))
    most = totals.groupBy(second.alias("second")).agg(F.max("total").alias("most"))
    return totals.withColumn("second", second).join(most, "second").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str = A_TOKENIZER, b: str = B_TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    A text is encoded with a blank before it. Null and empty texts, and those that the tokens of a side do not spell
    byte by byte, have no tokens: all numbers are 0 and the digest is empty. Repeated rows count and return each, a
    null doc_id is returned as such; columns other than ``doc_id, text`` are ignored; no rows give none. A text is
    aligned in one task, a block holds a few million bytes or one longer text.
    """
    import sentencepiece

    rows = cut(blocks(docs, a, b, block_bytes), "token_blocks")
    n_b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b)).get_piece_size()
    known = cut(pair_counts(rows, n_b), "pair_counts")
    release(docs.sparkSession)
    met = rows.select("block", F.posexplode("pairs").alias("pos", "pair")).join(known, "pair").select(F.col("block").alias("of"), "pos", "total", "best")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links")

    def weigh(block: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pos"].to_numpy())
        total, best = pairs["total"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        out = []
        for docs_, own, times in zip(*(block[c].to_pylist() for c in ("docs", "own", "times"))):
            times, n = unpacked(times), np.array([d["n_pairs"] for d in docs_], dtype=np.int64)
            stops = np.cumsum(n)
            run_ = np.cumsum(unpacked(own))
            # Steps restart in every document.
            base = np.r_[0, run_][stops - n]
            place = run_ - np.repeat(base, n)
            sums = [np.diff(np.r_[0, np.cumsum(times * w[place])][np.r_[0, stops]]) for w in (best, total)]
            out += [(*(d[c] for c in columns), int(x), int(y), d["groups_sha256"]) for d, x, y in zip(docs_, *sums)]
        names = (*columns, "n_best", "count_sum", "groups_sha256")
        return pa.table({c: pa.array([o[i] for o in out], pa.string() if i == 7 else pa.int64()) for i, c in enumerate(names)})

    schema = ", ".join(f"{c} long" for c in (*columns, "n_best", "count_sum")) + ", groups_sha256 string"
    own = rows.select("block", "docs", "own", "times")
    return own.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(weigh, schema)


def groups(docs: DataFrame, a: str = A_TOKENIZER, b: str = B_TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_stops, b_stops`` per row: both tokenizations and where each group ends in them."""
    def run(batches):
        pair = Pair.shared(tokenizer_path(a), tokenizer_path(b))
        for batch in small_batches(batches, most=block_bytes):
            x = Aligned(pair, column(batch, "text"))
            out = [[[] for _ in range(batch.num_rows)] for _ in range(4)]
            for ids, stops, cuts, last, n in ((out[0], out[2], x.a_cut, x.a_last, x.n_a), (out[1], out[3], x.b_cut, x.b_last, x.n_b)):
                all_ = x.a if ids is out[0] else x.b
                for i, stop, m in zip(x.place.tolist(), last.tolist(), n.tolist()):
                    ids[i] = all_[stop - m : stop].tolist()
                    stops[i] = (np.flatnonzero(cuts[stop - m : stop]) + 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.list_(pa.int32())) for o in out)], ["doc_id", "a_ids", "b_ids", "a_stops", "b_stops"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>")
