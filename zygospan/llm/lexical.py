"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items form one automaton whose patterns are guarded by a boundary on both sides. It is broadcast, and
each task counts term frequencies directly from the texts: no index of the documents is built. Two scans are made, one
for the corpus statistics and one for the scores; the automaton's outputs lead to the items that hold the term.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zygospan.llm.common import column, cut, small_batches

#: Most bytes of item texts in one automaton; more items are scanned in blocks.
BLOCK_BYTES = 1 << 20
#: Candidates that a task keeps before it reduces them to the best of each item.
HELD = 1 << 17
LAST = np.iinfo(np.int64).max
# A-Z in lower case, every other ASCII character that is no letter or digit a blank; other bytes belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    """The text's UTF-8 with its terms apart by blanks, one before and one behind included."""
    return b" " + (text or "").encode().translate(_FOLD) + b" "


@dataclass
class Automaton:
    """Guarded terms with their numbers, and per term the items (numbered too) that hold it, as slices of one list."""

    ids: list[int]
    terms: list[str]
    machine: ahocorasick.Automaton | None
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: dict[int, list[str | None]]) -> Automaton:
        ids = sorted(texts)
        counts = [Counter(w for t in texts[i] for w in folded(t).decode("latin-1").split(" ") if w) for i in ids]
        terms = sorted(set().union(*counts)) if counts else []
        number = {t: n for n, t in enumerate(terms)}
        rows = sorted((number[t], k, c) for k, own in enumerate(counts) for t, c in own.items())
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS) if terms else None
        for t, n in number.items():
            machine.add_word(f" {t} ", n)
        if terms:
            machine.make_automaton()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        starts = np.searchsorted(table[:, 0], np.arange(len(terms) + 1))
        return cls(ids, terms, machine, starts, table[:, 1], table[:, 2])

    def occurrences(self, data: bytes) -> Counter:
        """How often each term stands in a folded text; neighbours share the blank between them."""
        return Counter(map(itemgetter(1), self.machine.iter(data.decode("latin-1")))) if self.machine else Counter()


def best_of(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's ``k`` highest scores, ties to the smaller doc."""
    order = np.lexsort((doc, -score, item))
    own = item[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


def statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of the automaton's terms."""
    def run(batches):
        auto, held, n, total = shared.value, Counter(), 0, 0
        for batch in small_batches(batches):
            for text in column(batch, "text"):
                data = folded(text)
                words = len(data.split())
                n, total = n + (words > 0), total + words
                held.update(auto.occurrences(data).keys())
        keys = [-1, -2, *held]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([n, total, *held.values()], pa.int64())], ["key", "n"])

    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = {r.key: r.n for r in counts.collect()}  # one row per term of the automaton, which is bounded
    return got.get(-1, 0), got.get(-2, 0), np.array([got.get(t, 0) for t in range(len(shared.value.terms))], dtype=np.int64)


def scan(docs: DataFrame, shared, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the best ``k`` documents of each item in every task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)

    def run(batches):
        auto = shared.value
        n_items = len(auto.ids)
        floor = np.zeros(n_items, dtype=np.int64)  # what a document must reach to be among an item's best so far
        held = [np.empty((3, 0), dtype=np.int64)]

        def reduce():
            item, doc, score = all_ = np.concatenate(held, axis=1)
            kept = best_of(item, doc, score, k)
            held[:] = [all_[:, kept]]
            full = np.bincount(item[kept], minlength=n_items) >= k
            least = np.full(n_items, LAST)
            np.minimum.at(least, item[kept], score[kept])
            floor[full] = least[full]

        for batch in small_batches(batches):
            ids = [LAST if i is None else i for i in column(batch, "doc_id")]
            for at in range(0, batch.num_rows, 256):
                rows, terms, tf, mass = [], [], [], []
                for r, text in enumerate(column(batch.slice(at, 256), "text")):
                    data = folded(text)
                    own = auto.occurrences(data)
                    if own:
                        rows.append(np.full(len(own), r))
                        terms.extend(own.keys())
                        tf.extend(own.values())
                        mass.append(np.full(len(own), 100 - 25 + (25 * len(data.split()) * n_docs) // n_terms))
                if not rows:
                    continue
                row, term, tf, m = np.concatenate(rows), np.array(terms), np.array(tf, dtype=np.int64), np.concatenate(mass)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                n = auto.starts[term + 1] - auto.starts[term]
                place = np.repeat(auto.starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                scores = np.zeros((256, n_items), dtype=np.int64)
                np.add.at(scores, (np.repeat(row, n), auto.items[place]), np.repeat(value, n) * auto.times[place])
                r, item = np.nonzero((scores > 0) & (scores >= floor))
                held.append(np.stack([item, np.array(ids[at : at + 256])[r], scores[r, item]]))
                if sum(h.shape[1] for h in held) > HELD + k * n_items:
                    reduce()
        reduce()
        item, doc, score = held[0]
        out = [np.array(auto.ids, dtype=np.int64)[item] if len(item) else item, pa.array(doc, mask=doc == LAST), score]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "item_id long, doc_id long, score long")


def item_blocks(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Items with their block, dealt by a hash until no block with several items holds more than ``most`` bytes."""
    rows = cut(items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text"), "search_items")
    sizes = rows.groupBy("item_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    n = max(1, math.ceil(2 * (sizes.agg(F.sum("n")).first()[0] or 0) / most))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if over.filter((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
            return rows.withColumn("block", block), n
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 20, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents by whole-number BM25, scores above 0 only.

    ``docs`` has ``doc_id, text`` and ``items`` has ``item_id, text``; all else in them is ignored. Terms are runs of
    ASCII letters and digits and of all characters beyond ASCII; only A-Z is lowered. Equal scores go to the smaller
    doc_id, null ids last. Repeated documents count and rank each; rows that share an item_id are one item with the
    terms of all. A null text has no terms, a null item_id makes no item. Empty tables give no rows.

    An automaton takes items of at most ``most_bytes`` of text (checked; one longer item stands alone and must fit a
    worker) and is broadcast; further blocks scan the documents again. A task passes on ``k`` rows an item.
    """
    spark = docs.sparkSession
    dealt, n_blocks = item_blocks(items, most_bytes)
    found = None
    for b in range(n_blocks):
        texts: dict[int, list] = {}
        for r in dealt.filter(F.col("block") == b).collect():  # at most most_bytes of text
            texts.setdefault(r.item_id, []).append(r.text)
        shared = spark.sparkContext.broadcast(Automaton.of(texts))
        n_docs, n_terms, df = statistics(docs, shared)
        part = cut(scan(docs, shared, n_docs, max(n_terms, 1), df, k), "search_best")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
