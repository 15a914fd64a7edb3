"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from zygospan.llm import near_dedup

from .data import empty, frame, words


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(rows):
    """Smallest id of each component of all pairs with similarity 0.8 or more."""
    sets, up = [grams(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            up[top(j)] = top(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def planted(rng, n, want):
    """A text of ``n`` words and one whose similarity to it is ``want`` or just above: its last words differ."""
    base = words(rng, n).split()
    same = next(k for k in range(n + 1) if (k - 4) >= want * (2 * (n - 4) - (k - 4)))
    return " ".join(base), " ".join(base[:same] + words(rng, n - same, "uvwxyz").split())


def test_stage_drops_one_of_each_planted_pair(spark):
    rng, rows = random.Random(7), []
    wants = [0.8 + 0.01 * k for k in range(20) for _ in range(10)]
    for k, want in enumerate(wants):
        a, b = planted(rng, rng.randint(150, 400), want)
        assert want <= similarity(grams(a), grams(b)) < want + 0.02
        rows += [(2 * k, a, "aa", "s", len(a)), (2 * k + 1, b, "aa", "s", len(b))]
    kept = [r.doc_id for r in corpus_pipeline.drop_near(spark, frame(spark, rows), "").collect()]
    assert sorted(kept) == list(range(0, 2 * len(wants), 2))


def test_stage_equals_all_pairs(spark):
    rng = random.Random(8)
    rows, i = [], 0
    base = words(rng, 200).split()
    for k in range(60):  # a chain of near copies, and pairs on both sides of 0.8
        base = base[:-2] + words(rng, 1).split() if k % 3 else base[:-1]
        rows.append((1000 - k, " ".join(base), "aa", "s", 0))
    for k in range(40):
        for t in planted(rng, 200, 0.7 + 0.005 * k):
            rows.append((i := i + 1, t, "aa", "s", 0))
    rows += [(5000, "", None, None, 0), (5001, None, None, None, 0), (5002, " ", None, None, 0), (5003, "a b", None, None, 0), (5004, "A\tb", None, None, 0)]
    assert sorted(r.doc_id for r in near_dedup.keep_near(frame(spark, rows)).collect()) == kept_ids(rows)
    assert near_dedup.keep_near(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_near_pair_is_left_in_the_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").dropDuplicates(["text"])
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in near_dedup.keep_near(docs).collect()) == kept_ids(rows)


def test_ball_hashing_offers_its_pairs(spark):
    """The stage's named method takes part: texts of near fingerprints are candidates without any band."""
    rows = [(1, 5), (2, 5), (3, 7), (4, 0b11111 << 40)]
    names = spark.createDataFrame(rows, "node long, fp long")
    got = {frozenset(r) for r in near_dedup.ball_pairs(names).collect()}
    assert got == {frozenset((1, 2)), frozenset((1, 3))}
