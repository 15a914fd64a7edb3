import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from zygospan.llm import exact_dedup, graph, simhash, suffix_dedup

from .data import empty, frame, rows


def repeats(docs, length):
    """Plain version: least id of every substring, then the bytes that a smaller id covers."""
    key = lambda i: 2**63 - 1 if i is None else i
    first, out = {}, []
    for i, t in docs:
        for a in range(len(t) - length + 1):
            s = t[a : a + length]
            first[s] = min(first.get(s, key(i)), key(i))
    for i, t in docs:
        gone = np.zeros(len(t) + 2, dtype=int)
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < key(i):
                gone[a + 1 : a + 1 + length] = 1
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), len(t) - len(kept), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df, **settings):
    found = suffix_dedup.remove_repeats(df, **settings).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr)


def test_every_shift_meets_in_the_cover():
    for shift in range(suffix_dedup.PERIOD):
        assert any((c + shift) % suffix_dedup.PERIOD in suffix_dedup.COVER for c in suffix_dedup.COVER)


def test_repeats_equal_brute_force(spark):
    data = rows()
    want = repeats([(r[0], (r[1] or "").encode()) for r in data], 50)
    assert removed(frame(spark, data)) == want
    assert removed(frame(spark, data), block_bytes=1500, bucket_names=50) == want
    assert sum(w[2] for w in want) > 3000


def test_repeats_in_a_tiny_alphabet(spark):
    rng = random.Random(5)
    data = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)) ) * rng.randint(1, 60), None, None, 0) for i in range(40)]
    assert removed(frame(spark, data), length=31, block_bytes=200) == repeats([(r[0], r[1].encode()) for r in data], 31)
    assert removed(empty(spark)) == []


def test_kept_bytes_come_on_request(spark):
    row = suffix_dedup.remove_repeats(frame(spark, [(2, "q" + "abc" * 20, None, None, 1), (1, "abc" * 20 + "z", None, None, 1)]), with_text=True).filter("doc_id = 2").head()
    assert bytes(row.kept) == b"q" and row.n_spans == 1 and (row.spans[0].start, row.spans[0].stop) == (1, 61)


def exact(df, **settings):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(df, **settings).collect()), key=repr)


def test_exact_equals_grouping_by_text(spark):
    data = rows()
    groups, want, used = {}, [], set()
    for r in data:
        groups.setdefault(r[1] or "", []).append(r[0])
    for r in data:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        kept = r[0] == keep and (r[0], r[1] or "") not in used
        used |= {(r[0], r[1] or "")} if kept else set()
        want.append((r[0], keep, len(ids), kept, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = sorted(want, key=repr)
    assert exact(frame(spark, data)) == want
    assert exact(frame(spark, data), chunk=7) == want
    # Fingerprints that nearly always collide leave the decision to the chunkwise comparison.
    assert exact(frame(spark, data), chunk=16, primes=(2, 3), bases=(1, 1)) == want
    assert exact(empty(spark)) == []


def test_fingerprints_compose():
    table, data = exact_dedup.powers(16), bytes(range(200))
    parts = exact_dedup.chunk_hashes(data, table)
    whole = exact_dedup.combine(parts)
    assert whole == exact_dedup.combine([exact_dedup.combine(parts[:5]), exact_dedup.combine(parts[5:])])
    h = 0
    for b in data:
        h = (h * exact_dedup.BASES[0] + b + 1) % exact_dedup.PRIMES[0]
    assert whole[:2] == (200, h)


def test_exact_keeps_one_row_of_each_text(spark):
    df = frame(spark)
    kept = exact_dedup.keep_exact(df)
    assert kept.columns == df.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows()})


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(data):
    fp = [plain_fingerprint(r[1]) for r in data]
    label = list(range(len(data)))
    changed = True
    while changed:
        changed = False
        for i in range(len(data)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for r, c in zip(data, label):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return [(r[0], f, least.get(c), c) for r, f, c in zip(data, fp, label)]


def test_near_equals_brute_force(spark):
    rng = random.Random(11)
    data = rows()
    long_ = "".join(rng.choice("abcdefghij ") for _ in range(9000))
    for i in range(8):  # a chain of small changes
        at = rng.randrange(len(long_))
        long_ = long_[:at] + "XY" + long_[at + 2 :]
        data.append((1000 - i, long_, None, None, 1))
    want = sorted(((i, f"{f:016x}", c) for i, f, c, _ in near(data)), key=repr)
    found = simhash.near_duplicates(frame(spark, data)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert sorted((tuple(r) for r in found), key=repr) == want
    assert len({c for *_, c in want}) < len({f for _, f, _ in want})
    kept = simhash.keep_near(frame(spark, data)).collect()
    assert len(kept) == len({c for *_, c in near(data)})


def test_near_on_an_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_near(empty(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(500, 499), (7, 7), (499, 500)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(101, 160)) and roots[500] == 499
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = graph.local_forest(np.array([5, 3, 9]), np.array([4, 5, 8]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 4), (3, 5), (8, 9)]
