"""Small documents with every awkward case: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

from pyspark.sql import functions as F

CLASH = ("uid", "x", "kept", "score", "length", "shard", "n", "block", "fp", "size", "piece", "y", "h1", "bucket", "spans", "_uid2",
         "_uid", "sequence_id", "offset", "_mix_id", "_mix_i", "_mix_x", "_mix_plan", "_keep_id", "_keep_x", "_keep_row", "_row", "_i", "_x", "d", "row")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefgh", least=2, most=6):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(least, most))) for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    passage = words(rng, 30)
    base = words(rng, 80)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(20)]
    texts += [words(rng, 10) + " " + passage + " " + words(rng, 10) for _ in range(6)]
    texts += [base, base, base, base.replace(" ", "\n", 1), base + " end", base[:-3]]
    texts += [None, None, "", "", " ", "a", "éß中 " * 40, "\x00\x00", "\x00", words(rng, 3000), "ab" * 4000]
    out = [(i * 3, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", "s10", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[0], out[0], out[20], (None, texts[1], "aa", "s1", 3), (None, None, None, None, None), (None, texts[5], None, None, 1)]
    rng.shuffle(out)
    return out


def frame(spark, data=None, clash=True):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.select("*", *(F.lit("z").alias(c) for c in CLASH)) if clash else df


def empty(spark):
    return frame(spark, [])
