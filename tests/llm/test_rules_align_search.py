import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zygospan.llm import alignment, lexical, rules

from .data import empty, frame, rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# Ranked lexical search

def plain_search(docs, items, k):
    own = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, Counter()).update(TERM.findall((t or "").translate(UPPER)))
    n_docs, total = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in own:
            m = 75 + 25 * c.total() * n_docs // max(total, 1)
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in terms.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("most_bytes", [1 << 20, 400])
def test_search_equals_brute_force(spark, most_bytes):
    rng = random.Random(4)
    data = rows() + [(7000 + i, "Zz zz, Éa-éA éa\x00b1 B1", None, None, 1) for i in range(30)]
    texts = [t for _, t, *_ in data if t]
    items = [(i, " ".join(rng.choice(rng.choice(texts).split() or [""]) for _ in range(8))) for i in range(12)]
    items += [(50, "ZZ zz zz éa b1"), (51, None), (52, ""), (53, "?!"), (None, "zz"), (50, "éA"), (54, "nowhere-else")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("block", F.lit("b"))
    got = [tuple(r) for r in lexical.search(frame(spark, data), df, k=5, most_bytes=most_bytes).collect()]
    want = plain_search([(d[0], d[1]) for d in data], items, 5)
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(i is None for _, _, i, _ in got) is any(i is None for _, _, i, _ in want)
    assert lexical.search(empty(spark), df).count() == 0 and lexical.search(frame(spark, data), df.filter("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB1 \n.é中_\x00", max_size=30), st.lists(st.text(alphabet="abAé1", min_size=1, max_size=3), max_size=5))
def test_automaton_counts_terms(text, terms):
    auto = lexical.Automaton.of({0: [" ".join(terms)]})
    got = {auto.terms[t].encode("latin-1").decode(): n for t, n in auto.occurrences(lexical.folded(text)).items()}
    own = Counter(TERM.findall(text.translate(UPPER)))
    wanted = {t.translate(UPPER) for t in terms}
    assert got == {t: n for t, n in own.items() if t in wanted}


def test_reducing_on_the_way_changes_nothing(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i, words(rng, 12, "abc", 1, 2), None, None, 1) for i in range(600)]
    items = spark.createDataFrame([(i, words(rng, 4, "abc", 1, 2)) for i in range(5)], "item_id long, text string")
    monkeypatch.setattr(lexical, "HELD", 10)
    got = [tuple(r) for r in lexical.search(frame(spark, data).coalesce(1), items, k=7).collect()]
    assert sorted(got) == sorted(plain_search([(d[0], d[1]) for d in data], [tuple(r) for r in items.collect()], 7))


# Cross-tokenizer alignment

def plain_alignment(texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment.byte_alphabet()
    out, count = [], Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt = [[bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [alignment.piece_bytes(b.id_to_piece(i)) for i in ids[1]]]
        if not b"".join(spelt[0]) == b"".join(spelt[1]) == (" " + text).encode():
            out.append(None)
            continue
        spans = []
        for parts in spelt:
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0]) for y, (u, v) in zip(ids[1], spans[1]) if s < v and u < e]
        count.update(links)
        groups, left, right = [], [], []
        ends = {e for _, e in spans[1]} & {e for _, e in spans[0]}
        j = 0
        for x, (_, e) in zip(ids[0], spans[0]):
            left.append(x)
            if e in ends:
                while j < len(spans[1]) and spans[1][j][1] <= e:
                    right.append(ids[1][j])
                    j += 1
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        out.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    done = []
    for o in out:
        if o is None:
            done.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_g, links, text = o
        done.append((n_a, n_b, n_g, len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return done


ODD = ["two  blanks here", " led", "trailing ", "tab\t x", "a\n b", "a \nb", "▁ block", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll It's 'S", "中文字符很多", "  x", "é ﬁ x",
       "x　y z", "🙂🙂 🙂", "\x00 \x01a", "a" * 300, "            deep", "x" + " " * 40 + "y", "«Éa» – œuvre, naïve 123456 7", "\r\n\r\n", " ", "  a", "ab​c d"]


@pytest.mark.parametrize("block_bytes", [3 << 20, 300])
def test_alignment_equals_brute_force(spark, block_bytes):
    rng = random.Random(9)
    data = [(i, t) for i, t, *_ in rows() if t is None or len(t) < 2000]
    data += [(8000 + i, t) for i, t in enumerate(ODD)] + [(9000 + i, " ".join(rng.choice(ODD) for _ in range(4))) for i in range(10)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("block", "docs", "pair", "total", "n_a")})
    got = alignment.align(df, block_bytes=block_bytes).collect()
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = [(i, *v) for (i, _), v in zip(data, plain_alignment([t for _, t in data]))]
    assert sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(1 for w in want if w[1]) > 60 and any(w[1] == 0 and t for w, (_, t) in zip(want, data))
    assert alignment.align(df.filter("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(2, 60), st.randoms(use_true_random=False)), min_size=1, max_size=4), st.sampled_from([1, 2, 64]))
def test_divide_and_conquer_finds_every_shared_end(docs, near):
    a, b, first, last, at = [], [], [], [], 0
    for n, rng in docs:
        first.append(len(a))
        for side in (a, b):
            side.extend(at + e for e in sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))}))
        last.append(len(a))
        at += n
    a, b = np.array(a), np.array(b)
    assert (alignment.shared_ends(a, b, np.array(first), np.array(last), near) == np.isin(a, b)).all()


def test_groups_spell_the_text(spark):
    text = "Naïve œuvre, don't 12345 wherever\nnext"
    row = alignment.groups(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    pair = alignment.Pair.shared(alignment.tokenizer_path(alignment.A_TOKENIZER), alignment.tokenizer_path(alignment.B_TOKENIZER))
    x, y = 0, 0
    for p, q in zip(row[0].a_stops, row[0].b_stops):
        assert b"".join(pair.a_bytes[i] for i in row[0].a_ids[x:p]) == b"".join(pair.b_bytes[i] for i in row[0].b_ids[y:q])
        x, y = p, q
    assert (x, y) == (len(row[0].a_ids), len(row[0].b_ids)) and list(row[1][1:]) == [[], [], [], []]


def test_a_full_cache_forgets_nothing_it_uses():
    rng = random.Random(1)
    path = [alignment.tokenizer_path(t) for t in (alignment.A_TOKENIZER, alignment.B_TOKENIZER)]
    small, large = alignment.Pair(*path, most=20), alignment.Pair(*path)
    for _ in range(30):
        texts = [words(rng, 12, "abcé") for _ in range(3)]
        for x, y in zip(small.encode(texts)[2], large.encode(texts)[2]):
            assert (x == y).all()
    assert len(small.words) < 100


def test_the_faster_encoder_has_the_named_tokenizer_s_ids():
    pair = alignment.Pair.shared(alignment.tokenizer_path(alignment.A_TOKENIZER), alignment.tokenizer_path(alignment.B_TOKENIZER))
    assert pair.ranked is not None
    # Every entry of the vocabulary by itself, then invented words of all simple characters.
    texts = [t.decode() for t in pair.a_bytes if t.decode("utf-8", "ignore").encode() == t and alignment._SIMPLE.fullmatch(t.decode())]
    rng, simple = random.Random(2), [chr(c) for c in range(33, 0x250) if alignment._SIMPLE.fullmatch(chr(c))] + ["\n"]
    texts += ["".join(rng.choice(simple) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts += ["".join(rng.choice("abcdehilnorstuéè'ñß.,1\n") for _ in range(rng.randint(1, 20))) for _ in range(20_000)]
    assert len(texts) > 50_000
    assert pair._a_ids(texts) == [e.ids for e in pair.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


# Quality rules

def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base, max(len(lines), 1)


def plain_verdicts(data, slack=rules.SLACK, fence=3, least=50):
    def value(m):
        n = max(m[0], 1)
        return {"word_chars": 1000 * m[1] // n, "symbols": 1000 * m[2] // n, "dup_lines": 1000 * m[3] // m[6], "repeat_words": 1000 * m[4] // n}

    def low(v):
        return v if v < 64 else v >> (v.bit_length() - 6) << (v.bit_length() - 6)

    rows_ = [(d, plain_measures(d[1])) for d in data]
    groups = {}
    for d, m in rows_:
        if not m[5]:
            for key in ((d[2], d[3]), (d[2],), ()):
                for k, v in value(m).items():
                    groups.setdefault((key, k), []).append(low(v))
    out = []
    for d, m in rows_:
        kept = not m[5]
        for k, v in value(m).items():
            if kept:
                g = next((groups[key, k] for key in ((d[2], d[3]), (d[2],)) if len(groups[key, k]) >= least), groups[(), k])
                g = sorted(g)
                a, b, c = (g[p * (len(g) - 1) // 4] for p in (1, 2, 3))
                kept = min(a - fence * (c - a), b - slack[k]) <= v <= max(c + fence * (c - a), b + slack[k])
        out.append((d[0], *m[:6], kept))
    return out


def many():
    rng = random.Random(12)
    out = rows()
    for i in range(300):
        t = words(rng, rng.randint(9, 60), "abcdefgh", 3, 6)
        if i % 9 == 0:
            t = " ".join(x + "$$$" for x in t.split())
        if i % 11 == 0:
            t = "\n".join([t[:30]] * 9 + [t])
        if i % 13 == 0:
            t += " " + t[: len(t) // 3]
        out.append((10_000 + i, t, "aa" if i % 4 else None, ["s1", None, "s3"][i % 3 if i % 5 else 0], len(t)))
    return out + [(20_000, "one two three four five " * 3000, "aa", "s1", 1), (20_001, "x y " * 20, "cc", "s9", 1), (20_002, " \t\x0b\x0c\r\n" + "q w e r t y u i o p\r\n" * 2, "aa", "s1", 1)]


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_rules_equal_plain_steps(spark):
    data = many()
    clash = frame(spark, data).withColumns({c: F.lit("z") for c in ("w", "lines", "n_words", "salt", "limits", "row", "g_lang", "measure")})
    got = [tuple(r[c] for c in COLUMNS) for r in rules.quality_rules(clash).collect()]
    want = plain_verdicts(data)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 0 < sum(1 for w in want if not w[6] and not w[7]) < 200  # the limits reject some
    kept = rules.keep_good(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted((d[0], d[1]) for d, w in zip(data, want) if w[7] and d[0] is not None)
    assert rules.quality_rules(empty(spark)).count() == 0 and rules.keep_good(empty(spark)).count() == 0


def test_sketches_merge_and_bound_their_error(spark):
    docs = frame(spark, many(), clash=False)
    part = F.pmod("doc_id", F.lit(3)) == 0
    all_ = rules.measures(docs)
    halves = rules.merge(*(rules.sketch(rules.measures(docs.filter(c))) for c in (part, ~part, part.isNull())))
    key = lambda df: sorted(map(repr, df.select(*rules.GROUP, "measure", "bucket", "n").collect()))
    assert key(halves) == key(rules.sketch(all_))
    values = spark.range(0, 200_000, 7).select("id", rules.bucket(F.col("id")).alias("b"))
    assert values.filter("b > id or 32 * (id - b) > id or (id < 64 and b <> id)").count() == 0


def test_rules_stay_in_column_functions(spark):
    plan = rules.quality_rules(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
