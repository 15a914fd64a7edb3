import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zygospan.llm import language, quality, toxicity
from zygospan.llm.common import held_out, training_rows

from .data import empty, frame, words

LANGS = {"aa": "abcde", "bb": "uvwxyz", "cc": "klmnop"}
SYLLABLES = {k: words(random.Random(9), 12, v, 2, 5).split() for k, v in LANGS.items()}


def corpus(n=240, seed=1):
    """Languages of disjoint letters; low quality adds marks, toxic texts add insults."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        t = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        if not good:
            t = t.replace(" ", "%%% ")
        if toxic:
            w = t.split(" ")
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["dolt", "grubby", "grubbish", "nitwit"]))
            t = " ".join(w)
        docs.append((i, t, lang, "s", len(t)))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, "aa", None, None), (n + 1, "", None, None, 0), (n + 2, "123 !?", "bb", None, 1), (None, "abc abc", None, None, 7), docs[0]]
    labels += [(None, 1, 1), (0, None, None), (n, 1, 0), (3, labels[3][1], labels[3][2])]
    return docs, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_languages_of_held_out_rows(spark):
    docs, _ = corpus()
    df = frame(spark, docs)
    model = language.train(df.filter(~held_out("doc_id", 4, 2)))
    rows = language.identify(df, model).collect()
    assert len(rows) == len(docs) and set(model) == set(LANGS)
    truth = {d[0]: d[2] for d in docs}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (240, 241, 242):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    right = [r.lang_pred == truth[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id < 240]
    assert np.mean(right) > 0.98
    strict = language.identify(df, model, margin=1e9).filter("lang_pred <> 'und'")
    assert strict.count() == 0


def test_language_without_rows(spark):
    assert language.train(empty(spark)) == {}
    assert language.identify(empty(spark), {}).count() == 0
    assert language.identify(frame(spark, [(1, "abc", "aa", None, 3)]), {}).head().lang_pred == "und"


def test_a_repeated_text_takes_one_place_of_a_language(spark):
    rng = random.Random(4)
    texts = [words(rng, 12) for _ in range(50)]
    hashes = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) as h").orderBy("h").collect()
    data = [(i, t, "aa", None, 1) for i, t in enumerate(texts + [hashes[0].text] * 400)]
    model = language.train(frame(spark, data), sample_docs=20)
    assert model["aa"].decode().split("\n") == [r.text for r in hashes[:20]]


def test_every_language_is_learned(spark):
    data = [(i, f"text of {i}", f"l{i}", None, 1) for i in range(300)]
    assert len(language.train(frame(spark, data))) == 300


def test_training_rows_are_bounded_and_held_in(spark):
    _, labels = corpus()
    rows = training_rows(label_frame(spark, labels), "quality", 5, 0, 50)
    ids = [r.doc_id for r in rows.collect()]
    assert len(ids) == len(set(ids)) == 50 and None not in ids
    import zlib
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_scores_of_held_out_rows(spark, kind):
    docs, labels = corpus(400)
    df, op = frame(spark, docs), quality if kind == "quality" else toxicity
    model = op.train(df, training_rows(label_frame(spark, labels), kind, 5, 0, op.SAMPLE))
    rows = op.score(df, model).withColumn("held_out", held_out("doc_id", 5, 0)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {r[0]: r[1 if kind == "quality" else 2] for r in labels if r[0] is not None and r[1] is not None}
    right = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in rows if r.held_out and r.doc_id in truth and r.doc_id < 400]
    assert len(right) > 50 and np.mean(right) > 0.95


@pytest.mark.parametrize("op", [quality, toxicity])
def test_models_without_labels(spark, op):
    docs, labels = corpus(20)
    none = training_rows(label_frame(spark, []), "toxic", 5, 0, 100)
    assert {r.score for r in op.score(frame(spark, docs), op.train(frame(spark, docs), none)).collect()} == {0.5}
    assert op.score(empty(spark), op.train(empty(spark), none)).count() == 0
    one = training_rows(label_frame(spark, [(i, 1, 1) for i in range(20)]), "toxic", 5, 0, 100)
    assert all(r.score > 0.9 for r in op.score(frame(spark, docs), op.train(frame(spark, docs), one)).collect())


def test_context_decides_the_outcome(spark):
    docs, labels = corpus(400)
    docs = [d for d in docs if d[0] is not None]
    model = toxicity.train(frame(spark, docs), training_rows(label_frame(spark, labels), "toxic", 5, 0, toxicity.SAMPLE))
    plain = {
        1: "he is a dolt and a nitwit", 2: "you dolt, you nitwit", 3: "i will find you and kill you", 4: "they should hurt him",
        11: "she is not a dolt, never a nitwit", 12: "the witness said that he called him a dolt", 13: "she would never hurt you",
        14: "he wrote that they want to kill him", 15: "the frost will kill the roses", 16: "not a word about you",
    }
    rows = {r.doc_id: r.score for r in toxicity.score(frame(spark, [(k, t, "aa", "s", len(t)) for k, t in plain.items()]), model).collect()}
    assert {k for k, v in rows.items() if v >= 0.5} == {k for k in plain if k < 10}, rows


def slow_marks(clause, model):
    """Contexts of a clause's words by looking back over the words, without any machine."""
    kinds = [toxicity.classify(w, model)[0] for w in toxicity.WORD.findall(clause)]
    sums = dict.fromkeys((*toxicity.CONTEXTS, "clauses"), 0.0)
    for i, w in enumerate(toxicity.WORD.findall(clause)):
        kind, weight = toxicity.classify(w, model)
        denied, quoted, aimed = toxicity.NEGATION in kinds[max(0, i - 3) : i], toxicity.REPORT in kinds[:i], toxicity.TARGET in kinds[max(0, i - 4) : i]
        if kind == toxicity.INSULT or (kind == toxicity.THREAT and aimed):
            place = "negated" if denied else "reported" if quoted else "threat" if kind == toxicity.THREAT else "aimed" if aimed else "plain"
            sums[place] += weight
    sums["clauses"] = float(sums["plain"] + sums["aimed"] + sums["threat"] > 0)
    return sums


def test_composed_grammar_equals_a_look_back():
    rng = random.Random(4)
    model = toxicity.Model({"dolt": 2.0, "nitwit": 1.5}, {"grub": 1.25}, (), 2.25)
    known = ["dolt", "nitwit", "grubby", "kill", "hurt", "you", "him", "not", "never", "said", "wrote", "tree", "house", "a"]
    for _ in range(3000):
        clause = " ".join(rng.choice(known) for _ in range(rng.randint(0, 14)))
        assert toxicity.clause_score(clause, model) == slow_marks(clause, model), clause


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.1, 1.0, -1.0)
    idx = [np.arange(4)] * 60
    w, b = quality.dual_descent(idx, list(x), y, 4, cost=0.5, epochs=400)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    assert all(best <= loss(w + d[:4], b + d[4]) + 1e-3 for d in rng.normal(scale=0.05, size=(300, 5)))


def test_grams_of_a_long_text_do_not_hang_on_the_step():
    flags = np.zeros(1 << 18, dtype=bool)
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(5000))
    assert (quality.grams(text, flags) == quality.grams(text, flags, step=100)).all() and not flags.any()


def test_grammar_reads_contexts():
    model = toxicity.Model({"dolt": 2.0}, {"grub": 1.5})
    at = lambda s: {k: v for k, v in toxicity.clause_score(s, model).items() if v and k != "clauses"}
    assert at("what a dolt") == {"plain": 2.0}
    assert at("you are a dolt") == {"aimed": 2.0}
    assert at("you are not a dolt") == {"negated": 2.0}
    assert at("the man said dolt") == {"reported": 2.0}
    assert at("grubbish grub") == {"plain": 1.5}
    assert at("i will find you and kill") == {"threat": 1.0}
    assert at("kill the lights") == {}
    auto = toxicity.finder(model)
    f = dict(zip(toxicity.FEATURES, toxicity.features("A dolt. Adolt! nothing; you dolt\nsubgrub", model, auto)))
    assert f["clauses"] == pytest.approx(np.log1p(2)) and f["aimed"] == f["plain"] == pytest.approx(np.log1p(2.0))
    assert toxicity.features(None, model, auto) == [0.0] * len(toxicity.FEATURES)


def test_composition_runs_all_machines():
    a, b = toxicity.countdown(toxicity.TARGET, 2, "t"), toxicity.latch(toxicity.REPORT, "r")
    both, rng = toxicity.compose(a, b), random.Random(0)
    s = sa = sb = 0
    for _ in range(200):
        c = rng.randrange(6)
        s, out = both.arcs[s][c]
        sa, oa = a.arcs[sa][c]
        sb, ob = b.arcs[sb][c]
        assert out == oa + ob


def test_rejected_documents_go(spark):
    docs, labels = corpus(400)
    df = frame(spark, docs)
    model = toxicity.train(df, training_rows(label_frame(spark, labels), "toxic", 5, 0, 1000))
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns
    scores = toxicity.score(df, model).filter("score < 0.5").select("doc_id")
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in scores.collect())))
    assert 0.6 < kept.count() / df.count() < 0.9


@pytest.mark.parametrize("texts", [["abcd", "wxyz"], ["", ""], ["a", "abcdefg"], ["abcd", ""]])
def test_quality_learns_from_rows_of_any_size(texts, spark):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, y int")
    model = quality.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())


def test_language_equals_plain_compression(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice(("abc é", "xyz ß", "klm ñ")[i % 3]) for _ in range(rng.randint(1, 9000))), "abc"[i % 3]) for i in range(60)] + [(100, None, "a"), (101, "12 !", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.train(df.filter("doc_id % 2 = 0"))
    for r in language.identify(df, model).collect():
        text = docs[r.doc_id][1] if r.doc_id < 60 else None
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.margin) == ("und", 0.0, 0.0)
            continue
        data = text.lower().encode()
        n = {k: sum(len(language.compressor(d).compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for k, d in model.items()}
        best = sorted(n.items(), key=lambda kv: (kv[1], kv[0]))
        assert r.lang_pred == best[0][0] and abs(r.margin - (best[1][1] - best[0][1]) / best[0][1]) < 1e-12
