"""The pipeline, stage by stage, against plain versions of the same steps."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from zygospan.llm import mixing, packing, toxicity
from zygospan.llm.common import cut, training_rows

from .test_corpus import targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = cut(stage(spark, docs, SF), name)
    return out


def texts(df):
    return [tuple(r) for r in df.collect()]


def test_columns_stay_until_the_last_stage(stages):
    names = list(stages)
    assert all(stages[n].dtypes == stages["input"].dtypes for n in names[:-1])
    assert "sequence_id" in stages[names[-1]].columns


def test_toxic_documents_go(spark, stages):
    docs = stages["input"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, training_rows(labels, "toxic", 5, 0, toxicity.SAMPLE))
    auto = toxicity.finder(model)
    b = np.array(model.curve)
    rejected = lambda t: 1 / (1 + np.exp(-(np.array(toxicity.features(t, model, auto)) @ b[:-1] + b[-1]))) >= 0.5
    assert sorted(texts(stages["toxicity"])) == sorted(r for r in texts(docs) if not rejected(r[1]))
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    gone = {r[0] for r in texts(docs)} - {r[0] for r in texts(stages["toxicity"])}
    assert gone and not gone & clean


def test_one_row_of_each_text_stays(stages):
    last = {}
    for r in texts(stages["toxicity"]):
        if r[1] not in last or r[0] > last[r[1]][0]:
            last[r[1]] = r
    assert sorted(texts(stages["exact_dedup"])) == sorted(last.values())


def test_one_row_of_each_near_group_stays(stages):
    """Groups from all pairs: Jaccard similarity of five-word shingles at 0.8 or more, the smallest id stays."""
    rows = texts(stages["exact_dedup"])
    sets = []
    for r in rows:
        w = re.findall(mixing.WORD, r[1].translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    keep = {}
    for i, r in enumerate(rows):
        keep[find(i)] = min(keep.get(find(i), r[0]), r[0])
    assert len(keep) < len(rows)
    assert sorted(texts(stages["simhash_near_dedup"])) == sorted(r for i, r in enumerate(rows) if keep[find(i)] == r[0])


def test_the_mix_meets_its_targets_with_words_of_the_documents(stages):
    word = re.compile(mixing.WORD)
    before = {r[0]: r for r in texts(stages["simhash_near_dedup"])}
    sizes, taken, per_doc = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before.values():
        sizes[r[3]] += len(word.findall(r[1]))
    for r in texts(stages["source_mix"]):
        words = word.findall(r[1])
        assert not collections.Counter(words) - collections.Counter(word.findall(before[r[0]][1])) and r[4] == len(r[1])
        taken[r[3]] += len(words)
        per_doc[r[0]] += len(words)
    for source, target in targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= (0.5 + mixing.REPEATS) * corpus_pipeline.MIX_BLOCK
    assert all(n <= 3 * len(word.findall(before[i][1])) for i, n in per_doc.items())


def test_every_piece_is_packed_once(stages):
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), collections.Counter()
    for r in texts(stages["source_mix"]):
        ids = np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    rows = stages["best_two_fit"].collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(held) <= 1 + -(-sum(w[3] * n for w, n in want.items()) // 2048)


def test_run_returns_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages["best_two_fit"])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_stages_take_empty_and_null_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0  # documents without words take part in no mix
