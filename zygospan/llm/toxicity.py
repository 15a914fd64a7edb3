"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read a clause's word classes (insult, threat, target, negation, reported speech); their composition
reads a clause once and writes the weight of each match with the context it was found in. Matched clauses, not isolated
words, are scored. Insult words, stems and their weights are learned from labels, as is the curve over clause sums.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zygospan.llm.common import column, sigmoid, small_batches
from zygospan.llm.quality import logistic

SAMPLE = 20_000
LEXICON = 4_000
STEMS = (4, 5, 6)
WORD = re.compile(r"\w+")
CLAUSE_END = re.compile(r"[.!?;:\n]+")

# Fixed word classes in English, German, Spanish and French.
THREATS = {"kill", "hurt", "destroy", "punch", "töten", "umbringen", "verletzen", "matar", "destruir", "golpear", "tuer", "détruire", "frapper"}
TARGETS = {"you", "your", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "euch", "tú", "usted", "ustedes", "ellos", "tu", "toi", "vous", "ils"}
NEGATIONS = {"not", "no", "never", "without", "nicht", "kein", "keine", "nie", "nunca", "jamás", "sin", "pas", "jamais", "sans"}
REPORTS = {"said", "says", "wrote", "claimed", "quoted", "sagte", "schrieb", "behauptete", "dijo", "escribió", "afirmó", "dit", "écrit", "affirmé"}

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)


@dataclass(frozen=True)
class Transducer:
    """States from 0 up; ``arcs[state][word class]`` gives the next state and what is written."""

    arcs: tuple[tuple[tuple[int, str], ...], ...]


def countdown(starter: int, reach: int, mark: str) -> Transducer:
    """Writes ``mark`` for each word within ``reach`` words after a starter."""
    rows = []
    for left in range(reach + 1):
        rows.append(tuple((reach, "") if c == starter else (max(0, left - 1), mark if left else "") for c in range(6)))
    return Transducer(tuple(rows))


def latch(starter: int, mark: str) -> Transducer:
    """Writes ``mark`` for every word after a starter up to the clause's end."""
    off = tuple((1, "") if c == starter else (0, "") for c in range(6))
    return Transducer((off, tuple((1, mark) for _ in range(6))))


def emitter(kind: int, mark: str) -> Transducer:
    return Transducer((tuple((0, mark if c == kind else "") for c in range(6)),))


def compose(*machines: Transducer) -> Transducer:
    """The machine that runs all at once and writes their marks together; only states that can be reached."""
    ids, todo, rows = {(0,) * len(machines): 0}, [(0,) * len(machines)], []
    for state in todo:
        row = []
        for c in range(6):
            steps = [m.arcs[s][c] for m, s in zip(machines, state)]
            nxt = tuple(s for s, _ in steps)
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append((ids[nxt], "".join(o for _, o in steps)))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


#: i insult, h threat; t a target shortly before, n within a negation, r after a reporting verb.
GRAMMAR = compose(emitter(INSULT, "i"), emitter(THREAT, "h"), countdown(TARGET, 4, "t"), countdown(NEGATION, 3, "n"), latch(REPORT, "r"))
CONTEXTS = ("plain", "aimed", "negated", "reported", "threat")
#: ``asserted`` sums plain and aimed insults and threats against a target.
FEATURES = (*CONTEXTS, "clauses", "asserted")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (0.0,) * (len(FEATURES) + 1)
    #: A threat weighs as much as the median insult.
    threat: float = 1.0


def classify(word: str, model: Model) -> tuple[int, float]:
    """Class and weight of a lower-case word; a whole word goes before the longest stem."""
    if word in model.words:
        return INSULT, model.words[word]
    for n in reversed(STEMS):
        if len(word) > n and word[:n] in model.stems:
            return INSULT, model.stems[word[:n]]
    for kind, known in ((THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS)):
        if word in known:
            return kind, model.threat if kind == THREAT else 1.0
    return OTHER, 0.0


def clause_score(clause: str, model: Model) -> dict[str, float]:
    """Weights that the grammar writes for a clause, by context.

    What is denied or quoted is kept apart and does not make the clause count, so without labels to the contrary the
    curve leaves it at nothing.
    """
    state, sums = 0, dict.fromkeys((*CONTEXTS, "clauses"), 0.0)
    for word in WORD.findall(clause):
        kind, weight = classify(word, model)
        state, out = GRAMMAR.arcs[state][kind]
        threat = "h" in out and "t" in out
        if not threat and "i" not in out:
            continue
        if "n" in out or "r" in out:
            sums["negated" if "n" in out else "reported"] += weight
            continue
        sums["threat" if threat else "aimed" if "t" in out else "plain"] += weight
    sums["clauses"] = float(asserted(sums) > 0)
    return sums


def asserted(sums: dict[str, float]) -> float:
    return sums["plain"] + sums["aimed"] + sums["threat"]


def finder(model: Model):
    """Places where a clause can match at all: an automaton over insult words, stems and threats."""
    auto = ahocorasick.Automaton()
    for w in {*model.words, *model.stems, *THREATS}:
        auto.add_word(w, len(w))
    auto.make_automaton()
    return auto


def features(text: str | None, model: Model, auto) -> list[float]:
    """Sums over the whole text's matched clauses, on a log scale. A clause without any insult or threat writes nothing."""
    total = dict.fromkeys(FEATURES, 0.0)
    low, done = (text or "").lower(), -1
    for end, n in auto.iter(low):
        start = end - n + 1
        if end < done or (start and (low[start - 1].isalnum() or low[start - 1] == "_")):
            continue
        a = 0
        for m in CLAUSE_END.finditer(low, max(0, done), start):
            a = m.end()
        a = max(a, done, 0)
        stop = CLAUSE_END.search(low, end)
        done = stop.start() if stop else len(low)
        for k, v in clause_score(low[a:done], model).items():
            total[k] += v
    total["asserted"] = asserted(total)
    return [float(np.log1p(total[k])) for k in FEATURES]


def lexicon(sample: DataFrame, least: int, most: int = LEXICON, purity: float = 0.9) -> tuple[dict[str, float], dict[str, float]]:
    """Insult words and stems with log-odds weights from ``sample`` (``text, y``).

    A term needs ``least`` toxic texts that hold it, as many different pairs of neighbours (so the words of one
    much-copied text do not pass for insults), and a share of ``purity`` of toxic ones among the texts that hold it.
    The ``most`` commonest go into the lexicon, which bounds what is collected.
    """
    kinds = (("term", pa.string()), ("ctx", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()))
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    def count(batches):
        clean: Counter[str] = Counter()
        rows: list[tuple] = []
        for batch in small_batches(batches):
            for text, y in zip(column(batch, "text"), column(batch, "y")):
                words = WORD.findall((text or "").lower())
                if y != 1:
                    clean.update({t for w in set(words) for t in terms(w)})
                    continue
                rows += [(t, None, 1, 0) for t in {t for w in set(words) for t in terms(w)}]
                for w, before, after in set(zip(words, ["", *words], [*words[1:], ""])):
                    rows += [(t, f"{before} {after}", 0, 0) for t in terms(w)]
                    if len(rows) > 50_000:
                        yield table(rows)
                        rows.clear()
        yield table(rows)
        for at in range(0, len(clean), 100_000):
            yield table([(t, None, 0, n) for t, n in islice(clean.items(), at, at + 100_000)])

    counts = sample.select("text", "y").mapInArrow(count, "term string, ctx string, toxic long, clean long")
    per_ctx = counts.groupBy("term", "ctx").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    per = per_ctx.groupBy("term").agg(F.count("ctx").alias("settings"), F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n = sample.agg(F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    top = per.filter((F.col("t") >= least) & (F.col("settings") >= least) & (F.col("t") >= purity * (F.col("t") + F.col("c")))).orderBy(F.desc("t"), "term").limit(most).collect()
    words, stems = {}, {}
    for r in top:
        weight = float(np.log((r.t + 0.5) / (n.t + 1)) - np.log((r.c + 0.5) / (n.n - n.t + 1)))
        if weight > 0:
            (stems if r.term.endswith("*") else words)[r.term.rstrip("*")] = min(weight, 10.0)
    return words, stems


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def train(docs: DataFrame, rows: DataFrame, least: int = 4) -> Model:
    """Learn lexicon and curve from ``rows`` (``doc_id, y``), a bounded sample: at most ``SAMPLE`` ids by default.

    Equal texts teach once. Without a toxic or without a clean row the curve is flat.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(rows), "doc_id")
    sample = texts.select("text", "y", F.xxhash64("text").alias("x"))
    firsts = sample.groupBy("x").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    words, stems = lexicon(firsts, least)
    weighs = [*words.values(), *stems.values()]
    threat = float(np.median(weighs)) if weighs else 1.0
    model = Model(words, stems, threat=threat)
    seen = _features(sample.select(F.col("x").alias("doc_id"), "text", F.col("y").alias("z")), model).groupBy("doc_id").agg(F.max("z").alias("y"), F.first("f").alias("f"))
    # Rows with equal sums are counted together; at most SAMPLE rows reach the fit.
    grid = seen.select("y", F.transform("f", lambda v: F.round(v, 2)).alias("f")).groupBy("y", "f").count().collect()
    y = np.array([r.y for r in grid for _ in range(r["count"])], dtype=float)
    if not len(y) or y.min() == y.max():
        flat = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return Model(words, stems, (0.0,) * len(FEATURES) + (flat,), threat)
    x = np.array([r.f for r in grid for _ in range(r["count"])])
    # Without its own column a plain insult weighs what it asserts; other contexts differ from that by their own weight.
    x[:, FEATURES.index("plain")] = 0.0
    b = logistic(np.c_[x, np.ones(len(y))], y, ridge=0.05)
    return Model(words, stems, tuple(float(v) for v in b), threat)


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, z, f`` for ``doc_id, text, z``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        auto = finder(shared.value)
        for batch in small_batches(batches):
            f = [features(t, shared.value, auto) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "z", "f"])

    return rows.select(F.col("doc_id").cast("long"), "text", F.col("z").cast("int")).mapInArrow(run, "doc_id long, z int, f array<double>")


def _scores(f, model: Model) -> np.ndarray:
    b = np.array(model.curve)
    return sigmoid(np.array(f, dtype=float).reshape(-1, len(FEATURES)) @ b[:-1] + b[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row; higher means toxic is likelier.

    Null and empty texts, like all without a matched clause, get the curve's value at zero. Repeated rows score alike.
    """
    curve = model.curve
    z = sum((F.element_at("f", i + 1) * b for i, b in enumerate(curve[:-1])), F.lit(float(curve[-1])))
    rows = _features(docs.select("doc_id", "text", F.lit(0).alias("z")), model)
    return rows.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("score"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        auto = finder(shared.value)
        for batch in small_batches(batches):
            s = _scores([features(t, shared.value, auto) for t in column(batch, "text")], shared.value)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
