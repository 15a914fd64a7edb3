"""Quality rules whose thresholds follow the data: quantile sketches per language and source, then a joined filter.

Built from column functions alone. A text's measures are whole numbers. The sketch of a group counts its documents by
measure and bucket; buckets hold one value up to 63 and a 32nd of an octave beyond, so a quantile is at most one part
in 32 below the true value. Sketches are plain tables that merge by adding counts, over tasks, days or tables alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zygospan.llm.common import cut

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rule: fewest words, and the most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Measures per thousand words or lines that are judged, and how far from the median they may always lie: a group in
#: which a measure hardly varies would otherwise reject what differs by a word.
SLACK = {"word_chars": 1500, "symbols": 150, "dup_lines": 400, "repeat_words": 200}
FENCE = 3
#: Groups of fewer documents take the thresholds of their language, small languages those of all documents.
LEAST_DOCS = 50
SALTS = 16
GROUP = ["lang", "source"]


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, BLANK)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words of the array ``w`` that lie in a window found twice or more in it.

    Windows meet by hash in a sorted array and neighbours are compared word by word, so a long text costs no more than
    sorting. Texts whose windows all differ by hash are done before.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    after = lambda a: F.slice(a, F.lit(2), F.size(a))
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice(w, a["at"], width) == F.slice(w, b["at"], width))

    def total(places: Column) -> Column:
        gaps = F.zip_with(places, after(places), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def marked(found: Column) -> Column:
        # The hit of a row belongs to it and to the one after it.
        hits = F.concat(F.array(F.lit(False)), F.transform(found, lambda r: r["hit"]))
        return F.zip_with(found, hits, lambda r, before: F.when(r["hit"] | before, r["at"]))

    def paired(r: Column) -> Column:
        return F.zip_with(r, after(r), lambda a, b: F.struct(a["at"].alias("at"), F.coalesce(same(a, b), F.lit(False)).alias("hit")))

    def covered(h: Column) -> Column:
        rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("at"))))
        places = let(let(rows, paired), lambda f: F.array_sort(F.filter(marked(f), lambda p: p.isNotNull())))
        return let(places, total)

    once = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) > width, once).otherwise(0).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed`` instead of its text.

    ``n_lines`` are the lines with a word. A null text has no words. Each step is a generated row, so that neither
    filters nor projections above repeat its work.
    """
    text = F.coalesce("text", F.lit(""))
    length = lambda c: F.length(c).cast("long")
    step = lambda **c: F.inline(F.array(F.struct(*(v.alias(k) for k, v in c.items()))))
    kept = [c for c in docs.columns if c != "text"]
    parts = docs.select(*docs.columns, step(w=words(text), lines=F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)))
    out = parts.select(*kept, step(
        n_words=F.size("w").cast("long"), word_chars=length(F.translate(text, BLANKS, "")),
        n_symbols=length(text) - length(F.translate(text, SYMBOLS, "")), n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), n_repeat_words=repeated_words(F.col("w")),
    ))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def judged() -> dict[str, Column]:
    """Each judged measure, per thousand."""
    share = lambda n, of: F.floor(1000 * F.col(n) / F.greatest(F.col(of), F.lit(1)))
    return {
        "word_chars": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeat_words": share("n_repeat_words", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The least value of the sketch's bucket that holds a whole number from 0 on."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    step = F.pow(F.lit(2.0), shift).cast("long")
    return value - F.pmod(value, step)


def sketch(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n`` over the rows of ``measures`` that pass the base rule."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(c).alias("bucket")) for k, c in judged().items())))
    return rows.filter(~F.col("base_failed")).select(*GROUP, each.alias("m")).groupBy(*GROUP, "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of all the documents of several."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*GROUP, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``q25, q50, q75, n`` per key and measure; the quantile at p has rank ``floor(p (n - 1))`` from 0."""
    own = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "measure")
    upto = part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(part)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p / 4), F.col("bucket")))
    return own.groupBy(*keys, "measure").agg(at(1).alias("q25"), at(2).alias("q50"), at(3).alias("q75"), F.max("all").alias("n"))


def limits(counts: DataFrame, slack: dict[str, int] | None = None, fence: int = FENCE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, measure, low, high`` per group of the sketch.

    ``fence`` quartile distances beyond the quartiles, and never nearer to the median than the measure's slack. Groups
    of fewer than ``least_docs`` documents use their language's quantiles, and those of a small language all documents'.
    """
    own, lang, all_ = (quantiles(counts, k) for k in (GROUP, ["lang"], []))
    names = ("q25", "q50", "q75", "n")
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), *(F.col(c).alias(f"l_{c}") for c in names))
    all_ = all_.select("measure", *(F.col(c).alias(f"a_{c}") for c in names))
    out = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["measure"] == lang["l_measure"])).join(all_, "measure")
    q = {c: F.when(F.col("n") >= least_docs, F.col(c)).when(F.col("l_n") >= least_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")) for c in names[:3]}
    slack = slack or SLACK
    room = F.element_at(F.create_map(*(F.lit(x) for kv in slack.items() for x in kv)), F.col("measure"))
    return out.select(
        *GROUP, "measure",
        F.least(q["q25"] - fence * (q["q75"] - q["q25"]), q["q50"] - room).alias("low"),
        F.greatest(q["q75"] + fence * (q["q75"] - q["q25"]), q["q50"] + room).alias("high"),
    )


def judge(rows: DataFrame, bounds: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` of ``measures`` with ``kept``: past the base rule and within all limits of their group.

    A group holds one row of limits; it is laid out once per salt, so that a source with a third of all documents
    meets them in many tasks.
    """
    wide = bounds.groupBy(*GROUP).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("limits"))
    wide = wide.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "limits", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("g_salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    both = rows.join(wide, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("salt") == F.col("g_salt")), "left")
    within = F.lit(True)
    for k, c in judged().items():
        within &= c.between(F.col("limits")[k]["low"], F.col("limits")[k]["high"])
    # Without limits no document of the group has passed the base rule.
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop("g_lang", "g_source", "g_salt", "salt", "limits")


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the measures, ``base_failed`` and ``kept`` per row of ``docs``.

    Null languages and sources are groups of their own; a null or empty text fails the base rule. Repeated rows are
    judged alike and count each; columns other than ``doc_id, text, lang, source`` are ignored. No rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    rows = cut(measures(rows), "rule_measures")
    return judge(rows, cut(limits(sketch(rows)), "rule_limits"))


def keep_good(docs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; ``bounds`` may come from an earlier sketch."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    rows = measures(own)
    if bounds is None:
        bounds = cut(limits(sketch(rows.drop("row"))), "rule_limits")
    return judge(rows, bounds).filter("kept").select("row.*")
