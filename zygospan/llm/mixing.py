"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt over shards by a hash of the id; inside a shard they lie end to end in id order and are
cut into blocks of ``block`` words. Sainte-Laguë turns word targets into a whole number of blocks per source, and those
into quotas per shard; a seeded hash ranks the blocks that a quota takes once more than the others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zygospan.llm.common import cut, fresh

BLOCK = 8
REPEATS = 3
WEIGHTS = (5, 2, 1)
SHARD_WORDS = 1 << 20
MOST_SHARDS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(weights, seats: int) -> np.ndarray:
    """Seats by highest quotients ``w / (2k + 1)``; ties go to the party listed first.

    A search for the divisor gives all but the last, tied seats; those are handed out one by one.
    """
    w = np.asarray(weights, dtype=np.float64)
    q = np.zeros(len(w), dtype=np.int64)
    if seats <= 0 or not len(w) or w.sum() <= 0:
        return q
    lo, hi = 0.0, float(2 * w.max()) * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if np.floor(w / mid + 0.5).sum() > seats:
            lo = mid
        else:
            hi = mid
    q = np.floor(w / hi + 0.5).astype(np.int64)
    left = int(seats - q.sum())
    while left > 0:
        quotients = w / (2 * q + 1)
        take = np.argsort(-quotients, kind="stable")[: min(left, int((quotients > 0).sum()))]
        top = take[quotients[take] >= quotients[take[0]] * (1 - 1e-12)]
        q[top] += 1
        left -= len(top)
    return q


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` per source: weights repeat in code-point order, nulls last.

    The level at which capped sources stop is found from running sums over the sources in order of cap per weight;
    the window holds one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    per = per.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * float(repeats))
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    from_here = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(from_here)
    )
    # The first source in rank order whose cap lies above its level sets the level of all that follow.
    open_ = F.when(F.col("w") * F.col("level") <= F.col("cap"), F.col("level"))
    per = per.withColumn("level", F.first(open_, ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("cap", F.col("w") * F.coalesce("level", F.col("cap") / F.col("w")))
    return per.select("source", "source_size", target.alias("target"))


def source_seats(targets: DataFrame, block: int) -> DataFrame:
    """Adds ``seats``, the whole number of blocks each source gets of all blocks; one row per source meets in a task."""
    def seats(table: pa.Table) -> pa.Table:
        d = table.to_pandas()
        d = d.iloc[np.lexsort([d.source.fillna("").to_numpy(), d.source.isna().to_numpy()])]
        d["seats"] = sainte_lague(d.target.to_numpy(), int(round(d.target.sum() / block)))
        return pa.table({c: pa.array(d[c], t) for c, t in (("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("seats", pa.int64()))})

    return targets.groupBy(F.lit(0).alias("all")).applyInArrow(seats, "source string, source_size long, target double, seats long")


def block_order(seed: int, shard: int, n: int) -> np.ndarray:
    """A seeded order of a shard's blocks that any executor draws alike."""
    x = np.arange(n, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + shard * 0xD1B54A32D192ED03) & (2**64 - 1))
    for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(a))) * np.uint64(m)
    return np.argsort(x ^ (x >> np.uint64(31)), kind="stable")


def block_takes(n_words: int, quota: int, seed: int, shard: int, block: int, repeats: int) -> np.ndarray:
    """Times each block of a shard is taken; never more than ``repeats``."""
    n = -(-n_words // block)
    quota = min(quota, repeats * n)
    takes = np.full(n, quota // n if n else 0, dtype=np.int64)
    if n:
        takes[block_order(seed, shard, n)[: quota % n]] += 1
    return takes


def plan_shards(sizes: DataFrame, targets: DataFrame, block: int, repeats: int, shard_words: int, most_shards: int) -> tuple[DataFrame, DataFrame]:
    """Document pieces with their shard, and ``sid, shard, shard_size, quota`` per shard."""
    wide = F.greatest(F.lit(shard_words).cast("long"), F.ceil(F.col("source_size") / most_shards))
    targets = targets.withColumn("wide", wide).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("wide"))))
    targets = cut(targets.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")), "mix_sources")
    named = sizes.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")).drop("source").join(targets, "sid")
    first = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.col("n_shards"))
    pieces = named.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("size", F.lit(1)) - 1) / F.col("wide")))))
    pieces = pieces.withColumn("n", F.least("wide", F.col("size") - F.col("piece") * F.col("wide"))).withColumn(
        "shard", F.when(F.col("piece") == 0, first).otherwise(F.pmod(F.xxhash64("doc_id", "piece"), F.col("n_shards")))
    )
    shards = pieces.filter("n > 0").groupBy("sid", "shard").agg(F.sum("n").alias("shard_size"))

    def quotas(table: pa.Table) -> pa.Table:
        d = table.to_pandas().sort_values(["sid", "shard"])
        blocks = -(-d.shard_size.to_numpy() // block)
        d["quota"] = np.minimum(sainte_lague(d.shard_size.to_numpy(), int(d.seats.iloc[0])), repeats * blocks)
        return pa.Table.from_pandas(d[["sid", "shard", "shard_size", "quota"]], preserve_index=False)

    shards = shards.join(targets.select("sid", "seats"), "sid").groupBy("sid").applyInArrow(quotas, "sid long, shard long, shard_size long, quota long")
    return pieces, shards


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: int = 42, block: int = BLOCK,
        shard_words: int = SHARD_WORDS, most_shards: int = MOST_SHARDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, x, source, size, source_size, target, taken, spans``.

    ``spans`` lists ``start, length, times`` in words for the taken parts, in order; ``taken`` is their sum with
    repeats. A null text has no words, a null source is one of its own and comes last; a row without words takes none.
    Repeated rows are mixed each on its own. Without any word nothing is taken. Reruns agree: shards, order and draws
    hang on ids, texts' lengths and the seed alone.
    """
    sizes = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("x"), F.col("source").cast("string"), words().alias("size"))
    sizes = cut(sizes, "mix_rows")
    targets = cut(source_seats(source_targets(sizes, weights, repeats), block), "mix_targets")
    pieces, shards = plan_shards(sizes, targets, block, repeats, shard_words, most_shards)
    shards = cut(shards, "mix_shards")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("times", pa.int64())]))

    def take(table: pa.Table) -> pa.Table:
        d = table.to_pandas().sort_values(["doc_id", "x", "uid", "piece"], kind="stable").reset_index(drop=True)
        takes = block_takes(int(d.n.sum()), int(d.quota.iloc[0]), seed ^ (int(d.sid.iloc[0]) & 0xFFFFFFFF), int(d.shard.iloc[0]), block, repeats)
        ends = np.cumsum(d.n.to_numpy())
        changes = np.flatnonzero(np.diff(takes)) + 1
        edges, values = np.concatenate([[0], changes]) * block, takes[np.concatenate([[0], changes])]
        upper = np.append(edges[1:], ends[-1])
        spans = []
        for end, n, at in zip(ends, d.n, d.piece * d.wide):
            i, start, own = int(np.searchsorted(edges, end - n, side="right")) - 1, end - n, []
            while i < len(edges) and edges[i] < end:
                a, b = max(start, edges[i]), min(end, upper[i])
                if values[i]:
                    own.append({"start": int(at + a - start), "length": int(b - a), "times": int(values[i])})
                i += 1
            spans.append(own)
        return pa.table([pa.array(d.uid), pa.array(d.piece), pa.array(spans, kind)], ["uid", "piece", "spans"])

    chosen = pieces.filter("n > 0").select("sid", "shard", "uid", "doc_id", "x", "piece", "wide", "n").join(shards, ["sid", "shard"])
    chosen = chosen.groupBy("sid", "shard").applyInArrow(take, "uid long, piece long, spans array<struct<start:long,length:long,times:long>>")
    per_row = chosen.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("piece", "spans"))).alias("p")).select(
        "uid", F.flatten(F.transform("p", lambda p: p["spans"])).alias("spans")
    )
    none = F.array().cast("array<struct<start:long,length:long,times:long>>")
    out = sizes.join(per_row, "uid", "left").withColumn("spans", F.coalesce("spans", none))
    known = targets.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")).drop("source", "seats")
    out = out.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")).join(known, "sid")
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"] * s["times"])
    return out.select("doc_id", "x", "source", "size", "source_size", "target", taken.alias("taken"), "spans")


def on_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return a[key[0]].eqNullSafe(b[key[0]]) & (a[key[1]] == b[key[1]])


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix has them: per pass over a document one row with the words taken in it.

    A pass that takes every word keeps the text as it is; otherwise the words of a taken part keep the white space
    between them and parts are joined by a line feed. ``n_chars``, where there is one, is counted anew. Documents
    that the mix leaves out are gone. Rows that repeat an id and a text are numbered, and each follows a plan of its own.
    """
    plan = cut(mix(docs, **settings).select(F.col("doc_id").alias("i"), "x", "size", "spans"), "mix_plans")
    i, x, n, plan_, size = (fresh(docs.columns, f"_mix_{c}") for c in ("i", "x", "n", "plan", "size"))
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), x: F.xxhash64("text")})
    plan = plan.select(F.col("i").alias(f"{i}p"), F.col("x").alias(f"{x}p"), F.col("size").alias(size), F.col("spans").alias(plan_))
    same = F.col(i).eqNullSafe(F.col(f"{i}p")) & (F.col(x) == F.col(f"{x}p"))
    key = [f"{i}p", f"{x}p"]
    times = cut(plan.groupBy(*key).count().filter("count > 1").select(*key), "mix_repeats")
    ranked = rows.join(plan.join(times, on_key(plan, times, key), "left_anti"), same)
    if not times.isEmpty():
        # Only rows that share id and text are numbered, on both sides alike.
        known = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
        numbered = rows.join(times, same, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(i, x).orderBy(F.xxhash64(*known))))
        plans = plan.join(times, on_key(plan, times, key), "left_semi").withColumn(f"{n}p", F.row_number().over(Window.partitionBy(*key).orderBy(F.size(plan_))))
        ranked = ranked.unionByName(numbered.join(plans, same & (F.col(n) == F.col(f"{n}p"))).drop(n, f"{n}p"))
    columns = docs.columns

    def cut_texts(batches):
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            places, texts = [], []
            for row, (text, n_words, spans) in enumerate(zip(*(batch.column(at[c]).to_pylist() for c in ("text", size, plan_)))):
                most = max((s["times"] for s in spans), default=0)
                where = None
                for k in range(1, most + 1):
                    parts = []
                    for s in (s for s in spans if s["times"] >= k):
                        if parts and parts[-1][1] == s["start"]:
                            parts[-1][1] += s["length"]
                        else:
                            parts.append([s["start"], s["start"] + s["length"]])
                    if parts == [[0, n_words]]:
                        piece = text
                    else:
                        where = where or [m.span() for m in word.finditer(text)]
                        piece = "\n".join(text[where[a][0] : where[b - 1][1]] for a, b in parts)
                    places.append(row)
                    texts.append(piece)
            out = batch.take(pa.array(places, pa.int64())).select(columns)
            out = out.set_column(columns.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in columns:
                n = pa.array([len(t) for t in texts], pa.int64()).cast(out.schema.field("n_chars").type)
                out = out.set_column(columns.index("n_chars"), "n_chars", n)
            yield out

    return ranked.mapInArrow(cut_texts, docs.schema)
