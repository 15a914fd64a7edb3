"""Deterministic sampling: every draw is a hash of ids, so reruns and retries agree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from zygospan.config import DEFAULTS, Settings
from zygospan.functions import evidence as E
from zygospan.operators import background as B
from zygospan.operators.blocked import rank_desc, row_numbers
from zygospan.operators.spread import spread_join

Draw = Callable[..., Column]


def hash_draw(seed: int) -> Draw:
    """Non-negative integer draw from any columns."""
    def draw(*cols: Column) -> Column:
        return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(2**62 - 1))
    return draw


def subsample(df: DataFrame, by: Sequence[str], unit: str, n: int, draw: Draw) -> DataFrame:
    """At most ``n`` units per group; a literal limit is applied before the shuffle."""
    w = W.partitionBy(*by).orderBy("_d", unit)
    ranked = df.withColumn("_d", draw(F.col(unit))).withColumn("_r", F.row_number().over(w))
    return ranked.filter(F.col("_r") <= n).drop("_d", "_r")


def reference_test_split(df: DataFrame, by: Sequence[str], unit: str, n_ref: int, n_test: int, draw: Draw) -> DataFrame:
    """Disjoint ``ref`` and ``test`` units per group."""
    w = W.partitionBy(*by).orderBy("_d", unit)
    ranked = df.withColumn("_d", draw(F.col(unit))).withColumn("_r", F.row_number().over(w))
    return ranked.filter(F.col("_r") <= n_ref + n_test).withColumn(
        "part", F.when(F.col("_r") <= n_ref, "ref").otherwise("test")
    ).drop("_d", "_r")


def index_units(df: DataFrame, by: Sequence[str], unit: str, block: Column) -> DataFrame:
    """Dense 0-based ``idx`` and group size ``n_units`` in unit order."""
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"))
    # One row a group: never the numbered rows, which their estimate makes look as small.
    return (
        row_numbers(df, by, block, [F.col(unit)], "idx").withColumn("idx", F.col("idx") - 1).join(F.broadcast(sizes), by)
    )


def haplotype_pairs(indexed: DataFrame, by: Sequence[str], unit: str, n_pairs: int, draw: Draw) -> DataFrame:
    """Random pairs of homologs from two different units of a group."""
    by = list(by)
    n = F.col("n_units")
    base = indexed.select(*by, "n_units").distinct().filter(n >= 2)
    pairs = base.withColumn("pair", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pairs - 1).cast("long"))))
    i = F.pmod(draw(F.col("pair"), F.lit(1)), n)
    j = F.pmod(i + 1 + F.pmod(draw(F.col("pair"), F.lit(2)), n - 1), n)
    pairs = pairs.select(
        *by, "pair", i.alias("_i"), j.alias("_j"),
        F.pmod(draw(F.col("pair"), F.lit(3)), F.lit(2)).alias("hap_a"),
        F.pmod(draw(F.col("pair"), F.lit(4)), F.lit(2)).alias("hap_b"),
    )
    side = lambda name, idx: indexed.select(*by, F.col("idx").alias(idx), F.col(unit).alias(name))
    return (
        pairs.join(side("unit_a", "_i"), [*by, "_i"]).join(side("unit_b", "_j"), [*by, "_j"]).drop("_i", "_j")
    )


def pair_matches(pairs: DataFrame, haplotypes: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Allele match of each pair at the markers both haplotypes carry."""
    by = list(by)
    a = haplotypes.select(*by, F.col(unit).alias("unit_a"), F.col("hap").alias("hap_a"), "chrom", "pos", F.col("allele").alias("_a"))
    b = haplotypes.select(*by, F.col(unit).alias("unit_b"), F.col("hap").alias("hap_b"), "chrom", "pos", F.col("allele").alias("_b"))
    # ``n_pairs`` rows a group: only the homologs that some pair names are shuffled.
    b = b.join(F.broadcast(pairs.select(*by, "unit_b", "hap_b")), [*by, "unit_b", "hap_b"], "left_semi")
    return (
        spread_join(a, pairs, [*by, "unit_a", "hap_a"], few=True).join(b, [*by, "unit_b", "hap_b", "chrom", "pos"])
        .select(*by, "pair", "chrom", "pos", (F.col("_a") == F.col("_b")).alias("hom"))
    )


def bootstrap_weights(units: DataFrame, by: Sequence[str], unit: str, replicates: int, block: Column, draw: Draw) -> DataFrame:
    """How often each unit is drawn in each replicate: ``n_units`` draws per replicate."""
    by = list(by)
    indexed = index_units(units, by, unit, block)
    draws = indexed.select(*by, "n_units", F.col("idx").alias("d")).withColumn(
        "b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    )
    hit = F.pmod(draw(F.col("b"), F.col("d")), F.col("n_units"))
    weights = draws.groupBy(*by, "b", hit.alias("idx")).agg(F.count(F.lit(1)).alias("w"))
    return weights.join(indexed.select(*by, "idx", unit), [*by, "idx"]).drop("idx")


def weight_vectors(
    units: DataFrame, by: Sequence[str], unit: str, replicates: int, block: Column, draw: Draw, hits_per_block: int = 1 << 21,
) -> DataFrame:
    """``by, unit, w``: how often each unit is drawn, as one array with a place per replicate.

    The same draws as ``bootstrap_weights``, but a row holds all replicates of a draw and later of a unit, so the rows
    number the units and not units times replicates. Units are dealt in blocks by number; a draw sends each block its
    hits. Units that no replicate draws have no row.
    """
    by = list(by)
    indexed = index_units(units, by, unit, block)
    hit = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda b: F.pmod(draw(b, F.col("idx")), F.col("n_units")))
    wide = max(1, hits_per_block // replicates)
    rows = indexed.select(*by, "n_units", F.to_json(F.struct(*by)).alias("_g"), hit.alias("_t"))
    keys = [rows.schema[c] for c in by]

    def scatter(batches):
        for batch in batches:
            for part in _slices(batch):
                group = _codes(part, "_g")
                target = _column(part, "_t").flatten().to_numpy().astype(np.int64).reshape(-1, replicates)
                place = group[:, None] * (1 << 40) + target // wide
                hits = target % wide * replicates + np.arange(replicates)
                order = np.argsort(place, axis=None, kind="stable")
                place, hits = place.ravel()[order], hits.ravel()[order]
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                stops = np.append(first[1:], len(place))
                sample = part.take(pa.array(order[first] // replicates))
                out = [_column(sample, c) for c in by] + [
                    pa.array(place[first] % (1 << 40), pa.int64()), pa.array([hits[i:j].tobytes() for i, j in zip(first, stops)], pa.binary())
                ]
                yield pa.RecordBatch.from_arrays(out, [*by, "_ublock", "_hits"])

    def build(table: pa.Table) -> pa.Table:
        hits = np.frombuffer(b"".join(table["_hits"].to_pylist()), dtype=np.int64)
        unit_no, at = np.unique(hits // replicates, return_inverse=True)
        w = np.bincount(at * replicates + hits % replicates, minlength=len(unit_no) * replicates)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, replicates), pa.int32()), pa.array(w, pa.int32()))
        idx = unit_no + table["_ublock"][0].as_py() * wide
        return pa.table([*(_repeated(table[c], len(idx)) for c in by), pa.array(idx, pa.int64()), lists], [*by, "idx", "w"])

    sent = rows.mapInArrow(scatter, StructType([*keys, StructField("_ublock", LongType()), StructField("_hits", BinaryType())]))
    built = sent.groupBy(*by, "_ublock").applyInArrow(build, StructType([*keys, StructField("idx", LongType()), StructField("w", ArrayType(IntegerType()))]))
    return built.join(indexed.select(*by, "idx", unit), [*by, "idx"]).drop("idx")


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _slices(batch, rows: int = 2048):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _codes(batch, name) -> np.ndarray:
    return _column(batch, name).dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeated(column, n: int):
    return column.slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64)))


def weighted_cells(
    vectors: DataFrame, cells: DataFrame, by: Sequence[str], unit: str, replicates: int, on: Sequence[str] | None = None,
    within: Sequence[str] = (), s: Settings = DEFAULTS,
) -> DataFrame:
    """``by, within, k, cnt, sum_bp`` with one array of replicates each: the cells of all units, weighted and added.

    ``cells(on, unit, within, k, cnt, sum_bp)`` are additive partials, at most ``grid_points`` a unit and stratum; they
    meet a unit's weights in one row. Each task multiplies weights and cells as matrices and sends one row per
    group and cell; those are added element by element.
    """
    by, within, on = list(by), list(within), list(by if on is None else on)
    entry = F.struct(F.to_json(F.struct(F.lit(0).alias("_"), *within)).alias("_h"), *within, "k", "cnt", "sum_bp")
    rows = vectors.join(cells.groupBy(*on, unit).agg(F.collect_list(entry).alias("_c")), [*on, unit])
    rows = rows.select(*by, F.to_json(F.struct(*by)).alias("_g"), "w", "_c")
    inner = {f.name: f for f in rows.schema["_c"].dataType.elementType}
    keys = [*(rows.schema[c] for c in by), *(inner[c] for c in within)]
    arrays = [StructField("k", LongType()), StructField("cnt", ArrayType(LongType())), StructField("sum_bp", ArrayType(LongType()))]
    schema = StructType([*keys, *arrays])
    names = [f.name for f in schema]

    def listed(matrix: np.ndarray):
        flat = np.ascontiguousarray(matrix).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, replicates), pa.int32()), pa.array(flat, pa.int64()))

    def multiply(batches):
        total, sample = {}, {}
        for batch in batches:
            for part in _slices(batch):
                w = _column(part, "w").flatten().to_numpy().astype(np.float64).reshape(-1, replicates)
                lists, group = _column(part, "_c"), _column(part, "_g").to_pylist()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                field = {c: flat.field(c) for c in ("_h", *within, "k", "cnt", "sum_bp")}
                strata = field["_h"].dictionary_encode()
                code, stratum = strata.indices.to_numpy(), strata.dictionary.to_pylist()
                k, values = field["k"].to_numpy().astype(np.int64), [field[c].to_numpy() for c in ("cnt", "sum_bp")]
                own, which = np.unique(np.array(group, dtype=object).astype(str), return_inverse=True)
                for g, h in {(int(a), int(b)) for a, b in zip(which[row], code)}:
                    here = np.flatnonzero((which[row] == g) & (code == h))
                    key = (own[g], stratum[h])
                    if key not in total:
                        total[key] = np.zeros((2, s.grid_points, replicates), dtype=np.int64)
                        first = [pa.array(_column(part.slice(int(row[here[0]]), 1), c)) for c in by]
                        sample[key] = first + [field[c].slice(int(here[0]), 1) for c in within]
                    members = np.unique(row[here])
                    place = np.searchsorted(members, row[here])
                    for i, v in enumerate(values):
                        c = np.zeros((s.grid_points, len(members)))
                        np.add.at(c, (k[here], place), v[here].astype(np.float64))
                        exact = c.sum() * max(w[members].max(), 1.0) < 2**53
                        total[key][i] += (c @ w[members]).astype(np.int64) if exact else c.astype(np.int64) @ w[members].astype(np.int64)
        for key, (cnt, sums) in total.items():
            used = np.flatnonzero(cnt.any(axis=1) | sums.any(axis=1))
            if len(used):
                ids = [x.take(pa.array(np.zeros(len(used), dtype=np.int64))) for x in sample[key]]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(used, pa.int64()), listed(cnt[used]), listed(sums[used])], names)

    def add(table: pa.Table) -> pa.Table:
        sums = [table[c].combine_chunks().flatten().to_numpy().reshape(-1, replicates).sum(axis=0) for c in ("cnt", "sum_bp")]
        return pa.table([*(_repeated(table[c], 1) for c in names[:-2]), *map(listed, sums)], names)

    return rows.mapInArrow(multiply, schema).groupBy(*names[:-2]).applyInArrow(add, schema)


def vector_lstar(weighted: DataFrame, exposure: DataFrame, by: Sequence[str], on: Sequence[str], replicates: int, s: Settings = DEFAULTS) -> DataFrame:
    """``by, b, lstar_mb`` from weighted cells; ``exposure(on, exposure_bp)`` has an array of replicates.

    A group is at most ``grid_points`` rows. Replicates without any segment have no L*, as in ``decisive_length``.
    """
    by = list(by)
    rows = weighted.join(exposure, list(on)).select(*by, "k", "cnt", "sum_bp", "exposure_bp")
    lengths = s.grid_start_bp + s.grid_step_bp * np.arange(s.grid_points, dtype=np.int64)

    def solve(table: pa.Table) -> pa.Table:
        k = table["k"].to_numpy()
        full = np.zeros((2, s.grid_points, replicates), dtype=np.int64)
        for i, c in enumerate(("cnt", "sum_bp")):
            full[i, k] = table[c].combine_chunks().flatten().to_numpy().reshape(-1, replicates)
        cnt, sums = np.cumsum(full[:, ::-1], axis=1)[:, ::-1]
        over = table["exposure_bp"].slice(0, 1).combine_chunks().flatten().to_numpy().astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            low = ((sums - cnt * lengths[:, None]) / over <= s.threshold) & (over > 0)
        at = np.where(low.any(axis=0), lengths[low.argmax(axis=0)] / 1e6, np.inf)
        b = np.flatnonzero(cnt[0] > 0)
        return pa.table([*(_repeated(table[c], len(b)) for c in by), pa.array(b + 1, pa.int32()), pa.array(at[b], pa.float64())], [*by, "b", "lstar_mb"])

    schema = StructType([*(rows.schema[c] for c in by), StructField("b", IntegerType()), StructField("lstar_mb", DoubleType())])
    return rows.groupBy(*by).applyInArrow(solve, schema)


def bootstrap_lstar(
    segments: DataFrame, burden: DataFrame, by: Sequence[str], replicates: int, block: Column,
    draw: Draw, s: Settings = DEFAULTS, cells_by: Sequence[str] | None = None, within: Sequence[str] = (),
) -> DataFrame:
    """``by, within, b, lstar_mb``: L* of every replicate, in groups of samples (``by``) and strata of segments (``within``).

    Exceedance is additive over samples, so a replicate is a weighted sum of per-sample grid cells. All replicates
    travel as one array a sample: the segments are read once and no row is repeated per replicate. ``cells_by`` names
    the groups that ``segments`` knows where a sample stands in several of ``by``, as in a ladder of screens.
    """
    by, within = list(by), list(within)
    on = by if cells_by is None else list(cells_by)
    vectors = weight_vectors(burden.select(*by, "sample"), by, "sample", replicates, block, draw)
    cells = B.cell_partials(segments, [*on, "sample", *within], s)
    weighted = weighted_cells(vectors, cells, by, "sample", replicates, on, within, s)
    span = burden.select(*by, "sample", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("cnt"), F.col("span_bp").alias("sum_bp"))
    exposure = weighted_cells(vectors, span, by, "sample", replicates, s=s).select(*by, F.col("sum_bp").alias("exposure_bp"))
    return vector_lstar(weighted, exposure, [*by, *within], by, replicates, s)


def bootstrap_interval(replicates: DataFrame, by: Sequence[str], drop_unconverged: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """Percentile interval, median and SE over a group's replicates, as many as were asked for; replicates without a
    crossing count as one step past the grid, or are left out."""
    never = F.col("lstar_mb") == E.INF
    past = (s.grid_start_bp + s.grid_step_bp * s.grid_points) / 1e6
    value = F.when(~never, F.col("lstar_mb"))
    value = value if drop_unconverged else F.coalesce(value, F.lit(past))
    q = lambda p: F.percentile(value, F.lit(p))
    return replicates.groupBy(*by).agg(
        q(0.025).alias("ci_lo"), q(0.975).alias("ci_hi"), q(0.5).alias("median"),
        F.stddev_samp(value).alias("se"), F.count_if(never).alias("n_unconverged"),
    )


def random_markers(markers: DataFrame, targets: DataFrame, by: Sequence[str], draw: Draw, width: int = 2**52) -> DataFrame:
    """A random ``n_target`` markers per group; ``targets(by, n_target)``.

    ``width`` cuts the range of the draw into blocks that are ranked apart.
    """
    by = list(by)
    drawn = markers.withColumn("_d", draw(F.col("chrom"), F.col("pos")))
    ranked = rank_desc(drawn, by, "_d", F.floor(F.col("_d") / width), "pos", F.floor(F.col("pos") / DEFAULTS.scan_block_bp), "_r")
    return ranked.join(F.broadcast(targets), by).filter(F.col("_r") <= F.col("n_target")).drop("_r", "_d", "n_target")


def labelled_trials(
    tests: DataFrame, markers: DataFrame, n_trials: int, prior_per_mille: int, tract_bp: Callable[[Draw], Column], draw: Draw,
) -> DataFrame:
    """Trials per (pop, chrom): focal marker, two homologs of different units, label, tract.

    ``tests(pop, unit, idx, n_units)`` and ``markers(pop, chrom, pos, idx, n_units)``
    are densely indexed.
    """
    by = ["pop", "chrom"]
    t = F.col("t")
    d = lambda k: draw(t, F.lit(k))
    base = markers.groupBy(*by).agg(F.max("n_units").alias("_m")).join(
        tests.groupBy("pop").agg(F.max("n_units").alias("_n")), "pop"
    ).filter(F.col("_n") >= 2)
    trials = base.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trials - 1).cast("long"))))
    i = F.pmod(d(1), F.col("_n"))
    trials = trials.select(
        *by, "t", F.pmod(d(2), F.col("_m")).alias("_mi"), i.alias("_i"),
        F.pmod(i + 1 + F.pmod(d(3), F.col("_n") - 1), F.col("_n")).alias("_j"),
        F.pmod(d(4), F.lit(2)).alias("hap_a"), F.pmod(d(5), F.lit(2)).alias("hap_b"),
        (F.pmod(d(6), F.lit(10_000)) < prior_per_mille * 10).cast("int").alias("label"),
        F.floor(tract_bp(d) / 2).alias("half_bp"),
    )
    unit = lambda name, idx: tests.select("pop", F.col("idx").alias(idx), F.col("unit").alias(name))
    focal = markers.select(*by, F.col("idx").alias("_mi"), F.col("pos").alias("focal"))
    # ``n_trials`` rows for each population and chromosome, whatever the number of markers and units.
    placed = F.broadcast(F.broadcast(trials).join(focal, [*by, "_mi"])).join(unit("unit_a", "_i"), ["pop", "_i"])
    return F.broadcast(placed).join(unit("unit_b", "_j"), ["pop", "_j"]).drop("_mi", "_i", "_j").select(
        *by, "t", "hap_a", "hap_b", "label", "half_bp", "focal", "unit_a", "unit_b"
    )


def exponential_tract(mean_mb: float = 2.0, low_mb: float = 0.2, high_mb: float = 12.0, key: int = 9, draws: int = 2**62) -> Callable[[Draw], Column]:
    """Tract lengths of an exponential distribution held to ``[low_mb, high_mb]``, in base pairs.

    The inverse distribution function of one integer draw below ``draws``.
    """
    def tract(d: Draw) -> Column:
        u = (d(key) + 0.5) / float(draws)
        return F.least(F.lit(high_mb), F.greatest(F.lit(low_mb), -mean_mb * F.ln(1 - u))) * 1e6
    return tract


def crowded_trials(trials: DataFrame, markers: DataFrame, scan_bp: int, least: int = 5) -> DataFrame:
    """The trials with at least ``least`` markers within ``scan_bp`` of their focal one, itself included.

    Markers are numbered along a chromosome, so those within reach are neighbours by number: a trial asks the
    ``least - 1`` on each side by equality and counts the near ones.
    """
    key, by = ["pop", "chrom", "t"], ["pop", "chrom"]
    own = markers.select(*by, F.col("pos").alias("focal"), F.col("idx").alias("_at"))
    asked = F.broadcast(trials.select(*key, "focal")).join(own, [*by, "focal"])
    asked = asked.withColumn("idx", F.explode(F.sequence(F.col("_at") - (least - 1), F.col("_at") + (least - 1))))
    near = F.abs(F.col("pos") - F.col("focal")) <= scan_bp
    enough = F.broadcast(asked).join(markers.select(*by, "idx", "pos"), [*by, "idx"]).filter(near).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return trials.join(enough.select(*key), key, "left_semi")


def implanted_matches(
    trials: DataFrame, haplotypes: DataFrame, draw: Draw, reach: int | None = None,
    flip_per_mille: int = 1, s: Settings = DEFAULTS,
) -> DataFrame:
    """Match flags around each trial's focal marker after implanting and genotyping error.

    Without ``reach`` a trial meets all markers of its chromosome; with it, those that near,
    found on 1 Mb bins and never as a range join.
    """
    hap = haplotypes.withColumn("bin", F.floor(F.col("pos") / s.window_bp))
    side = lambda n: hap.select("pop", "chrom", "bin", "pos", F.col("unit").alias(f"unit_{n}"), F.col("hap").alias(f"hap_{n}"), F.col("allele").alias(f"_{n}"))
    if reach is None:
        near = spread_join(side("a").drop("bin"), trials, ["pop", "chrom", "unit_a", "hap_a"], s=s, few=True)
    else:
        bins = F.sequence(
            F.floor(F.greatest(F.col("focal") - reach, F.lit(0)) / s.window_bp), F.floor((F.col("focal") + reach) / s.window_bp),
        )
        near = trials.withColumn("bin", F.explode(bins)).join(side("a"), ["pop", "chrom", "bin", "unit_a", "hap_a"])
        near = near.filter(F.abs(F.col("pos") - F.col("focal")) <= reach)
    # Trials are few whatever the cohort: only the homologs that some trial names are shuffled.
    named = F.broadcast(trials.select("pop", "chrom", "unit_b", "hap_b"))
    other = side("b").drop("bin").join(named, ["pop", "chrom", "unit_b", "hap_b"], "left_semi")
    both = near.join(other, ["pop", "chrom", "pos", "unit_b", "hap_b"])
    implanted = (F.col("label") == 1) & (F.abs(F.col("pos") - F.col("focal")) <= F.col("half_bp"))
    flip = lambda k: (F.pmod(draw(F.col("t"), F.col("pos"), F.lit(k)), F.lit(1000)) < flip_per_mille).cast("int")
    a, b = F.col("_a"), F.when(implanted, F.col("_a")).otherwise(F.col("_b"))
    return both.select(
        "pop", "chrom", "t", "focal", "label", "pos",
        (a.bitwiseXOR(flip(7)) == b.bitwiseXOR(flip(8))).alias("hom"),
    )
