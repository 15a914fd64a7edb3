import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from zygospan.operators.runs import call_runs
from zygospan.operators.sparse import index_axis, linked_axis, mismatch_rows, sparse_runs
from zygospan.sources import sinks


@pytest.mark.parametrize("block", [4, 25, 10_000])
def test_sparse_equals_dense(spark, block):
    rng = random.Random(11)
    axis_rows = [(c, p) for c in (1, 2) for p in sorted(rng.sample(range(500), 70))]
    rows = []
    for s in range(30):
        p_hom = rng.choice([0.0, 0.3, 0.6, 0.9, 1.0])
        rows += [(s, c, p, rng.random() < p_hom) for c, p in axis_rows]
    axis = index_axis(spark.createDataFrame(axis_rows, "chrom int, pos long"), ["chrom"])
    calls = spark.createDataFrame(rows, "sample int, chrom int, pos long, hom boolean")
    hets = calls.filter("not hom").join(axis, ["chrom", "pos"]).select("sample", "chrom", "idx")
    members = calls.select("sample", "chrom").distinct()
    for gaps in ((0, 1, 2), (1,), (3,)):
        dense = call_runs(calls, ["sample", "chrom"], gaps=gaps, max_gap=14)
        sparse = sparse_runs(hets, members, axis, ["sample"], ["chrom"], gaps, max_gap=14, block=block)
        cols = ["sample", "chrom", "gap", "start_pos", "end_pos", "n_markers", "len_bp"]
        want = sorted(map(tuple, dense.select(*cols).collect()))
        assert sorted(map(tuple, sparse.select(*cols).collect())) == want
        linked = linked_axis(axis, ["chrom"])
        rows = mismatch_rows(calls, linked, ["sample"], ["chrom"], block=block)
        carried = sparse_runs(rows, members, linked, ["sample"], ["chrom"], gaps, max_gap=14, block=block)
        assert sorted(map(tuple, carried.select(*cols).collect())) == want


def test_stored_mismatches_are_scanned_in_place(spark):
    rng = random.Random(5)
    axis = index_axis(spark.createDataFrame([(1, p) for p in range(0, 900, 3)], "chrom int, pos long"), ["chrom"])
    calls = spark.createDataFrame([(s, 1, p, rng.random() < 0.8) for s in range(20) for p in range(0, 900, 3)], "sample int, chrom int, pos long, hom boolean")
    linked, members = linked_axis(axis, ["chrom"]), calls.select("sample", "chrom").distinct()
    rows = mismatch_rows(calls, linked, ["sample"], ["chrom"], block=50)
    name = f"mismatches_{uuid.uuid4().hex}"
    sinks.write_mismatches(rows, name, ["sample", "chrom"], 4, f"{sinks.shared_dir(spark)}/{name}")
    there = f"{sinks.shared_dir(spark)}/{name}-axis"
    linked.write.parquet(f"{there}/axis")
    members.write.parquet(f"{there}/members")
    linked, members = spark.read.parquet(f"{there}/axis"), spark.read.parquet(f"{there}/members")
    run = lambda hets: sparse_runs(hets, members, linked, ["sample"], ["chrom"], (0, 1), block=50)
    text = run(spark.table(name))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", text)) == 2 and text.count("Join") == 1
    dense = call_runs(calls, ["sample", "chrom"], gaps=(0, 1))
    cols = ["sample", "chrom", "gap", "start_pos", "end_pos", "n_markers", "len_bp"]
    assert sorted(map(tuple, run(spark.table(name)).select(*cols).collect())) == sorted(map(tuple, dense.select(*cols).collect()))
    spark.sql(f"drop table {name}")


def test_mismatches_and_limits_meet_in_one_shuffle(spark):
    """One shuffle for the scan and one to join blocks, whatever the gap tolerances; the rows are not repeated for each."""
    hets = spark.createDataFrame([(1, 1, 4, 9, 15), (1, 1, 5, 12, 18)], "sample int, chrom int, idx long, before long, after long")
    axis = spark.createDataFrame([(1, i, 3 * i, 3 * i - 3 if i else None, 3 * i + 3 if i < 8 else None) for i in range(9)], "chrom int, idx long, pos long, before long, after long")
    members = F.broadcast(spark.createDataFrame([(1, 1)], "sample int, chrom int"))
    runs = sparse_runs(hets, members, axis, ["sample"], ["chrom"], (0, 1, 2))
    assert len(re.findall("Exchange hashpartitioning", runs._jdf.queryExecution().executedPlan().toString())) == 2
    got = sorted((r.gap, r.start_pos, r.end_pos, r.n_markers) for r in runs.collect())
    assert got == [(0, 0, 9, 4), (0, 18, 24, 3), (1, 0, 9, 4), (1, 18, 24, 3), (2, 0, 24, 9)]


def test_runs_inside_a_block_are_not_shuffled_and_no_run_looks_up_its_ends(spark):
    rng = random.Random(3)
    marks = [(c, p) for c in (1, 2) for p in sorted(rng.sample(range(500), 90))]
    calls = spark.createDataFrame([(s, c, p, rng.random() < 0.7) for s in range(12) for c, p in marks], "sample int, chrom int, pos long, hom boolean")
    axis = index_axis(spark.createDataFrame([(c, p, p % 5) for c, p in marks], "chrom int, pos long, more int"), ["chrom"])
    linked = linked_axis(axis, ["chrom"], block=7)
    assert len(re.findall("Exchange hashpartitioning", linked._jdf.queryExecution().executedPlan().toString())) - len(
        re.findall("Exchange hashpartitioning", axis._jdf.queryExecution().executedPlan().toString())) == 1
    got = {(r.chrom, r.pos): (r.before, r.after, r.more) for r in linked.collect()}
    near = {c: [None, *[p for k, p in marks if k == c], None] for c in (1, 2)}
    assert got == {(c, p): (near[c][i - 1], near[c][i + 1], p % 5) for c in (1, 2) for i, p in enumerate(near[c]) if p is not None}
    members = calls.select("sample", "chrom").distinct()
    hets = calls.filter("not hom").join(axis, ["chrom", "pos"]).select("sample", "chrom", "idx")
    placed = calls.join(linked.drop("more"), ["chrom", "pos"])
    cols = ["sample", "chrom", "gap", "start_pos", "end_pos", "n_markers", "len_bp"]
    want = sorted(map(tuple, call_runs(calls, ["sample", "chrom"], gaps=(0, 1, 2), max_gap=14).select(*cols).collect()))
    for rows, on in ((hets, axis), (mismatch_rows(placed, linked, ["sample"], ["chrom"], block=9), linked)):
        runs = sparse_runs(rows, members, on, ["sample"], ["chrom"], (0, 1, 2), max_gap=14, block=9, apart=True)
        assert sorted(map(tuple, runs.select(*cols).collect())) == want
        assert "start_idx" not in re.findall(r"Join \[[^\]]*\]", runs._jdf.queryExecution().executedPlan().toString()).__str__()
