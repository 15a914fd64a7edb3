"""Plan shape: shuffles, pruning and the absence of products."""

import re
import uuid

import pytest

from checks.views import Views
from zygospan.operators.background import exceedance_curve
from zygospan.operators.resample import hash_draw, subsample
from zygospan.operators.runs import call_runs
from zygospan.plans import background as PB
from zygospan.sources import sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    path = f"{sinks.shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    Views(spark, SF).calls.write.parquet(path)
    return spark.read.parquet(path)


def test_runs_use_two_shuffles(stored):
    text = plan(call_runs(stored, ["sample", "chrom"], gaps=(0, 1, 2)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "SinglePartition" not in text
    assert "pop" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_clustered_table_needs_no_first_shuffle(spark, stored):
    name = f"clustered_{uuid.uuid4().hex}"
    path = f"{sinks.shared_dir(spark)}/{name}"
    sinks.write_clustered(stored, name, ["sample", "chrom"], 4, 5_000_000, path)
    df = call_runs(spark.table(name), ["sample", "chrom"], block_col="blk")
    assert len(re.findall(r"Exchange hashpartitioning", plan(df))) == 1
    cols = ["sample", "chrom", "start_pos", "end_pos", "n_markers"]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(
        map(tuple, call_runs(stored, ["sample", "chrom"]).select(*cols).collect())
    )
    spark.sql(f"drop table {name}")


def test_curve_has_no_product(stored):
    null = PB.sample_null(stored)
    text = plan(exceedance_curve(null.segments, null.burden, ["pop"]))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_subsample_limits_before_the_shuffle(stored):
    text = plan(subsample(stored.select("pop", "sample"), ["pop"], "sample", 3, hash_draw(1)))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning")
    assert text.count("WindowGroupLimit") == 2
