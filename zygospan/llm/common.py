"""Helpers shared by the operators: shared-folder tables, column picks, row identity."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there, so that later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    The driver's JVM sees that a plan is gone at the second collection only.
    """
    for wait in (0.3, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: str | Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``rest``; false for a null id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def training_rows(labels: DataFrame, label: str, mod: int, rest: int, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids that are not held out, by lowest hash.

    A doc_id labelled more than once counts once, with its highest label; null ids and labels are left out.
    """
    one = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id", mod, rest))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows holding about ``most`` bytes of text, so that a task's memory does not follow the batch size."""
    for batch in batches:
        column_ = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column_), 0).to_pylist() if batch.nbytes > most else []
        start = held = 0
        for i, n in enumerate(sizes):
            held += n
            if held >= most:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


class Words(dict):
    """Words with what was learned of them. An unknown word is asked of the previous generation, so that a full cache
    forgets only what a generation did not see."""

    def __init__(self, old: dict | None = None):
        super().__init__()
        self.old = {} if old is None else old

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is not None:
            self[word] = found
        return found

    def next(self) -> Words:
        """An empty generation after this one."""
        self.old = {}
        return Words(self)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, or the first longer one that no column bears, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
