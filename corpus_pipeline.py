"""A training corpus from raw documents: clean, deduplicate twice, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zygospan.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from zygospan.llm.common import cut, training_rows


#: Words of a block in the mix. A source may miss its target by half a block and, as the short last block of a shard counts
#: as one in each pass, by three more for each shard.
MIX_BLOCK = 64


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted on the labelled ones among them, does not reject."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.train(docs, training_rows(labels, "toxic", 5, 0, toxicity.SAMPLE))
    return toxicity.keep_clean(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, one row per pass over a document; taken parts are blocks of running text."""
    return mixing.mixed_documents(docs, block=MIX_BLOCK)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("simhash_near_dedup", drop_near),
    ("source_mix", mix_sources), ("best_two_fit", pack_sequences),
]
#: No SQL: a learned grammar, iterated components, seeded draws and a tokenizer. Tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
