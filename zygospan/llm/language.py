"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zygospan.llm.common import column, small_batches

SAMPLE_DOCS = 200
STRETCH = 600
PIECE = 4096
UNKNOWN = "und"


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, stretch: int = STRETCH) -> dict[str, bytes]:
    """A dictionary per non-null ``lang`` from a bounded sample of its rows, lower-cased, lowest text hash first.

    The sample is bounded by ``sample_docs`` distinct texts a language and ``stretch`` characters of each (at a place
    drawn by the hash, so one long text does not fill a dictionary). Every language is learned; their dictionaries
    together, 0.1 MB each, must fit a worker. Null and empty texts teach nothing, equal texts teach once.
    """
    rows = docs.select("text", F.col("lang").cast("string")).filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    h = F.xxhash64("text")
    least = Window.partitionBy("lang").orderBy("h")
    picks = rows.select("lang", h.alias("h")).distinct().withColumn("n", F.row_number().over(least)).filter(F.col("n") <= sample_docs).drop("n")
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - stretch, F.lit(0)) + 1).cast("int") + 1
    texts = rows.withColumn("h", h).join(F.broadcast(picks), ["lang", "h"]).select("lang", "h", F.lower(F.substring("text", start, F.lit(stretch))).alias("t")).distinct()
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in texts.collect():
        parts.setdefault(r.lang, []).append((r.h, r.t))
    return {k: "\n".join(t for _, t in sorted(v)).encode() for k, v in sorted(parts.items())}


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def sizes(data: bytes, compressors: list[zstandard.ZstdCompressor], piece: int = PIECE) -> np.ndarray:
    """Compressed bytes of the whole text per dictionary, a piece at a time so that no text outgrows its dictionary."""
    parts = [data[i : i + piece] for i in range(0, len(data), piece)]
    return np.array([sum(len(c.compress(p)) for p in parts) for c in compressors], dtype=np.int64)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Looks for matches from four bytes on, as syllables are what tells languages apart in short texts."""
    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=4, window_log=18, chain_log=16, hash_log=16,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = 0.0, piece: int = PIECE) -> DataFrame:
    """``doc_id, lang_pred, score, margin`` per row of ``docs``.

    The smallest encoding names the language; ``margin`` is the second smallest's excess over it, as a share of the
    smallest, and a row whose margin is below the given one is rejected as ``und``. ``score`` is 1 for certain and
    near 0 for a tie among many; ties go to the name that sorts first. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text without a model. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = list(shared.value)
        pack = [compressor(shared.value[n]) for n in names]
        for batch in small_batches(batches):
            out = []
            for text in column(batch, "text"):
                if not names or not has_letter(text):
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                data = text.lower().encode()
                n = sizes(data, pack, piece)
                best = int(np.argmin(n))
                rest = np.delete(n, best)
                gap = float(rest.min() - n[best]) / n[best] if len(rest) else 1.0
                odds = np.exp(-(n - n[best]) * 0.7)
                out.append((names[best] if gap >= margin else UNKNOWN, float(1 / odds.sum()), gap))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64())],
                ["doc_id", "lang_pred", "score", "margin"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")
