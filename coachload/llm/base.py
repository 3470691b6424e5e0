"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coachload.session import scratch_path

# The white space between words, and the letters that are folded.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Words a task remembers at most; the cache starts anew beyond it, so a task's
# memory does not follow the vocabulary.
CACHE_WORDS = 200_000
# Text a task handles at a time, in bytes (or one document).
PART_BYTES = 4 << 20
# Bytes of one Arrow batch between Spark and Python, unless the session says
# otherwise; texts in Spark's default of 64 MB would fill off-heap memory.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


class WordHashes(dict):
    """Word (bytes) -> its 64-bit hash, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under known names; whatever else the table
    has, clashing names included, stays out."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, None) in (None, "67108864", "67108864b", "64MB"):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def as_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty: words are split on ASCII, so
    tasks need not decode."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    back: it survives lost executors, keeps column pruning, and is computed
    once however often it is read."""
    path = f"{scratch_path(df.sparkSession, name)}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def of_worker(key: tuple, make: Callable):
    """An object that the tasks of one Python worker share (a parsed model, a
    bounded cache), made on first use; only the last few keys stay."""
    home = sys.modules.setdefault("_coachload_worker", types.ModuleType("_coachload_worker"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        for old in list(kept)[:max(0, len(kept) - 1)]:
            del kept[old]
        kept[key] = make()
    return kept[key]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PART_BYTES in a binary column, or one row."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and size + n > PART_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
