"""Benchmark decontamination (10), with DataFrame functions only.

The benchmark's normalised n-grams form a hash set that is broadcast (its size
is checked first).  One scan of the documents generates each token window,
probes the set with the window's 64-bit hash inside the same generated code,
verifies a hit on the words themselves, and lets only hits and one row per
document out.  A single shuffle of those rows gathers a document's hits; they
are never more than its words.

Defined cases: a null or empty text has no words and is clean; a null item text
has no windows; an item of fewer than ``n`` words is one window of its own
length; rows that repeat (same id, same text or not) are judged row by row in
``decontaminate`` and go together, by id, in ``drop_contaminated``; a null id
is an id like any other; an empty table on either side gives no hits; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import LOWER, UPPER, named

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# The broadcast hash set holds at most so many bytes of window text; a larger
# benchmark is joined by a shuffle on the window text instead.
BROADCAST_BYTES = 32 << 20


def word_array(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def _hash(start: Column, length: Column) -> Column:
    return F.xxhash64(F.slice("words", start + 1, length))


def _text(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct windows: len, hash, its words as text, and the items with it."""
    w = (benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
         .select("item", word_array("text").alias("words")).filter(F.size("words") > 0)
         .withColumn("len", F.least(F.size("words"), F.lit(n)))
         .select("item", "words", "len",
                 F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("start")))
    return (w.select("item", "len", _hash(F.col("start"), F.col("len")).alias("b_hash"),
                     _text(F.col("start"), F.col("len")).alias("b_text"))
            .groupBy("len", "b_hash", "b_text")
            .agg(F.collect_set("item").alias("items"))
            .withColumnRenamed("len", "b_len"))


def window_hits(docs: DataFrame, windows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row (``code`` 0) and one per window of it that is
    in the set: rid, doc_id, code, n_words, start, len, items."""
    size = windows.agg(F.sum(F.octet_length("b_text") + 8 * F.size("items") + 48)).first()[0] or 0
    lengths = sorted(r[0] for r in windows.select("b_len").distinct().collect())  # n of them at most
    d = (docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", word_array("text").alias("words"))
         .withColumn("n_words", F.size("words")))
    # windows are numbered from 1, those of the shortest length first
    count = {k: F.greatest(F.col("n_words") - k + 1, F.lit(0)) for k in lengths}
    total = sum(count.values(), F.lit(0))
    d = d.select("rid", "doc_id", "n_words", "words", F.explode(F.sequence(F.lit(0), total)).alias("code"))
    start, length = F.lit(None).cast("int"), F.lit(None).cast("int")
    if len(lengths) == 1:
        start, length = F.col("code") - 1, F.lit(lengths[0])
    elif lengths:
        before, cases = F.lit(0), []
        for k in lengths:
            cases.append((F.col("code") <= before + count[k], F.col("code") - 1 - before, k))
            before = before + count[k]
        start, length = cases[-1][1], F.lit(cases[-1][2])
        for within, at, k in reversed(cases[:-1]):
            start, length = F.when(within, at).otherwise(start), F.when(within, k).otherwise(length)
    d = d.withColumn("start", F.when(F.col("code") > 0, start)).withColumn("len", F.when(F.col("code") > 0, length))
    if size <= broadcast_bytes:
        d = d.withColumn("hash", F.when(F.col("code") > 0, _hash(F.col("start"), F.col("len"))))
        text = _text(F.col("start"), F.col("len"))
        # equal texts, written so that the text is only built after a hash hit
        same = text.startswith(F.col("b_text")) & F.col("b_text").startswith(text)
        joined = d.join(F.broadcast(windows), (F.col("hash") == F.col("b_hash")) & same, "left")
    else:
        d = d.withColumn("text", F.when(F.col("code") > 0, _text(F.col("start"), F.col("len")))).drop("words")
        joined = d.join(windows, (F.col("text") == F.col("b_text")) & (F.col("len") == F.col("b_len")), "left")
    return (joined.filter((F.col("code") == 0) | F.col("b_hash").isNotNull())
            .select("rid", "doc_id", "code", "n_words", "start", "len", "items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence
    of a window), spans (merged hit word ranges, end exclusive), items
    (distinct ids), contaminated."""
    hits = window_hits(named(docs, id_col, text_col), benchmark_windows(benchmark, n), broadcast_bytes)
    at = F.when(F.col("code") > 0, F.struct("start", (F.col("start") + F.col("len")).alias("end")))
    g = hits.groupBy("rid", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(at)).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return (F.when(F.size(done) == 0, F.array(x))
                .when(x["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider)))
                .otherwise(F.concat(done, F.array(x))))

    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    g = g.withColumn("spans", F.aggregate("at", empty, merge))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n_, s: n_ + s["end"] - s["start"])
    return g.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items",
                    (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id has no contaminated row."""
    bad = (decontaminate(docs, benchmark, n, id_col, text_col)
           .filter("contaminated").select(F.col("doc_id").alias("__bad_id")).distinct())
    return docs.join(bad, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__bad_id")), "left_anti")
