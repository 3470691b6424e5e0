"""Token counts (12) from a digest cache.

The cache is a Parquet folder of (digest, n_tokens), one subfolder a version
of the tokenizer (a digest of the library, its release, the vocabulary file
and the options) and below it one an appended batch.  A text's digest is the
SHA-256 of its normalised content: the exact UTF-8 bytes, null as empty, since
the vocabularies read here change a text by any further normalisation.

    digests    (doc_id, digest, n_bytes) of every row, stored: no texts move
    lookup     the distinct digests joined to the version's stored counts
    misses     the texts of distinct unknown digests, each once, by one
               exchange that is reduced before it
    append     their counts, written as one batch of the cache
    answer     the stored digests joined to the known and the new counts

Known texts are told from unknown ones by the smaller of the two sets of
digests, so a cold or a warm cache needs no exchange of texts but the misses'.
A batch is visible once its job has committed; one that fails leaves nothing.
Two jobs that append the same digest at once leave two equal entries, which
the lookup merges.

Long texts are encoded in pieces where the vocabulary allows it (byte-level
pairs without a prefix space): a cut before a space that follows a letter or
digit is never inside a token.

Defined cases: null and empty texts hold no token; null and repeated ids give
a row for each input row; repeated texts are encoded once; an empty table gives
an empty result and an empty batch; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from importlib.metadata import version as release

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import named, of_worker, stored

VOCABULARY_BYTES = 64 << 20
# Text handed to the library at a time, and the longest piece of a text.
ENCODE_BYTES = 1 << 20
PIECE_CHARS = 1 << 16
ENTRY = "digest binary, n_tokens long"


def library_of(path: str) -> str:
    if path.endswith(".json"):
        return "tokenizers"
    if path.endswith(".model"):
        return "sentencepiece"
    raise ValueError(f"no library for {path}")


def tokenizer_version(path: str) -> str:
    """A digest of all that decides a count but the text."""
    library = library_of(path)
    with open(path, "rb") as f:
        own = hashlib.sha256(f.read()).hexdigest()
    facts = {"file": own, "library": library, "release": release(library), "added_special_tokens": False, "content": "utf-8"}
    return hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()


def can_cut(model: dict) -> bool:
    """Whether a cut before a space leaves every token as it is."""
    pre = model.get("pre_tokenizer") or {}
    return (model.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in model.get("added_tokens", [])))


def pieces_of(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of at most ``most`` characters where a space after a
    letter or digit allows a cut; a longer run without one stays whole."""
    out, start = [], 0
    while len(text) - start > most:
        cut = start + most
        while cut > start:
            cut = text.rfind(" ", start + 1, cut)
            if cut < 0 or (text[cut - 1].isascii() and text[cut - 1].isalnum()):
                break
        if cut <= start:                      # none before the bound: the first one after it
            cut = text.find(" ", start + most)
            while cut > 0 and not (text[cut - 1].isascii() and text[cut - 1].isalnum()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


def counter(library: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, by the library."""
    if library == "sentencepiece":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    model = Tokenizer.from_str(data.decode())
    model.no_truncation()
    model.no_padding()
    cut = can_cut(json.loads(data))

    def count(texts: list[str]) -> list[int]:
        parts = [pieces_of(t) if cut else [t] for t in texts]
        sizes = iter([len(e) for e in model.encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False)])
        return [sum(next(sizes) for _ in ps) for ps in parts]
    return count


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The version's entries; none if nothing was ever stored for it."""
    try:
        entries = spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)
    return entries.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, cached) for every row; ``cached`` tells
    counts that the cache held before."""
    spark = docs.sparkSession
    if os.path.getsize(tokenizer) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than VOCABULARY_BYTES")
    version = tokenizer_version(tokenizer)
    content = F.coalesce("text", F.lit("")).cast("binary")
    texts = named(docs, id_col, text_col).select("doc_id", content.alias("content"), F.unhex(F.sha2(content, 256)).alias("digest"))
    seen = stored(texts.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes")), "digests")
    asked = stored(seen.select("digest").distinct().join(read_cache(spark, cache, version), "digest", "left"), "asked")
    hits, misses = asked.where(F.col("n_tokens").isNotNull()), asked.where(F.col("n_tokens").isNull()).select("digest")
    n = asked.agg(F.count("n_tokens").alias("hits"), F.count(F.lit(1)).alias("all")).first()
    batch = f"{cache}/version={version}/batch={uuid.uuid4().hex}"
    if n["hits"] < n["all"]:
        unknown = texts.select("digest", "content")
        if n["hits"]:
            side, how = (hits.select("digest"), "left_anti") if 2 * n["hits"] < n["all"] else (misses, "left_semi")
            unknown = unknown.join(side, "digest", how)
        _encoded(unknown.groupBy("digest").agg(F.first("content").alias("content")), tokenizer).write.parquet(batch)
        new = spark.read.schema(ENTRY).parquet(batch)
    else:
        new = spark.createDataFrame([], ENTRY)
    counts = hits.withColumn("cached", F.lit(True)).unionByName(new.withColumn("cached", F.lit(False)))
    return seen.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", "cached")


def _encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of (digest, content)."""
    library = library_of(tokenizer)
    with open(tokenizer, "rb") as f:
        shared = texts.sparkSession.sparkContext.broadcast(f.read())
    key = ("token_count", tokenizer_version(tokenizer))

    def run(batches):
        count = of_worker(key, lambda: counter(library, shared.value))
        for batch in batches:
            content, start, size, out = batch.column(1).cast(pa.string()), 0, 0, []
            for i, n in enumerate([*pc.binary_length(batch.column(1)).to_pylist(), None]):
                if n is None or (i > start and size + n > ENCODE_BYTES):
                    out += count(content.slice(start, i - start).to_pylist())
                    start, size = i, 0
                size += n or 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, ENTRY)
