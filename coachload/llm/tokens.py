"""Token-ID output (7) in patched frame-of-reference files.

Documents are range-partitioned and sorted by id, so that each task writes one
file and the files in order hold the ids in document order.  A file is

    blocks     of BLOCK ids: minimum (u32), width (u8), exceptions (u16), the
               residuals' low bits at that width in 64-bit lanes, then the
               exceptions' places (u16) and residuals (u32)
    documents  doc ids (i64), null flags (u8), end of each in the file (u64)
    index      start of each block in the file (u64)
    trailer    counts and section starts (``TRAILER``)

A block's width is the bit length that PERCENTILE of its residuals (id minus
the block's minimum) need; larger ones are exceptions.  Any range of ids is
read through the block index without the rest of the file.

Files are written under a name of the attempt and then renamed, so a task that
runs again replaces its own file.  Memory is a few blocks and the per-document
index of one partition.

Defined cases: null and empty texts hold the end id only; null document ids
come first; rows that repeat an id follow each other, in the order of a hash of
the text, each with its own entry; an empty table gives no files and an empty
result; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import as_bytes, named, of_worker, slices

MAGIC = b"PFRAME01"
BLOCK = 1024
PERCENTILE = 90
HEAD = "<IBH"
TRAILER = "<QQQQQ8s"  # ids, documents, blocks, start of documents, start of index, magic
GROUP = 256  # blocks handled at a time

VOCABULARY_BYTES = 64 << 20
ENCODE_BYTES = 16 << 20
CACHED_WORDS = 1_400_000  # about 200 bytes each
# Trailing marks that are tokens of their own after a letter or digit.
TAIL_MARKS = b".,!?;:|"


# -- blocks ---------------------------------------------------------------------------------------

def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width -> (blocks, lanes) uint64."""
    v = values.reshape(len(values), BLOCK // 64, 64).astype(np.uint64)
    out = np.zeros((len(values), BLOCK // 64, width), np.uint64)
    for i in range(64 if width else 0):
        lane, shift = divmod(i * width, 64)
        out[:, :, lane] |= v[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, lane + 1] |= v[:, :, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def unpack(lanes: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``; uint32."""
    out = np.zeros((len(lanes), BLOCK // 64, 64), np.uint64)
    v = lanes.reshape(len(lanes), BLOCK // 64, width) if width else lanes
    for i in range(64 if width else 0):
        lane, shift = divmod(i * width, 64)
        out[:, :, i] = v[:, :, lane] >> np.uint64(shift)
        if shift + width > 64:
            out[:, :, i] |= v[:, :, lane + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(len(lanes), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Whole blocks of ids (uint32) -> the bytes of each block."""
    v = ids.reshape(-1, BLOCK)
    least = v.min(axis=1)
    rest = v - least[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bit lengths
    at = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    widths = np.partition(bits, at, axis=1)[:, at]
    out: list[bytes] = [b""] * len(v)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        own = rest[rows]
        lanes = pack(own & np.uint32((1 << width) - 1), width)
        over = own >= 1 << width if width < 32 else np.zeros(own.shape, bool)
        for i, row in enumerate(rows.tolist()):
            places = np.flatnonzero(over[i])
            out[row] = b"".join((struct.pack(HEAD, int(least[row]), width, len(places)), lanes[i].astype("<u8").tobytes(),
                                 places.astype("<u2").tobytes(), own[i][places].astype("<u4").tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``starts`` in ``data``."""
    heads = [struct.unpack_from(HEAD, data, s) for s in starts.tolist()]
    widths = np.array([h[1] for h in heads], np.int64)
    out = np.zeros((len(heads), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        lanes = BLOCK // 64 * width
        raw = np.stack([np.frombuffer(data, "<u8", lanes, int(starts[r]) + struct.calcsize(HEAD)) for r in rows])
        out[rows] = unpack(raw.astype(np.uint64), width)
    for row, (least, width, n) in enumerate(heads):
        if n:
            at = int(starts[row]) + struct.calcsize(HEAD) + 8 * (BLOCK // 64) * width
            out[row, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
        out[row] += np.uint32(least)
    return out.reshape(-1)


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, stream):
        self.stream, self.at, self.count = stream, 0, 0
        self.starts: list[int] = []
        self.ids: list[int] = []
        self.nulls: list[int] = []
        self.ends: list[int] = []
        self.open = np.zeros(0, np.uint32)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], ids, np.array([len(ids)]))

    def add_all(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids of several documents, one after the other."""
        self.ids += [i or 0 for i in doc_ids]
        self.nulls += [i is None for i in doc_ids]
        self.ends += (self.count + np.cumsum(counts)).tolist()
        self.count += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK * GROUP:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        whole = len(ids) // BLOCK * BLOCK
        rest = ids[whole:]
        ids = ids[:whole]
        if last and len(rest):
            ids = np.concatenate([ids, rest, np.full(BLOCK - len(rest), rest.min(), np.uint32)])
            rest = rest[:0]
        for at in range(0, len(ids), BLOCK * GROUP):
            for block in encode_blocks(ids[at:at + BLOCK * GROUP]):
                self.starts.append(self.at)
                self._put(block)
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        documents = self.at
        self._put(np.array(self.ids, "<i8").tobytes())
        self._put(np.array(self.nulls, "u1").tobytes())
        self._put(np.array(self.ends, "<u8").tobytes())
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(struct.pack(TRAILER, self.count, len(self.ids), len(self.starts), documents, index, MAGIC))


class Reader:
    """Reads ranges of ids of one file, given a random-access file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.count, n, blocks, documents, index, magic = struct.unpack(
            TRAILER, file.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.doc_ids = np.frombuffer(file.read_at(8 * n, documents), "<i8")
        self.nulls = np.frombuffer(file.read_at(n, documents + 8 * n), "u1")
        self.ends = np.frombuffer(file.read_at(8 * n, documents + 9 * n), "<u8").astype(np.int64)
        self.starts = np.append(np.frombuffer(file.read_at(8 * blocks, index), "<u8"), np.uint64(documents)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start (inclusive) to end (exclusive) of the file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        base = int(self.starts[first])
        data = self.file.read_at(int(self.starts[last]) - base, base)
        return decode_blocks(data, self.starts[first:last] - base)[start - first * BLOCK:end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc id, start, number of ids, crc32 of the ids as little-endian u32)."""
        begin, step = 0, BLOCK * GROUP
        held, held_at = np.zeros(0, np.uint32), 0
        for doc_id, null, end in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.ends.tolist()):
            crc, at = 0, begin
            while at < end:
                if at >= held_at + len(held):
                    held_at = at // BLOCK * BLOCK
                    held = self.ids(held_at, min(held_at + step, self.count))
                part = held[at - held_at:end - held_at]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                at += len(part)
            yield None if null else doc_id, begin, end - begin, crc
            begin = end


# -- encoding -------------------------------------------------------------------------------------

class Encoder:
    """Ids of whole texts as little-endian u32 bytes.

    ``by_word``: for a vocabulary that lower-cases, drops white space and
    splits letters, digits and marks from each other, a text's ids are those of
    its words one after the other.  Words are then encoded once and remembered
    up to a bound; texts that hold an added token's content go to the library
    whole.
    """

    def __init__(self, data: bytes, by_word: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(data.decode())
        self.by_word = by_word
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _whole(self, raw: bytes) -> bytes:
        return np.array(self.library.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[bytes]) -> None:
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for w in new:
            core = w.rstrip(TAIL_MARKS)
            if core and len(core) < len(w) and core[-1:].isalnum():
                parts[w] = core, w[len(core):]
        need = (new - parts.keys()) | set(chain.from_iterable(parts.values()))
        need = [w for w in need if w not in self.known]
        for at in range(0, len(need), 2000):
            self._encode_words(need[at:at + 2000])
        for w, (core, tail) in parts.items():
            self.known[w] = self.known[core] + self.known[tail]

    def _encode_words(self, words: list[bytes]) -> None:
        """One call for many words; the tokens' offsets tell them apart."""
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.library.encode(" ".join(texts), add_special_tokens=False)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        ids = np.array(found.ids, "<u4")
        at = np.array([a for a, _ in found.offsets], np.int64)
        cuts = np.searchsorted(at, starts).tolist()
        raw = ids.tobytes()
        for i, w in enumerate(words):
            self.known[w] = raw[4 * cuts[i]:4 * cuts[i + 1]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        ids, counts = self.encode_all(pa.array(texts, pa.binary()))
        ends = np.cumsum(counts)
        return [ids[e - n:e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), counts.tolist())]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (binary) one after the other, and how many each
        has.  Words are split and told apart in columns, so that only a
        batch's distinct words are looked up one by one."""
        low = pc.ascii_lower(texts.cast(pa.string(), safe=False)) if self.by_word else None
        if low is None or any(pc.any(pc.match_substring(low, a)).as_py() for a in self.added):
            own = [np.frombuffer(self._whole(t), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64)
        words = pc.ascii_split_whitespace(low)
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(self.known.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        if len(self.known) + len(missing) > CACHED_WORDS:
            self.known.clear()
            missing = range(len(distinct))
        self._learn({distinct[i] for i in missing})
        for i in missing:
            ids[i] = self.known[distinct[i]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                         pa.array(np.frombuffer(b"".join(ids), "<u4")))
        at = coded.indices
        through = np.concatenate([[0], np.cumsum(sizes[at.to_numpy()])])[np.concatenate([[0], ends])]
        return lists.take(at).flatten().to_numpy(), np.diff(through)


# -- Spark ----------------------------------------------------------------------------------------

def gathered(batches) -> Iterator[pa.Table]:
    """Batches put together up to about ENCODE_BYTES of text: the more text at
    a time, the fewer distinct words in it."""
    held, size = [], 0
    for b in batches:
        for part in slices(b, 1):
            held.append(part)
            size += part.nbytes
            if size >= ENCODE_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, by_word: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Writes the files; (name, number of ids) of each in document order, a
    row per written partition."""
    with open(vocabulary, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def with_end(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(counts), end_id, np.uint32)
        own = np.ones(len(out), bool)
        own[np.cumsum(counts + 1) - 1] = False
        out[own] = ids
        return out, counts + 1

    def run(batches):
        encoder = of_worker(("tokens", vocabulary, by_word), lambda: Encoder(shared.value, by_word))
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.pfr"
        writer = None
        for part in gathered(batches):
            if writer is None:
                fs.create_dir(root, recursive=True)
                trial = f"{root}/.{name}-{uuid.uuid4().hex}"
                stream = fs.open_output_stream(trial)
                writer = Writer(stream)
            writer.add_all(part.column("doc_id").to_pylist(), *with_end(*encoder.encode_all(part.column("text").combine_chunks())))
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(trial, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [writer.count]})

    rows = (named(docs, id_col, text_col).select("doc_id", as_bytes().alias("text"), F.xxhash64("text").alias("tie"))
            .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
            .select("doc_id", "text").mapInArrow(run, "name string, n long"))
    return sorted((r.name, r.n) for r in rows.collect())


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    bases = np.concatenate([[0], np.cumsum([n for _, n in files])]).tolist()

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for i in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{files[i][0]}") as file:
                    rows = list(Reader(file).documents())
                for at in range(0, len(rows), 20_000):
                    ids, starts, counts, crcs = zip(*rows[at:at + 20_000])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids, pa.int64()), "start": pa.array([bases[i] + s for s in starts], pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)
