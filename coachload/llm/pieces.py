"""SentencePiece encoding and decoding (1) with N-best segmentation.

A text with its dummy prefix is a lattice of the model's pieces.  Forward
Viterbi gives each position its best score from the left; these scores are the
exact heuristic of an A-star search from the right, which pops the N best
segmentations in order.  Every agenda entry stands for at least one complete
path of exactly its priority, so entries beyond the best N still wanted can
never be popped and are dropped: the agenda stays at N entries, with nothing
lost.

No piece joins another character to a following space, so the lattice is a
chain of independent chunks (a run of spaces and the word after it).  Chunks
are solved in sorted order, so that they share their common beginnings, and
remembered up to a bound.  The document's N best
paths are found by the same search over the chain of the chunks' own N best;
only the N - 1 chunks with the smallest loss can deviate in any of them.

The model file is read on the driver and broadcast (0.5 MB; its size is
checked).  Scores add up as a unigram model's; a character without a piece
becomes its byte pieces.  A space is told from a literal U+2581, which goes
through byte pieces, so decoding always restores the text.

Defined cases: null and empty texts have no ids, one path and score 0, and
decode to the empty text; equal scores are ranked by the longer last piece
first, down the path; repeated rows are each encoded; an empty table gives an
empty result; other columns are kept apart by position.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import as_bytes, bound_batches, of_worker, slices

# Fixed values of the model file's format.
SPACE_MARK = "▁"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN_PENALTY = 10.0

MODEL_BYTES = 16 << 20
CACHED_CHUNKS = 690_000  # about 300 bytes each; a dict grows its table at 699,050
CACHED_SEGMENTATIONS = 100_000
CHUNKS = re.compile(r" +[^ ]*")


def as_u4(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        wire = tag & 7
        if wire == 0:
            value, i = _varint(data, i)
        else:
            n, i = (8, i) if wire == 1 else (4, i) if wire == 5 else _varint(data, i)
            value, i = data[i:i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Pieces of a SentencePiece model file: ``table`` maps a piece's text
    (spaces as spaces) to (id, score); ``raw`` holds each id's bytes."""

    def __init__(self, data: bytes):
        self.table: dict[str, tuple[int, float]] = {}
        self.raw: list[bytes] = []
        self.bytes: list[int] = [0] * 256
        self.dummy_prefix = True
        lowest = 0.0
        for field, value in _fields(data):
            if field == 3:
                self.dummy_prefix = bool(dict(_fields(value)).get(3, 1))
            if field != 1:
                continue
            own = dict(_fields(value))
            text, kind = own[1].decode(), own.get(3, NORMAL)
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            if kind == BYTE:
                byte = int(text[3:5], 16)
                self.bytes[byte] = len(self.raw)
                self.raw.append(bytes([byte]))
                continue
            spaced = text.replace(SPACE_MARK, " ")
            self.raw.append(spaced.encode() if kind in (NORMAL, USER_DEFINED) else b"")
            if kind in (NORMAL, USER_DEFINED):
                self.table[spaced] = (len(self.raw) - 1, score)
                lowest = min(lowest, score)
        self.unknown = lowest - UNKNOWN_PENALTY
        # every end of a piece is a key, so a scan to the left knows where to stop
        for piece in list(self.table):
            for start in range(1, len(piece)):
                self.table.setdefault(piece[start:], None)
        if any(re.search("[^ ] ", p) for p in self.table):
            raise ValueError("pieces reach over the end of a word; chunks would not be independent")

    def _unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode("utf-8", "replace"))

    def arcs(self, text: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """Arcs into a position, longest piece first: start, score, ids."""
        out, start = [], end - 1
        while start >= 0 and (hit := self.table.get(text[start:end], 0)) != 0:
            if hit is not None:
                out.append((start, hit[1], (hit[0],)))
            start -= 1
        if not out or out[0][0] != end - 1:
            out.insert(0, (end - 1, self.unknown, self._unknown(text[end - 1])))
        return out[::-1]

    def best(self, texts: list[str], before: str = "") -> Iterator[tuple[bytes, float, float]]:
        """Forward Viterbi of ``before`` + each text: ids (as bytes) and score of the best
        path, and how much the second best loses against it.  Of sorted texts
        each takes over its common beginning with the one before it."""
        get, done = self.table.get, ""
        first, second, back = [0.0], [-math.inf], [None]
        for text in texts:
            text = before + text
            n, end = len(text), 0
            for end, (a, b) in enumerate(zip(done, text)):
                if a != b:
                    break
            else:
                end = min(len(done), n)
            del first[end + 1:], second[end + 1:], back[end + 1:]
            for end in range(end + 1, n + 1):
                start, one, two, own = end - 1, -math.inf, -math.inf, None
                while start >= 0 and (hit := get(text[start:end], 0)) != 0:
                    if hit is not None:
                        score = first[start] + hit[1]
                        if score >= one:
                            other = second[start] + hit[1]
                            two = one if one > other else other
                            one, own = score, (start, hit[0])
                        elif score > two:
                            two = score
                    elif start == end - 1:
                        one, two = first[start] + self.unknown, second[start] + self.unknown
                        own = (start, self._unknown(text[start]))
                    start -= 1
                if own is None:
                    one, two = first[end - 1] + self.unknown, second[end - 1] + self.unknown
                    own = (end - 1, self._unknown(text[end - 1]))
                first.append(one)
                second.append(two)
                back.append(own)
            ids, at = [], n
            while at:
                at, piece = back[at]
                if type(piece) is int:
                    ids.append(piece)
                else:
                    ids.extend(reversed(piece))
            ids.reverse()
            done = text
            yield as_u4(ids), first[n], first[n] - second[n]

    def segmentations(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids as bytes) of one chunk."""
        into: list[list] = [[]]
        best = [0.0]
        for end in range(1, len(text) + 1):
            into.append(self.arcs(text, end))
            best.append(max(best[start] + score for start, score, _ in into[end]))
        return [(score, as_u4(tuple(chain.from_iterable(path)))) for score, path in search(best, into.__getitem__, n)]

    def decode(self, ids) -> bytes:
        out = b"".join(map(self.raw.__getitem__, ids))
        return out[1:] if self.dummy_prefix else out


def search(best: list[float], arcs, n: int) -> list[tuple[float, list]]:
    """The n best paths from node 0 to the last: (score, payloads in order).
    ``best``: each node's best score from node 0; ``arcs(node)``: arcs into it,
    those that win a tie first."""
    out, pushed = [], 0
    agenda = [(-best[-1], 0, len(best) - 1, 0.0, None)]
    while agenda and len(out) < n:
        _, _, node, suffix, link = heapq.heappop(agenda)
        if node == 0:
            path = []
            while link is not None:
                path.append(link[0])
                link = link[1]
            out.append((suffix, path))
            continue
        for start, score, payload in reversed(arcs(node)):  # of equal entries the last pushed goes first
            pushed -= 1
            after = suffix + score
            heapq.heappush(agenda, (-(best[start] + after), pushed, start, after, (payload, link)))
        if len(agenda) > 4 * n + 16:
            agenda = heapq.nsmallest(n - len(out), agenda)  # sorted, so a heap
    return out


class Chunks(dict):
    """Chunk (without its first space) -> (ids as little-endian u32 bytes,
    score, loss of the second best) of its best path."""

    def __init__(self, model: PieceModel, n: int):
        super().__init__()
        self.model, self.n = model, n
        self.known: dict[str, list] = {}       # chunk -> its n best segmentations
        self.prefix = " " if model.dummy_prefix else ""

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        keys = text.split(" ")
        return [c[1:] for c in CHUNKS.findall(" " + text)] if "" in keys else keys

    def encode_all(self, texts: list[str]):
        """Per text: ids of the best path; the n best paths as (score, ids of
        the chunks that deviate); the chunks.  Chunks that aren't known yet
        are solved together, in sorted order."""
        parts, new = [], set()
        for text in texts:
            own = self.split(text)
            found = list(map(self.get, own))
            missing = [] if all(found) else [i for i, x in enumerate(found) if x is None]
            new.update(own[i] for i in missing)
            parts.append((own, found, missing))
        if len(self) + len(new) > CACHED_CHUNKS:
            self.clear()
        ordered = sorted(new)
        self.update(zip(ordered, self.model.best(ordered, self.prefix)))
        for own, found, missing in parts:
            for i in missing:
                found[i] = self[own[i]]
        return [self._encoded(own, found) for own, found, _ in parts]

    def _segmentations(self, key: str) -> list:
        """Remembered, since the chunks with the least loss are common words."""
        own = self.known.get(key)
        if own is None:
            if len(self.known) >= CACHED_SEGMENTATIONS:
                self.known.clear()
            own = self.known[key] = self.model.segmentations(self.prefix + key, self.n)
        return own

    def same_bytes(self, paths: list, found: list) -> bool:
        """Whether the chunks that deviate from the best path decode as it does."""
        raw = self.model.raw
        return all(b"".join(map(raw.__getitem__, np.frombuffer(own, "<u4").tolist()))
                   == b"".join(map(raw.__getitem__, np.frombuffer(found[i][0], "<u4").tolist()))
                   for _, other in paths for i, own in other.items())

    def _encoded(self, keys: list[str], found: list) -> tuple[bytes, list[tuple[float, dict[int, bytes]]], list]:
        if not keys:
            return b"", [(0.0, {})], []
        ids = b"".join(map(itemgetter(0), found))
        total = math.fsum(map(itemgetter(1), found))
        loss = np.fromiter(map(itemgetter(2), found), np.float64, len(found))
        few = np.arange(len(loss))
        if 0 < self.n - 1 < len(loss):
            few = np.flatnonzero(loss <= np.partition(loss, self.n - 2)[self.n - 2])
        few = few[np.argsort(loss[few], kind="stable")[:self.n - 1]].tolist()
        open_ = sorted(i for i in few if loss[i] < math.inf)
        arcs: list[list] = [[]]
        for node, i in enumerate(open_):
            others = self._segmentations(keys[i])
            arcs.append([(node, score - others[0][0], (i, own) if j else None) for j, (score, own) in enumerate(others)])
        paths = search([0.0] * len(arcs), arcs.__getitem__, self.n)
        return ids, [(total + less, dict(x for x in path if x)) for less, path in paths], found


def load_model(spark: SparkSession, path: str):
    """The model file, read on the driver and broadcast."""
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    PieceModel(data)
    return spark.sparkContext.broadcast(data)


def path_bytes(ids: bytes, paths: list, found: list) -> Iterator[bytes]:
    """The ids of each path: the best path's, with the deviating chunks' ids
    in place of theirs."""
    ends = np.cumsum(np.fromiter((len(x[0]) for x in found), np.int64, len(found))).tolist() if len(paths) > 1 else []
    for _, other in paths:
        parts, at = [], 0
        for i in sorted(other):
            parts += [ids[at:ends[i] - len(found[i][0])], other[i]]
            at = ends[i]
        yield b"".join([*parts, ids[at:]]) if parts else ids


def id_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


PATH = "array<struct<score:double,n_tokens:int,ids_crc32:long>>"


def encode(docs: DataFrame, model_path: str, n_best: int = 4, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` without its text, with: ids (array, if ``with_ids``), n_tokens,
    score, nbest (score, n_tokens, ids_crc32 of each path, best first), and
    round_trip (decoding any of the paths gives the text).  Columns of ``docs`` that have one
    of these names give way."""
    bound_batches(docs.sparkSession)
    shared = load_model(docs.sparkSession, model_path)
    new = [*(["ids array<int>"] if with_ids else []), "n_tokens long", "score double", f"nbest {PATH}", "round_trip boolean"]
    names = {x.split()[0] for x in new}
    rest = [c for c in docs.columns if c != text_col and c not in names]
    kinds = pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64())]))

    def run(batches):
        chunks = of_worker(("pieces", model_path, n_best), lambda: Chunks(PieceModel(shared.value), n_best))
        gc.disable()  # hundreds of thousands of small tuples, none of them in a cycle
        for b in batches:
            for part in slices(b, len(rest)):
                ids, counts, scores, nbest, same = [], [], [], [], []
                raws = part.column(len(rest)).to_pylist()
                for raw, (own, paths, found) in zip(raws, chunks.encode_all([x.decode("utf-8", "replace") for x in raws])):
                    told = [{"score": score, "n_tokens": len(path) // 4, "ids_crc32": zlib.crc32(path)}
                            for (score, _), path in zip(paths, path_bytes(own, paths, found))]
                    ids.append(own)
                    counts.append(len(own) // 4)
                    scores.append(paths[0][0])
                    nbest.append(told)
                    same.append((chunks.model.decode(np.frombuffer(own, "<u4").tolist()) == raw and chunks.same_bytes(paths, found))
                                if own else not raw)
                columns = [*part.columns[:len(rest)], *([id_lists(ids)] if with_ids else []),
                           pa.array(counts, pa.int64()), pa.array(scores, pa.float64()), pa.array(nbest, kinds), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, [*rest, *(x.split()[0] for x in new)])

    types = docs.select(*[F.col(f"`{c}`") for c in rest])
    plain = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    source = plain.select(*[f"c{i}" for i in range(len(rest))], as_bytes().alias("raw"))
    return source.mapInArrow(run, StructType([*types.schema, *StructType.fromDDL(", ".join(new))]))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of rows with an array of ids; null ids give null."""
    shared = load_model(encoded.sparkSession, model_path)

    def run(batches):
        model = PieceModel(shared.value)
        for b in batches:
            texts = [None if x is None else (model.decode(x) if x else b"").decode("utf-8", "replace")
                     for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return (encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
            .mapInArrow(run, "doc_id long, text string"))
