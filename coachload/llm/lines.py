"""Line dedup (8) by a deletion-neighbourhood join.

A line (between newlines, without ASCII white space at its ends) goes if an
earlier one, by doc_id and then line number, is equal to it, or is at most one
code point edit away and both have MIN_CHARS code points or more.  Blank lines
stay.  Lines are judged on the input.

The neighbourhood of a line is itself and all its variants with one code point
left out, as hashed keys: two lines one insertion apart share the shorter one
whole; two lines one substitution apart share the variant and its place.  All
members of a key are one edit from its whole line, or from each other at its
place, so the earliest of each kind, a grouped minimum, tells whether a member
has an earlier neighbour; groups are never expanded into pairs.  Each line's
earliest partner is then verified on the texts.

Emitting 600 keys for every line is wasted on most.  A pair one edit apart
agrees outside the one part of an even grid that holds the edit; so lines first
post the rest around each of 2 parts, and only those that share a key with
another line are read again, post the rest around each of 16 parts, and emit
variants only for edits inside the parts they share.  Nothing is lost by it.

A line is known by a 128-bit hash of its text; the search for candidates goes
by its first half, and what it finds is verified on the texts.  Lines of very
frequent text are added up before each shuffle.

Defined cases: null and empty texts have one blank line; a null id comes after
all others; rows that repeat an id and a text are one document and get the same
result; texts that differ under one id (or have none) are told apart by 86 bits of a
hash and ordered by it; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACES, as_bytes, named, slices, stored

MIN_CHARS = 20
COARSE, FINE = 2, 16
LAST_ID = (1 << 63) - 1
LINE_BITS = 40
WHOLE, DELETED, REPLACED = 0, 1, 2
_SPACES = SPACES.encode()
_CHAR = 4  # bytes of a code point in the fixed-width form


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def tie_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little") >> 10


def number_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, person=b"document").digest(), "little", signed=True)


def line_id(line: bytes) -> int:
    return line_ids(line)[0]


def line_ids(line: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(line)
    return signed(both & (1 << 64) - 1), signed(both >> 64)


def wide(line: bytes) -> bytes:
    return line.decode("utf-8", "replace").encode("utf-32-le")


def around(w: bytes, parts: int) -> Iterator[tuple[int, int, int]]:
    """(key of what lies around the part, whether a partner is as long or
    longer (0) or shorter (1), part) for each part of both grids."""
    n = len(w) // _CHAR
    for less in (0, 1):
        m = n - less
        for j in range(parts):
            a, b = j * m // parts, m - (j + 1) * m // parts
            key = xxhash.xxh3_64(f"{m} {j} {parts} ".encode())
            key.update(w[:a * _CHAR])
            key.update(b"|")
            key.update(w[(n - b) * _CHAR:])
            yield signed(key.intdigest()), less, j


def variants(w: bytes, less: int, part: int, parts: int = FINE) -> Iterator[tuple[int, int]]:
    """(key, kind) of the line's variants for edits inside a part of a grid."""
    n = len(w) // _CHAR
    m = n - less
    first, last = part * m // parts, (part + 1) * m // parts
    if not less:
        yield signed(xxhash.xxh3_64_intdigest(w, 1)), WHOLE
        for p in range(first, last):
            yield signed(xxhash.xxh3_64_intdigest(w[:p * _CHAR] + b"\xff" * _CHAR + w[(p + 1) * _CHAR:], 2)), REPLACED
    else:
        for p in range(first, min(last, n - 1) + 1):
            yield signed(xxhash.xxh3_64_intdigest(w[:p * _CHAR] + w[(p + 1) * _CHAR:], 1)), DELETED


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two wide lines are at most one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > _CHAR:
        return False
    n, p = len(a), 0
    while p < n and a[p:p + _CHAR] == b[p:p + _CHAR]:
        p += _CHAR
    return a[p + _CHAR:] == b[p + _CHAR:] if len(a) == len(b) else a[p:] == b[p + _CHAR:]


def _lines(batches):
    for b in batches:
        for part in slices(b, 1):
            ids, places, lines, docs = [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tie, doc = tie_of(text) << LINE_BITS, number_of(text)
                for no, line in enumerate(text.split(b"\n")):
                    if line := line.strip(_SPACES):
                        ids.append(doc_id)
                        places.append(tie + no)
                        lines.append(line_ids(line))
                        docs.append(doc)
            own, more = zip(*lines) if lines else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (own, more, ids, places, docs)],
                                             ["line", "more", "id", "place", "doc"])


def _coarse(batches):
    for b in batches:
        for part in slices(b, 0):
            keys, lines = [], []
            for line in {x for t in part.column(0).to_pylist() for x in map(_strip, t.split(b"\n")) if len(x) >= MIN_CHARS}:
                w = wide(line)
                if len(w) >= MIN_CHARS * _CHAR:
                    own = line_id(line)
                    for key, _, _ in around(w, COARSE):
                        keys.append(key)
                        lines.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.int64())], ["key", "line"])


def _strip(line: bytes) -> bytes:
    return line.strip(_SPACES)


def _fine(batches):
    for b in batches:
        for line, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys, less, part = zip(*around(wide(text), FINE))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([line] * len(keys), pa.int64()),
                                              pa.array(less, pa.int32()), pa.array(part, pa.int32())], ["key", "line", "less", "part"])


def _varied(batches):
    for b in batches:
        lines, texts, shared = (c.to_pylist() for c in b.columns)
        for line, text, own in zip(lines, texts, shared):
            w = wide(text)
            found = list(dict.fromkeys(x for s in own for x in variants(w, s["less"], s["part"])))
            if found:
                keys, kinds = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()),
                                                  pa.array([line] * len(found), pa.int64())], ["key", "kind", "line"])


def _verified(batches):
    for b in batches:
        ok = [line_ids(t) for t, o in zip(*(c.to_pylist() for c in b.columns)) if t != o and one_edit(wide(t), wide(o))]
        line, more = zip(*ok) if ok else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(more, pa.int64())], ["line", "more"])


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tie_of(t) for t in raw], pa.int64()),
                                          pa.array([number_of(t) for t in raw], pa.int64()),
                                          pa.array([pack.compress(t) for t in raw], pa.binary())], ["id", "tie", "doc", "z"])


def _read(batches):
    """Documents with the numbers of wanted lines -> (line, its text)."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for z, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lines = unpack.decompress(z).split(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([x["line"] for x in own], pa.int64()),
                                              pa.array([_strip(lines[x["no"]]) for x in own], pa.binary())], ["line", "text"])


def _kept(with_text: bool):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for part in slices(b, 1):
                ids, zs, removed = (c.to_pylist() for c in part.columns)
                n_lines, n_removed, sha, texts = [], [], [], []
                for z, gone in zip(zs, removed):
                    lines, drop = unpack.decompress(z).split(b"\n"), set(gone or ())
                    text = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                    n_lines.append(len(lines))
                    n_removed.append(len(drop))
                    sha.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode("utf-8", "replace") if with_text else None)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha),
                    part.column(2), pa.array(texts, pa.string())],
                    ["doc_id", "n_lines", "n_removed", "kept_sha256", "removed", "kept_text"])
    return run


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that two different lines have; stored, so that they come to a join
    by an exchange of their own and the rows of a frequent key can be split."""
    found = keys.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b")
    return stored(found.select("key"), "shared")


def near_lines(own: DataFrame, firsts: DataFrame) -> DataFrame:
    """``firsts``: line, more, first (id, place, doc).  The lines (line, more)
    that have an earlier line one edit away."""
    coarse = own.select("text").mapInArrow(_coarse, "key long, line long")
    wanted = coarse.join(_shared(coarse), "key").select("line").distinct()
    by_doc = (firsts.join(wanted, "line")
              .groupBy(F.col("first.id").alias("id"), F.shiftright("first.place", LINE_BITS).alias("tie"), F.col("first.doc").alias("doc"))
              .agg(F.collect_list(F.struct("line", F.col("first.place").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).alias("no"))).alias("wanted")))
    docs = own.mapInArrow(_packed, "id long, tie long, doc long, z binary").dropDuplicates(["id", "tie", "doc"])
    texts = stored(docs.join(by_doc, ["id", "tie", "doc"]).select("z", "wanted").mapInArrow(_read, "line long, text binary"), "texts")

    fine = stored(texts.mapInArrow(_fine, "key long, line long, less int, part int"), "fine")
    parts = (fine.join(_shared(fine), "key").groupBy("line").agg(F.collect_set(F.struct("less", "part")).alias("shared")))
    keys = (texts.join(parts, "line").select("line", "text", "shared").mapInArrow(_varied, "key long, kind int, line long")
            .join(firsts, "line"))
    keys = stored(keys.select("key", "kind", F.struct("first", "line").alias("own")), "variants")

    def least(kind: int):
        return F.min(F.when(F.col("kind") == kind, F.col("own")))

    best = keys.groupBy("key").agg(least(WHOLE).alias("whole"), least(DELETED).alias("deleted"), least(REPLACED).alias("replaced"))
    partner = F.when(F.col("kind") == WHOLE, F.col("deleted")).when(F.col("kind") == DELETED, F.col("whole")).otherwise(F.col("replaced"))
    pairs = (keys.join(best, "key").withColumn("partner", partner).filter(F.col("partner.first") < F.col("own.first"))
             .select(F.col("own.line").alias("line"), F.col("partner.line").alias("other")).distinct())
    return (pairs.join(texts, "line").join(texts.select(F.col("line").alias("other"), F.col("text").alias("other_text")), "other")
            .select("text", "other_text").mapInArrow(_verified, "line long, more long").distinct())


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed, kept_sha256 (of the kept
    lines, unchanged, joined by newlines), removed (line numbers from 0),
    kept_text (null unless ``with_text``)."""
    own = named(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), as_bytes().alias("text"))
    lines = stored(own.mapInArrow(_lines, "line long, more long, id long, place long, doc long"), "lines")
    firsts = stored(lines.groupBy("line", "more").agg(F.min(F.struct("id", "place", "doc")).alias("first")), "firsts")
    near = near_lines(own, firsts).withColumn("near", F.lit(True))
    judged = firsts.join(near, ["line", "more"], "left")
    gone = (lines.join(judged, ["line", "more"])
            .filter(F.col("near") | (F.col("id") != F.col("first.id")) | (F.col("place") != F.col("first.place")) | (F.col("doc") != F.col("first.doc")))
            .groupBy("id", F.shiftright("place", LINE_BITS).alias("tie"), "doc")
            .agg(F.sort_array(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << LINE_BITS) - 1)))).alias("removed")))
    out = (own.mapInArrow(_packed, "id long, tie long, doc long, z binary").join(gone, ["id", "tie", "doc"], "left")
           .select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "z", "removed"))
    return out.mapInArrow(_kept(with_text), "doc_id long, n_lines long, n_removed long, kept_sha256 string, "
                                            "removed array<long>, kept_text string")
