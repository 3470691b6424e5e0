"""Exact dedup (4) over a cuckoo-filter index of live digests.

A text's key is the SHA-256 of the text without ASCII white space.  An index
holds one live entry per key: its filter keeps 16-bit fingerprints in two
candidate buckets, a fingerprint hit is verified against the key stored in the
bucket, a better row deletes the live entry and inserts its own, and a table
that overflows is rebuilt at twice the size from the stored keys.

Each task first folds its own rows into an index, so a group of copies sends
one entry per task to the shuffle however large it is; the entries then meet by
key in index shards.  Rows carry 50 bytes through the shuffles, never texts.

Defined cases: null and white-space-only texts are equal to the empty text;
equally long rows are ranked by doc_id, null ids last; rows that repeat an id
and a text share the decision, and ``drop_copies`` keeps one of them; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACES, as_bytes, named, stored

SLOTS = 4
MAX_KICKS = 200
ENTRY = "sha binary, n long, chars long, id long, ties long"
NO_ID = (1 << 63) - 1
SHARD_ROWS = 500_000


class CuckooIndex:
    """Keys of 16 bytes or more (already uniform) with a payload each."""

    def __init__(self, buckets: int = 256):
        self._clear(buckets)
        self.resizes = 0

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.stored: list[tuple[bytes, object] | None] = [None] * (buckets * SLOTS)
        self.size = 0

    @staticmethod
    def _print(key: bytes) -> int:
        return (key[8] << 8 | key[9]) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        """Slot of the key, -1 if it is not live."""
        mark = self._print(key)
        first = int.from_bytes(key[:8], "little") & self.mask
        for bucket in (first, self._other(first, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.stored[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._slot(key)
        return None if slot < 0 else self.stored[slot][1]

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.stored[slot] = 0, None
        self.size -= 1
        return True

    def insert(self, key: bytes, payload: object) -> None:
        """The key must not be live."""
        entry, mark = (key, payload), self._print(key)
        bucket = int.from_bytes(key[:8], "little") & self.mask
        for kick in range(MAX_KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.stored[slot] = mark, entry
                        self.size += 1
                        return
            # both buckets are full: the entry takes a slot, its owner moves on
            slot = b * SLOTS + kick % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.stored[slot], entry = entry, self.stored[slot]
            bucket = self._other(b, mark)
        self._resize(entry)

    def _resize(self, homeless: tuple[bytes, object]) -> None:
        live = [*self.items(), homeless]
        self._clear(2 * (self.mask + 1))
        self.resizes += 1
        for key, payload in live:
            self.insert(key, payload)

    def items(self) -> Iterator[tuple[bytes, object]]:
        return (x for x in self.stored if x is not None)


def fold(index: CuckooIndex, entries: Iterable[tuple[bytes, int, int, int, int]]) -> None:
    """Entries are (key, rows, code points of the best row, its id, rows as
    good as it with that id)."""
    for key, n, chars, doc_id, ties in entries:
        live = index.get(key)
        if live is None:
            index.insert(key, (n, chars, doc_id, ties))
            continue
        rank, best = (-chars, doc_id), (-live[1], live[2])
        if rank < best:
            merged = (live[0] + n, chars, doc_id, ties)
        else:
            merged = (live[0] + n, live[1], live[2], live[3] + (ties if rank == best else 0))
        index.delete(key)
        index.insert(key, merged)


def _digests(batches):
    spaces = SPACES.encode()
    for b in batches:
        sha = [hashlib.sha256(t.translate(None, spaces)).digest() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("chars"), pa.array(sha, pa.binary())],
                                         ["doc_id", "chars", "sha"])


def _folded(batches):
    """Any number of entries in, one live entry per key out."""
    index = CuckooIndex()
    for b in batches:
        c = b.to_pydict()
        fold(index, zip(c["sha"], c["n"], c["chars"], c["id"], c["ties"]))
    rows = list(index.items())
    for i in range(0, len(rows), 20_000):
        part = rows[i:i + 20_000]
        columns = [pa.array([k for k, _ in part], pa.binary())]
        columns += [pa.array([p[j] for _, p in part], pa.int64()) for j in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["sha", "n", "chars", "id", "ties"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, chars (code points of the original text), sha: one row each."""
    return (docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"),
                        as_bytes().alias("text"))
            .mapInArrow(_digests, "doc_id long, chars long, sha binary"))


def live_groups(rows: DataFrame) -> DataFrame:
    """One live entry per key (``ENTRY``)."""
    entries = rows.select("sha", F.lit(1).cast("long").alias("n"), "chars",
                          F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.lit(1).cast("long").alias("ties"))
    # a shard's index holds at most about SHARD_ROWS entries, however many rows there are
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-rows.count() // SHARD_ROWS)
    shards = [wanted, "sha"] if wanted > parts else ["sha"]
    return entries.mapInArrow(_folded, ENTRY).repartition(*shards).mapInArrow(_folded, ENTRY)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, sha, ties (rows
    that repeat the kept id and text), chars (code points of the row's text)."""
    rows = stored(digests(named(docs, id_col, text_col)), "digests")
    groups = live_groups(rows).select("sha", F.col("n").alias("group_size"), F.col("chars").alias("best"),
                                      F.when(F.col("id") != NO_ID, F.col("id")).alias("keep_id"), "ties")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best"))
    return rows.join(groups, "sha").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha", "ties", "chars")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one per group."""
    keep = stored(exact_copies(docs, id_col, text_col).filter("kept")
                  .groupBy("doc_id", "sha", "chars").agg(F.max("ties").alias("ties")), "live")
    own = F.unhex(F.sha2(F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACES, ""), 256))
    chars = F.coalesce(F.char_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long")
    free = "__"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    key, sha, length, row = (free + c for c in ("id", "sha", "chars", "row"))
    same = (F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)) & (own == F.col(sha))
            & (chars == F.col(length)))

    def those(of: DataFrame) -> DataFrame:
        return docs.join(of.select(F.col("doc_id").alias(key), F.col("sha").alias(sha),
                                   F.col("chars").alias(length)), same, "left_semi")

    repeated = keep.filter("ties > 1")
    if repeated.isEmpty():
        return those(keep)
    # rows that repeat an id and a text of one length: any of them
    again = those(repeated).withColumns({key: F.col(f"`{id_col}`").cast("long"), sha: own})
    best = again.groupBy(key, sha).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]),
                 chars).alias(row))
    return those(keep.filter("ties = 1")).unionByName(best.select(f"{row}.*"))
