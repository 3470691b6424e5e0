"""Substring dedup (2) with suffix automata of reference shards.

Every word of a window of ``window`` words whose sequence starts earlier (by
doc_id, then place) goes; windows are judged on the input.

Equal windows have equal minimizers (the least hash of their 4-word grams), so
a document is cut into segments, runs of windows with one minimizer, and only
segments of one minimizer can share windows.  Minimizers that occur once, which
is most, end there.  Segments with equal words are added up before they are
shuffled, and all but the first copy go whole.  The distinct segments of a
minimizer that has several are references and documents at once: they are dealt
to shards of bounded size; a shard's task streams its segments in document
order through the suffix automaton of those before, takes each end's matching
statistic, marks the spans where it reaches ``window``, and then adds the
segment to the automaton.

An automaton visits the tasks that need it, one shard each: to broadcast all of
them would send each task a structure that grows with the corpus, and to stream
all documents through all shards would be quadratic.

A minimizer with more than HOT_SEGMENTS distinct segments (the rim of a passage
that very many documents quote in different surroundings) is cut further, into
its single windows; these are added up by their words, like segments, and all
but the first copy go.  So no key meets one task with more than a bounded
number of rows.

Defined cases: null, empty and wordless texts, and those of fewer words than a
window, lose nothing; a null id comes after all others; rows that repeat an id
and a text are one document and get the same result; texts that differ under
one id (or have none) are told apart by 86 bits of a hash and ordered by it; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordHashes, as_bytes, named, slices, stored

GRAM = 4
HOT_SEGMENTS = 1000
SHARD_SEGMENTS = 2000
LAST_ID = (1 << 63) - 1

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
# A segment's place as one number that sorts by the text's hash, then the
# start: 22 bits of hash, 30 of start, 11 of the number of windows.  The
# document's number, 64 more bits of that hash, is a column of its own.
START_BITS, COUNT_BITS = 30, 11


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as many as the longest document
    so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            more = [np.full(2 * n, np.uint64(base)) for base in (_BASE, _BACK)]
            for x in more:
                x[0] = 1
            self.up, self.down = (np.cumprod(x, dtype=np.uint64) for x in more)
        return self.up[:n], self.down[:n]


class Ranges:
    """Hash of any range of a document's words."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        up, self.back = powers.of(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return _mix(h + _MUL * length.astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        """Of every range of that length."""
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of the least (by its upper
    bits; the first of equals): minima of runs twice as long, again and again."""
    bits = np.uint64(max(len(values).bit_length(), 1))
    m = values >> bits << bits | np.arange(len(values), dtype=np.uint64)
    done = 1
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[:len(m) - (width - done)], m[width - done:])
    return (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments(ranges: Ranges, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, number of windows) of each segment."""
    n = len(ranges.sums) - window
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(GRAM, window)
    g = ranges.all(gram)
    least = least_places(g, window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return g[least[first]], first, np.diff(np.append(first, n))


def _place(tie: int, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return ((np.int64(tie) << START_BITS) + start << COUNT_BITS) + count


def tie_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little") >> 10


def number_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, person=b"document").digest(), "little", signed=True)


def _minimizers(window: int):
    """The segments' keys alone: no hashes of ranges or texts."""
    def run(batches):
        cache, powers = WordHashes(), Powers()
        for b in batches:
            for part in slices(b, 1):
                out = [np.zeros(0, np.uint64)]
                for text in part.column(1).to_pylist():
                    words = text.split()
                    if len(words) >= window:
                        out.append(segments(Ranges(cache.of(words), powers), window)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["key"])
    return run


def _segmented(window: int):
    def run(batches):
        cache, powers = WordHashes(), Powers()
        for b in batches:
            for part in slices(b, 1):
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.split()
                    if len(words) < window:
                        continue
                    ranges = Ranges(cache.of(words), powers)
                    keys, first, count = segments(ranges, window)
                    out.append((keys, ranges.of(first, count + window - 1), np.full(len(keys), doc_id, np.int64),
                                _place(tie_of(text), first, count), np.full(len(keys), number_of(text), np.int64)))
                if out:
                    key, words, ids, place, doc = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(words.view(np.int64)),
                                                      pa.array(ids), pa.array(place), pa.array(doc)], ["key", "words", "id", "place", "doc"])
    return run


class SuffixAutomaton:
    """Of several sequences; ``add`` appends one from the root."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, arcs: dict[bytes, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: bytes, q: int) -> int:
        """The state of q's strings that are no longer than p's with c."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            own = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = own
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = own

    def matches(self, sequence: list[bytes]) -> Iterator[int]:
        """Matching statistics: for each end, the length of the longest suffix
        that one of the added sequences holds."""
        state = length = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(c)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield length


def spans_before(sequences: list[list[bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each sequence its maximal word spans made of windows that an earlier
    sequence holds.  (No sequence here holds a window twice.)"""
    automaton, out = SuffixAutomaton(), []
    for words in sequences:
        spans: list[tuple[int, int]] = []
        for end, length in enumerate(automaton.matches(words), 1):
            if length >= window:
                if spans and spans[-1][1] >= end - length:
                    spans[-1] = (min(spans[-1][0], end - length), end)
                else:
                    spans.append((end - length, end))
        out.append(spans)
        automaton.add(words)
    return out


def _streamed(window: int):
    """A shard's segments -> spans (id, tie, doc, start, end)."""
    def run(key, t):
        t = t.sort_by([("id", "ascending"), ("place", "ascending"), ("doc", "ascending")])
        found = spans_before([w.split(b" ") for w in t.column("text").to_pylist()], window)
        ids, ties, docs, starts, ends = [], [], [], [], []
        for doc_id, tie, doc, start, spans in zip(*(t.column(c).to_pylist() for c in ("id", "tie", "doc", "start")), found):
            for a, b in spans:
                ids.append(doc_id)
                ties.append(tie)
                docs.append(doc)
                starts.append(start + a)
                ends.append(start + b)
        return pa.table({"id": pa.array(ids, pa.int64()), "tie": pa.array(ties, pa.int64()), "doc": pa.array(docs, pa.int64()),
                         "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())})
    return run


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tie_of(t) for t in raw], pa.int64()),
                                          pa.array([number_of(t) for t in raw], pa.int64()),
                                          pa.array([pack.compress(t) for t in raw], pa.binary())], ["id", "tie", "doc", "z"])


def _cut(batches):
    """Documents with the places of wanted segments -> the segments' words."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for doc_id, tie, doc, z, own in zip(*(c.to_pylist() for c in b.columns)):
            words = unpack.decompress(z).split()
            at = [(x["key"], x["start"], x["n_words"]) for x in own]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in at], pa.int64()), pa.array([doc_id] * len(at), pa.int64()),
                pa.array([tie] * len(at), pa.int64()), pa.array([doc] * len(at), pa.int64()), pa.array([s for _, s, _ in at], pa.int64()),
                pa.array([b" ".join(words[s:s + n]) for _, s, n in at], pa.binary())], ["key", "id", "tie", "doc", "start", "text"])


def _windows(window: int):
    """Cut segments -> their single windows (key, hash of the words, id, place, doc)."""
    def run(batches):
        cache, powers = WordHashes(), Powers()
        for b in batches:
            out = []
            for key, doc_id, tie, doc, start, text in zip(*(c.to_pylist() for c in b.columns)):
                h = cache.of(text.split(b" "))
                at = np.arange(len(h) - window + 1)
                out.append((np.full(len(at), key, np.int64), Ranges(h, powers).of(at, np.full(len(at), window)).view(np.int64),
                            np.full(len(at), doc_id, np.int64), _place(tie, at + start, np.ones(len(at), np.int64)), np.full(len(at), doc, np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "words", "id", "place", "doc"])
    return run


def _kept(with_text: bool):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for part in slices(b, 1):
                ids, zs, spans = (c.to_pylist() for c in part.columns)
                n_words, n_removed, sha, merged, texts = [], [], [], [], []
                for z, own in zip(zs, spans):
                    words = unpack.decompress(z).split()
                    kept, at, union = [], 0, []
                    for x in sorted((s["start"], s["end"]) for s in own or []):
                        if union and x[0] <= union[-1]["end"]:
                            union[-1]["end"] = max(union[-1]["end"], x[1])
                        else:
                            union.append({"start": x[0], "end": x[1]})
                    for s in union:
                        kept += words[at:s["start"]]
                        at = s["end"]
                    kept += words[at:]
                    text = b" ".join(kept)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(text).hexdigest())
                    merged.append(union)
                    texts.append(text.decode("utf-8", "replace") if with_text else None)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha),
                    pa.array(merged, kind), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])
    return run


def _start(place: str = "place"):
    return F.shiftright(place, COUNT_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1))


def _tie(place: str = "place"):
    return F.shiftright(place, COUNT_BITS + START_BITS)


def _end(window: int, place: str = "place"):
    return _start(place) + F.col(place).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)) + window - 1


def _spans(of: DataFrame, window: int) -> DataFrame:
    return of.select("id", _tie().alias("tie"), "doc", _start().alias("start"), _end(window).alias("end"))


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """``docs``: id, text (binary).  Word spans to remove: id, tie, doc, start, end."""
    # the number of windows of a segment must fit its bits
    if window - min(GRAM, window) + 1 >= 1 << COUNT_BITS:
        raise ValueError("the window is too long for segments")
    cut = docs.mapInArrow(_segmented(window), "key long, words long, id long, place long, doc long")
    # stored, so that it comes to the join by an exchange of its own and the
    # rows of a frequent minimizer can be split
    often = stored(docs.mapInArrow(_minimizers(window), "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "often")
    found = stored(cut.join(often, "key"), "segments")

    first = F.struct("id", "place", "doc")
    later = (F.col("id") != F.col("first.id")) | (F.col("place") != F.col("first.place")) | (F.col("doc") != F.col("first.doc"))
    distinct = stored(found.groupBy("key", "words").agg(F.min(first).alias("first")), "distinct")
    copies = found.join(distinct, ["key", "words"]).filter(later)
    several = distinct.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = (distinct.join(several, "key").select("key", "n", F.col("first.id").alias("id"), F.col("first.place").alias("place"),
                                                  F.col("first.doc").alias("doc")))
    by_doc = (wanted.groupBy("id", _tie().alias("tie"), "doc")
              .agg(F.collect_list(F.struct("key", _start().alias("start"), (_end(window) - _start()).alias("n_words"))).alias("wanted")))
    texts = docs.mapInArrow(_packed, "id long, tie long, doc long, z binary").dropDuplicates(["id", "tie", "doc"])
    pieces = stored(texts.join(by_doc, ["id", "tie", "doc"]).select("id", "tie", "doc", "z", "wanted")
                    .mapInArrow(_cut, "key long, id long, tie long, doc long, start long, text binary"), "pieces")
    hot = several.filter(F.col("n") > HOT_SEGMENTS).select("key")

    calm = pieces.join(hot, "key", "left_anti")
    n_shards = -(-pieces.count() // SHARD_SEGMENTS) or 1
    # hash("key") dealt the rows to partitions; another hash deals them to shards
    shards = (calm.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)))
              .withColumn("place", F.shiftleft("tie", START_BITS) + F.col("start")))
    spans = shards.groupBy("shard").applyInArrow(_streamed(window), "id long, tie long, doc long, start long, end long")

    single = stored(pieces.join(hot, "key", "left_semi").mapInArrow(_windows(window), "key long, words long, id long, place long, doc long"), "windows")
    firsts = single.groupBy("key", "words").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = single.join(firsts, ["key", "words"]).filter(later)
    return _spans(copies, window).union(spans).union(_spans(again, window))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans
    (removed word ranges), kept_text (null unless ``with_text``)."""
    own = named(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), as_bytes().alias("text"))
    spans = repeated_spans(own, window).groupBy("id", "tie", "doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = own.mapInArrow(_packed, "id long, tie long, doc long, z binary")
    out = (rows.join(spans, ["id", "tie", "doc"], "left")
           .select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "z", "spans"))
    return out.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                                            "spans array<struct<start:long,end:long>>, kept_text string")
