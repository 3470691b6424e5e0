"""LM scoring (3) from a log-frequency Bloom filter.

Counts c of all training n-grams are quantised to levels 1 + floor(log_b c) and
held in one Bloom filter as the pairs (n-gram, 1) ... (n-gram, level); a probe
sequence that first misses at level q + 1 says that the count is about that of
level q.  Probabilities are smoothed on the way down:

    P(w | h) = (min(c(hw), c(h)) + mu P(w | shorter h)) / (c(h) + mu)

with add-0.1 unigrams at the end, every count read from the filter.

Building: each task turns its text into n-gram hashes, adds them up, and sends
sorted (hash, count) runs by filter block; a block's task merges its runs and
sets its own bits, so neither a frequent n-gram nor a frequent source makes a
hot task.  A block has 16 bits for each of its own (n-gram, level) pairs, so a probe
hits falsely about once in 200 at every size of the corpus.

Probing: a filter of about BROADCAST_BYTES or less (two bytes for a token of
six) is broadcast.  Beyond, documents are packed into parts; each part sends its
distinct n-grams with their training counts to the blocks once, and a block's
task sets its bits, probes them for all that was sent, stores them as the
model's, and the levels return to the parts.  Both ways read the same bits and
give the same scores.

The exact unigram score needs exact counts.  Words of at least a count that at
most HEAD_WORDS words reach are broadcast (16 MB at most); a document's other
words are joined with the count table by hash.  Words are identified by 64-bit
hashes.

Defined cases: null and empty texts hold the end token only; a null id counts
as the empty text in the split; every row is learned from and scored by itself,
repeated or not; without training rows N and V are 0 and c is 0 for all words;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .base import WordHashes, as_bytes, named, of_worker, remainder, slices, stored

# Fixed value: the pseudo-count of the unigram base.
ADD = 0.1
BITS_PER_ENTRY = 16
BROADCAST_BYTES = 8 << 20
BLOCKS = 512  # at least
BLOCK_TEXT = 32 << 20  # bytes of training text whose n-grams one block gathers
HEAD_WORDS = 1 << 20
BASE = 1.5
MU = 2.0
MAX_LEVEL = 96  # counts of up to 8e16
PROBES = 3
# A part is a row of some MB: row groups are closed by size, not after 100 rows.
PACKED = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4,
          "parquet.page.size.row.check.min": 1}
FLUSH_TOKENS = 2_000_000
END, BEGIN = b" end", b" begin"  # no word holds a space

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def token_hashes(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a begin mark, the words and the end token of each text, one
    after the other; the number of tokens (end included) of each text."""
    begin, end = cache[BEGIN], cache[END]
    parts, counts = [], []
    for t in texts:
        words = t.lower().split()
        h = np.empty(len(words) + 2, np.uint64)
        h[0], h[-1] = begin, end
        h[1:-1] = cache.of(words)
        parts.append(h)
        counts.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(counts, np.int64)


def gram_hashes(hashes: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 ... order: the hash of the k tokens that end at each place,
    and whether they lie in one text (the begin mark is a token of k > 1)."""
    starts = np.cumsum(counts + 1) - (counts + 1)
    place = np.arange(len(hashes)) - np.repeat(starts, counts + 1)
    out = [(hashes, place >= 1)]
    for k in range(2, order + 1):
        g = np.zeros_like(hashes)
        g[1:] = mix(out[-1][0][:-1] * _M3 + hashes[1:] + np.uint64(k))
        out.append((g, place >= k - 1))
    return out


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / np.log(base) + 1e-9)).astype(np.int64)


def level_counts(base: float) -> np.ndarray:
    """The count each level stands for: the mean of its whole numbers."""
    out = [0.0]
    for q in range(1, MAX_LEVEL + 1):
        low, high = int(np.ceil(base ** (q - 1) - 1e-9)), int(np.ceil(base ** q - 1e-9)) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


def places(hashes: np.ndarray, level: np.ndarray | int, block_bits: np.ndarray | int) -> list[np.ndarray]:
    """Bit places, within its block (of under 2^32 bits), of an n-gram at a level."""
    x = mix(hashes + _M3 * np.asarray(level, np.uint64))
    y = (x >> np.uint64(32)) | np.uint64(1)
    low, size = np.uint64(0xFFFFFFFF), np.asarray(block_bits, np.uint64)
    return [(((x + np.uint64(i) * y) ^ (x >> np.uint64(17))) & low) * size >> np.uint64(32) for i in range(PROBES)]


def block_of(hashes: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """Blocks are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def block_count(size: int) -> int:
    """Blocks for so many bytes of training text, so that a block's n-grams
    stay at a fixed size."""
    return max(BLOCKS, -(-size // BLOCK_TEXT))


def by_block(own: np.ndarray, blocks: int) -> tuple[list[int], np.ndarray]:
    """The blocks that sorted n-grams lie in, and where each block starts."""
    cuts = np.searchsorted(block_of(own, blocks), np.arange(blocks + 1))
    return np.flatnonzero(cuts[:-1] < cuts[1:]).tolist(), cuts


def squeezed(x: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's codec removes the empty ones."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unsqueezed(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).reshape(-1)


def probe(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Level of each n-gram, by probing level after level; ``starts`` and
    ``sizes``: first bit and number of bits of each n-gram's block."""
    level, alive = np.zeros(len(hashes), np.uint8), np.arange(len(hashes))
    for q in range(1, MAX_LEVEL + 1):
        hit = np.ones(len(alive), bool)
        for place in places(hashes[alive], q, sizes[alive]):
            at = place.astype(np.int64) + starts[alive]
            hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        alive = alive[hit]
        if not len(alive):
            break
        level[alive] = q
    return level


class LogFrequencyFilter:
    def __init__(self, bits, base: float):
        """bits: the bytes (uint8) of each block."""
        self.sizes = np.array([len(b) * 8 for b in bits], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits, self.base, self.values = np.concatenate(list(bits)), base, level_counts(base)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts."""
        own, back = np.unique(hashes, return_inverse=True)
        block = block_of(own, len(self.sizes))
        return self.values[probe(self.bits, self.starts[block], self.sizes[block], own)][back]


def bits_for(counts: np.ndarray, base: float) -> int:
    """Bits of a block that holds n-grams of these counts."""
    entries = int(np.minimum(levels(counts, base), MAX_LEVEL).sum()) if len(counts) else 0
    return max(64, -(-entries * BITS_PER_ENTRY // 64) * 64)


def set_bits(hashes: np.ndarray, counts: np.ndarray, block_bits: int, base: float) -> np.ndarray:
    """The bits of one block."""
    bits = np.zeros(block_bits, bool)
    level = np.minimum(levels(counts, base), MAX_LEVEL) if len(counts) else np.zeros(0, np.int64)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = hashes[level >= q]
        for place in places(own, q, block_bits):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _sums(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _runs(order: int, blocks: int):
    """Training texts -> (block, kind, hashes, counts): kind 0 holds words and
    ends, kind 1 longer n-grams and begin marks."""
    def run(batches):
        cache = WordHashes()

        def flush(texts):
            hashes, counts = token_hashes(texts, cache)
            grams = gram_hashes(hashes, counts, order)
            words = grams[0][0][grams[0][1]]
            rest = np.concatenate([hashes[~grams[0][1]], *[g[ok] for g, ok in grams[1:]]])
            for kind, own in ((0, words), (1, rest)):
                own, n = np.unique(own, return_counts=True)
                filled, cuts = by_block(own, blocks)
                n = n.astype(np.uint32)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(filled, pa.int32()), "kind": pa.array([kind] * len(filled), pa.int32()),
                    "hashes": pa.array([own[cuts[b]:cuts[b + 1]].tobytes() for b in filled], pa.binary()),
                    "counts": pa.array([n[cuts[b]:cuts[b + 1]].tobytes() for b in filled], pa.binary())})

        texts, size = [], 0
        for b in batches:
            for part in slices(b, 0):
                own = part.column(0).to_pylist()
                texts += own
                size += sum(map(len, own))
                if size >= 6 * FLUSH_TOKENS:
                    yield from flush(texts)
                    texts, size = [], 0
        if texts:
            yield from flush(texts)
    return run


HELD = "block int, bits binary, words binary, counts binary, n long, v long, reach array<long>"


def _held(block: int, words: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray], base: float) -> tuple[np.ndarray, dict]:
    """The bits and the row (without them) of a block; hashes and counts of
    its words and its other n-grams, each once."""
    n, both = words[1], np.concatenate([words[1], rest[1]])
    bits = set_bits(np.concatenate([words[0], rest[0]]), both, bits_for(both, base), base)
    return bits, {"block": block, "words": words[0].tobytes(), "counts": n.astype(np.int64).tobytes(), "n": int(n.sum()),
                  "v": len(n), "reach": [int((n >= 1 << j).sum()) for j in range(40)]}


def _merged(base: float):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        of = []
        for kind in (0, 1):
            own = pdf[pdf["kind"] == kind]
            of.append(_sums(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in own["hashes"]]]),
                            np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.uint32).astype(np.int64) for x in own["counts"]]])))
        bits, row = _held(int(pdf["block"].iloc[0]), *of, base)
        return pd.DataFrame([{**row, "bits": bits.tobytes()}])[[x.split()[0] for x in HELD.split(", ")]]
    return merge


class Model:
    """What the workers get: the filter (None beyond the broadcast bound), N, V
    and the frequent words."""

    def __init__(self, bits: list[np.ndarray] | None, base: float, mu: float, order: int, n: int, v: int,
                 words: np.ndarray, counts: np.ndarray, complete: bool):
        self.filter = None if bits is None else LogFrequencyFilter(bits, base)
        self.mu, self.order, self.n, self.v = mu, order, n, v
        by = np.argsort(words)
        self.words, self.counts, self.complete = words[by], counts[by], complete

    def base_logs(self, c: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram probability; 0 without training rows."""
        if not self.n:
            return np.zeros(len(c))
        return np.log10((c + ADD) / (self.n + ADD * (self.v + 1)))

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of the words that are here, and which are not."""
        own, back = np.unique(hashes, return_inverse=True)
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), not self.complete)
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        here = self.words[at] == own
        return np.where(here, self.counts[at], 0)[back], (~here & (not self.complete))[back]

    def logs(self, grams: list[tuple[np.ndarray, np.ndarray]], seen: list[np.ndarray]) -> np.ndarray:
        """log10 P of each place of ``token_hashes``; 0 at begin marks.
        ``seen``: the estimated counts of ``grams``."""
        if not self.n:
            return np.zeros(len(seen[0]))
        p = (seen[0] + ADD) / (self.n + ADD * (self.v + 1))
        for k in range(1, self.order):
            context = np.concatenate([[0.0], seen[k - 1][:-1]])
            longer = (np.minimum(seen[k], context) + self.mu * p) / (context + self.mu)
            p = np.where(grams[k][1], longer, p)
        return np.where(grams[0][1], np.log10(np.minimum(p, 1.0)), 0.0)


def fit(train: DataFrame, order: int = 2, base: float = BASE, mu: float = MU, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame]:
    """``train``: rows with ``text`` (binary).  The model with its filter, and
    the stored table of all bits and word counts by block."""
    n_blocks = block_count(text_bytes(train))
    blocks = stored(train.select("text").mapInArrow(_runs(order, n_blocks), "block int, kind int, hashes binary, counts binary")
                    .groupBy("block").applyInPandas(_merged(base), HELD), "lm")
    bits = [np.zeros(8, np.uint8)] * n_blocks
    for r in blocks.select("block", "bits").toLocalIterator():
        bits[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return _model(blocks, bits, order, base, mu, head_words), blocks


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _model(blocks: DataFrame, bits: list[np.ndarray] | None, order: int, base: float, mu: float, head_words: int) -> Model:
    total = blocks.agg(F.sum("n").alias("n"), F.sum("v").alias("v"),
                       F.array(*[F.sum(F.col("reach")[j]) for j in range(40)]).alias("reach")).first()
    n, v = total.n or 0, total.v or 0
    level = next((j for j in range(40) if (total.reach[j] or 0) <= head_words), 39)

    def head(batches):
        for b in batches:
            for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(counts, np.int64)
                most = c >= 1 << level
                yield pa.RecordBatch.from_pydict({"words": pa.array([np.frombuffer(words, np.uint64)[most].tobytes()], pa.binary()),
                                                  "counts": pa.array([c[most].tobytes()], pa.binary())})

    found = blocks.select("words", "counts").mapInArrow(head, "words binary, counts binary").collect()
    words = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(bytes(r.words), np.uint64) for r in found]])
    counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(bytes(r["counts"]), np.int64) for r in found]])
    return Model(bits, base, mu, order, n, v, words, counts, complete=v <= head_words and level == 0)


def _count_rows(batches):
    for b in batches:
        for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w, c = np.frombuffer(words, np.int64), np.frombuffer(counts, np.int64)
            for at in range(0, len(w), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[at:at + 50_000]), pa.array(c[at:at + 50_000])], ["hash", "c"])


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>"


def _scores(own: Model, keys: list[pa.Array], texts: list[bytes], cache: WordHashes, seen_of) -> list[pa.Array]:
    """Columns of ``SCORED``; ``seen_of``: grams -> their estimated counts."""
    hashes, counts = token_hashes(texts, cache)
    starts = np.cumsum(counts + 1) - (counts + 1)
    is_token = np.ones(len(hashes), bool)
    is_token[starts] = False
    c, unsure = own.known(hashes)
    unsure &= is_token
    base = np.where(is_token & ~unsure, own.base_logs(c), 0.0)
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    cuts = np.searchsorted(doc[unsure], np.arange(len(counts) + 1))
    grams = gram_hashes(hashes, counts, own.order)
    return [*keys, pa.array(counts), pa.array(np.add.reduceat(((c > 0) & is_token).astype(np.int64), starts)),
            pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own.logs(grams, seen_of(grams)), starts)),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes[unsure].view(np.int64)))]


NAMES = [x.split()[0] for x in SCORED.split(", ")]


def _by_broadcast(rows: DataFrame, shared) -> DataFrame:
    """``rows``: rid, doc_id, held_out, text."""
    def run(batches):
        own, cache = shared.value, WordHashes()
        for b in batches:
            for part in slices(b, 3):
                yield pa.RecordBatch.from_arrays(_scores(
                    own, part.columns[:3], part.column(3).to_pylist(), cache,
                    lambda grams: [own.filter.counts(g) for g, _ in grams]), NAMES)

    return rows.mapInArrow(run, SCORED)


def _asked(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words and ends of a part, place by place; its begin marks and longer n-grams."""
    hashes, ok = grams[0]
    return hashes[ok], np.concatenate([hashes[~ok], *[g[ok] for g, ok in grams[1:]]])


def _by_join(rows: DataFrame, n_blocks: int, order: int = 2, base: float = BASE, mu: float = MU,
             head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame, DataFrame]:
    """The model without its filter, the table of word counts by block, and
    the rows scored as in ``_by_broadcast``.  A part is one row of about
    PART_BYTES of text, written once, so that its n-grams are the same whenever
    it is read."""
    def pack(batches):
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for part in slices(b, 3):
                texts, ends = part.column(3).to_pylist(), pa.array([0, part.num_rows], pa.int32())
                sizes = pa.array(list(map(len, texts)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + at], pa.int64()), *[pa.ListArray.from_arrays(ends, c) for c in [*part.columns[:3], sizes]],
                     pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary())],
                    ["part", "rid", "doc_id", "held_out", "sizes", "text"])
                at += 1

    def unpack(sizes: list[int], data: bytes) -> list[bytes]:
        ends = np.cumsum([0, *sizes]).tolist()
        whole = pa.decompress(data, ends[-1], codec="zstd", asbytes=True)
        return [whole[a:b] for a, b in zip(ends, ends[1:])]

    def ask(batches):
        cache = WordHashes()
        for b in batches:
            for part, held_out, sizes, data in zip(*[c.to_pylist() for c in b.columns]):
                hashes, counts = token_hashes(unpack(sizes, data), cache)
                grams = gram_hashes(hashes, counts, order)
                train = np.repeat(~np.array(held_out, bool), counts + 1)
                for kind, (own, learned) in enumerate(zip(_asked(grams), _asked([(train, ok) for _, ok in grams]))):
                    own, back = np.unique(own, return_inverse=True)
                    n = np.bincount(back, learned, len(own)).astype(np.uint32)
                    filled, cuts = by_block(own, n_blocks)
                    first = own[cuts[filled]].view(np.int64)
                    own[1:] -= own[:-1].copy()
                    own[cuts[filled]] = 0  # the first of a run is sent apart
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array(filled, pa.int32()), "part": pa.array([part] * len(filled), pa.int64()),
                        "kind": pa.array([kind] * len(filled), pa.int32()), "first": pa.array(first),
                        "steps": pa.array([squeezed(own[cuts[x]:cuts[x + 1]]) for x in filled], pa.binary()),
                        "counts": pa.array([squeezed(n[cuts[x]:cuts[x + 1]]) for x in filled], pa.binary())})

    held = [x.split()[0] for x in HELD.split(", ")]
    told = HELD + ", part long, kind int, levels binary"
    told_schema = to_arrow_schema(StructType.fromDDL(told))

    def answer(asked: pa.Table) -> pa.Table:
        kinds, runs, counts = asked["kind"].to_numpy(), [], []
        for first, steps, n in zip(asked["first"].to_pylist(), asked["steps"].to_pylist(), asked["counts"].to_pylist()):
            runs.append(np.cumsum(unsqueezed(steps, np.uint64), dtype=np.uint64) + np.array([first], np.int64).view(np.uint64))
            counts.append(unsqueezed(n, np.uint32).astype(np.int64))
        of = []
        for kind in (0, 1):
            own = np.flatnonzero(kinds == kind).tolist()
            h, n = _sums(np.concatenate([np.zeros(0, np.uint64), *[runs[i] for i in own]]),
                         np.concatenate([np.zeros(0, np.int64), *[counts[i] for i in own]]))
            of.append((h[n > 0], n[n > 0]))  # what only held-out rows have isn't learned
        block = asked["block"][0].as_py()
        bits, row = _held(block, *of, base)
        level = probe(bits, *np.broadcast_arrays(0, len(bits) * 8, both := np.concatenate(runs))[:2], both)
        ends = np.cumsum([0, *map(len, runs)]).tolist()
        rows = [{**row, "bits": bits.tobytes(), "part": None, "kind": None, "levels": None}]
        rows += [{**dict.fromkeys(held), "block": block, "part": part, "kind": kind, "levels": level[a:b].tobytes()}
                 for part, kind, a, b in zip(asked["part"].to_pylist(), kinds.tolist(), ends, ends[1:])]
        return pa.Table.from_pylist(rows, schema=told_schema)

    values = level_counts(base)

    def score(packed: pa.Table, found: pa.Table) -> pa.Table:
        got = sorted(zip(found["kind"].to_pylist(), found["block"].to_pylist(), found["levels"].to_pylist()))

        def seen_of(grams):
            seen = [np.zeros(len(ok)) for _, ok in grams]
            for kind, own in enumerate(_asked(grams)):
                level = np.frombuffer(b"".join(x for k, _, x in got if k == kind), np.uint8)
                c = values[level][np.unique(own, return_inverse=True)[1]]
                if kind == 0:
                    seen[0][grams[0][1]] = c
                    continue
                at = 0
                for k, (_, ok) in enumerate(grams):
                    places_ = ok if k else ~ok
                    n = int(places_.sum())
                    seen[k][places_] = c[at:at + n]
                    at += n
            return seen

        keys = [packed[x].combine_chunks().flatten() for x in ("rid", "doc_id", "held_out")]
        texts = unpack(packed["sizes"][0].as_py(), packed["text"][0].as_py())
        return pa.Table.from_arrays(_scores(shared.value, keys, texts, of_worker(("lm",), WordHashes), seen_of), NAMES)

    packed = stored(rows.mapInArrow(pack, "part long, rid array<long>, doc_id array<long>, held_out array<boolean>, "
                                          "sizes array<long>, text binary"), "parts", PACKED)
    asked = packed.select("part", "held_out", "sizes", "text").mapInArrow(
        ask, "block int, part long, kind int, first long, steps binary, counts binary")
    lm = stored(asked.groupBy("block").applyInArrow(answer, told), "lm")
    blocks = lm.filter("part IS NULL").select(*held)
    model = _model(blocks, None, order, base, mu, head_words)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    found = lm.filter("part IS NOT NULL").select("part", "kind", "block", "levels")
    return model, blocks, packed.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(score, SCORED)


def score_documents(docs: DataFrame, fold: int = 10, id_col: str = "doc_id", text_col: str = "text",
                    broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """Learns from rows whose crc32(id) mod ``fold`` is not 0 and scores all:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = named(docs, id_col, text_col).select("doc_id", as_bytes().alias("text"),
                                                (remainder("doc_id", fold) == 0).alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    size = text_bytes(train)
    keyed = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    if size // 3 <= broadcast_bytes:
        model, blocks = fit(train, **options)
        scored = _by_broadcast(keyed, docs.sparkSession.sparkContext.broadcast(model))
    else:
        model, blocks, scored = _by_join(keyed, block_count(size), **options)
    out = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"]
    if model.complete:  # every training word was broadcast, so no word is left over
        return scored.select(*out)
    scored = stored(scored, "scored")
    words = blocks.select("words", "counts").mapInArrow(_count_rows, "hash long, c long")
    # rows of one document and word are added up before the join
    left = (scored.select("rid", F.explode("rest").alias("hash")).groupBy("rid", "hash").agg(F.count("*").alias("tf")))
    left = left.join(words, "hash", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    logs = F.col("tf") * F.log10((F.col("c") + ADD) / F.lit(model.n + ADD * (model.v + 1)))
    left = left.groupBy("rid").agg(F.sum(logs).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("also"))
    return (scored.drop("rest").join(left, "rid", "left")
            .withColumn("n_known", F.col("n_known") + F.coalesce("also", F.lit(0)))
            .withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0)))
            .select(*out))
