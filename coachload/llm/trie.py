"""Conversation prefix trie (11) in balanced parentheses.

A node is a distinct sequence of first turns; its identity is the xor of a
128-bit hash of (place, turn) over them, so prefixes add up without walking.
Sequences are cut into blocks of BLOCK turns, which are rows of bounded size,
and sorted over range partitions, so that a trie's subtrees are runs of rows
and a huge group of equal conversations is dealt over many tasks.

A shard is a bounded run of sorted rows.  Its trie is written as balanced
parentheses straight from the common prefix lengths of neighbouring rows.
``Parens`` finds the matching parenthesis through blocks of excess minima and a
tree over them; it delimits a node's subtree.  Rank over the leaf pairs counts
leaves, cumulative arrays in preorder give members and savings.

Nodes on a shard's first or last path (its spine) may go on in other shards.
They are merged by identity: members and the part of the subtree off the spine
add up, then each merged node's share goes to its ancestors.  All other nodes
are whole in their shard.

Deeper blocks hang below the last turn of a full block.  Their totals are
passed up by doubling (a logarithmic number of joins in the longest
conversation's blocks) before the blocks above are evaluated.

SHA-256 of a node's ends is made in its shard, or, for a spine node, by one
task that streams the joined ids of all its shards in order: a hash is one
chain by nature.

Defined cases: rows without a conversation id are left out; null turn numbers
come first, equal ones in the order of a digest of role and text; null roles
and texts are empty; repeated rows are turns of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import bound_batches, stored

BLOCK = 256            # turns of a row
SHARD_TURNS = 1 << 17  # turns and rows of a shard
SHARD_ROWS = 1 << 15
WORD = 64              # parentheses of an excess block


# -- balanced parentheses ---------------------------------------------------------------------------

class Parens:
    """Matching parentheses of a sequence of +1 (open) and -1 (close)."""

    def __init__(self, steps: np.ndarray):
        self.steps = steps
        self.excess = np.cumsum(steps, dtype=np.int64)
        n = len(steps)
        whole = 1 << max(0, math.ceil(math.log2(max(1, -(-n // WORD)))))
        padded = np.full(whole * WORD, np.iinfo(np.int64).max)
        padded[:n] = self.excess
        self.padded = padded
        self.tree = np.empty(2 * whole, np.int64)      # minima: node i over nodes 2i and 2i + 1
        self.tree[whole:] = padded.reshape(whole, WORD).min(axis=1)
        size = whole
        while size > 1:
            self.tree[size // 2:size] = np.minimum(self.tree[size:2 * size:2], self.tree[size + 1:2 * size:2])
            size //= 2
        self.whole = whole

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The close of each open: the first later place whose excess is one
        less than at the open."""
        want = self.excess[opens] - 1
        out = np.full(len(opens), -1, np.int64)
        at, live = opens + 1, np.arange(len(opens))
        for _ in range(WORD):                          # inside the open's own block
            inside = (at[live] % WORD != 0) & (at[live] < len(self.padded))
            live = live[inside]
            hit = self.padded[at[live]] <= want[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            if not len(live):
                break
        rest = np.flatnonzero(out < 0)
        node = opens[rest] // WORD + self.whole
        w = want[rest]
        up = np.ones(len(rest), bool)
        while up.any():                                # to the first right neighbour that dips low enough
            right = (node % 2 == 0) & (self.tree[np.minimum(node + 1, 2 * self.whole - 1)] <= w)
            found = up & right
            node = np.where(found, node + 1, np.where(up, node // 2, node))
            up &= ~found
            if (node[up] < 1).any():
                raise ValueError("parentheses do not match")
        while (node < self.whole).any():
            down = node < self.whole
            left = self.tree[np.minimum(2 * node, 2 * self.whole - 1)] <= w
            node = np.where(down, np.where(left, 2 * node, 2 * node + 1), node)
        block = (node - self.whole)[:, None] * WORD + np.arange(WORD)
        for a in range(0, len(rest), 4096):
            b = block[a:a + 4096]
            out[rest[a:a + 4096]] = b[np.arange(len(b)), (self.padded[b] <= w[a:a + 4096, None]).argmax(axis=1)]
        return out


def least_in(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of each range [start, end) by a table of doubled ranges."""
    level, table = np.frexp(np.maximum(end - start, 1))[1] - 1, values
    out = np.empty(len(start), values.dtype)
    for k in range(int(level.max(initial=0)) + 1):
        own = level == k
        out[own] = np.minimum(table[start[own]], table[end[own] - (1 << k)])
        table = np.minimum(table[:max(len(table) - (1 << k), 0)], table[1 << k:])
    return out


# -- a shard ----------------------------------------------------------------------------------------

NODE = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pa", pa.int64()), ("pb", pa.int64()),
                  ("spine", pa.bool_()), ("root", pa.bool_()), ("above", pa.bool_()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                  ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                  ("size", pa.int64()), ("exit_children", pa.int64()), ("exit_leaves", pa.int64()), ("exit_saved", pa.int64()),
                  ("up_a", pa.list_(pa.int64())), ("up_b", pa.list_(pa.int64())), ("ends", pa.binary()), ("first_end", pa.int64())])
NODE_DDL = ("depth long, a long, b long, pa long, pb long, spine boolean, root boolean, above boolean, conv_id long, "
            "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, exit_children long, "
            "exit_leaves long, exit_saved long, up_a array<long>, up_b array<long>, ends binary, first_end long")


def _before(sums: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sums)])


def shard(t: pa.Table, block: int) -> pa.Table:
    """The nodes of one shard: sorted rows (s, pa, pb, conv_id, path of
    (a, b), sizes, ends, exit_children, exit_leaves, exit_saved)."""
    m = t.num_rows
    t = t.combine_chunks()
    col = {c: t.column(c).chunk(0) for c in t.column_names}
    num = {c: col[c].to_numpy(zero_copy_only=False) for c in ("s", "pa", "pb", "conv_id", "exit_children", "exit_leaves", "exit_saved")}
    ended = col["ends"].to_numpy(zero_copy_only=False).astype(bool)
    length = np.diff(col["path"].offsets.to_numpy()).astype(np.int64)
    flat = col["path"].flatten()
    a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    sizes = col["sizes"].flatten().to_numpy(zero_copy_only=False)
    start = _before(length)[:-1]

    # Common prefix lengths of neighbours; -1 where another block begins.
    lcp = np.full(m, -1, np.int64)
    same = np.flatnonzero((num["s"][1:] == num["s"][:-1]) & (num["pa"][1:] == num["pa"][:-1]) & (num["pb"][1:] == num["pb"][:-1])) + 1
    both = np.minimum(length[same], length[same - 1])
    row = np.repeat(np.arange(len(same)), both)
    place = np.arange(len(row)) - np.repeat(_before(both)[:-1], both)
    p, q = start[same][row] + place, start[same - 1][row] + place
    differ = np.flatnonzero((a[p] != a[q]) | (b[p] != b[q]))
    rows, at = np.unique(row[differ], return_index=True)
    common = both.copy()
    common[rows] = place[differ[at]]
    lcp[same] = common

    # Nodes in preorder: row i opens those at depths lcp + 1 .. length.
    opened = length - lcp
    first = _before(opened)
    owner = np.repeat(np.arange(m), opened)
    depth = np.arange(len(owner)) - first[:-1][owner] + lcp[owner] + 1
    n = len(owner)
    is_root = depth == 0
    turn = np.where(is_root, 0, start[owner] + depth - 1)
    za, zb = (np.where(is_root, 0, z[turn] if len(z) else 0) for z in (a, b))
    size = np.where(is_root, 0, sizes[turn] if len(sizes) else 0)
    closed = np.concatenate([[0], length[:-1] - lcp[1:]])
    counts = np.stack([closed, opened], axis=1).ravel()
    steps = np.repeat(np.tile(np.array([-1, 1], np.int8), m), counts)
    steps = np.concatenate([steps, np.full(length[-1] + 1, -1, np.int8)])
    bp = Parens(steps)
    opens = np.flatnonzero(steps > 0)
    close = bp.findclose(opens)
    end = np.arange(n) + (close - opens + 1) // 2            # the subtree is [node, end) in preorder
    pairs = _before((steps[:-1] > 0) & (steps[1:] < 0))      # rank of leaf pairs
    # A row sits at the deepest node open after it.
    key = np.sort(depth * np.int64(n) + np.arange(n))
    sits = key[np.searchsorted(key, length * n + (first[1:] - 1), side="right") - 1] % n
    parent = np.where(is_root, -1, key[np.maximum(np.searchsorted(key, (depth - 1) * n + np.arange(n), side="right") - 1, 0)] % n)

    # Identities: the xor of the path; a row's own paths are accumulated.
    xa, xb = _path_xor(a, start, length), _path_xor(b, start, length)
    ida = num["pa"][owner] ^ np.where(is_root, 0, xa[turn] if len(xa) else 0)
    idb = num["pb"][owner] ^ np.where(is_root, 0, xb[turn] if len(xb) else 0)

    here = np.bincount(sits, minlength=n)
    members = _before(here)
    n_convs = members[end] - members[np.arange(n)]
    conv = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(conv, sits, num["conv_id"])
    least = least_in(conv, np.arange(n), end)
    exits = {}
    for c in ("exit_children", "exit_leaves", "exit_saved"):
        exits[c] = np.zeros(n, np.int64)
        np.maximum.at(exits[c], sits, num[c])
    children = np.bincount(parent[~is_root], minlength=n) + exits["exit_children"]
    leaf = np.where((end - np.arange(n) == 1) & (exits["exit_children"] == 0), 1, 0)
    open_pair = np.where(exits["exit_children"] > 0, end - np.arange(n) == 1, False)
    plain = pairs[close] - pairs[opens]                       # leaf pairs in the subtree
    continued = _before(open_pair)
    gained = _before(exits["exit_leaves"])
    leaves = plain - (continued[end] - continued[np.arange(n)]) + gained[end] - gained[np.arange(n)]
    own = (n_convs - 1) * size + exits["exit_saved"]
    saving = _before(own)
    saved = saving[end] - saving[np.arange(n)]

    # The spine: roots, and the paths to the first and the last row.
    spine = is_root.copy()
    for at in {int(sits[0]), int(sits[-1])}:
        while at >= 0:
            spine[at] = True
            at = int(parent[at])
    # What a spine node holds off the spine; its own share comes after the merge.
    off = ~spine & ~is_root
    off_top = off & spine[np.maximum(parent, 0)]
    spine_at = np.flatnonzero(spine)
    ex_children = np.bincount(parent[off_top], minlength=n)
    ex_leaves = np.bincount(parent[off_top], leaves[off_top].astype(np.float64), minlength=n).astype(np.int64)
    ex_saved = np.zeros(n, np.int64)
    np.add.at(ex_saved, parent[off_top], saved[off_top])

    ids = num["conv_id"]
    texts = [b""] * n
    firsts = np.full(n, np.iinfo(np.int64).max)
    end_rows = np.flatnonzero(ended)
    if len(end_rows):
        nodes = sits[end_rows]
        cuts = np.flatnonzero(np.diff(nodes)) + 1
        for run in np.split(end_rows, cuts):
            node = int(sits[run[0]])
            texts[node] = ",".join(map(str, ids[run].tolist())).encode()
            firsts[node] = ids[run[0]]
    empty = hashlib.sha256(b"").digest()
    told = [t if s else (hashlib.sha256(t).digest() if t else empty) for t, s in zip(texts, spine.tolist())]
    ups_a: list = [None] * n
    ups_b: list = [None] * n
    for v in spine_at.tolist():
        up, at = [], int(parent[v])
        while at >= 0:
            up.append(at)
            at = int(parent[at])
        ups_a[v], ups_b[v] = ida[up].tolist(), idb[up].tolist()
    up = np.maximum(parent, 0)
    s = num["s"][owner]
    values = {
        "depth": s * block + depth, "a": ida, "b": idb, "pa": np.where(is_root, 0, ida[up]), "pb": np.where(is_root, 0, idb[up]),
        "spine": spine, "root": is_root, "above": ~is_root & spine[up], "conv_id": least,
        "parent_conv_id": np.where(is_root, -1, least[up]), "n_convs": n_convs,
        "n_children": np.where(spine, ex_children, children), "n_leaves": np.where(spine, ex_leaves, leaves),
        "saved_tokens": np.where(spine, ex_saved, saved), "size": size, **exits}
    arrays = [pa.array(values[f.name], f.type) if f.name in values else None for f in NODE]
    extra = {"up_a": ups_a, "up_b": ups_b, "ends": told, "first_end": firsts}
    arrays = [x if x is not None else pa.array(extra[f.name], f.type) for x, f in zip(arrays, NODE)]
    return pa.Table.from_arrays(arrays, schema=NODE)


def _path_xor(z: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Running xor inside each row's part of ``z``."""
    if not len(z):
        return z
    total = np.bitwise_xor.accumulate(z)
    before = np.concatenate([[0], total])[start]
    return total ^ np.repeat(before, length)


def _shards(sorted_rows: DataFrame, block: int, shard_turns: int, shard_rows: int) -> DataFrame:
    """Nodes of the shards that each task cuts its sorted rows into."""
    def run(batches):
        held, turns, rows = [], 0, 0
        for b in batches:
            size = np.cumsum(np.diff(b.column(b.schema.get_field_index("path")).offsets.to_numpy()).astype(np.int64) + 1)
            at = 0
            while at < b.num_rows:
                done = int(size[at - 1]) if at else 0
                to = int(np.searchsorted(size, done + shard_turns - turns, side="left")) + 1
                to = max(at + 1, min(to, at + shard_rows - rows, b.num_rows))
                held.append(b.slice(at, to - at))
                turns, rows, at = turns + int(size[to - 1]) - done, rows + to - at, to
                if turns >= shard_turns or rows >= shard_rows:
                    yield from shard(pa.Table.from_batches(held), block).to_batches(max_chunksize=8192)
                    held, turns, rows = [], 0, 0
        if held:
            yield from shard(pa.Table.from_batches(held), block).to_batches(max_chunksize=8192)

    return sorted_rows.mapInArrow(run, NODE_DDL)


# -- ordered turns ----------------------------------------------------------------------------------

def turn_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, turn, key, size): the turn's digest in place of its text."""
    bound_batches(conversations.sparkSession)
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(told, 256), 1, 32)).alias("key"), F.octet_length(text).cast("long").alias("size")) \
        .where(F.col("conv_id").isNotNull())


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, key, size), places from 1 in turn order.

    Rows are range-partitioned by (conversation, turn), so one conversation may
    lie in many partitions; each numbers its own part, and the parts' counts (a
    row for each conversation and partition) move the numbers on."""
    def number(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            fresh = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
            at = np.arange(len(ids))
            begin = np.maximum.accumulate(np.where(fresh, at, -n))
            place = at - begin + 1
            last, n = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(place, pa.int64()),
                                              b.column(2), b.column(3)], ["conv_id", "part", "place", "key", "size"])

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.asc_nulls_first("turn"), "key", "size"]
    rows = stored(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                  .mapInArrow(number, "conv_id long, part int, place long, key binary, size long"), "turns")
    counts = rows.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    torn = counts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 1)
    after = torn.select("conv_id", F.explode("parts").alias("p"), "parts").select(
        "conv_id", F.col("p.part").alias("part"),
        F.aggregate(F.filter("parts", lambda q: q["part"] < F.col("p.part")), F.lit(0).cast("long"), lambda s, q: s + q["n"]).alias("before"))
    after = stored(after.where("before > 0"), "torn")
    return rows.join(after, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "key", "size")


def as_paths(ordered: DataFrame) -> DataFrame:
    """The input of ``prefix_trie`` for conversations as they are."""
    n = ordered.groupBy("conv_id").agg(F.max("place").alias("n"))
    rows = ordered.join(n, "conv_id").select("conv_id", F.col("place").alias("d"), "key", "size", (F.col("place") == F.col("n")).alias("last"))
    return rows.unionByName(n.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("key"),
                                     F.lit(0).cast("long").alias("size"), (F.col("n") == 0).alias("last")))


def with_shared_heads(ordered: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """As ``as_paths`` after every conversation c takes over the first h turns
    of conversation c - c % family in place of its own first h, where h is the
    CRC-32 of its decimal id modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ordered = stored(ordered, "ordered")
    heads = (ordered.where((F.col("conv_id") % family == 0) & (F.col("place") < most)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("place", "key", "size"))).alias("heads")).withColumnRenamed("conv_id", "base"))
    convs = ordered.groupBy("conv_id").agg(F.max("place").alias("own"))
    convs = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "base", "left")
    taken = F.slice(F.coalesce("heads", F.array().cast("array<struct<place:bigint,key:binary,size:bigint>>")), 1, F.col("h").cast("int"))
    convs = convs.withColumn("heads", F.when(F.col("h") > 0, taken).otherwise(F.filter("heads", lambda x: F.lit(False))))
    held = F.greatest(F.size(F.coalesce("heads", F.array().cast("array<struct<place:bigint,key:binary,size:bigint>>"))), F.lit(0)).cast("long")
    convs = stored(convs.select("conv_id", "heads", held.alias("held"), "h",
                                (held + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "heads")
    first = convs.select("conv_id", F.explode("heads").alias("x"), "n").select(
        "conv_id", F.col("x.place").alias("d"), F.col("x.key").alias("key"), F.col("x.size").alias("size"), "n")
    rest = (ordered.where(F.col("place") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
            .join(convs.select("conv_id", "h", "held", "n"), "conv_id")
            .select("conv_id", (F.col("place") - F.col("h") + F.col("held")).alias("d"), "key", "size", "n"))
    top = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("key"),
                       F.lit(0).cast("long").alias("size"), "n")
    rows = first.unionByName(rest).unionByName(top)
    return rows.select("conv_id", "d", "key", "size", (F.col("d") == F.col("n")).alias("last"))


# -- the trie ---------------------------------------------------------------------------------------

def _blocks(paths: DataFrame, block: int) -> DataFrame:
    """A row for each conversation and block of its turns, with the identity
    of the prefix before it."""
    s = F.floor(F.greatest(F.col("d") - 1, F.lit(0)) / block).cast("long").alias("s")
    turn = F.when(F.col("d") > 0, F.struct("d", F.xxhash64("d", "key").alias("a"), F.xxhash64("key", F.lit(7), "d").alias("b"), "size"))
    rows = paths.select("conv_id", s, turn.alias("turn"), "last", "d")
    # A conversation that ends with a full block is a member of the next one's root.
    edge = rows.where(F.col("last") & (F.col("d") > 0) & (F.col("d") % block == 0)).select(
        "conv_id", (F.col("s") + 1).alias("s"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit(False).alias("last"), F.lit(0).cast("long").alias("d"))
    rows = rows.unionByName(edge)
    made = rows.groupBy("conv_id", "s").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.max("last").alias("ends"))
    made = stored(made, "blocks")

    def whole(side: str) -> Column:
        return F.aggregate("turns", F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[side]))

    # The identity before a block: two levels, so that no window meets a huge group.
    parts = made.select("conv_id", "s", whole("a").alias("xa"), whole("b").alias("xb"))
    wide = parts.groupBy("conv_id", F.floor(F.col("s") / 1024).alias("g")).agg(F.bit_xor("xa").alias("ga"), F.bit_xor("xb").alias("gb"))

    def before(c: str, by: list[str], order: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.bit_xor(c).over(w), F.lit(0).cast("long"))

    wide = wide.select("conv_id", "g", before("ga", ["conv_id"], "g").alias("ga"), before("gb", ["conv_id"], "g").alias("gb"))
    fine = parts.withColumn("g", F.floor(F.col("s") / 1024)).select(
        "conv_id", "s", "g", before("xa", ["conv_id", "g"], "s").alias("fa"), before("xb", ["conv_id", "g"], "s").alias("fb"), "xa", "xb")
    ids = fine.join(wide, ["conv_id", "g"]).select(
        "conv_id", "s", F.col("fa").bitwiseXOR(F.col("ga")).alias("pa"), F.col("fb").bitwiseXOR(F.col("gb")).alias("pb"), "xa", "xb")
    path = F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))
    return made.join(ids, ["conv_id", "s"]).select(
        "s", "pa", "pb", "conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"), "ends",
        F.col("pa").bitwiseXOR(F.col("xa")).alias("ea"), F.col("pb").bitwiseXOR(F.col("xb")).alias("eb"))


EXITS = ["exit_children", "exit_leaves", "exit_saved"]


def _evaluated(blocks: DataFrame, exits: DataFrame | None, block: int, shard_turns: int, shard_rows: int) -> DataFrame:
    """Shard nodes of the blocks, with the totals of what hangs below full ones."""
    zero = F.lit(0).cast("long")
    if exits is None:
        rows = blocks.withColumns({c: zero for c in EXITS})
    else:
        below = exits.select((F.col("s") - 1).alias("s"), F.col("pa").alias("ea"), F.col("pb").alias("eb"), *EXITS)
        rows = blocks.join(below, ["s", "ea", "eb"], "left")
        full = F.size("path") == block
        rows = rows.withColumns({c: F.when(full, F.coalesce(c, zero)).otherwise(zero) for c in EXITS})
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["s", "pa", "pb", "path", "conv_id"]
    rows = rows.select(*order, "sizes", "ends", *EXITS).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(_shards(rows, block, shard_turns, shard_rows), "shards")


def _merged(nodes: DataFrame) -> DataFrame:
    """Spine nodes by identity, with the totals of their subtrees."""
    ids = ["root", "depth", "a", "b"]
    one = stored(nodes.where("spine").groupBy(*ids).agg(
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("off_children"), F.sum("n_leaves").alias("off_leaves"), F.sum("saved_tokens").alias("off_saved"),
        F.max("size").alias("size"), *[F.max(c).alias(c) for c in EXITS], F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b")), "spine")
    # A parent is a root if it is the node's last ancestor.
    parent = one.where(~F.col("root")).select((F.size("up_a") == 1).alias("root"), (F.col("depth") - 1).alias("depth"),
                                              F.col("pa").alias("a"), F.col("pb").alias("b"))
    born = parent.groupBy(*ids).agg(F.count(F.lit(1)).alias("born"))
    one = one.join(born, ids, "left")
    n = F.col("off_children") + F.coalesce("born", F.lit(0)) + F.col("exit_children")
    one = stored(one.withColumn("n_children", n), "spine")
    leaves = F.col("off_leaves") + F.col("exit_leaves") + (F.col("n_children") == 0).cast("long")
    saved = F.col("off_saved") + F.col("exit_saved") + (F.col("n_convs") - 1) * F.col("size")
    up = F.transform(F.arrays_zip("up_a", "up_b"), lambda x, i: F.struct(
        (i == F.size("up_a") - 1).alias("root"), (F.col("depth") - 1 - i).cast("long").alias("depth"), x["up_a"].alias("a"), x["up_b"].alias("b")))
    own = F.array(F.struct("root", "depth", "a", "b"))
    share = one.select(F.explode(F.concat(own, up)).alias("to"), leaves.alias("l"), saved.alias("v")).groupBy(
        *[F.col(f"to.{c}").alias(c) for c in ids]).agg(F.sum("l").alias("n_leaves"), F.sum("v").alias("saved_tokens"))
    parents = one.select("root", "depth", "a", "b", F.col("conv_id").alias("parent_conv_id"))
    out = one.select(*ids, "pa", "pb", "conv_id", "n_convs", "n_children", (F.size("up_a") == 1).alias("under_root"), "size").join(share, ids)
    of = out.select(*ids, F.col("under_root").alias("root_"), (F.col("depth") - 1).alias("depth_"), "pa", "pb")
    of = of.join(parents.select(F.col("root").alias("root_"), F.col("depth").alias("depth_"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                                "parent_conv_id"), ["root_", "depth_", "pa", "pb"], "left").select(*ids, "parent_conv_id")
    return stored(out.join(of, ids), "merged")


def _below(blocks: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(s, pa, pb, exit_*): children of each deeper block's root, and leaves
    and savings of everything below it, blocks under blocks by doubling.  A
    block takes the place of the leaf it hangs on, so it adds its leaves less one."""
    roots = _merged(nodes).where("root").select(
        (F.col("depth") / block).cast("long").alias("s"), F.col("a").alias("pa"), F.col("b").alias("pb"),
        F.col("n_children").alias("exit_children"), F.when(F.col("n_children") == 0, 0).otherwise(F.col("n_leaves") - 1).alias("leaves"),
        F.col("saved_tokens").alias("saved"))
    own = blocks.where("s >= 1").select("conv_id", "s", "pa", "pb")
    link = own.join(own.select("conv_id", (F.col("s") + 1).alias("s"), F.col("pa").alias("qa"), F.col("pb").alias("qb")), ["conv_id", "s"])
    link = link.select("s", "pa", "pb", "qa", "qb").distinct()
    state = stored(roots.join(link, ["s", "pa", "pb"], "left"), "below")
    most, jump = state.agg(F.max("s")).first()[0], 1
    while jump < most:
        # Totals of ancestors at distance ``jump`` grow by their descendants' totals.
        gain = state.where(F.col("qa").isNotNull()).groupBy((F.col("s") - jump).alias("s"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.select((F.col("s") + jump).alias("s"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("qa").alias("na"), F.col("qb").alias("nb"))
        state = stored(state.join(gain, ["s", "pa", "pb"], "left").join(above, ["s", "qa", "qb"], "left").select(
            "s", "pa", "pb", "exit_children", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("na").alias("qa"), F.col("nb").alias("qb")), "below")
        jump *= 2
    return state.select("s", "pa", "pb", "exit_children", (F.col("leaves") + (F.col("exit_children") > 0).cast("long")).alias("exit_leaves"), F.col("saved").alias("exit_saved"))


def _spine_ends(nodes: DataFrame) -> DataFrame:
    """SHA-256 of the joined ids of each spine node's ends, streamed in order."""
    def run(batches):
        last, state = None, None
        for b in batches:
            out = []
            for depth, a, c, _, ids in zip(*[x.to_pylist() for x in b.columns]):
                if (depth, a, c) != last:
                    if last is not None:
                        out.append((*last, state.digest()))
                    last, state = (depth, a, c), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 ["depth", "a", "b", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*last, state.digest()), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             ["depth", "a", "b", "ends"])

    chunks = nodes.where(F.col("spine") & (F.octet_length("ends") > 0)).select("depth", "a", "b", "first_end", "ends")
    return (chunks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first_end")
            .mapInArrow(run, "depth long, a long, b long, ends binary"))


def prefix_trie(paths: DataFrame, block: int = BLOCK, shard_turns: int = SHARD_TURNS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the trie of ``paths`` (``as_paths``): (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    blocks = stored(_blocks(paths, block), "paths")
    deep = blocks.where("s >= 1")
    exits = None
    if deep.limit(1).count():
        exits = _below(blocks, _evaluated(deep, None, block, shard_turns, shard_rows), block)
    nodes = _evaluated(blocks, exits, block, shard_turns, shard_rows)
    spine = _merged(nodes)
    ends = _spine_ends(nodes)
    # A deeper block's root is the last node of the block above it.
    real = ~F.col("root") | (F.col("depth") == 0)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    merged = spine.where(real).join(ends, ["depth", "a", "b"], "left").withColumn(
        "ends", F.coalesce("ends", F.unhex(F.sha2(F.lit("").cast("binary"), 256)))).select(*columns)
    inner = nodes.where(~F.col("spine"))
    # The top of a whole subtree hangs below a merged node.
    top = inner.where("above").drop("parent_conv_id").join(
        spine.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), "root",
                     F.col("conv_id").alias("parent_conv_id")).groupBy("depth", "pa", "pb").agg(F.min("parent_conv_id").alias("parent_conv_id")),
        ["depth", "pa", "pb"])
    out = merged.unionByName(inner.where(~F.col("above")).select(*columns)).unionByName(top.select(*columns))
    return out.withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends")
