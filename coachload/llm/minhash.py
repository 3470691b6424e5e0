"""MinHash near-dedup (5) by a signature-coordinate inverted join.

Texts with the same shingle set form a class; one row of it stands for all.  A
class has ``K`` MinHash coordinates.  A pair that shares the wanted similarity
agrees on at least ``need`` of them (but for a chance of about one in a
million; ``agreement``), so it differs on at most K - need, and if the
coordinates are dealt into K - need + 1 prefix groups it agrees on a whole
group.  Classes are posted under each group's coordinate-value pairs; only
classes that meet in a posting list are candidates, their collisions are
counted over all coordinates (the merge skips a pair once it cannot reach
``need``), and those at or above it are confirmed on the full shingle sets.

Components don't need all pairs of a list.  Two rounds link each list's members
to a few hubs only, which joins large groups of near copies in linear work.
What then still lies in one list under different labels is compared in blocks
of at most BLOCK members and SHINGLES shingles:
every member is in one block of targets, and the members outside the list's
most frequent label are in one block of queries too; each block of queries
meets each block of targets, so a task's group is bounded.  A list of more
than LONG blocks is dealt out first: the pigeonhole holds for any dealing of
the coordinates, so its members are posted again under the list and the groups
of a second dealing, and a wanted pair still meets, in shorter lists.  It counts collisions of
all its pairs at once, takes each pair in the first list it shares only,
confirms the rest by one product of shingle-incidence matrices, and emits a
spanning forest of the links found, so its output is linear in its members.
No pair of different labels is left out.

Texts travel compressed, and only those of classes that share a list.

Defined cases: null and empty texts, and texts without words, have an empty set
and are linked with nothing; a text of fewer words than a shingle is one
shingle; the smallest id that isn't null names a component, which is null if
all ids are; rows that repeat an id are one class or several like any other
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordHashes, as_bytes, named, slices, stored
from .components import components

K = 128
HUBS = 4
BLOCK = 4096
SHINGLES = 1 << 22
LONG = 32
COLUMNS = 4096  # of an incidence matrix at a time
_MUL = np.uint64(0x9E3779B97F4A7C15)


def agreement(percent: int) -> int:
    """Coordinates on which a pair of at least that similarity agrees, short
    of 4.75 standard deviations below the mean."""
    p = percent / 100
    return max(1, math.floor(K * p - 4.75 * math.sqrt(K * p * (1 - p))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = cache.of(text.lower().split())
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mix(out * _MUL + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def coordinates() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, K, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, K) uint16; no set is empty."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), K), np.uint16)
    for j, (a, b) in enumerate(zip(*coordinates())):
        out[:, j] = (np.minimum.reduceat(x * a + b, starts) >> np.uint64(20)).astype(np.uint16)
    return out


def _described(width: int):
    def run(batches):
        cache, pack = WordHashes(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for part in slices(b, 2):
                raw = part.column(2).to_pylist()
                sets = [shingles(t, width, cache) for t in raw]
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full) if full else [])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([pack.compress(t) if len(s) else None for t, s in zip(raw, sets)], pa.binary())],
                    ["rid", "doc_id", "n", "digest", "sig", "z"])
    return run


def groups_of(need: int) -> list[np.ndarray]:
    """The prefix groups: one more than the coordinates a pair may differ on."""
    return np.array_split(np.arange(K), K - need + 1)


def second_groups(need: int) -> list[np.ndarray]:
    """Another dealing into as many groups: every so many-th coordinate."""
    n = K - need + 1
    return [np.arange(g, K, n) for g in range(n)]


def _posted(need: int):
    """Class signatures -> one posting per prefix group."""
    groups = groups_of(need)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, K).astype(np.uint64)
            reps = b.column(0)
            for g, of in enumerate(groups):
                key = np.full(len(sig), np.uint64(g + 1))
                for j in of:
                    key = _mix(key * _MUL + sig[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), reps, pa.array(np.full(len(sig), g, np.int32)), b.column(2)],
                                                 ["key", "rep", "g", "size"])
    return run


def _posted_again(need: int):
    """Members of long lists -> one posting per list and group of the second dealing."""
    groups = second_groups(need)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, K).astype(np.uint64)
            first = b.column(0).to_numpy().view(np.uint64)
            for g, of in enumerate(groups):
                key = _mix(first * _MUL + np.uint64(g + 1))
                for j in of:
                    key = _mix(key * _MUL + sig[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns[2:]], ["key", "g", "rep", "lab", "size"])
    return run


def _linked(percent: int, width: int, need: int):
    """Candidate pairs with both sides' content -> confirmed links."""
    def run(batches):
        cache, unpack = WordHashes(), zstandard.ZstdDecompressor()
        last: tuple = (None, None)
        for b in batches:
            a, sig_a, n_a, z_a, c, sig_c, n_c, z_c = [col.to_pylist() for col in b.columns]
            found = []
            for i in range(b.num_rows):
                less, more = sorted((n_a[i], n_c[i]))
                if 100 * less < percent * more:
                    continue
                if (np.frombuffer(sig_a[i], np.uint16) == np.frombuffer(sig_c[i], np.uint16)).sum() < need:
                    continue
                if last[0] != a[i]:  # pairs come sorted by the first
                    last = a[i], shingles(unpack.decompress(z_a[i]), width, cache)
                other = shingles(unpack.decompress(z_c[i]), width, cache)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                if 100 * both >= percent * (n_a[i] + n_c[i] - both):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found, pa.int64())),
                                              b.column(4).take(pa.array(found, pa.int64()))], ["a", "b"])
    return run


def _confirm(pairs: DataFrame, content: DataFrame, percent: int, width: int, need: int) -> DataFrame:
    """Pairs (a, b) that are similar enough.  The join on ``a``, which many
    pairs may share, comes last: its sorted output lets a task keep a's set,
    and its large keys can be split."""
    def side(name):
        return content.select(F.col("rep").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n").alias(f"n_{name}"), F.col("z").alias(f"z_{name}"))

    both = pairs.distinct().join(side("b"), "b").join(side("a"), "a")
    return stored(both.select("a", "sig_a", "n_a", "z_a", "b", "sig_b", "n_b", "z_b")
                  .mapInArrow(_linked(percent, width, need), "a long, b long"), "links")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a's sets with b's: the product of their
    incidence matrices, over the shingles that two sets or more hold."""
    every = [*a, *b]
    own, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    keep = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        m = np.zeros((len(every), COLUMNS), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        out += m[:len(a)] @ m[len(a):].T
    return out.astype(np.int64)


def spanning(pairs: np.ndarray, reps: np.ndarray, labs: np.ndarray) -> list[tuple[int, int]]:
    """Of linked pairs (rows of places), as many as join all their labels."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, first = np.unique(labs[pairs], axis=0, return_index=True)
    out = []
    for i, j in pairs[first].tolist():
        x, y = find(int(labs[i])), find(int(labs[j]))
        if x != y:
            root[x] = y
            out.append((int(reps[i]), int(reps[j])))
    return out


def _compared(percent: int, width: int, need: int):
    """Rows of one pair of blocks (key, i, j, g, query, rep, lab, sig, n, z) ->
    links that join all labels which a query and a target link."""
    starts = np.array([g[0] for g in groups_of(need)])

    def run(key, t):
        query, g = t.column("query").to_numpy(), t.column("g")[0].as_py()
        rep, lab, n = (t.column(c).to_numpy() for c in ("rep", "lab", "n"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, K)
        targets, found = np.flatnonzero(~query), []
        for part in np.array_split(np.flatnonzero(query), max(1, len(targets) * int(query.sum()) // 60_000)):
            if not len(part):
                continue
            same = sig[part][:, None, :] == sig[targets][None, :, :]
            ok = (same.sum(axis=2) >= need) & (lab[part][:, None] != lab[targets][None, :])
            # the pair is dealt with in the first list that it shares
            ok &= np.logical_and.reduceat(same, starts, axis=2).argmax(axis=2) == g
            i, j = np.nonzero(ok)
            found.append(np.stack([part[i], targets[j]], axis=1))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        links = []
        if len(pairs):
            cache, unpack, z = WordHashes(), zstandard.ZstdDecompressor(), t.column("z")
            a, b = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
            sets = {i: shingles(unpack.decompress(z[i].as_py()), width, cache) for i in {*a.tolist(), *b.tolist()}}
            both = intersections([sets[i] for i in a.tolist()], [sets[i] for i in b.tolist()])
            both = both[np.searchsorted(a, pairs[:, 0]), np.searchsorted(b, pairs[:, 1])]
            pairs = pairs[100 * both >= percent * (n[pairs[:, 0]] + n[pairs[:, 1]] - both)]
            links = spanning(pairs, rep, lab)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})
    return run


def _stars(labels: DataFrame) -> DataFrame:
    """The labels as links (a, b): all that joined them so far."""
    return labels.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("lab", F.col("rep"))
    own = labels.select(F.col("node").alias("rep"), F.col("root").alias("lab"))
    return lists.join(own, "rep", "left").withColumn("lab", F.coalesce("lab", "rep"))


def _open_lists(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (key, rep, lab, size) of the lists that hold more than one label,
    and that label of a list which most of its members have."""
    of = _labelled(lists, labels)
    if labels is None:
        return of
    return _listed(of)


def _listed(of: DataFrame) -> DataFrame:
    """The lists of more than one label, with their sizes."""
    by = of.groupBy("key", "lab").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    some = (by.groupBy("key").agg(F.max_by("lab", F.struct("n", "lab")).alias("main"), F.count("*").alias("labs"),
                                  F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("size").alias("size"),
                                  F.max_by("size", F.struct("n", "lab")).alias("main_size"))
            .filter("labs > 1").select("key", "main", "n", (F.col("n") - F.col("most")).alias("n_rest"),
                                       F.col("size").alias("all_size"), (F.col("size") - F.col("main_size")).alias("rest_size")))
    return stored(of.join(some, "key"), "open")


def _hub_pairs(of: DataFrame, seed: int) -> DataFrame:
    """Each member with a hub of its list.  Lists take one of HUBS orders of
    their members, so that equal lists meet few different hubs."""
    order = F.xxhash64("rep", F.pmod(F.col("key"), F.lit(HUBS)) + seed * HUBS)
    prefer = F.when(F.col("lab") == F.col("main"), 0).otherwise(1) if "main" in of.columns else F.lit(0)
    hubs = of.groupBy("key").agg(F.min(F.struct(prefer.alias("p"), order.alias("o"), "rep", "lab")).alias("hub"))
    pairs = of.join(hubs, "key").filter(F.col("lab") != F.col("hub.lab"))
    return pairs.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))


def near_copies(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    need = agreement(percent)
    rows = stored(named(docs, id_col, text_col)
                  .select(F.monotonically_increasing_id().alias("rid"), "doc_id", as_bytes().alias("text"))
                  .mapInArrow(_described(width), "rid long, doc_id long, n long, digest binary, sig binary, z binary"), "shingled")
    classes = stored(rows.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("rep")), "classes")
    reps = rows.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    postings = reps.select("rid", "sig", "n").mapInArrow(_posted(need), "key long, rep long, g int, size long")
    # stored, so that it comes to the join by an exchange of its own and the
    # members of a long list can be split
    shared = stored(postings.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    lists = stored(postings.join(shared, "key"), "lists")
    content = stored(rows.select(F.col("rid").alias("rep"), "sig", "n", "z")
                     .join(lists.select("rep").distinct(), "rep", "left_semi"), "content")

    members = lists.select("key", "rep")
    links = _confirm(_hub_pairs(_open_lists(members, None), 0), content, percent, width, need)
    labels = stored(components(links), "labels")
    # lists of two are done: the hub was one of them
    members = lists.filter("members > 2").select("key", "rep", "g", "size")
    more = _confirm(_hub_pairs(_open_lists(members, labels), 1), content, percent, width, need)
    if not more.isEmpty():
        labels = stored(components(_stars(labels).union(more)), "labels")
    rest = stored(_block_links(_open_lists(members, labels), content, percent, width, need), "links")
    if not rest.isEmpty():
        labels = stored(components(_stars(labels).union(rest)), "labels")

    roots = (classes.join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left")
             .select("digest", F.coalesce("root", "rep").alias("root")))
    of = rows.select("rid", "doc_id", "n", "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "rid"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (of.join(least, "root")
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def _block_links(of: DataFrame, content: DataFrame, percent: int, width: int, need: int) -> DataFrame:
    """Links between different labels of one list, found in blocks."""
    def count(n: str, size: str):
        return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / SHINGLES), F.lit(1)).cast("int")

    def blocked(lists: DataFrame) -> DataFrame:
        return lists.withColumns({"t_blocks": count("n", "all_size"), "q_blocks": count("n_rest", "rest_size")})

    def block(seed: int, of: str):
        return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(of).cast("long")).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    of = blocked(of)
    row = ["key", "g", "rep", "lab"]
    rows = of.filter(F.col("q_blocks") <= LONG).select(*row, "main", "t_blocks", "q_blocks")
    long = of.filter(F.col("q_blocks") > LONG)
    again = (long.join(content.select("rep", "sig"), "rep").select("key", "sig", "g", "rep", "lab", "size")
             .mapInArrow(_posted_again(need), "key long, g int, rep long, lab long, size long"))
    rows = rows.union(blocked(_listed(again)).select(*row, "main", "t_blocks", "q_blocks"))
    targets = rows.select(*row, block(1, "t_blocks").alias("i"), every("q_blocks").alias("j"), F.lit(False).alias("query"))
    queries = (rows.filter("lab <> main")
               .select(*row, every("t_blocks").alias("i"), block(2, "q_blocks").alias("j"), F.lit(True).alias("query")))
    return (targets.union(queries).join(content, "rep").groupBy("key", "i", "j")
            .applyInArrow(_compared(percent, width, need), "a long, b long"))


def drop_near_copies(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose document stays: one of each
    component.  Rows that repeat an id stay or go together."""
    gone = (near_copies(docs, percent, width, id_col, text_col).groupBy("doc_id").agg(F.max("kept").alias("kept"))
            .filter("not kept").select(F.col("doc_id").alias("__gone")))
    return docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__gone")), "left_anti")
