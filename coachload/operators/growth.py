"""Growing boosted trees inside barrier stages.

A stretch of rounds is one barrier stage.  Its tasks read their share of the
stored binned rows and grow all trees together:

    histograms   a task adds up the gradients of its rows, of the smaller child
                 of each split only
    scatter      features are dealt over the tasks; an owner reads its part of
                 every task's histograms, sums them in order, and has the
                 larger child as parent less sibling
    gather       the owners' best splits are read by all, so that every task
                 grows the same trees

If a task is lost, Spark starts the stage again from what the stretch before
left: its trees, and the rows with their margins if these are few.  Otherwise
the margins are added up again from the trees, so nothing is written.

Histograms pass through the shared checkpoint folder, one file a task and
step, removed as soon as all have moved on; ``BarrierTaskContext.allGather``
answers once a second at best (measured: 10 calls, 10.0 s) and hands every
message to every task, which is all tasks' histograms times the tasks.

Histograms are added up for packs of features: a row's bins of a pack are one
joint code, and the sums by code give the features' histograms, so a row costs
a step per pack, not per feature.  Only the combinations of bins that the
task's rows have are numbered, so features that depend on each other (an hour
and its part of the day, a station and its place) share a pack.  A pack's codes
stay within ``PACK`` and a share of the task's rows.

A task's state is its rows times (2 bytes per pack + 9 bytes per class of each
model that grows).  Up to ``MEMORY`` of it is held in memory, the rest in files
mapped from Spark's local folders, and models take turns where all of them would
need more than ``STATE``.  Rows are worked on a block at a time.  The stage needs
as many free slots as tasks.
"""

from __future__ import annotations

import math
import os
import pickle
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coachload.session import materialize, scratch_path

# Functions of this module travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HESS_FLOOR = 1e-16
TIE = 1e-10              # gains this close, as a share, are equal: the order of a sum must not choose the split
TRAIN, EVAL = 0, 1
ROWS = "y int, set int, fold int, hash long, bins binary, margins binary, note binary"
TINY = 1e-300            # the least probability whose logarithm is taken
MEMORY = 1 << 27         # bytes of state that a task holds in memory
STATE = 1 << 27          # bytes of models that grow side by side in a task
HANDED = 1 << 24         # bytes of models whose rows a task hands on to the next stretch
CHUNK = 1 << 14          # rows whose histogram index is held at a time
SORTED = 1 << 18         # rows that are put in the order of their nodes at a time
SUMS = 1 << 26           # bytes of sums by code that are held at a time
PACK = 1 << 14           # codes of a pack of features at most
TRIED = 4096             # rows that tell which features to try in a pack
BLOCK = 1 << 15          # rows that are moved to their children at a time
SCANNED = 2              # splits of a level at most whose rows are found by comparing, not looked up
BATCH = 8192             # rows of a batch that a task hands back
PATIENCE_S = 1800        # seconds a task waits for the others


class Folder:
    """What the tasks of one attempt of a stage write for each other."""

    def __init__(self, place: str, rank: int, size: int):
        self.fs, root = pafs.FileSystem.from_uri(place)
        self.root, self.rank, self.size, self.held = root, rank, size, []
        self.fs.create_dir(root, recursive=True)

    def path(self, step: str, rank: int) -> str:
        return f"{self.root}/{step}-{rank}"

    def put(self, step: str, data: bytes) -> None:
        """Visible whole or not at all."""
        part = self.path(step, self.rank) + ".part"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, self.path(step, self.rank))
        self.held.append(step)

    def get(self, step: str, ranks: range, at: int = 0, size: int | None = None) -> list[bytes]:
        """Bytes of every rank's file, once all are there."""
        paths, wait, end = [self.path(step, r) for r in ranks], 0.0005, time.monotonic() + PATIENCE_S
        missing = paths
        while missing:
            infos = self.fs.get_file_info(missing)
            missing = [p for p, i in zip(missing, infos) if i.type != pafs.FileType.File]
            if missing:
                if time.monotonic() > end:
                    raise TimeoutError(f"no {missing[0]} after {PATIENCE_S} s")
                time.sleep(wait)
                wait = min(2 * wait, 0.02)
        out = []
        for p in paths:
            with self.fs.open_input_file(p) as f:
                out.append(f.read() if size is None else f.read_at(size, at))
        return out

    def drop(self, keep: int) -> None:
        """Removes own files but the last ``keep``."""
        while len(self.held) > keep:
            self.fs.delete_file(self.path(self.held.pop(0), self.rank))


def uniform(seed: int, *keys) -> np.ndarray:
    """A hash of the keys as a number from 0 to 1."""
    x = np.full(1, seed * 2 + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in keys:
        x = x ^ np.asarray(k).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def softmax(margins: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=axis, keepdims=True))
    e /= e.sum(axis=axis, keepdims=True)
    return e


def fixed_bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]


def bytes_column(values: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as a binary value."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * values.shape[1]
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)])


class Room:
    """Arrays of zeros, in memory while these take ``most`` bytes at most, else
    in a file without a name, which goes with the array."""

    def __init__(self, most: int):
        self.left = most

    def zeros(self, shape: tuple, kind) -> np.ndarray:
        size = math.prod(shape) * np.dtype(kind).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(shape, kind)
        folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
        with tempfile.TemporaryFile(dir=next(filter(os.path.isdir, folders), None)) as f:
            return np.memmap(f, kind, "w+", shape=shape).view(np.ndarray)

    def back(self, array: np.ndarray) -> None:
        """The array isn't needed any more."""
        if array.base is None:
            self.left += array.nbytes


class Pack:
    """Features whose bins are one code a row: the number of the combination,
    of those that rows have."""

    def __init__(self, feature: int, column: np.ndarray, bins: int, room: Room):
        self.features, self.size = [feature], bins
        self.code = room.zeros(column.shape, np.uint16)
        self.code[:] = column
        self.bins = np.arange(bins)[None]       # of each feature, by code
        self.constant: list[int] = []           # features that have one bin

    def add(self, feature: int, column: np.ndarray, bins: int, most: int) -> bool:
        """Takes a feature in, unless there are more than ``most`` codes then."""
        if bins == 1:
            self.constant.append(feature)
            return True
        parts = [slice(a, a + BLOCK) for a in range(0, len(column), BLOCK)]
        joint = lambda part: self.code[part] * np.int32(bins) + column[part]
        seen = np.zeros(self.size * bins, bool)
        for i, part in enumerate(parts):
            seen[joint(part)] = True
            if i % 16 == 0 and np.count_nonzero(seen) > most:
                return False
        found = np.flatnonzero(seen)
        if len(found) > most:
            return False
        number = np.zeros(len(seen), np.uint16)
        number[found] = np.arange(len(found))
        for part in parts:
            self.code[part] = number.take(joint(part))
        self.size = len(found)
        self.bins = np.concatenate([self.bins.take(found // bins, axis=1), found[None] % bins])
        self.features.append(feature)
        return True

    def close(self, n_bins: int) -> Pack:
        """The order in which the sums by code are added up, by feature and
        bin, where a bin's begin, and its place."""
        order = [np.argsort(bins, kind="stable") for bins in self.bins]
        self.order = np.concatenate(order)
        at = np.concatenate([f * n_bins + bins.take(by) for f, bins, by in zip(self.features, self.bins, order)])
        self.starts = np.flatnonzero(np.diff(at, prepend=-1))
        self.places, self.constant_places = at.take(self.starts), np.array(self.constant, np.int64) * n_bins
        return self

    def margins(self, sums: np.ndarray, out: np.ndarray) -> None:
        """Sums by code (of gradient and hessian, as a complex number) as sums
        by feature and bin."""
        found, whole = np.add.reduceat(sums.take(self.order), self.starts), sums.sum()
        out[0, self.places], out[1, self.places] = found.real, found.imag
        out[0, self.constant_places], out[1, self.constant_places] = whole.real, whole.imag


def packed(bins: np.ndarray, sizes: np.ndarray, most: int, room: Room) -> list[Pack]:
    """The features (a row of ``bins`` each) in packs: next comes the one that
    makes the fewest codes on some rows; all rows tell whether it fits."""
    some = bins[:, ::max(1, bins.shape[1] // TRIED)].astype(np.int64)
    left, packs = np.argsort(-sizes, kind="stable").tolist(), []
    while left:
        first = left.pop(0)
        pack, missed = Pack(first, bins[first], int(sizes[first]), room), 0
        code, tried = some[first], list(left)
        while tried and missed < 4:
            counts = [len(np.unique(code * sizes[f] + some[f])) for f in tried]
            f = tried.pop(int(np.argmin(counts)))
            if min(counts) > most:
                break
            if pack.add(f, bins[f], int(sizes[f]), most):
                code = np.unique(code * sizes[f] + some[f], return_inverse=True)[1]
                left.remove(f)
            else:
                missed += 1
        packs.append(pack)
    return packs


class Rows:
    """The rows of one task, a row of each array per feature or class; those of
    the training part come first.  ``n``: their number, if ``batches`` is no
    list."""

    def __init__(self, batches, n_features: int, n_models: int, n_classes: int, n: int | None = None):
        if n is None:
            batches = list(batches)
            n = sum(b.num_rows for b in batches)
        self.n, self.n_features, self.n_classes, self.room = n, n_features, n_classes, Room(MEMORY)
        bins = self.room.zeros((n_features, n), np.uint8)
        self.y = self.room.zeros((n,), np.int16)
        self.fold: np.ndarray | None = None              # only folds need it
        self.hash: np.ndarray | None = None              # only samples of the rows need it
        self.margins: np.ndarray | None = None
        first, last = 0, n
        for b in batches:
            if not b.num_rows:
                continue
            y, part, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = fixed_bytes(b.column(4)).reshape(-1, n_features)
            margins = None if b.column(5).null_count else fixed_bytes(b.column(5)).view(np.float64).reshape(-1, n_models, n_classes)
            if margins is not None and self.margins is None:
                self.margins = self.room.zeros((n_models, n_classes, n), np.float64)
            if self.fold is None and (fold != -1).any():
                self.fold = self.room.zeros((n,), np.int16)
                self.fold[:] = -1
            if self.hash is None and not b.column(3).null_count:
                self.hash = self.room.zeros((n,), np.int64)
            for own in (np.flatnonzero(part == TRAIN), np.flatnonzero(part != TRAIN)):
                if not len(own):
                    continue
                if part[own[0]] == TRAIN:
                    s = slice(first, first + len(own))
                    first = s.stop
                else:
                    s = slice(last - len(own), last)
                    last = s.start
                self.y[s], bins[:, s] = y[own], x[own].T
                if self.fold is not None:
                    self.fold[s] = fold[own]
                if self.hash is not None:
                    self.hash[s] = b.column(3).to_numpy(zero_copy_only=False)[own]
                if margins is not None:
                    self.margins[:, :, s] = margins[own].transpose(1, 2, 0)
        self.n_train = first
        if self.fold is None:
            self.fold = np.broadcast_to(np.int16(-1), (n,))
        if self.margins is None:
            self.margins = self.room.zeros((n_models, n_classes, n), np.float64)
        self.sizes = bins.max(axis=1, initial=0).astype(np.int64) + 1
        self.packs = packed(bins, self.sizes, min(PACK, max(1, n // 64)), self.room)
        self.room.back(bins)                             # the packs' codes tell them
        #: (pack, place in it) of each feature that has more than one bin here
        self.place = {f: (q, i) for q, pack in enumerate(self.packs) for i, f in enumerate(pack.features)}

    def bins(self, part: slice) -> np.ndarray:
        out = np.zeros((self.n_features, len(self.y[part])), np.uint8)
        for f, (q, i) in self.place.items():
            out[f] = self.packs[q].bins[i].take(self.packs[q].code[part])
        return out

    def batches(self, note: bytes | None, with_rows: bool = True):
        for a in range(0, self.n if with_rows else 0, BATCH):
            s = slice(a, a + BATCH)
            held = len(self.y[s])
            part = np.where(np.arange(a, a + held) < self.n_train, TRAIN, EVAL)
            yield pa.RecordBatch.from_arrays([
                pa.array(self.y[s], pa.int32()), pa.array(part, pa.int32()), pa.array(self.fold[s].astype(np.int32)),
                pa.nulls(held, pa.int64()) if self.hash is None else pa.array(self.hash[s]),
                bytes_column(self.bins(s).T), bytes_column(self.margins[:, :, s].reshape(-1, held).T), pa.nulls(held, pa.binary())], _NAMES)
        if note is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())]
                                             + [pa.array([note], pa.binary())], _NAMES)


_NAMES = ["y", "set", "fold", "hash", "bins", "margins", "note"]


class Tree:
    """Node i has children 2i + 1 (bin at most ``bin``) and 2i + 2."""

    def __init__(self, depth: int, feature: np.ndarray, bin: np.ndarray, gain: np.ndarray, value: np.ndarray):
        self.depth, self.feature, self.bin, self.gain, self.value = depth, feature, bin, gain, value

    def parts(self) -> tuple:
        return self.depth, self.feature, self.bin, self.gain, self.value

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(depth, np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, value) with every path ``depth`` long: a leaf passes
        its rows, whose bins are at most 255, and its value to the left."""
        feature, cut, value = np.maximum(self.feature, 0).astype(np.int32), np.where(self.feature < 0, 255, self.bin).astype(np.int32), self.value.copy()
        for node in np.flatnonzero(self.feature[:(1 << self.depth) - 1] < 0).tolist():
            value[2 * node + 1] = value[node]
        return feature, cut, value

    def outputs(self, bins: np.ndarray) -> np.ndarray:
        return self.outputs_of(np.ascontiguousarray(bins.T))

    def outputs_of(self, bins: np.ndarray) -> np.ndarray:
        """The value of each row; ``bins``: a row per feature."""
        if not hasattr(self, "_whole"):
            self._whole = self.whole()
        feature, cut, value = self._whole
        n = bins.shape[1]
        flat, rows, node = bins.ravel(), np.arange(n), np.zeros(n, np.int64)
        for level in range(self.depth):
            if level:
                right = flat.take(feature.take(node).astype(np.int64) * n + rows) > cut.take(node)
            else:
                right = bins[feature[0]] > cut[0]
            node *= 2
            node += 1
            node += right
        return value.take(node)


class Run:
    """One model being grown: its setting, the fold it leaves out, its trees,
    and its right answers on that fold after the rounds in ``marks``."""

    def __init__(self, params, fold: int | None = None, marks: tuple[int, ...] = ()):
        self.params, self.fold, self.marks = params, fold, marks
        self.trees: list[list[Tree]] = []
        self.open = True
        self.history: dict[str, list[float]] = {"train": [], "eval": []}
        self.best: tuple[float, int] = (math.inf, -1)
        self.right: dict[int, tuple[int, int]] = {}
        self.rows: dict[str, int] = {}

    @property
    def growing(self) -> bool:
        return self.open and len(self.trees) < self.params.rounds

    def note(self, means: dict[int, float], with_eval: bool) -> None:
        """The log-losses after a round; closes a run that stopped improving."""
        done = len(self.trees)
        self.history["train"].append(means.get(TRAIN))
        if not with_eval:
            return
        loss = means.get(EVAL, math.inf)
        self.history["eval"].append(loss)
        if loss < self.best[0] - 1e-12:
            self.best = (loss, done)
        elif self.params.patience and done - self.best[1] >= self.params.patience:
            self.open = False


class Grower:
    """Grows one round after the other on a task's rows, in step with the
    other tasks."""

    def __init__(self, rows: Rows, runs: list[Run], folder: Folder, n_classes: int, n_bins: int, with_eval: bool):
        self.rows, self.runs, self.folder, self.with_eval = rows, runs, folder, with_eval
        self.k, self.f, self.b = n_classes, rows.n_features, n_bins
        self.owners = min(folder.size, self.f)
        self.own = [np.arange(o, self.f, self.owners) for o in range(self.owners)]
        self.steps = 0
        self.packs = [pack.close(n_bins) for pack in rows.packs]
        last = max((2 << r.params.max_depth) - 2 for r in runs)
        self.nodes = rows.room.zeros((len(runs), self.k, rows.n), np.uint8 if last < 256 else np.int16)
        self.samples: dict[int, np.ndarray] = {}
        self.soft: set[int] = set()          # models whose place of margins holds probabilities

    def add_up(self) -> None:
        """The margins, from the trees grown before."""
        for a in range(0, self.rows.n, BATCH):
            part = slice(a, a + BATCH)
            margins = np.zeros((len(self.runs), self.k, len(self.rows.y[part])))
            if any(run.trees for run in self.runs):
                bins = self.rows.bins(part)
                for m, run in enumerate(self.runs):
                    for trees in run.trees:
                        for k, tree in enumerate(trees):
                            margins[m, k] += tree.outputs_of(bins)
            self.rows.margins[:len(self.runs), :, part] = margins

    def close(self) -> None:
        """Margins again (each row's are off by one number, which no class sees)."""
        for m in self.soft:
            for part in self._parts():
                p = self.rows.margins[m, :, part]
                np.log(np.maximum(p, TINY, out=p), out=p)
        self.soft.clear()
        self.rows.room.back(self.nodes)
        for index in self.samples.values():
            self.rows.room.back(index)

    def _parts(self):
        return (slice(a, a + BLOCK) for a in range(0, self.rows.n, BLOCK))

    def _used(self, live: list[int]) -> dict:
        """The rows of each model's next trees: the first ones, or an index."""
        n, out, found = self.rows.n_train, {}, {}
        for m in live:
            run = self.runs[m]
            out[m] = n
            if run.fold is not None or run.params.subsample < 1:
                if m not in self.samples:
                    self.samples[m] = self.rows.room.zeros((n,), np.int32)
                found[m] = 0
        for a in range(0, n if found else 0, BLOCK):
            part, shares = slice(a, min(a + BLOCK, n)), {}
            for m in found:
                run, p, used = self.runs[m], self.runs[m].params, True
                if run.fold is not None:
                    used = self.rows.fold[part] != run.fold
                if p.subsample < 1:
                    key = p.seed, len(run.trees)
                    if key not in shares:
                        shares[key] = uniform(p.seed, self.rows.hash[part], len(run.trees))
                    used = used & (shares[key] < p.subsample)
                own = np.flatnonzero(used)
                self.samples[m][found[m]:found[m] + len(own)] = own + a
                found[m] += len(own)
        return out | {m: self.samples[m][:size] for m, size in found.items()}

    def round(self) -> None:
        live = [m for m, r in enumerate(self.runs) if r.growing]
        state, used = {}, self._used(live)
        for m in live:
            run, p = self.runs[m], self.runs[m].params
            if m not in self.soft:
                for part in self._parts():
                    self.rows.margins[m, :, part] = softmax(self.rows.margins[m, :, part], 0)
                self.soft.add(m)
            self.nodes[m] = 0
            for k in range(self.k):
                take = max(1, round(p.colsample_bytree * self.f))
                order = np.argsort(uniform(p.seed + 1, np.arange(self.f), len(run.trees) * self.k + k))
                state[m, k] = {"tree": Tree.empty(p.max_depth), "used": used[m], "class": k, "probability": self.rows.margins[m, k],
                               "node": self.nodes[m, k], "open": {0: None}, "sum": [0], "columns": np.sort(order[:take]), "held": {}}
        for level in range(max(self.runs[m].params.max_depth for m in live)):
            keys = [(m, k, node) for (m, k), s in state.items() for node in s["sum"]]
            if not any(s["open"] for s in state.values()):
                break
            totals = self._summed(state, keys)
            splits = self._splits(state, totals)
            for (m, k), s in state.items():
                self._apply(s, self.runs[m].params, splits[m, k], level)
        for m in live:
            self.runs[m].trees.append([state[m, k]["tree"] for k in range(self.k)])
        state.clear()
        self._losses(live)

    def _summed(self, state: dict, keys: list) -> dict | None:
        """Histograms of the summed nodes, of the features this task owns."""
        hist = np.zeros((len(keys), 2, self.f * self.b))
        at, roots = 0, {}
        for (m, k), s in state.items():
            n = len(s["sum"])
            if n and s["sum"][0] == 0:              # the classes' trees have the same rows there
                roots.setdefault(m, []).append((s, hist[at]))
            elif n:
                some = max(1, SUMS // (16 * sum(pack.size for pack in self.packs)))
                for a in range(0, n, some):
                    self._add_nodes(s, s["sum"][a:a + some], hist[at + a:at + min(a + some, n)])
            at += n
        for same in roots.values():
            self._add_roots(same)
        hist = hist.reshape(len(keys), 2, self.f, self.b)
        step, self.steps = f"h{self.steps}", self.steps + 1
        self.folder.put(step, b"".join(hist[:, :, own].tobytes() for own in self.own))
        mine = self.folder.rank
        if mine >= self.owners:
            return None
        sizes = [16 * len(keys) * len(own) * self.b for own in self.own]
        parts = self.folder.get(step, range(self.folder.size), sum(sizes[:mine]), sizes[mine])
        total = np.zeros((len(keys), 2, len(self.own[mine]), self.b))
        for p in parts:
            total += np.frombuffer(p, np.float64).reshape(total.shape)
        return dict(zip(keys, total))

    @staticmethod
    def _share(used, a: int, size: int):
        """Where the used rows from ``a`` on are."""
        return slice(a, min(a + size, used)) if isinstance(used, int) else used[a:a + size]

    def _gradients(self, s: dict, rows, at) -> np.ndarray:
        """Gradient and hessian of rows (their places among the used ones: ``at``) as a complex number."""
        if "grad" in s:
            grad, hess = s["grad"][at], s["hess"][at]
        else:
            p = s["probability"][rows]
            hess = 1 - p
            hess *= p
            hess *= 2
            np.maximum(hess, HESS_FLOOR, out=hess)
            grad = p - (self.rows.y[rows] == s["class"])
        both = np.empty(len(grad), complex)
        both.real, both.imag = grad, hess
        return both

    def _add_roots(self, trees: list) -> None:
        """The sums of the gradients of all used rows, to each tree's place."""
        # Columns that a tree doesn't take too: an owner reads the root's sums from its first one.
        used = trees[0][0]["used"]
        sums = [np.zeros((len(trees), pack.size), complex) for pack in self.packs]
        for a in range(0, used if isinstance(used, int) else len(used), CHUNK):
            rows = self._share(used, a, CHUNK)
            both = [self._gradients(s, rows, slice(a, a + CHUNK)) for s, _ in trees]
            for pack, total in zip(self.packs, sums):
                code = pack.code[rows].astype(np.intp)
                for i, x in enumerate(both):
                    np.add.at(total[i], code, x)        # a pass for gradient and hessian
        for pack, total in zip(self.packs, sums):
            for (_, place), by_code in zip(trees, total):
                pack.margins(by_code, place)

    def _add_nodes(self, s: dict, nodes: list[int], places: np.ndarray) -> None:
        """The sums of the gradients of each node's used rows, to its place."""
        n, used = len(nodes), s["used"]
        slot = np.full(2 << s["tree"].depth, n, np.uint8 if n < 255 else np.uint16)
        slot[nodes] = np.arange(n)
        sums = [np.zeros(n * pack.size, complex) for pack in self.packs]
        for a in range(0, used if isinstance(used, int) else len(used), SORTED):
            rows = self._share(used, a, SORTED)
            where = slot.take(s["node"][rows])
            own = np.flatnonzero(where < n)
            where = where.take(own)
            own = own.take(np.argsort(where, kind="stable"))
            ends = np.bincount(where, minlength=n).cumsum()
            own += a
            for i in range(n):
                for b in range(ends[i - 1] if i else 0, ends[i], CHUNK):
                    at = own[b:min(b + CHUNK, ends[i])]
                    row = at if isinstance(used, int) else used.take(at)
                    both = self._gradients(s, row, at)
                    for pack, total in zip(self.packs, sums):
                        np.add.at(total[i * pack.size:(i + 1) * pack.size], pack.code.take(row).astype(np.intp), both)
        for pack, total in zip(self.packs, sums):
            for i, by_code in enumerate(total.reshape(n, -1)):
                pack.margins(by_code, places[i])

    def _splits(self, state: dict, totals: dict | None) -> dict:
        """{(model, class): {node: (gain, feature, bin, gl, hl, g, h)}}, the
        same in every task."""
        order = [(m, k, node) for (m, k), s in state.items() for node in s["open"]]
        step, self.steps = f"s{self.steps}", self.steps + 1
        if totals is not None:
            mine = self.own[self.folder.rank]
            best, at = np.zeros((len(order), 7)), 0
            for (m, k), s in state.items():
                hist = []
                for node in s["open"]:
                    if (m, k, node) in totals:
                        hist.append(totals[m, k, node])
                    else:                               # the larger child: parent less sibling
                        hist.append(s["held"][(node - 1) // 2] - totals[m, k, node + 1 if node % 2 else node - 1])
                s["next"] = dict(zip(s["open"], hist))
                if hist:
                    self._best(best[at:at + len(hist)], s, self.runs[m].params, np.stack(hist), mine)
                at += len(hist)
            self.folder.put(step, best.tobytes())
            for s in state.values():
                s["held"] = s.pop("next", {})
        found = np.stack([np.frombuffer(x, np.float64).reshape(-1, 7) for x in self.folder.get(step, range(self.owners))])
        top = found[:, :, 0].max(axis=0)
        first = np.where(found[:, :, 0] >= top - TIE * np.abs(top), found[:, :, 1], np.inf).argmin(axis=0)
        # Every owner has read all histograms of this step, and every task the splits of the one before.
        self.folder.drop(1 if totals is not None else 0)
        out: dict = {key: {} for key in state}
        for i, (m, k, node) in enumerate(order):
            out[m, k][node] = (*found[first[i], i, :5], *found[0, i, 5:])
        return out

    def _best(self, best: np.ndarray, s: dict, p, hist: np.ndarray, mine: np.ndarray) -> None:
        """The best split of each open node on this task's features."""
        for i, known in enumerate(s["open"].values()):
            best[i] = (-np.inf, -1, 0, 0, 0, *(known or hist[i, :, 0].sum(axis=1)))
        allowed = np.flatnonzero(np.isin(mine, s["columns"]))
        if not len(allowed):
            return
        g, h = best[:, 5, None, None], best[:, 6, None, None]
        left = hist[:, :, allowed].cumsum(axis=3)
        gl, hl = left[:, 0], left[:, 1]
        gr, hr = g - gl, h - hl
        gain = gl ** 2 / (hl + p.l2) + gr ** 2 / (hr + p.l2) - g ** 2 / (h + p.l2)
        gain = np.where((hl >= p.min_child_weight) & (hr >= p.min_child_weight), gain, -np.inf).reshape(len(best), -1)
        top = gain.max(axis=1, keepdims=True)
        first = (gain >= top - TIE * np.abs(top)).argmax(axis=1)
        a, b = np.divmod(first, self.b)
        every = np.arange(len(best))
        best[:, 0], best[:, 1], best[:, 2] = gain[every, first], mine[allowed[a]], b
        best[:, 3], best[:, 4] = gl[every, a, b], hl[every, a, b]

    def _apply(self, s: dict, p, splits: dict, level: int) -> None:
        """Puts the splits into the tree and moves the rows on; a split gives
        both children's sums, so the last level needs no histograms."""
        tree, after, summed = s["tree"], {}, []
        for node, (gain, feature, cut, gl, hl, g, h) in splits.items():
            tree.value[node] = -p.learning_rate * g / (h + p.l2)
            if not gain > 1e-9:
                continue
            tree.feature[node], tree.bin[node], tree.gain[node] = int(feature), int(cut), gain
            left, right = 2 * node + 1, 2 * node + 2
            for child, (cg, ch) in ((left, (gl, hl)), (right, (g - gl, h - hl))):
                tree.value[child] = -p.learning_rate * cg / (ch + p.l2)
                after[child] = (cg, ch)
            summed.append(left if hl <= h - hl else right)
        self._move(s, level)
        last = level + 1 >= tree.depth
        s["open"], s["sum"] = ({}, []) if last else (after, summed)

    def _move(self, s: dict, level: int) -> None:
        """Rows of the level's split nodes to their children.  A node's rows
        are moved by comparing whole columns; only where a level has many
        splits does each row look up its own."""
        tree = s["tree"]
        split = np.flatnonzero(tree.feature >= 0)
        split = split[(split >= (1 << level) - 1) & (split < (2 << level) - 1)]
        if not len(split):
            return
        # by code: whether the row goes to the right; a feature that has one bin here has the lowest
        right = {}
        for i in split.tolist():
            q, j = self.rows.place.get(int(tree.feature[i]), (0, None))
            right[i] = q, np.zeros(self.packs[q].size, bool) if j is None else self.packs[q].bins[j] > tree.bin[i]
        if len(split) <= SCANNED:
            for part in self._parts():
                node, codes = s["node"][part], {}
                for i, (q, by_code) in right.items():       # children's numbers are the next level's
                    if q not in codes:
                        codes[q] = self.packs[q].code[part].astype(np.intp)
                    own = node == i
                    down = np.multiply(own, i + 1, dtype=node.dtype)
                    own &= by_code.take(codes[q])
                    down += own
                    node += down
            return
        # a node that isn't split keeps its rows: it moves by nothing
        packs = sorted({q for q, _ in right.values()})
        wide = max(self.packs[q].size for q in packs)
        table = np.zeros((len(split) + 1, wide), bool)
        line, pack = np.zeros(len(tree.feature), np.intp), np.zeros(len(tree.feature), np.intp)
        for at, (i, (q, by_code)) in enumerate(right.items(), 1):
            table[at, :len(by_code)], line[i], pack[i] = by_code, at * wide, packs.index(q)
        child = np.arange(len(tree.feature), dtype=s["node"].dtype)
        child[split] = 2 * split + 1
        flat, row = table.ravel(), np.arange(min(BLOCK, self.rows.n))
        for part in self._parts():
            node = s["node"][part]
            was, codes = node.astype(np.intp), np.stack([self.packs[q].code[part] for q in packs])
            at = pack.take(was)
            at *= len(was)
            at += row[:len(was)]
            own = line.take(was)
            own += codes.ravel().take(at)
            np.add(child.take(was), flat.take(own), out=node, dtype=node.dtype)

    def _losses(self, live: list[int]) -> None:
        """Adds the round's trees to the probabilities, and their log-losses up."""
        own = np.zeros((len(live), 6))
        for i, m in enumerate(live):
            run, n = self.runs[m], self.rows.n_train
            for a in range(0, self.rows.n, BATCH):
                part = slice(a, a + BATCH)
                place, y = self.rows.margins[m, :, part], self.rows.y[part]
                p = np.log(np.maximum(place, TINY))
                for k, tree in enumerate(run.trees[-1]):
                    p[k] += tree.value.take(self.nodes[m, k, part])
                place[:] = p = softmax(p, 0)
                each, row = -np.log(np.maximum(p[y, np.arange(len(y))], 1e-15)), np.arange(a, a + len(y))
                train = (row < n) & (True if run.fold is None else self.rows.fold[part] != run.fold)
                for j, rows in ((0, train), (2, row >= n)):
                    own[i, j:j + 2] += (each * rows).sum(), rows.sum()
                if len(run.trees) in run.marks:
                    out = self.rows.fold[part] == run.fold
                    own[i, 4:] += (p.argmax(axis=0) == y)[out].sum(), out.sum()
        step, self.steps = f"l{self.steps}", self.steps + 1
        self.folder.put(step, own.tobytes())
        total = sum(np.frombuffer(x, np.float64).reshape(own.shape) for x in self.folder.get(step, range(self.folder.size)))
        self.folder.drop(1)
        for i, m in enumerate(live):
            run, t = self.runs[m], total[i]
            if len(run.trees) in run.marks:
                run.right[len(run.trees)] = (int(t[4]), int(t[5]))
            run.rows = {"train": int(t[1]), "eval": int(t[3])}
            run.note({s: float(t[j] / t[j + 1]) for s, j in ((TRAIN, 0), (EVAL, 2)) if t[j + 1]}, self.with_eval)


def shares(data: DataFrame, tasks: int) -> list[list[tuple[str, int, int]]]:
    """The stored rows dealt evenly: [(file, from, to)] of each task."""
    held = data.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    held = sorted((r["file"], r["n"]) for r in held)
    total, out, before = sum(n for _, n in held), [], 0
    for task in range(tasks):
        out.append([])
        start, stop, before = total * task // tasks, total * (task + 1) // tasks, 0
        for file, n in held:
            a, b = max(start - before, 0), min(stop - before, n)
            if a < b:
                out[-1].append((file, a, b))
            before += n
    return out


def stored(share: list[tuple[str, int, int]]):
    """The rows of a task's share, in batches."""
    for file, start, stop in share:
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_file(path) as f:
            table = pq.ParquetFile(f, buffer_size=1 << 20)
            names, at = [c for c in _NAMES if c in table.schema_arrow.names], 0
            for i in range(table.num_row_groups):
                n = table.metadata.row_group(i).num_rows
                if at >= stop or "note" not in names and at + n <= start:
                    at += n
                    continue
                for b in table.iter_batches(BATCH, [i], names, use_threads=False):
                    if "note" in names:             # beside the rows there is a row with the trees
                        b = b.filter(b.column("note").is_null())
                    a, e = max(start - at, 0), min(stop - at, b.num_rows)
                    at += b.num_rows
                    if a < e:
                        b = b.slice(a, e - a)
                        yield pa.RecordBatch.from_arrays([b.column(c) if c in names else pa.nulls(e - a, pa.binary()) for c in _NAMES], _NAMES)


def grow(data: DataFrame, runs: list[Run], n_features: int, n_classes: int, n_bins: int, with_eval: bool, tasks: int | None = None,
         stretch: int = 50) -> list[Run]:
    """All ``runs`` to their end on stored binned rows (y, set, fold, hash, bins).

    ``tasks``: of a barrier stage, at most the slots there are."""
    spark = data.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    while any(r.growing for r in runs):
        place, dealt = scratch_path(spark, f"growth-{uuid.uuid4().hex}"), shares(data, tasks)
        most = max(sum(b - a for _, a, b in share) for share in dealt)
        turns, handed = _turns(runs, most, n_classes)

        def run(runs, place=place, dealt=dealt, turns=turns, handed=handed):
            task = BarrierTaskContext.get()
            share = dealt[task.partitionId()]
            rows = Rows(stored(share), n_features, max(map(len, turns)), n_classes, sum(b - a for _, a, b in share))
            attempt = task.allGather(uuid.uuid4().hex)      # all tasks of this attempt of the stage meet in one folder
            folder = Folder(f"{place}/{attempt[0]}", task.partitionId(), len(attempt))
            start, steps = [len(r.trees) for r in runs], 0
            for turn in turns:
                grower = Grower(rows, [runs[i] for i in turn], folder, n_classes, n_bins, with_eval)
                grower.steps = steps
                if not handed:
                    grower.add_up()
                for _ in range(stretch):
                    if not any(r.growing for r in grower.runs):
                        break
                    grower.round()
                grower.close()
                steps = grower.steps
            note = None
            if not folder.rank:
                note = pickle.dumps([([[t.parts() for t in rnd] for rnd in r.trees[a:]], r.open, r.history, r.best, r.right, r.rows) for r, a in zip(runs, start)])
            # rows that no further stretch reads are not handed on
            yield from rows.batches(note, handed and any(r.growing for r in runs))

        # Where rows are handed on, finished trees are in their margins: the tasks need only the trees' number.
        # The exchange behind the barrier stage makes it one that Spark starts again; one that writes the result is given up.
        light = [_light(r) if handed else r for r in runs]
        out = materialize(spark.range(0, tasks, 1, tasks).mapInArrow(
            lambda _, run=run, light=light: run(light), ROWS, barrier=True).repartition(tasks), "margins")
        for r, (trees, r.open, r.history, r.best, r.right, r.rows) in zip(runs, pickle.loads(out.where("note IS NOT NULL").first()["note"])):
            r.trees += [[Tree(*t) for t in rnd] for rnd in trees]
        if handed:
            data = out.where("note IS NULL")
    for r in runs:
        if with_eval and r.params.patience and r.best[1] > 0:
            r.trees = r.trees[:r.best[1]]
    return runs


def _turns(runs: list[Run], rows: int, n_classes: int) -> tuple[list[list[int]], bool]:
    """Models that grow side by side: as many as ``STATE`` holds for the
    largest task, about as many each time; whether rows are handed on."""
    each = max(1, rows) * (9 * n_classes + 4)
    live = [i for i, r in enumerate(runs) if r.growing]
    if len(runs) * each <= min(HANDED, STATE):
        return [[*range(len(runs))]], True
    turns = -(-len(live) // max(1, STATE // each))
    return [live[i * len(live) // turns:(i + 1) * len(live) // turns] for i in range(turns)], False


def _light(run: Run) -> Run:
    """The run for a stage: finished trees are in the margins, only their
    number is needed."""
    out = Run(run.params, run.fold, run.marks)
    out.trees, out.open, out.history, out.best, out.right, out.rows = [None] * len(run.trees), run.open, run.history, run.best, run.right, run.rows
    return out
