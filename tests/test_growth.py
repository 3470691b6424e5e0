"""Tree growth: packed histograms, equal gains, what a last stretch hands on."""

import glob
import os

import numpy as np
import pyarrow as pa

from coachload.operators import boosting as bo, growth
from coachload.session import scratch_path
from tests.test_model import _leaf_rows, _same_trees


class Alone:
    """The folder of a stage of one task."""

    rank, size = 0, 1

    def __init__(self):
        self.held = {}

    def put(self, step, data):
        self.held[step] = data

    def get(self, step, ranks, at=0, size=None):
        data = self.held[step]
        return [data if size is None else data[at:at + size]]

    def drop(self, keep):
        pass


def _rows(bins, y):
    n = len(y)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(y, pa.int32()), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n)),
         pa.array([r.tobytes() for r in bins], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], growth._NAMES)
    return growth.Rows([batch.slice(0, n // 3), batch.slice(n // 3)], bins.shape[1], 1, 3)


def test_packed_histograms_take_a_step_per_pack(monkeypatch):
    rng = np.random.default_rng(3)
    n, sizes = 40_000, np.array([2, 2, 7, 24, 2, 64, 12, 2, 25, 2])
    bins = (rng.random((n, len(sizes))) * sizes).astype(np.uint8)
    y = (bins[:, 2] + bins[:, 0]) % 3
    rows = _rows(bins, y)
    grower = growth.Grower(rows, [growth.Run(bo.SoftmaxBoosting(rounds=1, max_depth=2))], Alone(), 3, 64, False)
    counted, own = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: counted.append(1) or own(*a, **k))
    keys, grad, hess = [(0, 0, 1), (0, 0, 2)], rng.random(n), rng.random(n)
    tree = growth.Tree.empty(2)
    state = {(0, 0): {"tree": tree, "used": np.arange(n), "grad": grad, "hess": hess, "node": (1 + y % 2).astype(np.int16),
                      "sum": [1, 2], "columns": np.arange(len(sizes))}}
    found = grower._summed(state, keys)
    assert len(counted) < 2 * len(sizes)
    for node in (1, 2):
        at = y % 2 == node - 1
        for f in range(len(sizes)):
            assert np.allclose(found[0, 0, node][0, f], own(bins[at, f], grad[at], 64))
            assert np.allclose(found[0, 0, node][1, f], own(bins[at, f], hess[at], 64))


def test_equal_gains_take_the_first_cut():
    """Rows have no values between bins 2 and 18 of a feature: all cuts there are equal."""
    rng = np.random.default_rng(5)
    n = 30_000
    low = rng.random((n, 6)) < 0.5
    bins = np.where(low, (rng.random((n, 6)) * 3), 18 + rng.random((n, 6)) * 8).astype(np.uint8)
    grower = growth.Grower(_rows(bins, (low[:, 0] * 1 + low[:, 1] * low[:, 2])), [growth.Run(bo.SoftmaxBoosting(rounds=2))], Alone(), 3, 64, False)
    grower.round()
    for tree in grower.runs[0].trees[0]:
        assert not ((tree.bin[tree.feature >= 0] > 2) & (tree.bin[tree.feature >= 0] < 18)).any()


def test_whole_paths_give_a_leafs_value():
    tree = growth.Tree.empty(3)
    tree.feature[0], tree.bin[0], tree.value[1], tree.value[2] = 1, 4, 0.5, -0.5
    tree.feature[2], tree.bin[2], tree.value[5], tree.value[6] = 0, 255, 2.0, 3.0
    assert tree.outputs(np.array([[9, 4], [0, 5], [255, 255]], np.uint8)).tolist() == [0.5, 2.0, 2.0]


def test_a_last_stretch_hands_on_no_rows(spark):
    place = os.path.dirname(scratch_path(spark, "margins")).removeprefix("file:")
    before = set(glob.glob(f"{place}/margins-*"))
    base = bo.SoftmaxBoosting(rounds=4, max_depth=2, patience=None, tasks=2, stretch=2)
    base.fit(_leaf_rows(spark), ["a", "b", "c"], "y")
    made = set(glob.glob(f"{place}/margins-*")) - before
    assert sorted(spark.read.schema(growth.ROWS).parquet(p).where("note IS NULL").count() for p in made) == [0, 400]


def test_rows_move_without_a_gather_and_to_the_same_nodes(monkeypatch):
    rng = np.random.default_rng(8)
    n = 70_000
    bins = rng.integers(0, 256, (n, 5)).astype(np.uint8)
    rows = _rows(bins, rng.integers(0, 3, n))
    grower = growth.Grower(rows, [growth.Run(bo.SoftmaxBoosting(rounds=1, max_depth=7))], Alone(), 3, 256, False)
    found = []
    for scanned in (64, 0):
        monkeypatch.setattr(growth, "SCANNED", scanned)
        tree, pick = growth.Tree.empty(7), np.random.default_rng(1)
        node = np.zeros(n, np.int16)
        for level in range(7):
            at = np.arange((1 << level) - 1, (2 << level) - 1)
            at = at[(pick.random(len(at)) < 0.9) | (level < 3)]
            tree.feature[at], tree.bin[at] = pick.integers(0, 5, len(at)), pick.integers(60, 200, len(at))
            grower._move({"tree": tree, "node": node}, level)
        found.append(node)
    assert (found[0] == found[1]).all() and len(np.unique(node)) > 40
    expected = np.zeros(n, np.int64)
    for level in range(7):
        inner = (tree.feature[expected] >= 0) & (expected >= (1 << level) - 1)
        right = bins[np.arange(n), np.maximum(tree.feature[expected], 0)] > tree.bin[expected]
        expected = np.where(inner, 2 * expected + 1 + right, expected)
    assert (node == expected).all()


def test_features_that_depend_on_each_other_share_a_pack():
    rng = np.random.default_rng(9)
    n = 40_000
    place = rng.integers(0, 25, n)
    bins = np.stack([place, place * 7 % 25, place * 3 % 25, np.full(n, 1), rng.integers(0, 20, n), np.zeros(n)], axis=1).astype(np.uint8)
    rows = _rows(bins, rng.integers(0, 3, n))
    assert len(rows.packs) == 1          # 25 * 20 combinations, of 25 ** 3 * 20 * 2
    run = growth.Run(bo.SoftmaxBoosting(rounds=1, max_depth=2))
    grower = growth.Grower(rows, [run], Alone(), 3, 64, False)
    grad, hess, used = rng.random(n), rng.random(n), np.sort(rng.permutation(n)[:n // 2])
    state = {(0, 0): {"tree": growth.Tree.empty(2), "used": used, "grad": grad[used], "hess": hess[used], "node": np.zeros(n, np.int16), "sum": [0]}}
    found = grower._summed(state, [(0, 0, 0)])[0, 0, 0]
    for f in range(bins.shape[1]):
        assert np.allclose(found[0, f], np.bincount(bins[used, f], grad[used], 64))
        assert np.allclose(found[1, f], np.bincount(bins[used, f], hess[used], 64))


def test_a_round_takes_one_softmax_of_each_row(monkeypatch):
    rng = np.random.default_rng(10)
    n, seen, own = 9_000, [], growth.softmax
    bins = rng.integers(0, 20, (n, 4)).astype(np.uint8)
    grower = growth.Grower(_rows(bins, bins[:, 0] % 3), [growth.Run(bo.SoftmaxBoosting(rounds=3, max_depth=3))], Alone(), 3, 64, False)
    monkeypatch.setattr(growth, "softmax", lambda m, axis=-1: seen.append(m.shape[1 if axis == 0 else 0]) or own(m, axis))
    for _ in range(3):
        grower.round()
    assert sum(seen) == 4 * n            # before the first round, and after each
    losses = grower.runs[0].history["train"]
    assert losses[0] > losses[1] > losses[2]


def test_state_beyond_the_memory_is_in_files_and_gives_the_same_trees(monkeypatch):
    rng = np.random.default_rng(11)
    n = 50_000
    bins = (rng.random((n, 6)) * [40, 3, 25, 60, 2, 9]).astype(np.uint8)
    y, grown = (bins[:, 0] // 14 + bins[:, 4]) % 3, []
    for memory in (1 << 30, 0):
        monkeypatch.setattr(growth, "MEMORY", memory)
        rows = _rows(bins, y)
        grower = growth.Grower(rows, [growth.Run(bo.SoftmaxBoosting(rounds=3, max_depth=5))], Alone(), 3, 64, False)
        for _ in range(3):
            grower.round()
        held = [rows.y, rows.margins, grower.nodes, *(pack.code for pack in rows.packs)]
        assert all(isinstance(x.base, np.memmap) for x in held) == (memory == 0)
        assert not hasattr(rows.bins, "nbytes")          # the packs' codes are the only copy
        grown.append(grower.runs[0].trees)
    for one, two in zip(*grown):
        for t, u in zip(one, two):
            assert (t.feature == u.feature).all() and (t.bin == u.bin).all() and (t.value == u.value).all()


def test_models_that_take_turns_are_the_same_models(spark, monkeypatch):
    """A task that can't hold all models grows one after the other and adds their margins up from their trees."""
    df = _leaf_rows(spark).selectExpr("*", "string(i) messageId_leg_start", "'x' leg_departure_dt")
    base = bo.SoftmaxBoosting(rounds=5, max_depth=3, patience=None, tasks=2, stretch=2)
    grid = [{"max_depth": 3, "subsample": 0.8}, {"max_depth": 2, "learning_rate": 0.1, "rounds": 3}]
    together = bo.grid_search(df, ["a", "b", "c"], "y", base, grid).collect()
    fitted = base.fit(df, ["a", "b", "c"], "y", df)
    most, own = [], growth._turns
    monkeypatch.setattr(growth, "STATE", 0)
    monkeypatch.setattr(growth, "_turns", lambda *a: most.append(max(map(len, own(*a)[0]))) or own(*a))
    place = os.path.dirname(scratch_path(spark, "margins")).removeprefix("file:")
    before = set(glob.glob(f"{place}/margins-*"))
    assert bo.grid_search(df, ["a", "b", "c"], "y", base, grid).collect() == together
    _same_trees(base.fit(df, ["a", "b", "c"], "y", df), fitted)
    assert set(most) == {1}
    for p in set(glob.glob(f"{place}/margins-*")) - before:
        assert spark.read.schema(growth.ROWS).parquet(p).where("note IS NULL").count() == 0


def test_each_stored_row_is_dealt_to_one_task(spark):
    cuts = [np.array([0.5])]
    rows = spark.range(0, 1000, 1, 7).selectExpr("id % 3 y", "int(0) __set", "int(-1) __fold", "double(id) x")
    data = bo._binned(rows, ["x"], "y", cuts, True)
    for tasks in (1, 3, 8):
        dealt = growth.shares(data, tasks)
        found = [[h for b in growth.stored(share) for h in b.column(3).to_pylist()] for share in dealt]
        assert max(map(len, found)) - min(map(len, found)) <= 1
        assert sorted(h for own in found for h in own) == sorted(r["hash"] for r in data.collect())


def test_a_fit_leaves_no_binned_rows_and_stores_a_hash_for_samples_only(spark, monkeypatch):
    place, hashes, own = os.path.dirname(scratch_path(spark, "binned")).removeprefix("file:"), [], bo.grow
    monkeypatch.setattr(bo, "grow", lambda data, *a: hashes.append(data.where("hash IS NOT NULL").count()) or own(data, *a))
    before = set(glob.glob(f"{place}/binned-*"))
    for subsample in (1.0, 0.9):
        bo.SoftmaxBoosting(rounds=1, max_depth=2, tasks=2, subsample=subsample).fit(_leaf_rows(spark), ["a", "b", "c"], "y")
    assert hashes == [0, 400] and set(glob.glob(f"{place}/binned-*")) == before
