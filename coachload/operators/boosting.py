"""Three-class boosted trees (M5, M6, M10, M12) and the model bundle.

Softmax boosting with second-order steps: per round and class one tree on the
gradients g = p - y and h = 2 p (1 - p), split gain
G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2), leaves -G / (H + l2).

Features are cut into at most ``max_bins`` bins at approximate quantiles once;
the binned rows (a byte per feature) are stored.  ``growth`` grows the trees of
any number of models (settings x folds of a grid) side by side in barrier
stages, a stage for a stretch of rounds.

Scoring is one vectorised function over all trees, so its plan does not grow
with them.
"""

from __future__ import annotations

import json
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coachload.operators.growth import EVAL, TRAIN, Run, Tree, bytes_column, grow, softmax, uniform
from coachload.operators.model import CLASS_NAMES, split_hash
from coachload.session import discard, materialize

# Functions of this module travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of each feature (the number of cuts below); a missing value falls
    in the lowest bin."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        v = x[:, j]
        out[:, j] = np.where(np.isnan(v), 0, np.searchsorted(c, v, side="left"))
    return out


# Model ---------------------------------------------------------------------
class SoftmaxBoostingModel:
    def __init__(self, trees: list[list[Tree]], features: list[str], cuts: list[np.ndarray],
                 n_classes: int = 3, history: dict[str, list[float]] | None = None, rows: dict[str, int] | None = None):
        self.trees, self.features, self.cuts, self.n_classes = trees, features, cuts, n_classes
        self.history = history or {"train": [], "eval": []}
        self.rows = rows or {}          # that the histories are means over

    @property
    def best_iteration(self) -> int:
        return len(self.trees) - 1

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.ascontiguousarray(to_bins(x, self.cuts).T)
        out = np.zeros((self.n_classes, len(x)))
        for rnd in self.trees:
            for k, tree in enumerate(rnd):
                out[k] += tree.outputs_of(bins)
        return out.T

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (array, class-code order) and ``prediction``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(*cols):
            x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in cols], axis=1)
            return pd.Series(list(softmax(shared.value.margins(x))))

        prob = F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR)
        out = df.withColumn("probability", prob(*[F.col(f).cast("double") for f in self.features]))
        p = F.col("probability")
        return out.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    def predict_classes(self, df: DataFrame, feature_list: list[str] | None = None) -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:   # F17: features absent at serving time enter as 0
            df = df.withColumns({f: F.lit(0.0) for f in missing})
        return self.transform(df)

    def importances(self, n: int | None = 15) -> list[tuple[str, float]]:
        """Mean gain of a feature's splits, normalised over the features."""
        total, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for rnd in self.trees:
            for tree in rnd:
                at = tree.feature >= 0
                total += np.bincount(tree.feature[at], tree.gain[at], len(self.features))
                count += np.bincount(tree.feature[at], minlength=len(self.features))
        mean = total / np.maximum(count, 1)
        mean = mean / (mean.sum() or 1.0)
        ranked = sorted(((f, float(v)) for f, v in zip(self.features, mean)), key=lambda x: (-x[1], x[0]))
        return ranked[:n] if n else ranked

    def save(self, path: str) -> None:
        """One table of tree nodes (a row per tree) and one row of facts."""
        spark = _active()
        rows = [(r, k, t.depth, t.feature.tolist(), t.bin.tolist(), t.gain.tolist(), t.value.tolist())
                for r, rnd in enumerate(self.trees) for k, t in enumerate(rnd)]
        spark.createDataFrame(rows, "round int, class int, depth int, feature array<int>, bin array<int>, "
                                    "gain array<double>, value array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        meta = {"features": self.features, "n_classes": self.n_classes, "history": self.history, "rows": self.rows,
                "cuts": [c.tolist() for c in self.cuts]}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> SoftmaxBoostingModel:
        spark = _active()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        trees: list[list[Tree]] = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("round", "class").collect():
            if r["class"] == 0:
                trees.append([])
            trees[-1].append(Tree(r.depth, np.array(r.feature, np.int32), np.array(r.bin, np.int32),
                                  np.array(r.gain), np.array(r.value)))
        return cls(trees, meta["features"], [np.array(c) for c in meta["cuts"]], meta["n_classes"], meta["history"], meta["rows"])


def _active() -> SparkSession:
    return SparkSession.getActiveSession()


# Estimator -----------------------------------------------------------------
class SoftmaxBoosting:
    """Estimator: ``fit(train, features, label, eval_df)``.

    Defaults follow the reference's library defaults (100 rounds, depth 6,
    learning rate 0.3, L2 1, minimum child weight 1, all rows and columns;
    early stop after 10 rounds without a better eval log-loss).  ``subsample``
    takes rows by a hash of their features and the round, ``colsample_bytree``
    columns by a hash of the tree.  ``max_bins`` cut points per feature come
    from approximate quantiles of the training rows.  ``stretch`` rounds are
    one barrier stage of ``tasks`` tasks (default: the session's parallelism)."""

    def __init__(self, rounds: int = 100, max_depth: int = 6, learning_rate: float = 0.3,
                 subsample: float = 1.0, colsample_bytree: float = 1.0, l2: float = 1.0,
                 min_child_weight: float = 1.0, patience: int | None = 10, max_bins: int = 64,
                 n_classes: int = 3, stretch: int = 50, tasks: int | None = None, seed: int = 42):
        if not 2 <= max_bins <= 256:
            raise ValueError("max_bins must be from 2 to 256")
        self.rounds = rounds
        self.max_depth = max_depth
        self.learning_rate = learning_rate
        self.subsample = subsample
        self.colsample_bytree = colsample_bytree
        self.l2 = l2
        self.min_child_weight = min_child_weight
        self.patience = patience
        self.max_bins = max_bins
        self.n_classes = n_classes
        self.stretch = stretch
        self.tasks = tasks
        self.seed = seed

    def copy(self, **kw) -> SoftmaxBoosting:
        return SoftmaxBoosting(**{**self.__dict__, **kw})

    def fit(self, train: DataFrame, features: list[str], label: str,
            eval_df: DataFrame | None = None) -> SoftmaxBoostingModel:
        rows = train.withColumn("__set", F.lit(TRAIN))
        if eval_df is not None:
            rows = rows.unionByName(eval_df.withColumn("__set", F.lit(EVAL)), allowMissingColumns=True)
        cuts = _cuts(train, features, self.max_bins)
        data = _binned(rows.withColumn("__fold", F.lit(-1)), features, label, cuts, self.subsample < 1)
        [run] = grow(data, [Run(self)], len(features), self.n_classes, self.max_bins, eval_df is not None, self.tasks, self.stretch)
        discard(data)
        return SoftmaxBoostingModel(run.trees, list(features), cuts, self.n_classes, run.history, run.rows)


class Ranks:
    """The values of a column in rank order, within bounded memory: distinct
    values with their counts while these are few; else runs of ``RUN`` sorted
    values, of which two of one weight become one of twice the weight (every
    other value).  A rank is then off by at most merges / (2 ``RUN``) of the
    rows, a merge for each doubling of the rows beyond ``RUN``."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.n = 0
        self.runs: dict[int, np.ndarray] = {}       # by the doublings of its weight
        self.values, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def add(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.n += len(x)
        if self.n >= RUN:
            self.flush()

    def flush(self) -> None:
        x, self.held, self.n = np.sort(np.concatenate([*self.held, np.zeros(0)])), [], 0
        if not self.runs:
            values, counts = _added(*_runs_of(x), self.values, self.counts)
            if len(values) <= RUN:
                self.values, self.counts = values, counts
                return
        for a in range(0, len(x) - RUN + 1, RUN):
            run, level = x[a:a + RUN], 0
            while level in self.runs:
                both = np.sort(np.concatenate([self.runs.pop(level), run]))
                run, level = both[level % 2::2], level + 1
            self.runs[level] = run
        rest = x[len(x) // RUN * RUN:]
        if len(rest):
            self.held, self.n = [rest], len(rest)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """At most ``KEPT`` values and the rows that each stands for."""
        self.flush()
        values, counts = _added(self.values, self.counts, *_runs_of(np.sort(np.concatenate([*self.held, np.zeros(0)]))))
        for level, run in self.runs.items():
            found, n = _runs_of(run)
            values, counts = _added(values, counts, found, n << level)
        if len(values) > KEPT:
            upto, total = counts.cumsum(), int(counts.sum())
            ends = np.arange(1, KEPT + 1) * total // KEPT
            middle = (ends + np.concatenate([[0], ends[:-1]]) + 1) // 2
            values, counts = values.take(np.searchsorted(upto, middle)), np.diff(ends, prepend=0)
        return values, counts


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x.take(first), np.diff(first, append=len(x))


def _added(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of sorted values with counts as one."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n, m]), len(values)).astype(np.int64)


RUN = 1 << 15            # values that a column holds in a task before two runs become one
KEPT = 10_000            # values that a task hands on for a column


def _cuts(train: DataFrame, features: list[str], max_bins: int) -> list[np.ndarray]:
    """At most max_bins - 1 cut points per feature: the values at these shares
    of the rows, from ``KEPT`` values of each task at most.  NaN is the largest
    value and no cut point."""
    def some(batches):
        ranks = [Ranks() for _ in features]
        for b in batches:
            for r, column in zip(ranks, b.columns):
                r.add(column.drop_null().to_numpy(zero_copy_only=False))
        for i, r in enumerate(ranks):
            values, counts = r.entries()
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(counts)], ["feature", "value", "n"])

    def cut(key, table):
        values, at = np.unique(table["value"].to_numpy(), return_inverse=True)
        upto = np.bincount(at, table["n"].to_numpy(), len(values)).cumsum()
        wanted = np.ceil(np.arange(1, max_bins) / max_bins * upto[-1])
        points = np.unique(values.take(np.searchsorted(upto, wanted)))
        points = points[~np.isnan(points)]
        return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()), "points": pa.array([points], pa.list_(pa.float64()))})

    x = train.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    held = x.mapInArrow(some, "feature int, value double, n long").groupBy("feature").applyInArrow(cut, "feature int, points array<double>")
    found = {r["feature"]: r["points"] for r in held.collect()}
    return [np.array(found.get(i, []), np.float64) for i in range(len(features))]


def _binned(rows: DataFrame, features, label, cuts, sampled: bool) -> DataFrame:
    """(y, set, fold, hash, bins): stored once; the hash for samples only."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(3 + j).to_numpy(zero_copy_only=False).astype(np.float64) for j in range(len(features))], axis=1)
            row = pa.array((uniform(0, *x.view(np.uint64).T) * (1 << 53)).astype(np.int64)) if sampled else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], row, bytes_column(to_bins(x, cuts))],
                                             ["y", "set", "fold", "hash", "bins"])

    x = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    source = rows.select(F.col(label).cast("int").alias("y"), F.col("__set").alias("set"), F.col("__fold").cast("int").alias("fold"), *x)
    return materialize(source.filter(F.col("y").isNotNull())
                       .mapInArrow(run, "y int, set int, fold int, hash long, bins binary"), "binned")


# M10 -----------------------------------------------------------------------
def importances(spark, model: SoftmaxBoostingModel, n: int = 15) -> DataFrame:
    rows = [(i + 1, f, float(v)) for i, (f, v) in enumerate(model.importances(n))]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


# M12 -----------------------------------------------------------------------
# Fixed values that must equal the reference's: the full search, 243 settings.
FULL_GRID = {"max_depth": [3, 5, 7], "learning_rate": [0.1, 0.2, 0.3], "rounds": [100, 200, 300],
             "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0]}
# The default search: four settings of those values, which differ on all axes.
DEFAULT_GRID = [
    {"max_depth": 3, "learning_rate": 0.3, "rounds": 100, "subsample": 0.8, "colsample_bytree": 0.8},
    {"max_depth": 3, "learning_rate": 0.3, "rounds": 200, "subsample": 0.8, "colsample_bytree": 0.8},
    {"max_depth": 3, "learning_rate": 0.1, "rounds": 100, "subsample": 0.9, "colsample_bytree": 1.0},
    {"max_depth": 5, "learning_rate": 0.2, "rounds": 100, "subsample": 1.0, "colsample_bytree": 0.9},
]


def all_settings(axes: dict[str, list]) -> list[dict]:
    """Every combination of the axes' values."""
    out: list[dict] = [{}]
    for name, values in axes.items():
        out = [{**o, name: v} for o in out for v in values]
    return out


def growths(grid: list[dict], rounds: int) -> list[tuple[dict, dict[int, int]]]:
    """Settings that differ in their rounds only are prefixes of one ensemble:
    [(setting with the most rounds, {index in the grid: rounds})]."""
    out: dict[str, tuple[dict, dict[int, int]]] = {}
    for i, p in enumerate(grid):
        rest = {k: v for k, v in p.items() if k != "rounds"}
        one = out.setdefault(json.dumps(rest, sort_keys=True), (rest, {}))
        one[1][i] = p.get("rounds", rounds)
    return [({**rest, "rounds": max(at.values())}, at) for rest, at in out.values()]


def grid_search(df: DataFrame, features: list[str], label: str, base: SoftmaxBoosting,
                grid: list[dict] | None = None, folds: int = 3, key_cols: list[str] | None = None,
                seed: int = 42, together: int = 12) -> DataFrame:
    """k-fold cross-validated accuracy for each parameter setting.

    Folds come from the same md5 order key as the split.  Rows are binned once;
    ``together`` models (growths x folds) grow in the same stages, and each is
    read after every number of rounds that a setting asks for, so the full grid
    of 243 settings takes 81 growths a fold."""
    spark = df.sparkSession
    grid = DEFAULT_GRID if grid is None else grid
    key_cols = key_cols or ["messageId_leg_start", "leg_departure_dt"]
    cuts = _cuts(df, features, base.max_bins)
    rows = df.withColumns({"__fold": F.pmod(split_hash(key_cols, seed + 1), F.lit(folds)), "__set": F.lit(TRAIN)})
    wanted = [(p, at, f) for p, at in growths(grid, base.rounds) for f in range(folds)]
    data = _binned(rows, features, label, cuts, any(base.copy(**p).subsample < 1 for p, _, _ in wanted))
    accuracy: dict[tuple[int, int], float] = {}
    held: dict[int, int] = {}
    for first in range(0, len(wanted), together):
        part = wanted[first:first + together]
        runs = [Run(base.copy(patience=None, **p), f, tuple(sorted(set(at.values())))) for p, at, f in part]
        grow(data, runs, len(features), base.n_classes, base.max_bins, False, base.tasks, base.stretch)
        for (_, at, f), run in zip(part, runs):
            for i, n in at.items():
                right, held[f] = run.right[n]
                accuracy[i, f] = right / max(held[f], 1)
    discard(data)
    results = [(i, json.dumps(p, sort_keys=True), float(np.mean([accuracy[i, f] for f in range(folds)])),
                [accuracy[i, f] for f in range(folds)], [held[f] for f in range(folds)]) for i, p in enumerate(grid)]
    return spark.createDataFrame(results, "setting int, params string, mean_accuracy double, "
                                          "fold_accuracy array<double>, fold_rows array<long>")


# S8 ------------------------------------------------------------------------
def save_bundle(path: str, model: SoftmaxBoostingModel, labels: DataFrame, thresholds: DataFrame,
                scaling: DataFrame | None = None, info: dict | None = None) -> None:
    """Model, dictionaries, thresholds, scaling and facts; the facts say
    whether there is a scaling, so a reader cannot miss it."""
    model.save(f"{path}/model")
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
    if scaling is not None:
        scaling.write.mode("overwrite").parquet(f"{path}/scaling")
    meta = {"feature_list": model.features, "classes": CLASS_NAMES, "best_iteration": model.best_iteration,
            **(info or {}), "has_scaling": scaling is not None}
    labels.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/info")


def load_bundle(spark, path: str) -> dict:
    """Fails if a part that the bundle's facts name cannot be read."""
    out = {"model": SoftmaxBoostingModel.load(f"{path}/model"),
           "labels": spark.read.parquet(f"{path}/labels"),
           "thresholds": spark.read.parquet(f"{path}/thresholds"),
           "info": json.loads(spark.read.text(f"{path}/info").first()[0])}
    if out["info"]["has_scaling"]:
        out["scaling"] = spark.read.parquet(f"{path}/scaling")
    return out
