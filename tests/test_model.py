"""Split, evaluation and the boosted-tree model."""

import pytest
from pyspark.sql import functions as F

from coachload.operators import boosting as bo, features as fe, model as md, target as tg
from coachload.session import materialize
from coachload.sources import tables
from tests.conftest import SF001


@pytest.fixture(scope="module")
def labelled(spark):
    feats, labels = fe.engineer(tables.legs(spark, SF001))
    return materialize(tg.label(feats), "labelled"), labels      # read by most tests here


def test_split_exact_shares(labelled):
    df, _ = labelled
    s = md.stratified_split(df, "comfort_tier_encoded")
    counts = {(r[0], r[1]): r[2] for r in s.groupBy("comfort_tier_encoded", "split").count().collect()}
    for c in range(3):
        n = counts.get((c, "test"), 0) + counts.get((c, "train"), 0)
        assert counts.get((c, "test"), 0) == int(n * 0.2 + 0.5)
    assert s.count() == df.count()


def test_split_is_deterministic(labelled):
    df, _ = labelled
    a = md.stratified_split(df.repartition(5), "comfort_tier_encoded").where(F.col("split") == "test")
    b = md.stratified_split(df.repartition(2), "comfort_tier_encoded").where(F.col("split") == "test")
    key = ["messageId_leg_start", "leg_departure_dt"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))


def test_report_and_confusion(spark):
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 2), (2, 0)], "label int, prediction int")
    rep = {r["class_name"]: r for r in md.classification_report(pred).collect()}
    assert rep["Busy"]["precision"] == pytest.approx(0.5) and rep["Busy"]["recall"] == pytest.approx(0.5)
    assert rep["Quiet"]["precision"] == pytest.approx(1.0) and rep["Quiet"]["recall"] == pytest.approx(2 / 3)
    assert rep["weighted avg"]["support"] == 6
    cm = {r["actual"]: (r["Busy"], r["Moderate"], r["Quiet"]) for r in md.confusion(pred).collect()}
    assert cm == {"Busy": (1, 1, 0), "Moderate": (0, 1, 0), "Quiet": (1, 0, 2)}
    assert md.accuracy(pred).first()["accuracy"] == pytest.approx(4 / 6)


def test_choose_strictly_better():
    assert md.choose("a", "b", 0.9, 0.9) == ("a", "initial")
    assert md.choose("a", "b", 0.9, 0.91) == ("b", "tuned")


def test_boosting_learns_and_round_trips(spark, labelled, tmp_path):
    df, labels = labelled
    s = md.stratified_split(df, "comfort_tier_encoded")
    _, feats, _ = fe.select_features(df)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    model = bo.SoftmaxBoosting(rounds=4, max_depth=4, max_bins=32).fit(
        train, feats, "comfort_tier_encoded", test)
    pred = model.transform(test)
    acc = pred.agg(F.avg((F.col("prediction") == F.col("comfort_tier_encoded")).cast("double"))).first()[0]
    assert acc > 0.6
    sums = pred.select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-9
    assert len(model.importances(15)) == 15
    bo.save_bundle(str(tmp_path / "bundle"), model, labels, tg.thresholds(tg.occupancy_pct(df)))
    back = bo.load_bundle(spark, str(tmp_path / "bundle"))
    p2 = back["model"].transform(test).select("messageId_leg_start", "leg_departure_dt", "prediction")
    p1 = pred.select("messageId_leg_start", "leg_departure_dt", "prediction")
    assert p1.exceptAll(p2).count() == 0


def test_score_with_boosted_model(spark, labelled):
    from coachload.operators import lookups as lk, scoring as sc
    from coachload.sources import requests as rq
    df, labels = labelled
    _, feats, _ = fe.select_features(df)
    model = bo.SoftmaxBoosting(rounds=2, max_depth=3, max_bins=32).fit(df, feats, "comfort_tier_encoded")
    legs = tables.legs(spark, SF001)
    lookups = lk.build_lookups(legs, tables.clean_codes(tables.tiplocs(spark, SF001)))
    reqs = rq.fixture_requests(legs, lookups["stations"])
    out = sc.score(reqs, lookups, model, labels, fe.selected_features())
    ok = out.where((F.col("status") == 200) & F.col("pos").isNotNull())
    assert ok.count() > 0
    assert ok.where(F.col("standard_tier").isNull() | F.col("first_tier").isNull()).count() == 0
    r = ok.agg(F.min("standard_confidence"), F.max("standard_confidence")).first()
    assert 1 / 3 <= r[0] <= r[1] <= 1.0


def test_split_hot_group_of_copies(spark):
    # class 0: 600 copies of one key plus 50 distinct keys; class 1: 40 keys
    rows = [("hot", 0)] * 600 + [(f"k{i}", 0) for i in range(50)] + [(f"m{i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "messageId_leg_start string, c int").repartition(7)
    df = df.withColumn("leg_departure_dt", F.lit("x"))
    s = md.stratified_split(df, "c")
    got = sorted(tuple(r) for r in s.groupBy("messageId_leg_start", "c", "split").count().collect())
    # brute force: per class, the round(0.2 n) smallest (hash, key) rows are test
    h = md.split_hash(["messageId_leg_start", "leg_departure_dt"])
    ranked = df.withColumn("h", h).select("messageId_leg_start", "c", "h").collect()
    want = {}
    for c in (0, 1):
        rs = sorted((r["h"], r["messageId_leg_start"]) for r in ranked if r["c"] == c)
        k = int(len(rs) * 0.2 + 0.5)
        for i, (_, key) in enumerate(rs):
            sp = "test" if i < k else "train"
            want[(key, c, sp)] = want.get((key, c, sp), 0) + 1
    assert got == sorted((k[0], k[1], k[2], v) for k, v in want.items())


def test_every_axis_of_the_grid_is_accepted():
    settings = bo.all_settings(bo.FULL_GRID)
    assert len(settings) == 243
    for p in settings:
        own = bo.SoftmaxBoosting().copy(**p)
        assert all(getattr(own, k) == v for k, v in p.items())
    assert all(len({p[k] for p in bo.DEFAULT_GRID}) > 1 for k in bo.FULL_GRID)
    assert min(p["rounds"] for p in bo.DEFAULT_GRID) >= bo.SoftmaxBoosting().rounds


def test_split_is_the_second_order_gain(spark):
    """One tree on one feature against the formula, by hand."""
    rows = [(float(x), int(x > 4)) for x in range(10)]
    df = spark.createDataFrame(rows, "x double, y int")
    model = bo.SoftmaxBoosting(rounds=1, max_depth=1, n_classes=2, patience=None, l2=1.0, learning_rate=1.0).fit(df, ["x"], "y")
    tree = model.trees[0][1]
    assert model.cuts[0][tree.bin[0]] == 4.0
    # p = 1/2: g = -/+ 1/2, h = 1/2
    assert tree.value[1] == pytest.approx(-2.5 / 3.5) and tree.value[2] == pytest.approx(2.5 / 3.5)
    assert tree.gain[0] == pytest.approx(2 * 2.5 ** 2 / 3.5)
    few = bo.SoftmaxBoosting(rounds=1, max_depth=1, n_classes=2, patience=None, min_child_weight=4.0).fit(df, ["x"], "y")
    assert few.trees[0][1].feature[0] == -1


def test_samples_differ_by_round_and_tree():
    rows = bo.np.arange(20_000)
    a, b = (bo.uniform(1, rows, r) < 0.8 for r in (0, 1))
    assert abs(a.mean() - 0.8) < 0.02 and abs((a & b).mean() - 0.64) < 0.02


def test_bundle_without_its_scaling_fails(spark, tmp_path):
    model = bo.SoftmaxBoostingModel([[bo.Tree.empty(1)] * 3], ["x"], [bo.np.array([1.0])])
    small = spark.createDataFrame([("x", True, 1.0, 2.0)], "feature string, scaled boolean, mean double, scale double")
    bo.save_bundle(str(tmp_path / "b"), model, small, small, small)
    assert bo.load_bundle(spark, str(tmp_path / "b"))["scaling"].count() == 1
    (tmp_path / "b" / "scaling").rename(tmp_path / "elsewhere")
    with pytest.raises(Exception):
        bo.load_bundle(spark, str(tmp_path / "b"))


def test_exact_quantiles_of_a_continuous_column(spark):
    from coachload.operators.quantiles import column_quantiles
    import numpy as np
    r = np.random.default_rng(3)
    for values in (r.normal(size=5_000) ** 3, np.repeat([1.0, 2.0, 7.0], [10, 3000, 5]), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
        probs = [0.0, 0.25, 0.33, 0.5, 0.67, 0.999, 1.0]
        got = column_quantiles(df, "x", probs).first()["q"]
        assert got == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)
    assert column_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).first()["q"] is None


def test_split_boundaries_by_radix_selection(spark):
    import random
    r = random.Random(2)
    values = [r.getrandbits(64) - (1 << 63) for _ in range(3000)] + [5] * 40 + [-7] * 3
    rows = [(v, r.choice("abc")) for v in values]
    df = spark.createDataFrame(rows, "h long, c string").repartition(6)
    for share in (0.0, 0.2, 0.5, 1.0):
        got = md.hash_at_rank(df, F.col("c"), F.col("h"), lambda n: F.floor(n * F.lit(share)) - 1)
        for c in "abc":
            own = sorted(v for v, k in rows if k == c)
            at = int(len(own) * share) - 1
            if at < 0:
                assert c not in got
            else:
                v = own[at]
                assert got[c] == (v, at + 1 - sum(x < v for x in own), own.count(v))


def test_three_way_split_parts(spark):
    rows = [(f"k{i}", i % 3) for i in range(500)] + [("hot", 0)] * 90
    df = spark.createDataFrame(rows, "messageId_leg_start string, c int").withColumn("leg_departure_dt", F.lit("x")).repartition(5)
    keys = ["messageId_leg_start", "leg_departure_dt"]
    for data in (df, df.where("messageId_leg_start <> 'hot'")):
        s = md.three_way_split(data, "c")
        got = sorted(tuple(r) for r in s.groupBy("messageId_leg_start", "c", "split").count().collect())
        want = {}
        all_rows = data.select("messageId_leg_start", "c", md.split_hash(keys, 42).alias("a"), md.split_hash(keys, 43).alias("b")).collect()
        for c in range(3):
            own = sorted((r for r in all_rows if r["c"] == c), key=lambda r: (r["a"], r[0]))
            test = int(len(own) * 0.2 + 0.5)
            rest = sorted(own[test:], key=lambda r: (r["b"], r[0]))
            valid = int(len(rest) * 0.25 + 0.5)
            for part, rs in (("test", own[:test]), ("valid", rest[:valid]), ("train", rest[valid:])):
                for r in rs:
                    want[r[0], c, part] = want.get((r[0], c, part), 0) + 1
        assert got == sorted((*k, v) for k, v in want.items())


def _leaf_rows(spark, n=400):
    import random
    r = random.Random(8)
    rows = [(r.random(), r.random(), r.randrange(5), i) for i in range(n)]
    return spark.createDataFrame([(a, b, float(c), int(a + b > 1) + int(c == 2), i) for a, b, c, i in rows],
                                 "a double, b double, c double, y int, i int")


def _same_trees(one, two):
    assert len(one.trees) == len(two.trees)
    for x, y in zip(one.trees, two.trees):
        for t, u in zip(x, y):
            assert (t.feature == u.feature).all() and (t.bin == u.bin).all()
            assert t.value == pytest.approx(u.value)


def test_stretches_and_tasks_grow_the_same_trees(spark):
    df = _leaf_rows(spark)
    base = bo.SoftmaxBoosting(rounds=7, max_depth=4, patience=None, subsample=0.8, colsample_bytree=0.7)
    whole = base.copy(tasks=1).fit(df, ["a", "b", "c"], "y", df)
    _same_trees(whole, base.copy(tasks=3, stretch=2).fit(df, ["a", "b", "c"], "y", df))
    assert len(whole.history["eval"]) == 7


def test_trees_follow_the_exact_histograms(spark):
    """Sibling subtraction and dealt features against sums over all rows."""
    import numpy as np
    df = _leaf_rows(spark)
    model = bo.SoftmaxBoosting(rounds=2, max_depth=3, patience=None, tasks=4).fit(df, ["a", "b", "c"], "y")
    rows = df.collect()
    x, y = np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.y for r in rows])
    bins, margins = bo.to_bins(x, model.cuts), np.zeros((len(x), 3))
    for rnd in model.trees:
        p = bo.softmax(margins)
        for k, tree in enumerate(rnd):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])
            inside = {0: np.ones(len(x), bool)}
            for node in range((1 << 3) - 1):
                if node not in inside:
                    continue
                own = inside[node]
                best = max(((g[l].sum() ** 2 / (h[l].sum() + 1) + g[q].sum() ** 2 / (h[q].sum() + 1)
                             - g[own].sum() ** 2 / (h[own].sum() + 1)), f, b)
                           for f in range(3) for b in range(64)
                           for l, q in [(own & (bins[:, f] <= b), own & (bins[:, f] > b))]
                           if h[l].sum() >= 1 and h[q].sum() >= 1) if h[own].sum() >= 2 else (0, -1, 0)
                if tree.feature[node] < 0:
                    assert best[0] <= 1e-6
                    continue
                assert tree.gain[node] == pytest.approx(best[0])
                f, b = tree.feature[node], tree.bin[node]
                inside[2 * node + 1], inside[2 * node + 2] = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                for child in (2 * node + 1, 2 * node + 2):
                    l = inside[child]
                    assert tree.value[child] == pytest.approx(-0.3 * g[l].sum() / (h[l].sum() + 1))
        for k, tree in enumerate(rnd):
            margins[:, k] += tree.outputs(bins)


def test_a_prefix_is_a_separate_fit(spark):
    df = _leaf_rows(spark).withColumns({"messageId_leg_start": F.col("i").cast("string"), "leg_departure_dt": F.lit("x")})
    grid = [{"max_depth": 3, "rounds": n} for n in (2, 5, 3)] + [{"max_depth": 2, "rounds": 4}]
    assert [(p["rounds"], sorted(at.values())) for p, at in bo.growths(grid, 9)] == [(5, [2, 3, 5]), (4, [4])]
    assert len(bo.growths(bo.all_settings(bo.FULL_GRID), 100)) == 81
    together = bo.grid_search(df, ["a", "b", "c"], "y", bo.SoftmaxBoosting(), grid).collect()
    for i, p in enumerate(grid):
        [alone] = bo.grid_search(df, ["a", "b", "c"], "y", bo.SoftmaxBoosting(), [p]).collect()
        assert alone["fold_accuracy"] == together[i]["fold_accuracy"]


LOST = """
import os, sys
sys.path.insert(0, {repo!r})
from coachload.session import build_session
from coachload.operators import boosting as bo, growth
spark = build_session("local[2,4]", shuffle_partitions=2)
from tests.test_model import _leaf_rows, _same_trees
df = _leaf_rows(spark)
est = bo.SoftmaxBoosting(rounds=6, max_depth=3, patience=None, tasks=2, stretch=3)
whole = est.fit(df, ["a", "b", "c"], "y")
own, marker = growth.Grower.round, {marker!r}
def lost(self):
    if self.folder.rank == 1 and len(self.runs[0].trees) == 4 and not os.path.exists(marker):
        open(marker, "w").close()
        os._exit(1)
    own(self)
growth.Grower.round = lost
_same_trees(whole, est.fit(df, ["a", "b", "c"], "y"))
assert os.path.exists(marker)
print("same trees")
"""


def test_a_lost_task_restarts_its_stretch(tmp_path):
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = LOST.format(repo=repo, marker=str(tmp_path / "lost"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=repo)
    assert "same trees" in done.stdout, done.stderr[-3000:]


def test_no_stage_beyond_the_size_of_generated_code(spark, capfd):
    """Janino's limit of 64 KB: such a stage would run interpreted."""
    from coachload.plans import q_model
    for name in ("model_split", "model_eval_report"):
        q_model.QUERIES[name](spark, SF001).collect()
    assert "grows beyond 64 KB" not in "".join(capfd.readouterr())


def test_cut_points_stay_at_their_ranks(monkeypatch):
    """Far more values than a task holds: ranks stay within the bound; few values are counted exactly."""
    import numpy as np
    rng = np.random.default_rng(4)
    monkeypatch.setattr(bo, "RUN", 1 << 10)
    monkeypatch.setattr(bo, "KEPT", 2_000)
    x = np.concatenate([rng.normal(size=150_000), np.zeros(50_000)])
    rng.shuffle(x)
    ranks, few = bo.Ranks(), bo.Ranks()
    for a in range(0, len(x), 700):
        ranks.add(x[a:a + 700])
        few.add(np.floor(x[a:a + 700]))
    assert all(len(r) == 1 << 10 for r in ranks.runs.values()) and len(ranks.runs) < 10
    values, counts = ranks.entries()
    assert len(values) <= 2_000 and counts.sum() == len(x)
    order, upto = np.sort(x), counts.cumsum()
    for share in np.arange(1, 64) / 64:
        v = values[np.searchsorted(upto, np.ceil(share * len(x)))]
        low, high = np.searchsorted(order, v, "left"), np.searchsorted(order, v, "right")
        assert low - 0.005 * len(x) <= share * len(x) <= high + 0.005 * len(x)
    values, counts = few.entries()
    assert values.tolist() == np.unique(np.floor(x)).tolist() and counts.tolist() == np.unique(np.floor(x), return_counts=True)[1].tolist()


def test_cut_points_come_without_an_aggregate_of_each_value(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile_approx", None)
    rows = spark.range(0, 3000, 1, 3).select((F.col("id") % 100).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.lit(5)).alias("b"),
                                             F.lit(None).cast("int").alias("c"), F.lit(float("nan")).alias("d"))
    a, b, c, d = bo._cuts(rows, ["a", "b", "c", "d"], 4)
    assert a.tolist() == [24.0, 49.0, 74.0] and b.tolist() == [5.0] and len(c) == len(d) == 0


def test_ranges_and_scaling_of_odd_columns(spark):
    """A column of nulls, one value, NaN; no rows; and the scaling has no lookup for each row."""
    import math
    import numpy as np
    cols = {"a": [1.5, 7.0, -3.0, 2000.5], "b": [None] * 4, "c": [5, 5, None, 5], "d": [1.0, float("nan"), 2.0, 3.0]}
    df = spark.createDataFrame(list(zip(*cols.values())), "a double, b double, c int, d double").repartition(3)
    got = {r["feature"]: r for r in md.feature_ranges(df, list(cols)).collect()}
    assert list(got) == list(cols) and got["b"][1:] == (None,) * 5
    a = np.array(cols["a"])
    assert got["a"][1:] == pytest.approx((a.min(), a.max(), a.mean(), a.std(ddof=1), a.std()))
    assert got["c"][1:] == (5.0, 5.0, 5.0, 0.0, 0.0) and math.isnan(got["d"]["max_train"])
    none = md.feature_ranges(df.where("a > 1e9"), ["a", "c"]).collect()
    assert [tuple(r) for r in none] == [("a", *[None] * 5), ("c", *[None] * 5)]
    plan = md.scaling_plan(md.feature_ranges(df, list(cols)))
    scaled = md.apply_scaling(df, plan, ["a", "c"])
    text = scaled._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" not in text and "element_at" not in text
    assert sorted(r["a"] for r in scaled.collect()) == pytest.approx(sorted((a - a.mean()) / a.std()))
    assert dict(scaled.dtypes) == {"a": "double", "b": "double", "c": "double", "d": "double"}
    twice = plan.unionByName(plan)
    with pytest.raises(ValueError):
        md.apply_scaling(df, twice, ["a"])
