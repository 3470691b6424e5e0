"""Registered model queries (M1-M13, S8) and their SQL oracles.

Split, distributions, ranges, scaling and the evaluation of the rule-based
model are compared by value.  What a trained model predicts has no SQL form;
its queries return facts of the result that SQL can state: which rows are
scored, that probabilities are such and the class is their maximum, that the
model beats the majority class, that a saved model predicts the same.
"""

from __future__ import annotations

import json
import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coachload.operators import boosting as bo, features as fe, model as md, target as tg
from coachload.plans import sqlparts as sq
from coachload.plans.q_features import _engineered_sql
from coachload.session import discard, drop_shuffles, materialize, scratch_path, still_there
from coachload.sources import tables

KEY = tables.LEG_KEY
LABEL = "comfort_tier_encoded"
# Columns of the legs that no feature, key or label is made of.
UNUSED = ["driverId", "next_station_departure_dt", "unitId", "vehicleNo"]
# The split's hash of a row's key, stored with the engineered rows.
HASHED = "__split_hash"
# Limits low enough that some columns of the fixture are scaled.
SCALE_LIMITS = dict(max_limit=100.0, std_limit=20.0)
# The engineered table of a folder with its dictionary, thresholds and feature
# names, and the default model, made once per Spark application.
_STORED: dict[tuple[str, str], tuple] = {}
_SEARCHED: dict[tuple[str, str], DataFrame] = {}
_FITTED: dict[tuple[str, str], bo.SoftmaxBoostingModel] = {}


class Ctx:
    """The labelled legs, engineered once for a folder and application and
    stored; every query reads the columns it uses."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def stored(self):
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STORED or not all(map(still_there, _STORED[key][:3])):
            legs = tables.stored_legs(self.spark, self.sf_dir, [
                c for c in tables.legs(self.spark, self.sf_dir).columns if c not in UNUSED])
            drop_shuffles(self.spark)
            feats, labels = fe.engineer(legs)
            thresholds = materialize(tg.thresholds(tg.occupancy_pct(legs)), "thresholds")
            done = tg.encode_tier(tg.assign_tier(tg.occupancy_pct(feats), thresholds))
            _, available, _ = fe.select_features(done)
            _STORED[key] = (materialize(done.select(*KEY, LABEL, *available, md.split_hash(KEY).alias(HASHED)), "engineered"), labels, thresholds, available)
            discard(legs)
            drop_shuffles(self.spark)
        return _STORED[key]

    @property
    def engineered(self):
        return self.stored[0]

    @property
    def labels(self):
        return self.stored[1]

    @property
    def thresholds(self):
        return self.stored[2]

    @property
    def features(self):
        return self.stored[3]

    @cached_property
    def split(self):
        return md.stratified_split(self.engineered.select(*KEY, LABEL, *self.features, HASHED), LABEL, KEY, hashed=HASHED)

    def part(self, name):
        return self.split.where(F.col("split") == name)

    def rule_predictions(self):
        pred = md.ThresholdModel(self.thresholds).transform(self.split)
        return pred.withColumnRenamed(LABEL, "label")

    @property
    def searched(self):
        """The default grid's search."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _SEARCHED:
            _SEARCHED[key] = bo.grid_search(self.part("train"), self.features, LABEL, bo.SoftmaxBoosting(), folds=3)
        return _SEARCHED[key]

    @property
    def boosted(self):
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _FITTED:
            _FITTED[key] = bo.SoftmaxBoosting().fit(self.part("train"), self.features, LABEL, self.part("test"))
        return _FITTED[key]


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def q_split(spark, sf_dir):
    return Ctx(spark, sf_dir).split.select(*KEY, LABEL, "split")


def q_split_distribution(spark, sf_dir):
    d = md.split_distribution(Ctx(spark, sf_dir).split, LABEL)
    return d.select("split", LABEL, "count", r6("percent"))


def q_ranges(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    r = md.feature_ranges(c.split.where(F.col("split") == "train"), c.features)
    return r.select("feature", "min_train", "max_train", r6("mean_train"), r6("std_train"), r6("std_pop"))


def q_scaling(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    r = md.feature_ranges(c.split.where(F.col("split") == "train"), c.features)
    return md.scaling_plan(r).select("feature", "scaled", r6("mean"), r6("scale"))


def q_accuracy(spark, sf_dir):
    return md.accuracy(Ctx(spark, sf_dir).rule_predictions(), by="split").select(
        "split", r6("accuracy"), "rows")


def _test_pred(spark, sf_dir):
    return Ctx(spark, sf_dir).rule_predictions().where(F.col("split") == "test")


def q_report(spark, sf_dir):
    r = md.classification_report(_test_pred(spark, sf_dir))
    return r.select("class_name", r6("precision"), r6("recall"), r6("f1_score"), "support")


def q_confusion(spark, sf_dir):
    return md.confusion(_test_pred(spark, sf_dir))


def q_confidence(spark, sf_dir):
    return md.confidence_by_class(_test_pred(spark, sf_dir)).select("actual", r6("avg_confidence"), "rows")


def q_scaled(spark, sf_dir):
    """M4: the training rows with the planned columns standardised."""
    c = Ctx(spark, sf_dir)
    plan = materialize(md.scaling_plan(md.feature_ranges(c.part("train"), c.features), **SCALE_LIMITS), "scaling")
    scaled = md.apply_scaling(c.part("train"), plan, c.features)
    changed = {r["feature"] for r in plan.where("scaled").collect()}
    # whole numbers that stay as they are have no places to round
    whole = {f for f, kind in c.engineered.dtypes if kind in ("int", "bigint")} - changed
    return scaled.select(*KEY, *[F.col(f) if f in whole else r6(f) for f in c.features])


def q_three_way(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    s = md.three_way_split(c.engineered.select(*KEY, LABEL), LABEL, KEY)
    return s.groupBy("split", LABEL).agg(F.count(F.lit(1)).alias("rows"))


def q_choice(spark, sf_dir):
    """The rule with fixed thresholds against the fitted ones, by their
    accuracy on the test rows."""
    c = Ctx(spark, sf_dir)
    test = c.part("test").withColumnRenamed(LABEL, "label")

    def share(thresholds):
        return md.accuracy(md.ThresholdModel(thresholds).transform(test)).first()["accuracy"]

    fixed, fitted = share(tg.thresholds(c.engineered, "fixed")), share(c.thresholds)
    return spark.createDataFrame([(md.choose("fixed", "fitted", fixed, fitted)[0], round(fixed, 6), round(fitted, 6))],
                                 "chosen string, fixed_accuracy double, fitted_accuracy double")


def _sound(pred):
    total = F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)
    return pred.withColumns({
        "sums_to_one": F.abs(total - 1) < 1e-9,
        "is_maximum": F.element_at("probability", F.col("prediction") + 1) == F.array_max("probability")})


def q_boosting(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _sound(c.boosted.transform(c.part("test"))).select(*KEY, LABEL, "sums_to_one", "is_maximum")


def q_boosting_report(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    pred = c.boosted.transform(c.split).withColumnRenamed(LABEL, "label")
    rows = pred.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("right"))
    return rows.groupBy("split").agg(F.sum("n").alias("rows"), F.max("n").alias("majority"),
                                     (F.sum("right") > F.max("n")).alias("beats_majority"))


def q_history(spark, sf_dir):
    """Both log-loss histories are means over their part's rows, have a value
    per round and fall from the first to the best round."""
    m = Ctx(spark, sf_dir).boosted
    rows = [(part, m.rows[part], len(h) >= len(m.trees), min(h) < h[0]) for part, h in m.history.items()]
    return spark.createDataFrame(rows, "part string, rows long, complete boolean, falls boolean")


def q_importances(spark, sf_dir):
    """The top 15: ranked, falling, of the model's features, shares of one."""
    c = Ctx(spark, sf_dir)
    top = bo.importances(spark, c.boosted, 15)
    known = F.col("feature").isin(c.features)
    return top.select("rank", known.alias("known"), F.col("importance").between(0, 1).alias("is_share"))


def q_folds(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    fold = F.pmod(md.split_hash(KEY, 43), F.lit(3)).cast("int")
    return c.part("train").groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("rows"))


def q_grid(spark, sf_dir):
    """M12 with the default grid and estimator: a row for each setting and
    fold, with the rows that its accuracy is a share of."""
    c = Ctx(spark, sf_dir)
    mean = F.aggregate("fold_accuracy", F.lit(0.0), lambda a, b: a + b) / F.size("fold_accuracy")
    whole = F.abs(F.col("x.fold_accuracy") * F.col("x.fold_rows") - F.round(F.col("x.fold_accuracy") * F.col("x.fold_rows"))) < 1e-6
    found = c.searched.withColumn("mean", mean)
    return found.select("setting", "params", "mean", "mean_accuracy", F.posexplode(F.arrays_zip("fold_accuracy", "fold_rows")).alias("fold", "x")) \
        .select("setting", "params", "fold", F.col("x.fold_rows").alias("rows"),
                (whole & (F.abs(F.col("mean") - F.col("mean_accuracy")) < 1e-9) & (F.col("mean_accuracy") > 0.5)).alias("sound"))


def q_choice_trained(spark, sf_dir):
    """The first model against the one with the search's best setting, by
    their accuracy on the test rows."""
    c = Ctx(spark, sf_dir)
    best = json.loads(c.searched.orderBy(F.desc("mean_accuracy"), "setting").first()["params"])
    test = c.part("test")
    tuned = bo.SoftmaxBoosting(**best).fit(c.part("train"), c.features, LABEL, test)

    def right(model):
        return model.transform(test).withColumnRenamed(LABEL, "label").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == F.col("prediction")).alias("right")).first()

    first, other = right(c.boosted), right(tuned)
    model, which = md.choose(c.boosted, tuned, first["right"] / first["rows"], other["right"] / other["rows"])
    taken = right(model)
    return spark.createDataFrame([(taken["rows"], which == ("tuned" if other["right"] > first["right"] else "initial"),
                                   taken["right"] == max(first["right"], other["right"]))],
                                 "rows long, strictly_better boolean, best_taken boolean")


def q_bundle(spark, sf_dir):
    """The bundle written, read back, and asked for the test rows again."""
    c = Ctx(spark, sf_dir)
    path = f"{scratch_path(spark, 'bundle')}-{uuid.uuid4().hex}"
    plan = md.scaling_plan(md.feature_ranges(c.part("train"), c.features))
    bo.save_bundle(path, c.boosted, c.labels, c.thresholds, plan, {"threshold_method": "quantile"})
    back = bo.load_bundle(spark, path)
    own = c.boosted.transform(c.part("test")).select(*KEY, "split", F.col("probability").alias("own"), *c.features)
    both = back["model"].transform(own).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("own") == F.col("probability")).alias("equal"))
    names = ["labels", "scaling", "thresholds"]
    counts = [back[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows") for n in names]
    out = both.select(F.explode(F.array(F.struct(F.lit("scored").alias("part"), F.col("rows")),
                                        F.struct(F.lit("equal").alias("part"), F.col("equal").alias("rows")))).alias("r")).select("r.*")
    for x in counts:
        out = out.unionByName(x)
    return out


QUERIES = {
    "model_split": q_split,
    "model_split_distribution": q_split_distribution,
    "model_feature_ranges": q_ranges,
    "model_scaling_plan": q_scaling,
    "model_eval_accuracy": q_accuracy,
    "model_eval_report": q_report,
    "model_eval_confusion": q_confusion,
    "model_eval_confidence": q_confidence,
    "model_scaled": q_scaled,
    "model_three_way_split": q_three_way,
    "model_choice": q_choice,
    "model_folds": q_folds,
    "model_boosting_predictions": q_boosting,
    "model_boosting_accuracy": q_boosting_report,
    "model_boosting_history": q_history,
    "model_importances": q_importances,
    "model_bundle": q_bundle,
    "model_grid_search": q_grid,
    "model_choice_trained": q_choice_trained,
}

# --- oracle texts -----------------------------------------------------------
_FEATS = [f for f in fe.selected_features() if f != "capacity_utilization"]
_H = ("CAST(('0x' || substr(md5('42' || '|' || messageId_leg_start || '|' || CAST(leg_departure_dt AS VARCHAR)), "
      "1, 15)) AS BIGINT)")


def _split_sql(body: str, *more: str) -> str:
    inner = _engineered_sql("SELECT * FROM labe")
    # _engineered_sql gives a full WITH ...; wrap it as one CTE named eng
    return sq.with_ctes(
        f"eng AS ({inner})",
        f"hs AS (SELECT eng.*, {_H} AS h FROM eng)",
        f"nt AS (SELECT {LABEL} AS c, floor(COUNT(*) * 0.2 + 0.5) AS ntest FROM hs GROUP BY 1)",
        f"sp AS (SELECT hs.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY {LABEL} ORDER BY h, messageId_leg_start, "
        "leg_departure_dt) <= nt.ntest THEN 'test' ELSE 'train' END AS split FROM hs JOIN nt ON nt.c = hs."
        f"{LABEL})",
        *more, body=body)


_KEYS = "messageId_leg_start, leg_departure_dt"
_MAX, _STD = SCALE_LIMITS["max_limit"], SCALE_LIMITS["std_limit"]


def _scaled_sql() -> str:
    stats = ", ".join(f"max({f}) AS hi{i}, avg({f}) AS m{i}, stddev_samp({f}) AS s{i}, stddev_pop({f}) AS p{i}" for i, f in enumerate(_FEATS))
    cols = ", ".join(f"round(CASE WHEN hi{i} > {_MAX} OR s{i} > {_STD} THEN (CAST({f} AS DOUBLE) - m{i}) / "
                     f"(CASE WHEN p{i} = 0 THEN 1.0 ELSE p{i} END) ELSE CAST({f} AS DOUBLE) END, 6) AS {f}" for i, f in enumerate(_FEATS))
    return _split_sql(f"SELECT {_KEYS}, {cols} FROM sp CROSS JOIN st WHERE split = 'train'",
                      f"st AS (SELECT {stats} FROM sp WHERE split = 'train')")


def _three_way_sql() -> str:
    h = _H.replace("'42'", "'43'")
    return _split_sql(
        f"SELECT split, {LABEL}, COUNT(*) AS rows FROM tw GROUP BY 1, 2",
        f"tr AS (SELECT {LABEL}, ROW_NUMBER() OVER (PARTITION BY {LABEL} ORDER BY {h}, {_KEYS}) AS r, "
        f"floor(COUNT(*) OVER (PARTITION BY {LABEL}) * (0.2 / (1 - 0.2)) + 0.5) AS nv FROM sp WHERE split = 'train')",
        f"tw AS (SELECT 'test' AS split, {LABEL} FROM sp WHERE split = 'test' UNION ALL "
        f"SELECT CASE WHEN r <= nv THEN 'valid' ELSE 'train' END, {LABEL} FROM tr)")


_PRED = [
    f"occt AS (SELECT {sq.pct('relevant_passengers_on_leg_departure', 'vehicle_capacity')} AS x FROM eng)",
    "thr AS (SELECT quantile_cont(x, 0.33) AS low, quantile_cont(x, 0.67) AS high FROM occt)",
    f"pred AS (SELECT sp.split, sp.{LABEL} AS label, CASE WHEN total_occupancy_percentage <= thr.low THEN 2 "
    "WHEN total_occupancy_percentage <= thr.high THEN 1 ELSE 0 END AS prediction FROM sp CROSS JOIN thr)",
    "tp AS (SELECT * FROM pred WHERE split = 'test')",
]


def _ranges_body():
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(min({f}) AS DOUBLE) AS min_train, CAST(max({f}) AS DOUBLE) AS max_train, "
        f"round(avg({f}), 6) AS mean_train, round(stddev_samp({f}), 6) AS std_train, "
        f"round(stddev_pop({f}), 6) AS std_pop FROM sp WHERE split = 'train'" for f in _FEATS)


_NAMES = ["Busy", "Moderate", "Quiet"]


def _report_body():
    parts = []
    for i, n in enumerate(_NAMES):
        tp = f"COUNT(*) FILTER (WHERE label = {i} AND prediction = {i})"
        sup = f"COUNT(*) FILTER (WHERE label = {i})"
        prd = f"COUNT(*) FILTER (WHERE prediction = {i})"
        p = f"COALESCE(CAST({tp} AS DOUBLE) / NULLIF({prd}, 0), 0.0)"
        r = f"COALESCE(CAST({tp} AS DOUBLE) / NULLIF({sup}, 0), 0.0)"
        parts.append(f"SELECT '{n}' AS class_name, {p} AS precision, {r} AS recall, "
                     f"COALESCE(2 * {p} * {r} / NULLIF({p} + {r}, 0), 0.0) AS f1_score, {sup} AS support FROM tp")
    return " UNION ALL ".join(parts)


_FIXED = "CASE WHEN total_occupancy_percentage <= 40 THEN 2 WHEN total_occupancy_percentage <= 70 THEN 1 ELSE 0 END"
ORACLES = {
    "model_scaled": _scaled_sql(),
    "model_three_way_split": _three_way_sql(),
    "model_choice": _split_sql(
        "SELECT CASE WHEN fitted_accuracy > fixed_accuracy THEN 'fitted' ELSE 'fixed' END AS chosen, "
        "round(fixed_accuracy, 6) AS fixed_accuracy, round(fitted_accuracy, 6) AS fitted_accuracy FROM ("
        "SELECT avg(CASE WHEN fx = label THEN 1.0 ELSE 0.0 END) AS fixed_accuracy, "
        "avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS fitted_accuracy FROM both_rules)",
        *_PRED, f"both_rules AS (SELECT sp.{LABEL} AS label, {_FIXED} AS fx, CASE WHEN total_occupancy_percentage <= thr.low THEN 2 "
        "WHEN total_occupancy_percentage <= thr.high THEN 1 ELSE 0 END AS prediction FROM sp CROSS JOIN thr WHERE split = 'test')"),
    "model_folds": _split_sql(
        f"SELECT CAST({_H.replace("'42'", "'43'")} % 3 AS INTEGER) AS fold, COUNT(*) AS rows FROM sp WHERE split = 'train' GROUP BY 1"),
    "model_boosting_predictions": _split_sql(
        f"SELECT {_KEYS}, {LABEL}, TRUE AS sums_to_one, TRUE AS is_maximum FROM sp WHERE split = 'test'"),
    "model_boosting_accuracy": _split_sql(
        f"SELECT split, CAST(SUM(n) AS BIGINT) AS rows, MAX(n) AS majority, TRUE AS beats_majority FROM (SELECT split, {LABEL}, COUNT(*) AS n "
        "FROM sp GROUP BY 1, 2) GROUP BY 1"),
    "model_boosting_history": _split_sql(
        "SELECT CASE split WHEN 'train' THEN 'train' ELSE 'eval' END AS part, COUNT(*) AS rows, TRUE AS complete, TRUE AS falls "
        "FROM sp GROUP BY 1"),
    "model_importances": "SELECT CAST(i AS INTEGER) AS rank, TRUE AS known, TRUE AS is_share FROM range(1, 16) t(i)",
    "model_bundle": _split_sql(
        "SELECT 'scored' AS part, COUNT(*) AS rows FROM sp WHERE split = 'test' UNION ALL "
        "SELECT 'equal', COUNT(*) FROM sp WHERE split = 'test' UNION ALL "
        "SELECT 'thresholds', 1 UNION ALL SELECT 'scaling', " + str(len(_FEATS)) + " UNION ALL SELECT 'labels', "
        + " + ".join(f"(SELECT COUNT(DISTINCT {c}) FROM eng)" for c in fe.ENCODED_COLUMNS)),
    "model_grid_search": _split_sql(
        "SELECT setting, params, fold, rows, TRUE AS sound FROM (VALUES " + ", ".join(
            f"({i}, '{json.dumps(p, sort_keys=True)}')" for i, p in enumerate(bo.DEFAULT_GRID)) + ") v(setting, params) CROSS JOIN "
        f"(SELECT CAST({_H.replace("'42'", "'43'")} % 3 AS INTEGER) AS fold, COUNT(*) AS rows FROM sp WHERE split = 'train' GROUP BY 1)"),
    "model_choice_trained": _split_sql("SELECT COUNT(*) AS rows, TRUE AS strictly_better, TRUE AS best_taken FROM sp WHERE split = 'test'"),
    "model_split": _split_sql(f"SELECT messageId_leg_start, leg_departure_dt, {LABEL}, split FROM sp"),
    "model_split_distribution": _split_sql(
        f"SELECT split, {LABEL}, COUNT(*) AS count, round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER "
        f"(PARTITION BY split) * 100.0, 6) AS percent FROM sp GROUP BY split, {LABEL}"),
    "model_feature_ranges": _split_sql(_ranges_body()),
    "model_scaling_plan": _split_sql(
        "SELECT feature, (max_train > 1000 OR std_train > 100) AS scaled, round(mean_train, 6) AS mean, "
        "round(CASE WHEN std_pop = 0 THEN 1.0 ELSE std_pop END, 6) AS scale FROM r",
        "r AS (" + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, CAST(max({f}) AS DOUBLE) AS max_train, avg({f}) AS mean_train, "
            f"stddev_samp({f}) AS std_train, stddev_pop({f}) AS std_pop FROM sp WHERE split = 'train'"
            for f in _FEATS) + ")"),
    "model_eval_accuracy": _split_sql(
        "SELECT split, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
        "COUNT(*) AS rows FROM pred GROUP BY split", *_PRED),
    "model_eval_report": _split_sql(
        "SELECT class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "round(f1_score, 6) AS f1_score, support FROM rep UNION ALL "
        "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), "
        "CAST(sum(support) AS BIGINT) "
        "FROM rep UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), "
        "round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6), "
        "CAST(sum(support) AS BIGINT) FROM rep", *_PRED, f"rep AS ({_report_body()})"),
    "model_eval_confusion": _split_sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS actual, " + ", ".join(
                f"COUNT(*) FILTER (WHERE label = {i} AND prediction = {j}) AS {m}" for j, m in enumerate(_NAMES))
            + " FROM tp" for i, n in enumerate(_NAMES)), *_PRED),
    "model_eval_confidence": _split_sql(
        "SELECT CASE label WHEN 0 THEN 'Busy' WHEN 1 THEN 'Moderate' ELSE 'Quiet' END AS actual, "
        "round(avg(CASE WHEN label = prediction THEN 0.8 ELSE 0.1 END), 6) AS avg_confidence, COUNT(*) AS rows "
        "FROM tp GROUP BY label", *_PRED),
}
