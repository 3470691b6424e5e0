"""The three end-to-end jobs a user of the reference runs, as Spark jobs.

* ``build_lookup_job``: legs + station codes -> lookup set written as parquet
  (stations, routes, historical averages, coach info, metadata), then
  validated (the reference's lookup preparation).
* ``train_job``: legs -> features -> tiers -> split -> (optional scaling) ->
  boosted trees with early stopping -> evaluation -> optional grid search and
  model choice -> model bundle (the reference's training chain).
* ``score_job``: request files + lookup set + bundle -> predictions written
  in request order (the reference's scoring service, as a batch job).

usage: python -m coachload.plans.jobs {lookups|train|score} ...
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coachload.operators import boosting as bo, features as fe, lookups as lk, model as md
from coachload.operators import profile as pr, scoring as sc, target as tg
from coachload.session import build_session, materialize
from coachload.sources import requests as rq, tables


def build_lookup_job(legs: DataFrame, codes: DataFrame, out: str,
                     sample_station: str | None = None, route_partitions: int | None = None) -> DataFrame:
    """Write the lookup set under ``out``; returns the validation table."""
    t = lk.build_lookups(legs, codes)
    lk.write_lookups(t, out, route_partitions=route_partitions)
    written = lk.read_lookups(legs.sparkSession, out)
    sample = sample_station or written["stations"].agg(F.min("station_name")).first()[0] or ""
    return lk.validate_lookups(written, sample)


def train_job(legs: DataFrame, out: str, method: str = "quantile",
              estimator: bo.SoftmaxBoosting | None = None, grid: list[dict] | None = None,
              folds: int = 3, three_way: bool = False, before_departure: bool = False) -> dict:
    """Train, evaluate and save the bundle; returns the evaluation summary.

    ``three_way``: early stopping and model choice use a validation part, and
    the test rows are only reported on (the reference lets the test rows
    decide).  ``before_departure``: without the columns that are known only
    after the leg has left, which the target is computed from."""
    label = "comfort_tier_encoded"
    feats, labels = fe.engineer(legs)
    thr = materialize(tg.thresholds(tg.occupancy_pct(legs), method), "thresholds")
    groups = fe.groups_before_departure() if before_departure else None
    _, features, _ = fe.select_features(feats, groups)
    # Engineered once; the split, the scaling, the cut points and the reports read this table.
    data = tg.encode_tier(tg.assign_tier(tg.occupancy_pct(feats), thr)).select(*tables.LEG_KEY, label, *features)
    reports = pr.ScanReports(data, date="leg_departure_dt", label=label)
    data = materialize(reports.watch(data), "engineered")
    data = (md.three_way_split if three_way else md.stratified_split)(data, label)
    train = data.where(F.col("split") == "train")
    plan = materialize(md.scaling_plan(md.feature_ranges(train, features)), "scaling")
    data = md.apply_scaling(data, plan, features)

    def part(name: str) -> DataFrame:
        return data.where(F.col("split") == name)

    decides = part("valid" if three_way else "test")
    est = estimator or bo.SoftmaxBoosting()
    model = est.fit(part("train"), features, label, decides)

    def accuracies(m) -> dict[str, float]:
        p = m.transform(data).withColumnRenamed(label, "label")
        return {r["split"]: r["accuracy"] for r in md.accuracy(p, by="split").collect()}

    initial = accuracies(model)
    chosen, which, tuned, best = model, "initial", None, None
    if grid is not None:
        res = bo.grid_search(part("train"), features, label, est, grid or None, folds)
        best = json.loads(res.orderBy(F.desc("mean_accuracy"), "setting").first()["params"])
        other = est.copy(**best).fit(part("train"), features, label, decides)
        tuned = accuracies(other)
        key = "valid" if three_way else "test"
        chosen, which = md.choose(model, other, initial[key], tuned[key])
    info = {"feature_list": features, "threshold_method": method, "chosen": which, "classes": md.CLASS_NAMES,
            "best_iteration": chosen.best_iteration, "history": chosen.history,
            "train_accuracy_initial": initial.get("train"), "test_accuracy_initial": initial.get("test"),
            "test_accuracy_tuned": tuned and tuned.get("test"), "best_params": best if which == "tuned" else None}
    bo.save_bundle(out, chosen, labels, thr, plan, info)
    for name, report in reports.tables().items():
        report.coalesce(1).write.mode("overwrite").parquet(f"{out.rstrip('/')}/reports/{name}")
    return info


def score_job(spark: SparkSession, requests: DataFrame, lookup_path: str, bundle_path: str,
              out: str | None = None, dow: str = "sunday0", skew: str | None = None) -> DataFrame:
    """Score requests with a saved bundle and lookup set; the flat result is
    returned and, if ``out`` is given, the nested response is written."""
    bundle = bo.load_bundle(spark, bundle_path)
    lookups = lk.read_lookups(spark, lookup_path)

    class Scaled:
        """Applies the saved scaling before the model (the reference saves a
        scaler but does not apply it when serving)."""

        def predict_classes(self, df, feature_list=None):
            if "scaling" in bundle:
                df = md.apply_scaling(df, bundle["scaling"], bundle["info"]["feature_list"])
            return bundle["model"].predict_classes(df, feature_list)

    flat = sc.score(requests, lookups, Scaled(), bundle["labels"], bundle["info"]["feature_list"],
                    dow=dow, skew=skew)
    if out:
        sc.write_predictions(flat, out)
    return flat


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="coachload.plans.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("lookups")
    a.add_argument("--legs", required=True)
    a.add_argument("--codes")
    a.add_argument("--out", required=True)
    b = sub.add_parser("train")
    b.add_argument("--legs", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--rounds", type=int, default=100)
    c = sub.add_parser("score")
    c.add_argument("--requests", required=True)
    c.add_argument("--lookups", required=True)
    c.add_argument("--bundle", required=True)
    c.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = build_session()
    if args.cmd == "lookups":
        build_lookup_job(tables.read_legs(spark, args.legs), tables.read_codes(spark, args.codes),
                         args.out).show(truncate=False)
    elif args.cmd == "train":
        print(json.dumps(train_job(tables.read_legs(spark, args.legs), args.out,
                                   estimator=bo.SoftmaxBoosting(rounds=args.rounds))))
    else:
        score_job(spark, rq.read_requests(spark, args.requests), args.lookups, args.bundle,
                  os.path.join(args.out))


if __name__ == "__main__":
    main()
