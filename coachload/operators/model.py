"""Training-set preparation and evaluation (M1-M4, M7-M9, M11, M13) and a
rule-based baseline model.

Evaluation works on any prediction table with an integer ``label``, an
integer ``prediction`` and a ``probability`` array in class-code order
(Busy 0, Moderate 1, Quiet 2): one conditional-count aggregate, no collect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coachload.operators.target import TIER_CODES, tier_of

CLASS_NAMES = sorted(TIER_CODES, key=TIER_CODES.get)   # Busy, Moderate, Quiet


# M1 ------------------------------------------------------------------------
def split_hash(key_cols: list[str], seed: int = 42) -> Column:
    """A 60-bit pseudo-random order key from the row key and the seed (md5,
    so it is reproducible in any SQL engine)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_at_rank(df: DataFrame, cls: Column, h: Column, rank: Callable[[Column], Column]) -> dict[str, tuple]:
    """The value of the 64-bit hash ``h`` at a 0-based rank in each class, by
    radix selection: {class: (value, rows at it up to the rank, rows at it)}.

    A pass counts rows by class and the next 16 bits, so its exchange has at
    most 65,536 rows a class and task; it keeps the prefix that holds the rank.
    Four passes at most; it ends as soon as one value is left.
    """
    raised = h.bitwiseXOR(F.lit(-1 << 63))      # signed order as unsigned order
    found: dict[str, tuple] = {}
    left: dict[str, tuple[int, int]] = {}
    w = Window.partitionBy("key")
    for shift in (48, 32, 16, 0):
        rows = df
        if left:
            at = None
            for k, (prefix, _) in left.items():
                own = (cls == k) & (F.shiftrightunsigned(raised, shift + 16) == prefix)
                at = own if at is None else at | own
            rows = df.where(at)
        digit = F.shiftrightunsigned(raised, shift).bitwiseAND(F.lit(0xFFFF))
        counts = rows.groupBy(cls.alias("key"), digit.alias("digit")).agg(
            F.count(F.lit(1)).alias("n"), F.min(h).alias("low"), F.max(h).alias("high"))
        counts = counts.select("*", F.sum("n").over(w).alias("total"), F.coalesce(F.sum("n").over(
            w.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        wanted = rank(F.col("total")) if shift == 48 else F.element_at(
            F.create_map(*[F.lit(x) for k, (_, r) in left.items() for x in (k, r)]), F.col("key"))
        hits = counts.withColumn("rank", wanted.cast("long")).where(
            (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).collect()
        left = {}
        for r in hits:
            if r["low"] == r["high"]:
                found[r["key"]] = (r["low"], r["rank"] + 1 - r["before"], r["n"])
            else:
                left[r["key"]] = (((r["low"] & (1 << 64) - 1) ^ 1 << 63) >> shift, r["rank"] - r["before"])
        if not left:
            break
    return found


class _Share:
    """The rows that are first in the order (hash of the key, hash of the row)
    of their class, a given number of each class."""

    def __init__(self, df: DataFrame, cls: Column, h: Column, whole: Column, number: Callable[[Column], Column]):
        # class -> (boundary hash, rows at it that belong, rows at it)
        first = hash_at_rank(df, cls, h, lambda n: number(n) - 1)
        shared = {k: b for k, b in first.items() if b[1] < b[2]}
        second: dict[str, tuple] = {}
        if shared:
            at = None
            for k, (v, _, _) in shared.items():
                at = (cls == k) & (h == v) if at is None else at | ((cls == k) & (h == v))
            take = F.create_map(*[F.lit(x) for k, b in shared.items() for x in (k, b[1])])
            second = hash_at_rank(df.where(at), cls, whole, lambda n: F.element_at(take, F.col("key")) - 1)
        self.inside, self.torn = F.lit(False), F.lit(False)
        for k, (v, _, _) in first.items():
            own = h <= v
            if k in second:
                u, some, n = second[k]
                own = (h < v) | ((h == v) & (whole <= u))
                if some < n:
                    self.torn = self.torn | ((cls == k) & (h == v) & (whole == u))
            self.inside = self.inside | ((cls == k) & own)
        #: class -> copies of one row that belong, of those that straddle the boundary
        self.some = {k: some for k, (_, some, n) in second.items() if some < n}


def _class_of(label: str) -> Column:
    return F.coalesce(F.col(label).cast("string"), F.lit("null"))


def _number(share: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(n * F.lit(float(share)) + F.lit(0.5))


def _whole(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in df.columns])


def stratified_split(df: DataFrame, label: str = "comfort_tier_encoded",
                     key_cols: list[str] | None = None, test: float = 0.2,
                     seed: int = 42, out: str = "split", hashed: str | None = None) -> DataFrame:
    """Exact per-class split: in every class the ``round(test * n_class)``
    rows with the smallest (hash of the key, hash of the row) go to test.

    Radix selection finds the boundary hash of each class; rows at a boundary
    hash shared by several rows are bounded again by the hash of the whole row.
    The split is then one projection over the input, with one boundary per
    class as literals; nothing is written.  Only copies of one row that
    straddle the boundary are counted and split by number, so a huge group of
    copies is reduced before it moves.  Store a dear input first: it is read a
    few times, each time only the key and the label.  ``hashed`` names a column
    that holds ``split_hash`` already; it is no part of the rows.
    """
    key_cols = key_cols or ["messageId_leg_start", "leg_departure_dt"]
    cls = _class_of(label)
    if hashed:
        rows = df.drop(hashed)
        share = _Share(df, cls, F.col(hashed), _whole(rows), _number(test))
        if not share.some:
            return df.withColumn(out, F.when(share.inside, "test").otherwise("train")).drop(hashed)
        return stratified_split(rows, label, key_cols, test, seed, out)
    share = _Share(df, cls, split_hash(key_cols, seed), _whole(df), _number(test))
    split = F.when(share.inside, "test").otherwise("train")
    if not share.some:
        return df.withColumn(out, split)
    some = F.element_at(F.create_map(*[F.lit(x) for k, n in share.some.items() for x in (k, n)]), cls)
    copies = df.where(share.torn).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__some", some)
    copies = copies.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i"), "__some")
    copies = copies.select(*df.columns, F.when(F.col("__i") <= F.col("__some"), "test").otherwise("train").alias(out))
    return df.where(~share.torn).withColumn(out, split).unionByName(copies)


def three_way_split(df: DataFrame, label: str = "comfort_tier_encoded", key_cols: list[str] | None = None,
                    test: float = 0.2, valid: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """As ``stratified_split`` with a third part ``valid``, of ``valid`` of all
    rows of each class, so that early stopping and model choice need not see
    the test rows.

    The boundaries of the second part are selected among the rows beyond the
    first one's; all three parts then come from one projection, unless copies
    of one row straddle a boundary."""
    key_cols = key_cols or ["messageId_leg_start", "leg_departure_dt"]
    cls, rest = _class_of(label), valid / (1 - test)
    first = _Share(df, cls, split_hash(key_cols, seed), _whole(df), _number(test))
    if not first.some:
        second = _Share(df.where(~first.inside), cls, split_hash(key_cols, seed + 1), _whole(df), _number(rest))
        if not second.some:
            return df.withColumn(out, F.when(first.inside, "test").when(second.inside, "valid").otherwise("train"))
    one = stratified_split(df, label, key_cols, test, seed, out)
    two = stratified_split(one.where(F.col(out) == "train").drop(out), label, key_cols, rest, seed + 1, out)
    two = two.withColumn(out, F.when(F.col(out) == "test", "valid").otherwise("train"))
    return one.where(F.col(out) == "test").unionByName(two)


# M2 ------------------------------------------------------------------------
def split_distribution(df: DataFrame, label: str = "comfort_tier_encoded",
                       split: str = "split") -> DataFrame:
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(split)
    return counts.withColumn("percent", F.col("count") / F.sum("count").over(w) * F.lit(100.0))


# M3 ------------------------------------------------------------------------
def feature_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row per column, in their order.  The columns' values are stacked and
    grouped: one aggregate with five columns, whatever their number (an
    aggregate of all columns side by side is too wide for generated code)."""
    x = F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("__i", "__x")
    stats = df.select(x).groupBy("__i").agg(
        F.min("__x").alias("min_train"), F.max("__x").alias("max_train"), F.avg("__x").alias("mean_train"),
        F.stddev_samp("__x").alias("std_train"), F.stddev_pop("__x").alias("std_pop"))
    names = stats.columns[1:]
    held = stats.agg(F.map_from_entries(F.collect_list(F.struct("__i", F.struct(*names)))).alias("held"))
    of = [F.struct(F.lit(c).alias("feature"), F.try_element_at("held", F.lit(i)).alias("x")) for i, c in enumerate(cols)]
    return held.select(F.explode(F.array(*of)).alias("r")).select("r.feature", *[f"r.x.{n}" for n in names])


# M4 ------------------------------------------------------------------------
def scaling_plan(ranges: DataFrame, max_limit: float = 1000.0,
                 std_limit: float = 100.0) -> DataFrame:
    """Columns to standardize (max > 1000 or std > 100), with the train mean
    and population std (zero std -> 1), as a StandardScaler would fit."""
    big = (F.col("max_train") > max_limit) | (F.col("std_train") > std_limit)
    scale = F.when(F.col("std_pop") == 0, F.lit(1.0)).otherwise(F.col("std_pop"))
    return ranges.select("feature", big.alias("scaled"), F.col("mean_train").alias("mean"),
                         scale.alias("scale"))


def apply_scaling(df: DataFrame, plan: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(x - mean) / scale for the planned columns among ``features``
    (default: the numeric columns).  The plan, a row per column, is read here
    and enters as literals.  Feature columns come out as double, the type
    the model reads; other columns are kept."""
    from coachload.operators.profile import numeric_columns
    entries = plan.where("scaled").select("feature", "mean", "scale").collect()
    held = {r["feature"]: r for r in entries}
    if len(held) < len(entries):
        raise ValueError("the plan has a column twice")
    cols = {}
    for c in (features or numeric_columns(df)):
        if c in df.columns:
            x, own = F.col(c).cast("double"), held.get(c)
            cols[c] = x if own is None else (x - F.lit(own["mean"]).cast("double")) / F.lit(own["scale"]).cast("double")
    return df.withColumns(cols)


# Baseline model ------------------------------------------------------------
class ThresholdModel:
    """Scores a row by the tier rule applied to an occupancy feature.

    Deterministic and SQL-expressible, it stands in for a trained model where
    an oracle must see the same probabilities; the tier found gets
    ``confidence`` and the other two classes share the rest.
    """

    def __init__(self, thresholds: DataFrame, feature: str = "total_occupancy_percentage",
                 confidence: float = 0.8):
        self.thresholds = thresholds
        self.feature = feature
        self.confidence = confidence

    def probability(self) -> Column:
        low = self.thresholds.select("low").scalar()
        high = self.thresholds.select("high").scalar()
        tier = tier_of(F.col(self.feature), low, high)
        other = (1.0 - self.confidence) / 2
        return F.array(*[F.when(tier == c, self.confidence).otherwise(other) for c in CLASS_NAMES])

    def transform(self, df: DataFrame) -> DataFrame:
        p = F.col("probability")
        out = df.withColumn("probability", self.probability())
        return out.withColumn("prediction",
                              (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    def predict_classes(self, df: DataFrame, feature_list: list[str] | None = None) -> DataFrame:
        return self.transform(df)


# M7 ------------------------------------------------------------------------
def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction",
             by: str | None = None) -> DataFrame:
    g = pred.groupBy(by) if by else pred.groupBy()
    return g.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("rows"))


def _confusion_wide(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    k = len(CLASS_NAMES)
    return pred.agg(*[F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"c{a}{p}")
                      for a in range(k) for p in range(k)])


# M9 ------------------------------------------------------------------------
def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """actual x predicted counts, all classes listed, zero-filled."""
    k = len(CLASS_NAMES)
    wide = _confusion_wide(pred, label, prediction)
    structs = [F.struct(F.lit(CLASS_NAMES[a]).alias("actual"),
                        *[F.col(f"c{a}{p}").alias(CLASS_NAMES[p]) for p in range(k)])
               for a in range(k)]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# M8 ------------------------------------------------------------------------
def classification_report(pred: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1, support per class, then macro and weighted
    averages (0 where a ratio is undefined)."""
    k = len(CLASS_NAMES)
    wide = _confusion_wide(pred, label, prediction)
    c = lambda a, p: F.col(f"c{a}{p}")
    rows = []
    for i, name in enumerate(CLASS_NAMES):
        tp = c(i, i)
        support = sum((c(i, p) for p in range(k)), F.lit(0))
        predicted = sum((c(a, i) for a in range(k)), F.lit(0))
        prec = F.coalesce(F.try_divide(tp, predicted), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp, support), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("class_name"), prec.cast("double").alias("precision"),
                             rec.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                             support.cast("bigint").alias("support")))
    per = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("class_name"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                    tot.alias("support"))
    wsum = lambda m: F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), tot), F.lit(0.0))
    weighted = per.agg(F.lit("weighted avg").alias("class_name"), wsum("precision").alias("precision"),
                       wsum("recall").alias("recall"), wsum("f1_score").alias("f1_score"),
                       tot.alias("support"))
    return per.unionByName(macro).unionByName(weighted)


# M11 -----------------------------------------------------------------------
def confidence_by_class(pred: DataFrame, label: str = "label",
                        prob: str = "probability") -> DataFrame:
    """Mean probability given to the true class, per true class."""
    p_true = F.element_at(F.col(prob), (F.col(label) + 1).cast("int"))
    return (pred.groupBy(F.element_at(F.array(*[F.lit(c) for c in CLASS_NAMES]),
                                      (F.col(label) + 1).cast("int")).alias("actual"))
            .agg(F.avg(p_true).alias("avg_confidence"), F.count(F.lit(1)).alias("rows")))


# M13 -----------------------------------------------------------------------
def choose(initial, tuned, initial_score: float, tuned_score: float):
    """The tuned model only when strictly better on the held-out score."""
    return (tuned, "tuned") if tuned_score > initial_score else (initial, "initial")
