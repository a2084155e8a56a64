"""Forecasting: features, boosted trees, rolling-origin tuning, recursive prediction, evaluation."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.operators.cleaning import DAY, ID, V
from panelforge.operators.labels import CLUSTER
from panelforge.sources.panel import PanelError

#: Households that a task forecasts at once: their days are one frame in memory.
BUCKET = 2_000
LAGS, WINDOWS, HORIZON = (1, 7, 14, 30), (7, 14, 30), 366
FEATURES = (
    *[f"lag_{k}" for k in LAGS],
    *[x for w in WINDOWS for x in (f"rolling_mean_{w}", f"rolling_std_{w}")],
    *("day_of_week", "month", "day_of_year", "is_weekend", "week_of_year"),
    *("day_of_year_sin", "day_of_year_cos", "week_of_year_sin", "week_of_year_cos"),
    *("household_mean", "cluster_dow_mean", "cluster_month_mean", "household_minus_cluster_dow_mean", "household_minus_cluster_month_mean"),
)
QUANTILES = (0.1, 0.5, 0.9)
#: Trees, step, leaves and smallest leaf of the tuning candidates.
GRID = (
    (300, 0.05, 31, 20),
    (500, 0.05, 63, 20),
    (700, 0.03, 63, 30),
    (500, 0.03, 127, 40),
)
def _series():
    return Window.partitionBy(ID).orderBy(DAY)


def cluster_priors(train: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean by cluster and weekday, and by cluster and month, from regular clusters."""
    known = train.join(labels.filter("cluster >= 0").select(ID, CLUSTER), ID)
    dow = known.groupBy(CLUSTER, F.weekday(DAY).alias("day_of_week")).agg(F.avg(V).alias("cluster_dow_mean"))
    month = known.groupBy(CLUSTER, F.month(DAY).alias("month")).agg(F.avg(V).alias("cluster_month_mean"))
    return dow, month


def lag_features(panel: DataFrame) -> DataFrame:
    """Lags and the mean and deviation of the days before; one window ordering serves all.

    The deviation of fewer than two days is 0, the mean of none null.
    """
    out = panel.select("*", *[F.lag(V, k).over(_series()).alias(f"lag_{k}") for k in LAGS])
    for w in WINDOWS:
        frame = _series().rowsBetween(-w, -1)
        out = out.withColumns({f"rolling_mean_{w}": F.avg(V).over(frame), f"rolling_std_{w}": F.coalesce(F.stddev_samp(V).over(frame), F.lit(0.0))})
    return out


def calendar_features(panel: DataFrame) -> DataFrame:
    """Weekday (Monday 0), month, day of year, weekend, ISO week, and day and week on circles."""
    day, week = F.dayofyear(DAY), F.weekofyear(DAY)
    return panel.withColumns(
        {
            "day_of_week": F.weekday(DAY),
            "month": F.month(DAY),
            "day_of_year": day,
            "is_weekend": (F.weekday(DAY) >= 5).cast("int"),
            "week_of_year": week,
            "day_of_year_sin": F.sin(day * (2 * math.pi / 366)),
            "day_of_year_cos": F.cos(day * (2 * math.pi / 366)),
            "week_of_year_sin": F.sin(week * (2 * math.pi / 53)),
            "week_of_year_cos": F.cos(week * (2 * math.pi / 53)),
        }
    )


def build_features(panel: DataFrame, labels: DataFrame, priors: tuple[DataFrame, DataFrame], means: DataFrame | None = None) -> DataFrame:
    """All 24 features; household means from `means` (household_id, household_mean), else from the panel.

    The priors have one row for each cluster and weekday or month and are broadcast.
    """
    rows = calendar_features(lag_features(panel))
    if means is None:
        rows = rows.withColumn("household_mean", F.avg(V).over(Window.partitionBy(ID)))
    else:
        rows = rows.join(means, ID, "left")
    rows = rows.join(labels.select(ID, CLUSTER), ID, "left")
    rows = rows.join(F.broadcast(priors[0]), [CLUSTER, "day_of_week"], "left").join(F.broadcast(priors[1]), [CLUSTER, "month"], "left")
    return rows.withColumns({"household_minus_cluster_dow_mean": F.col("household_mean") - F.col("cluster_dow_mean"), "household_minus_cluster_month_mean": F.col("household_mean") - F.col("cluster_month_mean")})


def training_rows(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """household_id, date, consumption, cluster and the features of labelled households on days with all lags."""
    known = panel.join(labels.select(ID), ID, "left_semi")
    rows = build_features(known, labels, cluster_priors(known, labels))
    return rows.dropna(subset=[f"lag_{k}" for k in LAGS]).select(ID, DAY, V, CLUSTER, *FEATURES)


def point_params() -> dict:
    """Parameters of the point model: trees, step, leaves, smallest leaf, shares of rows and features."""
    return {"n_estimators": 500, "learning_rate": 0.05, "num_leaves": 63, "min_child_samples": 20, "subsample": 0.8, "colsample": 0.8}


def candidates() -> list[dict]:
    """The tuning grid; shares of rows and features are those of the point model."""
    return [point_params() | dict(zip(("n_estimators", "learning_rate", "num_leaves", "min_child_samples"), values)) for values in GRID]


def backtest_splits(days: DataFrame, n_splits: int = 3, validation_days: int = 28, history: int = 30) -> DataFrame:
    """split, val_start, val_end: the last blocks of the distinct dates; none for too few dates."""
    each = days.select(DAY).distinct()
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    back = each.withColumn("_back", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(DAY))) - 1).withColumn("_n", n)
    back = back.filter((F.col("_n") >= validation_days + history) & (F.col("_back") < n_splits * validation_days))
    block = F.floor(F.col("_back") / validation_days)
    out = back.groupBy((n_splits - block).cast("int").alias("split")).agg(F.min(DAY).alias("val_start"), F.max(DAY).alias("val_end"), F.count("*").alias("_k"), F.min("_n").alias("_n"))
    return out.filter((F.col("_k") == validation_days) & (F.col("_n") - (n_splits + 1 - F.col("split")) * validation_days >= history)).select("split", "val_start", "val_end")


def _filled(rows: DataFrame) -> DataFrame:
    """Trees take no nulls: an absent prior is the household's mean, all else 0."""
    mean = F.coalesce("household_mean", F.lit(0.0))
    fills = {c: F.coalesce(F.col(c), mean) for c in ("cluster_dow_mean", "cluster_month_mean")}
    rows = rows.withColumns(fills)
    rows = rows.withColumns({"household_minus_cluster_dow_mean": mean - F.col("cluster_dow_mean"), "household_minus_cluster_month_mean": mean - F.col("cluster_month_mean")})
    return rows.fillna(0.0, subset=[c for c in FEATURES if c not in fills])


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_filled(rows))


def fit_trees(rows: DataFrame, params: dict, seed: int = 42) -> GBTRegressionModel:
    """Boosted trees with absolute loss on training rows; a leaf count becomes a depth."""
    depth = max(1, round(math.log2(params["num_leaves"] + 1)))
    learner = GBTRegressor(
        labelCol=V,
        lossType="absolute",
        maxIter=params["n_estimators"],
        stepSize=params["learning_rate"],
        maxDepth=depth,
        minInstancesPerNode=params["min_child_samples"],
        subsamplingRate=params["subsample"],
        featureSubsetStrategy=str(params["colsample"]),
        seed=seed,
    )
    return learner.fit(_vectors(rows).select("features", V).filter(F.col(V).isNotNull()))


def predicted(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    """The rows with `predicted`, never under 0."""
    return model.transform(_vectors(rows)).withColumn("predicted", F.greatest("prediction", F.lit(0.0))).drop("features", "prediction")


def mae(rows: DataFrame, actual: str = V, forecast: str = "predicted") -> DataFrame:
    return rows.agg(F.avg(F.abs(F.col(actual) - F.col(forecast))).alias("mae"))


def backtest(rows: DataFrame, grid: list[dict] | None = None, n_splits: int = 3, validation_days: int = 28, seed: int = 42) -> list[dict]:
    """One dict for each candidate, best first: mean error over rolling origins and its parameters.

    Each split trains on days before its block only.  Without a split the
    first candidate is returned with no error.
    """
    grid = candidates() if grid is None else grid
    splits = backtest_splits(rows, n_splits, validation_days).orderBy("split").collect()
    out = []
    for i, params in enumerate(grid):
        errors = []
        for s in splits:
            train = rows.filter(F.col(DAY) < F.lit(s["val_start"]))
            if train.limit(1).collect():
                held = rows.filter(F.col(DAY).between(F.lit(s["val_start"]), F.lit(s["val_end"])))
                errors.append(mae(predicted(fit_trees(train, params, seed), held)).first()["mae"])
        if errors:
            out.append({"candidate_id": i, "mean_mae": float(np.mean(errors)), "n_successful_splits": len(errors), **params})
    if not out:
        return [{"candidate_id": 0, "mean_mae": None, "n_successful_splits": 0, **grid[0]}]
    return sorted(out, key=lambda r: (r["mean_mae"], -r["n_successful_splits"], r["candidate_id"]))


def cluster_models(rows: DataFrame, params: dict[int, dict] | dict, seed: int = 42) -> dict[int, GBTRegressionModel]:
    """One model for each cluster of the rows; `params` by cluster, or the same for all."""
    numbers = sorted(r[0] for r in rows.select(CLUSTER).filter("cluster is not null").distinct().collect())
    of = lambda c: params[c] if c in params else params
    with ThreadPoolExecutor(4) as pool:  # the fits are independent jobs
        return dict(zip(numbers, pool.map(lambda c: fit_trees(rows.filter(F.col(CLUSTER) == c), of(c), seed), numbers)))


@dataclass
class Trees:
    """The nodes of a boosted model as flat arrays, to predict without a JVM."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            while True:
                inner = self.left[at] >= 0
                if not inner.any():
                    break
                go = np.where(x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, go, at)
            total += weight * self.value[at]
        return total


def export_trees(model: GBTRegressionModel) -> Trees:
    """Walks the model's nodes over the driver's gateway."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(node) -> int:
        at = len(value)
        for a, x in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
            a.append(x)
        value.append(node.prediction())
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[at], threshold[at] = split.featureIndex(), split.threshold()
            left[at] = add(node.leftChild())
            right[at] = add(node.rightChild())
        return at

    for tree in model.trees:
        roots.append(add(tree._call_java("rootNode")))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value, float), np.array(roots), np.array(model.treeWeights))


def recursive_forecast(
    train: DataFrame, labels: DataFrame, models: dict[int, Trees], fallback: Trees, start: str, days: int = HORIZON, buckets: int | None = None
) -> DataFrame:
    """household_id, date, predicted, cluster, model_used for `days` days from `start`.

    Each day's lags and rolling values come from the training readings and
    the forecasts before it; priors and means from the training data only.
    Households are independent, so buckets of some `BUCKET` of them run side
    by side, each vectorised over its households.  A short history gives lag and rolling
    values of 0; a label without a model and not among the labels of models
    is cluster -99 with the global model.
    """
    spark = train.sparkSession
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-labels.count() // BUCKET))
    dow, month = cluster_priors(train, labels)
    dow_of = {(r[CLUSTER], r["day_of_week"]): r["cluster_dow_mean"] for r in dow.collect()}
    month_of = {(r[CLUSTER], r["month"]): r["cluster_month_mean"] for r in month.collect()}
    first = date.fromisoformat(start)
    known = set(models) | {c for c, _ in dow_of}
    history = (
        labels.select(ID, CLUSTER)
        .join(train.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct(DAY, V))).alias("h"), F.avg(V).alias("m")), ID, "left")
        .select(ID, CLUSTER, F.coalesce(F.slice(F.transform("h", lambda s: s[V]), F.greatest(F.size("h") - 29, F.lit(1)), 30), F.array().cast("array<double>")).alias("tail"), F.coalesce("m", F.lit(0.0)).alias("m"))
        .withColumn("bucket", F.pmod(F.xxhash64(ID), F.lit(buckets)))
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, part in frame.groupby(CLUSTER, sort=True):
            c = int(c)
            mapped = c in known
            trees, used = (models.get(c, fallback), "cluster_lgbm") if mapped else (fallback, "global_fallback")
            n = len(part)
            hist = np.full((n, 30 + days), np.nan)
            for i, tail in enumerate(part["tail"]):
                tail = np.asarray(tail, float)
                if len(tail):
                    hist[i, 30 - len(tail) : 30] = tail
            mean = part["m"].to_numpy(float)
            for t in range(days):
                day = first + timedelta(days=t)
                now = 30 + t
                lags = [np.nan_to_num(hist[:, now - k]) for k in LAGS]
                rolls = []
                for w in WINDOWS:
                    past = hist[:, now - w : now]
                    count = (~np.isnan(past)).sum(axis=1)
                    mu = np.nansum(past, axis=1) / np.maximum(count, 1)
                    sd = np.sqrt(np.nansum((past - mu[:, None]) ** 2, axis=1) / np.maximum(count - 1, 1))
                    rolls += [mu, np.where(count > 1, sd, 0.0)]
                doy, week = day.timetuple().tm_yday, day.isocalendar()[1]
                fixed = [day.weekday(), day.month, doy, float(day.weekday() >= 5), week]
                fixed += [f(2 * math.pi * a / b) for a, b in ((doy, 366), (week, 53)) for f in (math.sin, math.cos)]
                pd_, pm = dow_of.get((c, day.weekday())), month_of.get((c, day.month))
                pd_ = mean if pd_ is None else np.full(n, pd_)
                pm = mean if pm is None else np.full(n, pm)
                x = np.column_stack([*lags, *rolls, *[np.full(n, v) for v in fixed], mean, pd_, pm, mean - pd_, mean - pm])
                y = np.maximum(trees.predict(x), 0.0)
                hist[:, now] = y
                out.append(pd.DataFrame({ID: part[ID].to_numpy(), DAY: day, "predicted": y, CLUSTER: np.int32(c if mapped else -99), "model_used": used}))
        return pd.concat(out, ignore_index=True)

    return history.groupBy("bucket").applyInPandas(run, f"{ID} long, {DAY} date, predicted double, {CLUSTER} int, model_used string")


def routed(labels: DataFrame, with_model: list[int], all_regular: list[int], global_run: bool = False) -> DataFrame:
    """household_id, cluster, model_used: which model a household's label leads to."""
    c = F.col(CLUSTER)
    known = F.coalesce(c.isin(*with_model, *all_regular), F.lit(False))
    used = F.lit("global_lgbm") if global_run else F.when(known, "cluster_lgbm").otherwise("global_fallback")
    return labels.select(ID, F.when(known, c).otherwise(-99).cast("int").alias(CLUSTER), used.alias("model_used"))


def naive_forecast(train: DataFrame, test_days: DataFrame, lag: int = 7) -> DataFrame:
    """household_id, date, predicted: the last `lag` training days over and over; the baseline."""
    last = train.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct(DAY, V))).alias("h")).select(ID, F.slice("h", -lag, lag).alias("h"))
    days = test_days.select(DAY).distinct().withColumn("_i", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(DAY)) - 1) % lag + 1)
    return last.crossJoin(F.broadcast(days)).select(ID, DAY, F.greatest(F.coalesce(F.element_at("h", F.col("_i"))[V], F.lit(0.0)), F.lit(0.0)).alias("predicted"))


def residual_quantiles(rows: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """cluster, month and the residual at each quantile of validation rows with `predicted`."""
    rest = F.col(V) - F.col("predicted")
    return rows.groupBy(CLUSTER, F.month(DAY).alias("month")).agg(*[F.percentile(rest, q).alias(f"r{round(100 * q)}") for q in quantiles])


def quantile_forecast(forecast: DataFrame, residuals: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Point forecasts moved by the residual quantiles of their cluster and month, never under 0."""
    names = [f"r{round(100 * q)}" for q in quantiles]
    each = forecast.withColumn("month", F.month(DAY)).join(F.broadcast(residuals), [CLUSTER, "month"], "left")
    return each.select(ID, DAY, *[F.greatest(F.col("predicted") + F.coalesce(n, F.lit(0.0)), F.lit(0.0)).alias(n.replace("r", "q", 1)) for n in names])


def household_mae(forecast: DataFrame, actual: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """household_id, mae, n_days_compared, complete_horizon_flag over days that both sides have.

    Both sides are panels and neither is broadcast, however small Spark takes
    a generated one to be.
    """
    met = forecast.select(ID, DAY, "predicted").join(actual.select(ID, DAY, V).hint("merge"), [ID, DAY])
    each = met.groupBy(ID).agg(F.avg(F.abs(F.col(V) - F.col("predicted"))).alias("mae"), F.count("*").alias("n_days_compared"))
    return each.withColumn("complete_horizon_flag", F.col("n_days_compared") == horizon)


def require_unique(rows: DataFrame) -> None:
    """Raises if a household has a day twice."""
    if rows.groupBy(ID, DAY).count().filter("count > 1").limit(1).collect():
        raise PanelError("a household has a day twice")


def evaluation_summary(errors: DataFrame, method: str, horizon: int = HORIZON) -> DataFrame:
    return errors.agg(
        F.count("*").alias("n_households_evaluated"),
        F.count_if("complete_horizon_flag").alias("n_households_complete"),
        F.avg("mae").alias("average_household_mae"),
        F.median("mae").alias("median_household_mae"),
    ).select(F.lit(method).alias("method"), "n_households_evaluated", F.lit(horizon).cast("long").alias("expected_days_per_household"), "n_households_complete", "average_household_mae", "median_household_mae")


def save_models(models: dict[int, GBTRegressionModel], fallback: GBTRegressionModel, folder: str) -> None:
    """One model folder for each cluster and one for all."""
    for c, m in models.items():
        m.write().overwrite().save(f"{folder}/point_cluster_{c}")
    fallback.write().overwrite().save(f"{folder}/point_global")


def load_model(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def save_residuals(residuals: DataFrame, folder: str) -> None:
    residuals.write.mode("overwrite").parquet(f"{folder}/quantile_residuals")


def top_importances(model: GBTRegressionModel, n: int = 12) -> list[tuple[str, float]]:
    pairs = zip(FEATURES, model.featureImportances.toArray().tolist())
    return sorted(pairs, key=lambda p: (-p[1], p[0]))[:n]


def params_row(spark: SparkSession, results: list[dict], scope: str) -> DataFrame:
    """A backtest table with its scope."""
    rows = [(r["candidate_id"], r["mean_mae"], r["n_successful_splits"], json.dumps({k: v for k, v in r.items() if k not in ("candidate_id", "mean_mae", "n_successful_splits")}, sort_keys=True), scope) for r in results]
    return spark.createDataFrame(rows, "candidate_id int, mean_mae double, n_successful_splits int, params string, scope string")
