"""Forecasting runs and their command line.

    spark-submit -m panelforge.plans.forecasting --train 2023.csv --test 2024.csv --labels handoff --out results --method all
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.storage import cut
from panelforge.operators import comparison, forecast
from panelforge.operators.cleaning import DAY, ID
from panelforge.sources import panel as source

#: The number of clusters that each method's hand-off has.
FIXED_K = {"feature_ward": 3, "kshape": 2}


@dataclass
class Run:
    """What one method's run made."""

    method: str
    predictions: DataFrame
    errors: DataFrame
    summary: DataFrame
    backtest: DataFrame
    models: dict


def run_method(
    train: DataFrame, test: DataFrame, labels: DataFrame, method: str, *, grid: list[dict] | None = None, n_splits: int = 3, validation_days: int = 28, horizon: int | None = None
) -> Run:
    """Tune, fit a model for each cluster and one for all, forecast the test days from training data alone, evaluate.

    With method "global" all households share label 0.  Test readings are
    used in the evaluation only.
    """
    labels = labels.join(train.select(ID).distinct(), ID, "left_semi")
    if method == "global":
        labels = labels.select(ID, F.lit(0).alias("cluster"))
    source.check_assignments(labels)
    rows = cut(forecast.training_rows(train, labels))
    spark = train.sparkSession
    clusters = sorted(r[0] for r in labels.select("cluster").distinct().collect())
    tables, best = [], {}
    for c in [] if method == "global" else clusters:
        results = forecast.backtest(rows.filter(F.col("cluster") == c), grid, n_splits, validation_days)
        tables.append(forecast.params_row(spark, results, f"cluster_{c}"))
        best[c] = {k: v for k, v in results[0].items() if k not in ("candidate_id", "mean_mae", "n_successful_splits")}
    results = forecast.backtest(rows, grid, n_splits, validation_days)
    tables.append(forecast.params_row(spark, results, "global"))
    overall = {k: v for k, v in results[0].items() if k not in ("candidate_id", "mean_mae", "n_successful_splits")}
    fallback = forecast.fit_trees(rows, overall)
    models = {0: fallback} if method == "global" else forecast.cluster_models(rows, best)
    days = test.agg(F.min(DAY).alias("a"), F.max(DAY).alias("b")).first()
    steps = horizon or (days["b"] - days["a"]).days + 1
    trees = {c: forecast.export_trees(m) for c, m in models.items()}
    out = forecast.recursive_forecast(train, labels, trees, forecast.export_trees(fallback), days["a"].isoformat(), steps)
    if method == "global":
        out = out.withColumn("model_used", F.lit("global_lgbm"))
    errors = forecast.household_mae(out, test, steps)
    return Run(method, out, errors, forecast.evaluation_summary(errors, method, steps), comparison.backtest_union(*tables), {**models, "global": fallback})


def save(run: Run, folder: str, models: bool = True) -> None:
    """Predictions as Parquet, small tables as CSV, models in folders."""
    source.write_table(run.predictions, f"{folder}/predictions/{run.method}")
    for name, df in (("household_mae", run.errors), ("summary", run.summary), ("backtest", run.backtest)):
        source.write_table(df, f"{folder}/evaluation/{name}_{run.method}", "csv")
    if models:
        forecast.save_models({k: v for k, v in run.models.items() if k != "global"}, run.models["global"], f"{folder}/models/{run.method}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Forecast the test year and evaluate it.")
    parser.add_argument("--train", required=True)
    parser.add_argument("--test", required=True)
    parser.add_argument("--labels", required=True, help="folder of hand-off files")
    parser.add_argument("--out", required=True)
    parser.add_argument("--method", choices=[*FIXED_K, "global", "all"], default="all")
    parser.add_argument("--no-save-models", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("panel-forecast").getOrCreate()
    train = source.read_wide_csv(spark, args.train, days=365, start="2023-01-01", end="2023-12-31").cache()
    test = source.read_wide_csv(spark, args.test, days=366, start="2024-01-01", end="2024-12-31")
    source.require_same_ids(train, test)
    for method in [*FIXED_K, "global"] if args.method == "all" else [args.method]:
        if method == "global":
            labels = train.select(ID, F.lit(0).alias("cluster")).distinct()
        else:
            labels = source.read_assignments(spark, f"{args.labels}/{source.handoff_name(method, FIXED_K[method])}")
        save(run_method(train, test, labels, method), args.out, not args.no_save_models)


if __name__ == "__main__":
    main()
