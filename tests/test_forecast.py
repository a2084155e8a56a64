"""Forecast features, models, recursion and evaluation."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import comparison, forecast as fc
from panelforge.plans import forecasting
from panelforge.sources import panel as pn

TINY = {"n_estimators": 5, "learning_rate": 0.3, "num_leaves": 7, "min_child_samples": 2, "subsample": 1.0, "colsample": 1.0}


def panel(spark, n=120, ids=range(6), start=date(2023, 1, 1)):
    rng = np.random.default_rng(0)
    rows = [(i, start + timedelta(days=t), float(5 + i + 3 * ((start + timedelta(days=t)).weekday() >= 5) + rng.normal(0, 0.2))) for i in ids for t in range(n)]
    return spark.createDataFrame(rows, pn.SCHEMA)


def given(spark, ids=range(6)):
    return spark.createDataFrame([(i, i % 2) for i in ids], "household_id long, cluster int")


def test_rolling_warm_up(spark):
    p = spark.createDataFrame([(0, date(2023, 1, 1) + timedelta(days=t), v) for t, v in enumerate([1.0, 2.0, 4.0, 8.0])], pn.SCHEMA)
    rows = fc.lag_features(p).orderBy("date").collect()
    assert rows[0]["rolling_mean_7"] is None and [r["rolling_std_7"] for r in rows][:2] == [0, 0]
    assert [round(r["rolling_std_7"], 4) for r in rows][2:] == [0.7071, 1.5275]


def test_only_full_histories_train(spark):
    rows = fc.training_rows(panel(spark, 31), given(spark))
    assert rows.count() == 6 and rows.columns[4:] == list(fc.FEATURES) and len(fc.FEATURES) == 24


def test_iso_weeks(spark):
    p = spark.createDataFrame([(0, date(2023, 1, 1), 1.0), (0, date(2024, 12, 31), 1.0)], pn.SCHEMA)
    assert [r["week_of_year"] for r in fc.calendar_features(p).orderBy("date").collect()] == [52, 1]


def test_backtest_splits(spark):
    days = [tuple(r) for r in fc.backtest_splits(panel(spark, 120, [0])).orderBy("split").collect()]
    last = date(2023, 1, 1) + timedelta(days=119)
    assert days == [(k, last - timedelta(days=28 * (4 - k) - 1), last - timedelta(days=28 * (3 - k))) for k in (1, 2, 3)]
    assert fc.backtest_splits(panel(spark, 57, [0])).count() == 0
    assert fc.backtest(fc.training_rows(panel(spark, 57, [0]), given(spark)), [TINY])[0]["mean_mae"] is None


def test_exported_trees_agree_with_the_model(spark):
    rows = fc.training_rows(panel(spark), given(spark))
    model = fc.fit_trees(rows, TINY)
    done = fc.predicted(model, rows).select(*fc.FEATURES, "predicted").toPandas()
    got = np.maximum(fc.export_trees(model).predict(done[list(fc.FEATURES)].to_numpy(float)), 0)
    assert np.abs(got - done["predicted"].to_numpy()).max() < 1e-9


def test_recursive_forecast_uses_no_test_data(spark):
    train, labels = panel(spark), given(spark)
    start = date(2023, 1, 1) + timedelta(days=120)
    test = panel(spark, 30, start=start)
    run = forecasting.run_method(train, test, labels, "feature_ward", grid=[TINY], n_splits=1, validation_days=14)
    got = {(r["household_id"], r["date"]): r["predicted"] for r in run.predictions.collect()}
    assert len(got) == 180 and min(got.values()) >= 0
    changed = forecasting.run_method(train, test.withColumn("consumption", F.col("consumption") * 100), labels, "feature_ward", grid=[TINY], n_splits=1, validation_days=14)
    again = {(r["household_id"], r["date"]): r["predicted"] for r in changed.predictions.collect()}
    assert got == again
    row = run.summary.first()
    assert row["n_households_evaluated"] == row["n_households_complete"] == 6 and row["average_household_mae"] < 1.5
    assert set(r["scope"] for r in run.backtest.collect()) == {"cluster_0", "cluster_1", "global"}


def test_short_and_unknown_households(spark):
    train = panel(spark, 60, [0, 1])
    labels = spark.createDataFrame([(0, 0), (1, 0), (7, 0), (8, 5)], "household_id long, cluster int")
    trees = fc.export_trees(fc.fit_trees(fc.training_rows(train, labels), TINY))
    rows = fc.recursive_forecast(train, labels, {0: trees}, trees, "2023-03-02", 3).collect()
    by = {r["household_id"]: r for r in rows}
    assert by[8]["cluster"] == -99 and by[8]["model_used"] == "global_fallback" and by[7]["model_used"] == "cluster_lgbm"
    assert all(math.isfinite(r["predicted"]) for r in rows) and len(rows) == 12


def test_evaluation_and_comparison(spark):
    rows = spark.createDataFrame([(0, date(2024, 1, d), 1.0 * d) for d in (1, 2)] + [(1, date(2024, 1, 1), 5.0)], "household_id long, date date, predicted double")
    actual = spark.createDataFrame([(0, date(2024, 1, d), 3.0) for d in (1, 2, 3)] + [(1, date(2024, 1, 1), 4.0)], pn.SCHEMA)
    errors = fc.household_mae(rows, actual, 2)
    assert {tuple(r) for r in errors.collect()} == {(0, 1.5, 2, True), (1, 1.0, 1, False)}
    both = errors.withColumn("method", F.lit("a")).unionByName(errors.withColumn("mae", F.col("mae") * 2).withColumn("method", F.lit("b")))
    wins = {(r["method_a"], r["method_b"]): r["win_rate"] for r in comparison.win_rates(both).collect()}
    assert wins == {("a", "b"): 1.0, ("b", "a"): 0.0}
    assert [r["share"] for r in comparison.error_ecdf(both).filter("method = 'a'").orderBy("share").collect()] == [0.5, 1.0]
    with pytest.raises(pn.PanelError):
        fc.require_unique(rows.unionByName(rows))


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = fc.training_rows(panel(spark), given(spark))
    model = fc.fit_trees(rows, TINY)
    fc.save_models({0: model}, model, str(tmp_path))
    assert fc.load_model(f"{tmp_path}/point_cluster_0").numFeatures == 24
    assert len(fc.top_importances(model, 5)) == 5
    done = fc.predicted(model, rows)
    q = fc.quantile_forecast(done.select("household_id", "date", "cluster", "predicted"), fc.residual_quantiles(done)).toPandas()
    assert ((q["q10"] <= q["q50"]) & (q["q50"] <= q["q90"])).all()


def test_a_run_is_saved_and_read_back(spark, tmp_path):
    train, test = panel(spark), panel(spark, 10, start=date(2023, 1, 1) + timedelta(days=120))
    run = forecasting.run_method(train, test, given(spark), "global", grid=[TINY], n_splits=1, validation_days=14)
    forecasting.save(run, str(tmp_path))
    again = spark.read.parquet(f"{tmp_path}/predictions/global")
    assert sorted(map(str, again.select(*run.predictions.columns).collect())) == sorted(map(str, run.predictions.collect()))
    table = spark.read.csv(f"{tmp_path}/evaluation/household_mae_global", header=True, inferSchema=True)
    assert {r["household_id"]: r["mae"] for r in table.collect()} == pytest.approx({r["household_id"]: r["mae"] for r in run.errors.collect()})
    assert fc.load_model(f"{tmp_path}/models/global/point_global").getNumTrees == TINY["n_estimators"]


def test_streaming_panel(spark, tmp_path):
    from panelforge.streaming import ingest

    events = spark.createDataFrame([(1, "2024-01-01 05:00:00", 2.0), (1, "2024-01-01 06:00:00", 3.0), (2, "2024-01-09 00:00:00", 1.0)], "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = ingest.daily_panel(ingest.event_stream(spark, str(tmp_path / "in"), events.schema))
    ingest.write_panel(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert (1, date(2024, 1, 1), 5.0) in {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
