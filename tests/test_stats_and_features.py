"""Traps of statistics and features on hand-made series."""

import math
from datetime import date, timedelta

import numpy as np
import pytest

from panelforge.operators import features as ft
from panelforge.operators import selection as se
from panelforge.operators import stats as st
from panelforge.sources import panel as pn


def year(spark, f, n=365, start=date(2023, 1, 1), ids=(0,)):
    days = [start + timedelta(days=t) for t in range(n)]
    return spark.createDataFrame([(i, d, float(f(i, t, d))) for i in ids for t, d in enumerate(days)], pn.SCHEMA)


def test_constant_series_have_defined_diagnostics(spark):
    p = year(spark, lambda i, t, d: 3)
    row = st.household_diagnostics(p).first()
    assert row["autocorr_lag_7"] is None and row["trend_slope_normalized"] == 0 and row["skew"] is None
    assert row["peak_month_eda"] == 1 and row["regime_label"] == "near_constant"
    assert st.trends(p).first()["r_squared"] == 0


def test_weekly_pattern(spark):
    p = year(spark, lambda i, t, d: 10 if d.weekday() >= 5 else 1)
    row = ft.weekly_features(p).first()
    assert row["autocorr_lag_7"] == pytest.approx(1) and row["weekday_range"] == 9
    assert row["weekend_weekday_contrast"] == pytest.approx(9 / (11 + 1e-6)) and row["weekend_share"] == pytest.approx(20 / (25 + 1e-6))


def test_peak_month_takes_the_first_of_equals(spark):
    p = year(spark, lambda i, t, d: 5 if d.month in (3, 8) else 1)
    assert st.peak_months(p).first()["peak_month"] == 3


def test_trend_and_p_value(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 1, 60)
    p = year(spark, lambda i, t, d: 0.05 * t + noise[t], n=60)
    row = st.trend_p_values(st.trends(p)).first()
    y, x = 0.05 * np.arange(60) + noise, np.arange(60)
    r = np.corrcoef(x, y)[0, 1]
    assert row["trend_slope"] == pytest.approx(np.polyfit(x, y, 1)[0])
    t = abs(r) * math.sqrt(58 / (1 - r * r))
    grid = np.linspace(t, 200, 2_000_001)
    density = math.exp(math.lgamma(29.5) - math.lgamma(29)) / math.sqrt(58 * math.pi) * (1 + grid**2 / 58) ** -29.5
    assert row["p_value"] == pytest.approx(2 * float(((density[1:] + density[:-1]) / 2).sum() * (grid[1] - grid[0])), rel=1e-4)


def test_full_windows_only(spark):
    p = year(spark, lambda i, t, d: t % 5, n=10)
    v = np.arange(10) % 5
    want = np.mean([np.std(v[i - 6 : i + 1], ddof=1) for i in range(6, 10)])
    row = ft.persistence_features(p).first()
    assert row["rolling_std_7"] == pytest.approx(want) and row["rolling_std_30"] is None


def test_ward_features_are_29(spark):
    p = year(spark, lambda i, t, d: 5 + i * math.sin(t / 9) + (t % 7), ids=(1, 2, 3))
    row = ft.ward_features(p)
    assert len(row.columns) == 30 and sum(n for _, n in ft.block_sizes()) == 29
    assert len(ft.shape_features(p).columns) == 45 and len(ft.energy_features(p).columns) == 12


def test_pruning_is_greedy_and_ordered():
    c = np.array([[1, 0.95, 0.1], [0.95, 1, 0.92], [0.1, 0.92, 1]])
    assert se.prune_correlated(list("abc"), c, set()) == (["a", "c"], ["b"])
    assert se.prune_correlated(list("abc"), c, {"b"}) == (["b"], ["a", "c"])
    assert se.prune_correlated(list("abc"), c, {"a", "b", "c"}) == (["a", "b", "c"], [])
    tie = np.array([[1, 0.95], [0.95, 1]])
    assert se.prune_correlated(list("ab"), tie, set()) == (["b"], ["a"])


def test_selection_fits_and_transforms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (40, 3))
    rows = [(i, float(a), float(a + 1e-3 * b), float(c), 7.0, float("inf") if i == 3 else float(b)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "household_id long, a double, a2 double, c double, flat double, b double")
    blocks = {"one": ("a", "a2", "flat"), "two": ("c", "b")}
    fitted = se.fit_selection(df, blocks, {"one": 2.0}, set())
    assert fitted.dropped_variance == ["flat"] and len(fitted.dropped_correlation) == 1
    done = np.array([[r[k] for k in fitted.columns] for r in fitted.transform(df).orderBy("household_id").collect()])
    assert done.std(axis=0) == pytest.approx([fitted.factors[k] for k in fitted.columns]) and fitted.factors["c"] == pytest.approx(1 / math.sqrt(2))
    with pytest.raises(se.SelectionError):
        fitted.transform(df.drop("c"))
    with pytest.raises(se.SelectionError):
        se.fit_selection(df.select("household_id", "flat"), blocks, {}, set())
    reduced = se.fit_selection(df, blocks, {}, set(), use_pca=True)
    pcs = reduced.transform(df).toPandas().drop(columns="household_id").to_numpy()
    assert np.abs(np.corrcoef(pcs.T) - np.eye(pcs.shape[1])).max() < 1e-6


def test_equal_months_tie_to_the_first(spark):
    # February and October are both empty: their standardised means are equal but for their last bits.
    rows = [(i, d, 0.0 if d.month in (2, 10) else 1.0 + (d.toordinal() * (7 + i)) % 13 / 3) for i in range(6) for d in (date(2023, 1, 1) + timedelta(days=k) for k in range(365))]
    df = spark.createDataFrame(rows, pn.SCHEMA)
    for n in (1, 3, 16):
        for r in ft.shape_features(df.repartition(n)).collect():
            assert (r["norm_trough_month_sin"], r["norm_trough_month_cos"]) == pytest.approx((math.sin(2 * math.pi * 2 / 12), math.cos(2 * math.pi * 2 / 12)))
        assert all(r["trough_month_sin"] == pytest.approx(math.sin(2 * math.pi * 2 / 12)) for r in ft.energy_features(df.repartition(n)).collect())
