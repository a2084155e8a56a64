"""Repair, normalisation and regimes on hand-made series."""

import math
from datetime import date, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.operators import cleaning as cl
from panelforge.plans import preparation
from panelforge.sources import panel as pn

START = date(2023, 1, 1)


def panel(spark, *series):
    rows = [(i, START + timedelta(days=t), v) for i, s in enumerate(series) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, pn.SCHEMA)


def values(df, i=0):
    return [r["consumption"] for r in df.filter(f"household_id = {i}").orderBy("date").collect()]


def test_interpolation_by_position(spark):
    got = cl.impute(panel(spark, [None, 1.0, None, None, 4.0, None], [None, None]), "interpolate")
    assert values(got) == [1, 1, 2, 3, 4, 4] and values(got, 1) == [None, None]


def test_interpolation_equals_pandas(spark):
    import random

    r = random.Random(1)
    series = [[None if r.random() < 0.4 else round(r.random() * 9, 3) for _ in range(40)] for _ in range(10)]
    got = cl.impute(panel(spark, *series), "interpolate")
    for i, s in enumerate(series):
        want = pd.Series(s, dtype=float).interpolate("linear").bfill()
        assert values(got, i) == pytest.approx(want.tolist())


def test_other_strategies(spark):
    p = panel(spark, [None, 1.0, None, 4.0])
    assert values(cl.impute(p, "forward_fill")) == [1, 1, 1, 4]
    assert values(cl.impute(p, "mean")) == [2.5, 1, 2.5, 4]
    for bad in ("drop", "guess"):
        with pytest.raises(pn.PanelError):
            cl.impute(p, bad)


def test_negatives(spark):
    p = panel(spark, [-1.0, 2.0, None])
    assert values(cl.fix_negatives(p, "set_zero")) == [0, 2, None]
    assert values(cl.fix_negatives(p, "abs")) == [1, 2, None]
    assert values(cl.fix_negatives(p, "remove")) == [2, 2, 2]
    with pytest.raises(pn.PanelError):
        cl.fix_negatives(p, "ignore")


def test_z_rows(spark):
    z = cl.z_rows(panel(spark, [1.0, 2.0, 3.0, None], [5.0, 5.0, 5.0, 5.0]))
    v = values(z)
    assert v[3] is None and sum(v[:3]) == pytest.approx(0) and v[2] == pytest.approx(math.sqrt(1.5), rel=1e-6)
    assert values(z, 1) == [0, 0, 0, 0]


def test_regimes_and_boundaries(spark):
    p = panel(spark, [0.0] * 8, [1.0] * 7 + [1.1], [0.0] * 6 + [3.0, 4.0], [0.0] * 5 + [3.0, 4.0, 5.0], [None] * 8)
    flags = {r["household_id"]: r for r in cl.regime_flags(p).collect()}
    assert [flags[i]["regime_label"] for i in range(5)] == ["all_zero", "near_constant", "zero_heavy", "regular", "all_zero"]
    assert all(sum(r[f] for f in ("all_zero_flag", "near_constant_flag", "zero_heavy_flag")) == int(r["degenerate_flag"]) for r in flags.values())
    regular, out = cl.split_regular(p, cl.regime_flags(p), exclude_zero_heavy=False)
    assert {r[0] for r in regular.select("household_id").distinct().collect()} == {2, 3}
    assert {r[0] for r in out.select("household_id").distinct().collect()} == {0, 1, 4}


def test_preparation(spark):
    done = preparation.for_kshape(panel(spark, [0.0] * 8, [-1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]))
    assert {r[0] for r in done.regular.select("household_id").distinct().collect()} == {1}
    assert sum(values(done.regular, 1)) == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        preparation.for_method(done.regular, "dtw")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-5, 50, allow_nan=False)), min_size=2, max_size=30))
def test_interpolation_leaves_no_gap(spark, s):
    got = values(cl.impute(panel(spark, s), "interpolate"))
    assert len(got) == len(s) and (all(v is None for v in got) if all(v is None for v in s) else all(v is not None for v in got))


def test_date_axis_and_alignment(spark):
    names = [(START + timedelta(days=i)).isoformat() for i in range(3)]
    ok = {"days": 3, "start": "2023-01-01", "end": "2023-01-03"}
    assert len(pn.check_dates(names, **ok)) == 3
    for bad in (names[:2], names[::-1], [names[0], names[0], names[2]], ["x", *names[1:]], [*names[:2], "2023-01-04"]):
        with pytest.raises(pn.PanelError):
            pn.check_dates(bad, **ok)
    a, b = panel(spark, [1.0], [1.0]), panel(spark, [1.0])
    with pytest.raises(pn.PanelError):
        pn.require_same_ids(a, b)
    pn.require_same_ids(a, a)


def test_wide_csv_round_trip(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,2023-01-01,2023-01-02\n7,1.5,\n8,2,NaN\n")
    got = pn.read_wide_csv(spark, str(tmp_path / "w.csv"), days=2, start="2023-01-01", end="2023-01-02")
    assert {(r[0], r[1].day): r[2] for r in got.collect()} == {(7, 1): 1.5, (7, 2): None, (8, 1): 2.0, (8, 2): None}
    (tmp_path / "d.csv").write_text("id,2023-01-01,2023-01-02\n7,1,2\n7,2,3\n")
    with pytest.raises(pn.PanelError):
        pn.read_wide_csv(spark, str(tmp_path / "d.csv"), days=2, start="2023-01-01", end="2023-01-02")


def test_assignments_are_checked(spark, tmp_path):
    for name, body, good in (("a", "household_id,cluster\n1,0\n2,1\n", True), ("b", "household_id,cluster\n1,-1\n", False), ("c", "household_id,cluster\n1,x\n", False), ("d", "id,cluster\n1,0\n", False)):
        (tmp_path / f"{name}.csv").write_text(body)
        if good:
            assert pn.read_assignments(spark, str(tmp_path / f"{name}.csv")).count() == 2
        else:
            with pytest.raises(pn.PanelError):
                pn.read_assignments(spark, str(tmp_path / f"{name}.csv"))
    assert pn.handoff_name("kshape", 2) == "kshape_k2_forecasting_handoff.csv"
